"""WARC archives in the shared folder with an index table: write, select, and read back by coalesced byte ranges.

Writing gives the index: archive, offset, length, URL and digest of every record, staged before anything is read. Reading
takes index rows, sorts them by archive and offset, and fetches neighbours that lie within GAP bytes in one ranged read of
up to READ_BYTES. Archives are .warc.gz files, one gzip member a record, of some ARCHIVE_BYTES under a name of their own, so
a task that runs again leaves at most an archive that no index row names.
Of equal payloads the one with the smallest page_id is the response and later ones are revisits of it; null page ids,
which have no order, are all responses, and so are further rows with the smallest page_id itself. Null payloads are empty;
null URLs give records without a URL; repeated rows give repeated records; empty tables give an empty index; extra columns
are ignored; a payload of any size is written and read whole.
"""
import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from .common import new_path, staged, table, trim

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 8 << 20
BATCH_BYTES = 4 << 20  # of payloads that leave a task at once; one payload may be larger
GAP = 64 << 10
INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _store(uri):
    """File system and path of a folder of the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _record(page_id, url, payload, digest, refers):
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    return gzip.compress(("\r\n".join([*head, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n", 1, mtime=0)


def write(pages):
    """Archive pages(page_id, url, html); returns the staged index (archive, offset, length, page_id, url, digest)."""
    folder = new_path(pages.sparkSession)

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root)
        out, name, at, rows = None, None, 0, []

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # the records are members of their own
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                record = _record(page_id, url, payload, digest, refers)
                out.write(record)
                rows.append((f"{folder}/{name}", at, len(record), page_id, url, digest))
                at += len(record)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()
        trim()

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("d", F.sha1("payload"))
    first = p.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("d", "first")
    # the first pages' ids are hashed, so no payload is sorted or held
    marked = p.join(first.hint("shuffle_hash"), "d", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    kind = "archive string, offset long, length long, page_id long, url string, digest string"
    return staged(marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, kind))


def _parse(record):
    head, _, rest = gzip.decompress(record).partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(h["Content-Length"])]
    digest, kind = h["WARC-Payload-Digest"][5:], h["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError("payload does not match its digest")
    ident = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    url = h.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return ident(h["WARC-Record-ID"]), int(h["X-Payload-Bytes"]), digest, kind, ident(h.get("WARC-Refers-To")), url, body


def ranges(rows):
    """Runs [begin, end, records] of sorted (offset, length), neighbours within GAP together up to READ_BYTES."""
    runs = []
    for at, n in rows:
        if runs and at - runs[-1][1] <= GAP and max(at + n, runs[-1][1]) - runs[-1][0] <= READ_BYTES:
            runs[-1][1] = max(runs[-1][1], at + n)
            runs[-1][2].append((at, n))
        else:
            runs.append([at, at + n, [(at, n)]])
    return runs


def _read(batches, bodies):
    store = name = file = None
    for batch in batches:
        archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
        cut = [k for k in range(len(archives)) if not k or archives[k] != archives[k - 1]] + [len(archives)]
        for lo, hi in zip(cut, cut[1:]):
            if archives[lo] != name:
                name = archives[lo]
                store, path = _store(name)
                file = store.open_input_file(path)
            for begin, end, inside in ranges(zip(offsets[lo:hi], lengths[lo:hi])):
                chunk = file.read_at(end - begin, begin)
                found, held = [], 0
                for k, (at, n) in enumerate(inside):
                    found.append(_parse(chunk[at - begin : at - begin + n]))  # this checks the payload by its digest
                    held += len(found[-1][-1])
                    if not bodies:
                        found[-1] = (*found[-1][:-1], None)
                    if held >= BATCH_BYTES and bodies or k == len(inside) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), RECORD)], schema=RECORD)
                        found, held = [], 0
                del chunk
    trim()


def read(index, bodies=True):
    """Records of the index rows (archive, offset, length), which may be any selection of them. Without bodies the payloads
    are read and checked all the same, but stay in the task."""
    # archives of a bounded size are dealt to the tasks, so the reads of one archive stay together
    rows = index.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(lambda batches: _read(batches, bodies), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def query(spark, sf_dir):
    return read(write(table(spark, sf_dir, "pages")), bodies=False).drop("payload", "url")


SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, payload, octet_length(encode(payload)) as n, sha1(payload) as hex, min(page_id) over (partition by payload) as first from p)
select page_id, cast(n as bigint) as payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), 'string_agg', '') as payload_digest,
 case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from h
"""
