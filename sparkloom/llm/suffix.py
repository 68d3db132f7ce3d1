"""Suffix-array dedup of 100-byte repeats over UTF-8 bytes.

Documents are packed in shards. Each shard is sorted by Larsson-Sadakane refinement; common prefixes follow Kasai's
argument on text order; windows that repeat inside a shard are found there. Across shards, the sorted lists of the shards
are merged and searched by halving, in three trips: anchors (the least hash of a window's 50-byte substrings) that more
than one shard has; runs of first windows under such an anchor, told apart by 64 bits besides the anchor's 64; and single
windows, by 128 bits, where the runs under an anchor differ. A shard sends each key once, so no key is hot.
Null and empty texts give rows of zero bytes; null ids come first; rows that share a doc_id are ordered by text inside a
shard and by shard across shards; equal rows are told apart by that place alone; an empty table gives no rows; extra
columns are ignored; texts of any length stay whole in one shard.
"""
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Rolling, Shards, fill, mixed, pieces, plain_rows, route, row_orders, runs_of, settle_first, split_by, table, tidy, unpack

LENGTH = 100
GRAM = 50
SHARD_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20


def suffix_array(b):
    """Suffix order of bytes to a depth past LENGTH: groups double their depth, and only groups still tied are sorted again.

    The first sort takes as many places in one key as the alphabet of the shard lets into 64 bits.
    """
    n = len(b)
    code = np.zeros(256, np.uint64)
    code[b] = 1
    bits = np.uint64(int(code.sum()).bit_length())
    code = np.cumsum(code, dtype=np.uint64) * code
    wide = np.zeros(n + 64, np.uint64)
    wide[:n] = code[b]
    key, depth = wide.copy(), 1
    while 2 * depth * int(bits) <= 64:
        key[:-depth] = (key[:-depth] << (bits * np.uint64(depth))) | key[depth:]
        depth *= 2
    while (depth + 1) * int(bits) <= 64:
        key[:-depth] = (key[:-depth] << bits) | wide[depth:]
        depth += 1
    key = key[:n]
    sa = np.argsort(key)
    key = key[sa]
    sa = sa.astype(np.int32)
    rank = np.full(n + 256, -1, np.int32)
    rank[sa] = _heads(np.r_[True, key[1:] != key[:-1]])
    at = np.arange(n, dtype=np.int32)
    while depth < LENGTH and len(at):
        r = rank[sa[at]]
        same = r[1:] == r[:-1]
        tied = np.zeros(len(at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = at[tied]
        s = sa[at]
        two = rank[s + depth]
        pair = r[tied].astype(np.int64) * (n + 2) + two + 1  # both ranks in one key: a shard is far below 2^31 bytes
        order = np.argsort(pair)
        s, pair = s[order], pair[order]
        sa[at] = s
        if len(at):
            rank[s] = at[_heads(np.r_[True, pair[1:] != pair[:-1]])]
        depth *= 2
    return sa, rank[:n]


def _heads(new):
    """Index of the group head of every place, from the places where groups begin."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def common_prefixes(b, first, second):
    """Lengths of the common prefixes of suffix pairs given in text order of first, with Kasai's saving:
    where the next position has the next partner, the length is one less."""
    n = len(b)
    follows = np.r_[False, (first[1:] == first[:-1] + 1) & (second[1:] == second[:-1] + 1)]
    head = np.flatnonzero(~follows)
    size = np.zeros(len(head), np.int64)
    live = np.arange(len(head))
    wide = np.r_[b, np.zeros(64, np.uint8)]
    step = np.arange(32)
    while len(live):
        x, y = first[head[live]] + size[live], second[head[live]] + size[live]
        on = (x < n) & (y < n)
        live, x, y = live[on], x[on], y[on]
        differ = (wide[x[:, None] + step] != wide[y[:, None] + step]) | (np.maximum(x, y)[:, None] + step >= n)
        stop = differ.any(1)
        size[live] += np.where(stop, differ.argmax(1), 32)
        live = live[~stop]
    group = np.cumsum(~follows) - 1
    return np.maximum(0, size[group] - (first - first[head[group]]))


def repeated_in_shard(b, valid):
    """True for valid windows whose bytes also start earlier in b."""
    out = np.zeros(len(b), bool)
    if len(b) < LENGTH:
        return out
    sa, rank = suffix_array(b)
    r = rank[sa]
    rest = np.flatnonzero(r[1:] != r[:-1])  # the others are equal to a depth past LENGTH
    a, p = sa[rest + 1], sa[rest]
    wide = np.r_[b, np.zeros(128, np.uint8)]
    close = np.arange(len(a))
    for at in (15, 31, 63, 99):
        close = close[wide[a[close] + at] == wide[p[close] + at]]
    close = close[np.argsort(a[close])]
    lcp = np.full(len(b), LENGTH, np.int64)
    lcp[0] = 0
    lcp[rest + 1] = 0
    if len(close):
        lcp[rest[close] + 1] = common_prefixes(b, a[close].astype(np.int64), p[close].astype(np.int64))
    begin = np.flatnonzero(lcp < LENGTH)
    least = np.minimum.reduceat(np.where(valid[sa], sa, len(b)), begin)
    again = np.repeat(least, np.diff(np.r_[begin, len(b)])) < sa
    out[sa] = again & valid[sa]
    return out


def layout(lens):
    """Start of each document in its shard, and which places start a window that stays inside its document."""
    starts = np.cumsum(lens) - lens
    d = np.zeros(int(lens.sum()) + 1, np.int64)
    long = lens >= LENGTH
    np.add.at(d, starts[long], 1)
    np.add.at(d, (starts + lens - LENGTH + 1)[long], -1)
    return starts, np.cumsum(d[:-1]) > 0


def anchored_runs(b, first):
    """Runs of first windows that have one anchor: begin, number of windows, place of the anchor."""
    n = len(b) - LENGTH + 1
    if n < 1 or not first.any():
        return (np.zeros(0, np.int64),) * 3
    g = Rolling(b).fixed(GRAM)
    a, wide, want = g, 1, LENGTH - GRAM + 1
    while 2 * wide <= want:
        a = np.minimum(a[:-wide], a[wide:])
        wide *= 2
    a = np.minimum(a[: len(a) - (want - wide)], a[want - wide :])
    use, turn = first[:n], np.r_[True, a[1:] != a[:-1]]
    begin = np.flatnonzero(use & (turn | ~np.r_[False, use[:-1]]))
    end = np.flatnonzero(use & np.r_[turn[1:] | ~use[1:], True]) + 1
    place = np.empty(len(begin), np.int64)
    for lo in range(0, len(begin), 1 << 16):
        s = begin[lo : lo + (1 << 16)]
        place[lo : lo + len(s)] = s + (g[s[:, None] + np.arange(want)] == a[s][:, None]).argmax(1)
    return begin, end - begin, place


def _make(blob, lens, ids, flags):
    _, valid = layout(lens)
    dup = repeated_in_shard(blob, valid)
    begin, n, place = anchored_runs(blob, valid & ~dup)
    words = lambda x: np.ascontiguousarray(x, np.uint32).tobytes()
    return {"blob": blob.tobytes(), "dup": np.packbits(dup).tobytes(), "begin": words(np.diff(begin, prepend=0)), "many": words(n), "place": words(place - begin)}


class Shard:
    """A staged shard: its runs with their anchors, hashes and document orders."""

    def __init__(self, row):
        self.row, self.blob, self.shard = row, row["blob"], row["shard"]
        self.begin = np.cumsum(row["begin"].view(np.uint32), dtype=np.int64)
        self.many = row["many"].view(np.uint32).astype(np.int64)
        place = self.begin + row["place"].view(np.uint32)
        self.hash = Rolling(self.blob)
        self.key = self.hash(place, place + GRAM)
        self.run = mixed(self.hash(self.begin, self.begin + self.many + LENGTH - 1) + self.many.astype(np.uint64))
        self.lens = row["lens"].to_numpy()

    def order(self, at):
        """The order key of the documents at these places."""
        starts = np.cumsum(self.lens) - self.lens
        return row_orders(self.row["ids"])[np.searchsorted(starts, at, "right") - 1]

    def anchors(self, spread):
        """Distinct anchors by bucket: (anchor, digest of its run or 0 if it has several), bounds of the buckets."""
        o = np.lexsort((self.key, route(self.key, spread)))
        k, r = self.key[o], (self.run[o] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        at = runs_of(k)
        one = np.diff(np.r_[at, len(k)]) == 1
        k = k[at]
        return k, np.where(one, r[at], 0).astype(np.uint32), np.searchsorted(route(k, spread), np.arange(spread + 1))

    def codes(self, spread):
        """What the first trip says of the anchor of each run: 0 in this shard alone, 1 one run everywhere, 2 several runs."""
        k, _, edge = self.anchors(spread)
        code = np.zeros(len(k), np.uint8)
        fill(code, edge, self.row["anchors"], lambda d: d)
        o = np.argsort(k)
        return code[o][np.searchsorted(k[o], self.key)] if len(k) else code

    def repeats(self, spread):
        """Index of the runs of shared anchors by bucket, their pair hashes, codes, and the bounds of the buckets."""
        code = self.codes(spread)
        at = np.flatnonzero(code)
        pair = mixed(self.key[at] ^ mixed(self.run[at]))
        order, edge = split_by(route(pair, spread), spread)
        return at[order], pair[order], code[at[order]], edge

    def open(self, spread):
        """Runs that repeat as a whole; and places and fingerprints, by bucket, of the windows that are still open."""
        at, _, code, edge = self.repeats(spread)
        again = np.zeros(len(at), np.uint8)
        fill(again, edge, self.row["runs"], np.unpackbits)
        left = np.sort(at[(again == 0) & (code == 2)])
        n = self.many[left]
        place = np.repeat(self.begin[left], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = self.hash(place, place + LENGTH)
        two = Rolling(self.blob, 1)(place, place + LENGTH) if len(place) else one
        order, edge = split_by(route(one, spread), spread)
        return at[again == 1], place[order], np.stack([one[order], two[order]], 1).astype(">u8"), edge


def settle_anchors(asked):
    """Merge the shards' sorted anchors and search each in the merged list: how many shards, and how many runs."""
    (key, digest), size, shards = unpack(asked, "u8", "u4")
    order = np.argsort(key)
    begin = runs_of(key[order])
    digest = digest[order]
    low, high = np.minimum.reduceat(digest, begin), np.maximum.reduceat(digest, begin)
    code = np.where(np.diff(np.r_[begin, len(key)]) == 1, 0, np.where((low == high) & (low > 0), 1, 2)).astype(np.uint8)
    found = code[np.searchsorted(key[order][begin], key)]
    for s, part in zip(shards, np.split(found, np.cumsum(size)[:-1])):
        if part.any():
            yield s, part.tobytes()


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, spans array<struct<begin:long,end:long>>, carried string"


def whole_characters(b, gone):
    """Text of the UTF-8 bytes b without every character that lost a byte."""
    of = np.cumsum((b & 0xC0) != 0x80) - 1
    lost = np.zeros(of[-1] + 1 if len(of) else 0, bool)
    lost[of[gone]] = True
    return b[~lost[of]].tobytes().decode()


def dedup(docs, carry=None):
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_text, spans) for every row of docs(doc_id, text).

    kept_text is the kept text without characters that were cut apart, given only with carry: each row then also brings
    the struct of these expressions of its own row as carried.
    """
    more = F.struct(*map(F.expr, carry)) if carry else None
    texts = more is not None
    shards = Shards(docs, _make, "blob binary, dup binary, begin binary, many binary, place binary", SHARD_BYTES, None if more is None else F.to_json(more))
    spread = max(1, -(-shards.bytes // BUCKET_BYTES))

    def ask_anchors(row):
        k, r, edge = Shard(row).anchors(spread)
        return pieces(edge, k, r)

    def ask_runs(row):
        s = Shard(row)
        at, pair, _, edge = s.repeats(spread)
        return pieces(edge, pair, s.order(s.begin[at]))

    def ask_windows(row):
        s = Shard(row)
        _, place, prints, edge = s.open(spread)
        return pieces(edge, prints, s.order(place))

    plain = shards.rows.select("shard", "ids", "lens", "blob", "begin", "many", "place")
    anchors = shards.trip(plain, ask_anchors, settle_anchors, spread)
    plain = shards.with_answers(plain, anchors, "anchors")
    runs = shards.trip(plain, ask_runs, functools.partial(settle_first, kind="u8"), spread)
    plain = shards.with_answers(plain, runs, "runs")
    windows = shards.trip(plain, ask_windows, functools.partial(settle_first, kind="S16"), spread)

    def cut(batches):
        for batch in batches:
            for row in plain_rows(batch):
                s = Shard(row)
                whole, place, _, edge = s.open(spread)
                again = np.zeros(len(place), np.uint8)
                fill(again, edge, row["windows"], np.unpackbits)
                size = len(s.blob)
                flag = np.unpackbits(row["dup"])[:size].astype(np.int64)
                flag[place[again == 1]] = 1
                d = np.zeros(size + LENGTH + 1, np.int64)
                np.add.at(d, s.begin[whole], 1)
                np.add.at(d, s.begin[whole] + s.many[whole] + LENGTH - 1, -1)
                d[:size] += flag
                d[LENGTH : size + LENGTH] -= flag
                gone = np.cumsum(d)[:size] > 0
                out, at = [], 0
                for i, c, n in zip(row["ids"].to_pylist(), row["carried"].to_pylist(), s.lens.tolist()):
                    g = gone[at : at + n]
                    edges = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8))).reshape(-1, 2).tolist()
                    kept = s.blob[at : at + n][~g].tobytes() if edges else s.blob[at : at + n].tobytes()
                    out.append({"doc_id": i, "n_bytes": n, "n_removed": int(g.sum()), "n_spans": len(edges), "kept": kept, "kept_text": None if not texts else whole_characters(s.blob[at : at + n], g) if edges else kept.decode(), "spans": [{"begin": x, "end": y} for x, y in edges], "carried": c})
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("carried", pa.string())])
    rows = shards.rows
    for name, answers in (("anchors", anchors), ("runs", runs), ("windows", windows)):
        rows = shards.with_answers(rows, answers, name)
    out = rows.mapInArrow(tidy(cut), KEPT)
    if more is None:
        return out.drop("carried", "kept_text")
    return out.withColumn("carried", F.from_json("carried", docs.select(more.alias("c")).schema[0].dataType))


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
with d as (select doc_id, hex(coalesce(text, '')) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from d),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from p),
f as (select s, min({'d': doc_id, 'i': i}) as m from w group by s having count(*) > 1),
g as (select doc_id, i from w join f using (s) where {'d': doc_id, 'i': i} > m),
r as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from (
 select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from g) t),
runs as (select doc_id, min(i) as b, max(i) + 100 as e from r group by doc_id, k),
gaps as (select doc_id, coalesce(lag(e) over (partition by doc_id order by b), 0) as lo, b as hi from runs
 union all select doc_id, max(e), 1000000000 from runs group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as h from gaps join d using (doc_id) group by doc_id),
n as (select doc_id, sum(e - b) as removed, count(*) as spans from runs group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
 sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
