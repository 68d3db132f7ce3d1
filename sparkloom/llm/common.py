"""Shared helpers: staged tables, documents packed in shards, exchanges between shards, and distributed components."""
import contextlib
import ctypes
import functools
import gc
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TASK_BYTES = 16 << 20
FEW = 1 << 16  # so many edges may be broadcast
MOST_DOCS = 1 << 14  # of a shard; a shard number and a place in the shard fit one long


def table(spark, sf_dir, name):
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark):
    """The cluster's shared folder; where the session names none (tests), the warehouse, which is shared as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark):
    """A new folder name in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there.getParent())
    return path


def staged(df):
    """Write df once as Parquet in the shared folder and read it back; this cuts lineage durably."""
    spark = df.sparkSession
    path = new_path(spark)
    bounded_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def wide(df):
    """df for joins whose rows grow with the input: never broadcast. Spark goes by the size of the files, which says little of
    their rows: these compress well or are exploded, and a broadcast is built on the driver."""
    return df.hint("merge")


def discard(df):
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def bounded_batches(spark, size="8m"):
    """Arrow batches of some 8 MB from here on, where the session has no size of its own; the built-in 64 MB, times buffers
    on both sides and tasks, is what would fill an executor beside its heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def trim():
    """Give freed memory back to the system; what a fit or a shard needed for a moment would else stay with the process."""
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run(batches) for a task that trims its worker at the end; workers wait beside the next stages' ones."""
    def out(batches):
        yield from run(batches)
        trim()

    return out


def long_hash(x):
    """Spark's Murmur3 hash (seed 42) of longs; it names the bucket of a bucketed table."""
    x = np.asarray(x, np.int64).view(np.uint64)
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(len(x), 42, np.uint32)
    with np.errstate(over="ignore"):
        for half in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
            h = turn(h ^ turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(8)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def shard_numbers(part, buckets):
    """Endless shard numbers of a writing task, all in one bucket, so that a task writes one file."""
    for at in itertools.count(0, 4 * buckets):
        x = (part << 28) + np.arange(at, at + 4 * buckets, dtype=np.int64)
        yield from x[long_hash(x) % buckets == part % buckets].tolist()


def raw(column):
    """Bytes of a binary Arrow column, and the begin and length of each value (nulls are empty)."""
    column = column.cast(pa.large_binary())
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    lens = np.diff(at)
    if column.null_count:
        lens = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lens)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], lens


class Shards:
    """Rows of docs packed in shards of about size bytes of text, staged once and bucketed by shard number.

    make(blob, lens, ids, flags) gives the columns `kind` of a shard; joins on the shard number move no shard. A shard
    holds whole documents, ordered by doc_id (nulls first) and text. Columns: shard, ids, flags, carried, lens, *kind.
    """

    def __init__(self, docs, make, kind, size, carried=None, flags=None):
        spark = docs.sparkSession
        text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, (F.lit(True) if flags is None else flags).alias("flag"), (F.lit(None) if carried is None else carried).cast("string").alias("carried"))
        self.bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = buckets = int(min(100_000, max(spark.sparkContext.defaultParallelism, -(-self.bytes // TASK_BYTES))))
        self.spark = spark

        def pack(batches):
            from pyspark import TaskContext

            numbers = shard_numbers(TaskContext.get().partitionId(), buckets)

            def flush(rows):
                rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
                ids, texts, flag, carry = (list(c) for c in zip(*rows))
                lens = np.array([len(t) for t in texts], np.int64)
                more = make(np.frombuffer(b"".join(texts), np.uint8), lens, ids, flag)
                row = {"shard": next(numbers), "ids": ids, "flags": flag, "carried": carry, "lens": lens} | more
                return pa.RecordBatch.from_pylist([row], schema=arrow)

            rows, n = [], 0
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "flag", "carried"))):
                    if rows and (n + len(row[1]) > size or len(rows) == MOST_DOCS):
                        yield flush(rows)
                        rows, n = [], 0
                    rows.append(row)
                    n += len(row[1])
            if rows:
                yield flush(rows)
            trim()

        names = [k.split()[0] for k in kind.split(", ")]
        arrow = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("carried", pa.list_(pa.string())), ("lens", pa.list_(pa.int64())), *((k, pa.binary()) for k in names)])
        out = d.mapInArrow(pack, "shard long, ids array<long>, flags array<boolean>, carried array<string>, lens array<long>, " + kind)
        name = "sparkloom_" + uuid.uuid4().hex
        self.path = new_path(spark)
        # small row groups: writers and readers hold a few shards at a time, however many a bucket has
        small = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "4"}
        bounded_batches(spark)
        out.write.option("path", self.path).options(**small).bucketBy(buckets, "shard").saveAsTable(name)
        self.rows = spark.table(name)
        spark.sql(f"drop table {name}")  # the name goes from the catalog; the files stay, and the plan knows them

    def with_answers(self, rows, answers, name):
        """rows (shard, ..) with the answers of a trip as array column name; the answers move, the shards stay."""
        got = answers.select("shard", F.col("got").alias(name)).repartition(self.buckets, "shard")
        return rows.join(got.hint("shuffle_hash"), "shard", "left")

    def trip(self, rows, emit, settle, spread):
        """Answers (shard, got array<(bucket, data)>) to what the shards ask each other.

        emit(row) gives (bucket, bytes) of a shard, buckets below spread; settle gets all (shard, bytes) of one bucket and
        gives (shard, bytes). What one bucket holds is set by a hash, and a shard sends each key once, so no key is hot.
        """
        def ask(batches):
            for batch in batches:
                for row in plain_rows(batch):
                    found = list(emit(row))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([row["shard"]] * len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())], ["bucket", "shard", "data"])
            trim()

        def answer(batches):
            held = {}
            for batch in batches:
                for b, s, d in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "data"))):
                    held.setdefault(b, []).append((s, d))
            for b in sorted(held):
                out = list(settle(sorted(held.pop(b))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], ["shard", "bucket", "data"])
            trim()

        asked = rows.mapInArrow(ask, "bucket int, shard long, data binary").repartitionById(spread, F.col("bucket"))
        answered = asked.mapInArrow(answer, "shard long, bucket int, data binary")
        return staged(answered.groupBy("shard").agg(F.collect_list(F.struct("bucket", "data")).alias("got")))


def plain_rows(batch):
    """Rows of an Arrow batch as dicts; lists of numbers become arrays, binaries byte arrays; lists with nulls stay lists."""
    cols = {}
    for name, kind in zip(batch.schema.names, batch.schema.types):
        c = batch.column(name)
        if pa.types.is_list(kind) and not pa.types.is_struct(kind.value_type):
            cols[name] = [v.values if v.is_valid else None for v in c]
        elif pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
            cols[name] = [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else None for v in c]
        else:
            cols[name] = c.to_pylist()
    for values in zip(*cols.values()):
        yield dict(zip(cols, values))


def add_up(df, fn, size, blocks=32, groups=16):
    """Sum over df's tasks of the array of `size` floats that fn(batches) gives; two rounds of partial sums in shuffles.

    The driver gets one array of fixed size. A task of the first round adds one block of a sixteenth of the tasks.
    """
    def run(batches):
        from pyspark import TaskContext

        part = np.array_split(fn(batches), blocks)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(blocks), pa.int32()), "g": pa.array([TaskContext.get().partitionId() % groups] * blocks, pa.int32()), "m": pa.array([x.astype(np.float64).tobytes() for x in part], pa.binary())})

    def fold(batches):
        sums = {}
        for batch in batches:
            for k, m in zip(batch.column("k").to_pylist(), batch.column("m")):
                m = np.frombuffer(m.as_buffer(), np.float64)
                sums[k] = sums[k] + m if k in sums else m
        for k, m in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "g": pa.array([0], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    kind = "k int, g int, m binary"
    bounded_batches(df.sparkSession)
    got = df.mapInArrow(run, kind).repartition("k", "g").mapInArrow(fold, kind).repartition("k").mapInArrow(fold, kind).toArrow()
    out = {k: np.frombuffer(m.as_buffer(), np.float64) for k, m in zip(got["k"].to_pylist(), got["m"])}
    out = np.concatenate([out[k] for k in range(blocks)]) if out else np.zeros(size)
    del got
    trim()
    return out


def mixed(x):
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


@functools.lru_cache(2)
def _powers(base, n):
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(base & 0xFFFF).integers(1, 2**63, 256, dtype=np.uint64)


class Rolling:
    """Hashes of any substrings of b: prefix sums of a polynomial over random byte values, modulo 2^64, then mixed."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, b, which=0):
        room = 1 << max(21, int(len(b) + 1).bit_length())
        up, self.down, byte = _powers(self.BASES[which], room)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(byte[b] * up[: len(b)], out=self.sums[1:])

    def __call__(self, begin, end):
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def fixed(self, n):
        """Hashes of all substrings of n bytes."""
        with np.errstate(over="ignore"):
            k = max(0, len(self.sums) - n)
            return mixed((self.sums[n : n + k] - self.sums[:k]) * self.down[:k])


def word_spans(b, lens, gap=SPACE):
    """Begin, end and document of each word of the documents of these lengths that follow one another in b."""
    starts = np.cumsum(lens) - lens
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = gap[b]
    before, after = np.empty(len(b), bool), np.empty(len(b), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = blank[:-1], blank[1:]
    some = lens > 0
    before[starts[some]] = True
    after[(starts + lens - 1)[some]] = True
    begin, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return begin, end, np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(begin, starts), append=len(begin)))


def runs_of(values):
    """Begin of each run of equal values in an array."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def split_by(bucket, buckets):
    """Order of items by bucket (stable) and the bounds of each bucket in that order."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def row_orders(ids):
    """Document order keys; nulls come first."""
    return ids.fill_null(int(np.iinfo(np.int64).min)).to_numpy(zero_copy_only=False).astype(np.int64)


def route(hashes, spread):
    """The bucket of each hash."""
    return (mixed(hashes) >> np.uint64(33)).astype(np.int64) % spread


def fill(out, edge, answers, read):
    """Put the answers of all buckets, in their order, into out."""
    for a in answers if answers is not None else []:
        lo, hi = edge[a["bucket"]], edge[a["bucket"] + 1]
        out[lo:hi] = read(np.frombuffer(a["data"], np.uint8))[: hi - lo]


def pieces(edge, *columns):
    """(bucket, bytes) of every bucket that has items; the columns stand one after another."""
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, b"".join(np.ascontiguousarray(c[edge[b] : edge[b + 1]]).tobytes() for c in columns)


def unpack(asked, *kinds):
    """Columns of the items of a bucket, the number of items of each shard, and the shards."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    size = [len(d) // width for _, d in asked]
    out = []
    at = [0] * len(asked)
    for k in kinds:
        item = np.dtype(k).itemsize
        out.append(np.concatenate([np.frombuffer(d, k, n, a) for (_, d), n, a in zip(asked, size, at)]))
        at = [a + n * item for a, n in zip(at, size)]
    return out, np.array(size), [s for s, _ in asked]


def settle_first(asked, kind, ties=True):
    """One bit for each (key, document order): whether an earlier document has the key; with ties, an earlier shard counts."""
    (key, order), size, shards = unpack(asked, kind, "i8")
    place = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((place, order))
    by = by[np.argsort(key[by], kind="stable")]
    begin = runs_of(key[by])
    merged, least = key[by][begin], by[begin]
    least = least[np.searchsorted(merged, key)]
    found = least != np.arange(len(key)) if ties else order[least] < order
    for s, part in zip(shards, np.split(found, np.cumsum(size)[:-1])):
        if part.any():
            yield s, np.packbits(part).tobytes()


def _stars(batches, most=1 << 20):
    """Edges(u, v) of a task replaced, a million at a time, by edges from every id to the smallest it reaches among them."""
    def contract(held):
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = list(range(len(ids)))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        for x in range(len(ids)):  # a root is never greater, so one pass in order is enough
            root[x] = root[root[x]]
        least = ids[np.array(root)]
        return pa.RecordBatch.from_arrays([pa.array(ids[least < ids]), pa.array(least[least < ids])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield contract(held)
            held, n = [], 0
    if n:
        yield contract(held)


def components(edges):
    """Smallest id reachable for every long id of edges(a, b); alternating large and small stars.

    Every task first contracts its own edges, which leaves few rounds.

    Hubs are combined by partial aggregation and joined, never gathered. Returns (id, component_id).
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().mapInArrow(_stars, "u long, v long").distinct())
    before = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
        before = sign
        held = wide if sign[0] > FEW else lambda df: df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(held(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        pairs = big.join(held(low), "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, staged(small.distinct())
        discard(last)


def forest(a, b, n):
    """Spanning-forest edges of the index pairs (a, b) over n nodes; plain union-find."""
    root, out = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist()):
        r, s = x, y
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        if r != s:
            root[max(r, s)] = min(r, s)
            out.append((x, y))
    return out
