"""SimHash near-dedup with exact recall: pigeonhole buckets and bit-sliced comparison.

Null and empty texts have fingerprint zero and link like any other; equal fingerprints collapse before any comparison;
a null doc_id keeps its row and has the least doc_id of its component, null if there is none; repeated rows share a
component; an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import components, forest, staged, table, wide

RADIUS = 4
TILE = 2048


def fingerprint(text, n=4):
    """Signed 64-bit SimHash of the n-word shingles of a text, ASCII lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    k = max(1, len(words) - n + 1)
    starts, ends = [0, *ends][:k], [e - 1 for e in ends[min(n, len(words)) - 1:]]
    h = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, k, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<i8")[0])


def fingerprints(docs, n=4):
    def run(batches):
        for batch in batches:
            fp = pa.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def near(x, y, radius=RADIUS):
    """Index pairs (i, j) with x[i], y[j] at most radius (< 8) bits apart; y is kept as 64 vertical bit planes."""
    m = len(y)
    bits = np.unpackbits(np.ascontiguousarray(y).view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    pad = np.zeros((-(-m // 64) * 64, 64), np.uint8)
    pad[:m] = bits
    planes = np.packbits(np.ascontiguousarray(pad.T), axis=1, bitorder="little").copy(order="C").view("<u8")
    valid = np.packbits(np.arange(len(pad)) < m, bitorder="little").view("<u8")
    found = []
    for lo in range(0, len(x), 256):
        q = x[lo : lo + 256]
        rows = np.arange(len(q))
        c0 = c1 = c2 = np.zeros((len(q), planes.shape[1]), np.uint64)
        over = np.tile(~valid, (len(q), 1))
        for b in range(64):
            d = planes[b][None, :] ^ (-((q[rows] >> np.uint64(b)) & np.uint64(1)).astype(np.int64)).view(np.uint64)[:, None]
            carry = c0 & d
            c0 = c0 ^ d
            c1, carry = c1 ^ carry, c1 & carry
            c2, carry = c2 ^ carry, c2 & carry
            over = over | carry
            # abandon query blocks whose every lane has passed the radius
            if b % 8 == 7:
                live = ((over | _above(c0, c1, c2, radius)) != np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
                if not live.all():
                    rows, c0, c1, c2, over = rows[live], c0[live], c1[live], c2[live], over[live]
                    if not len(rows):
                        break
        if len(rows):
            ok = ~(over | _above(c0, c1, c2, radius))
            i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(ok.copy(order="C")).view(np.uint8), axis=1, bitorder="little")[:, :m])
            found.append((rows[i] + lo, j))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _above(c0, c1, c2, radius):
    """Lanes whose 3-bit counter exceeds radius."""
    out = np.zeros_like(c0)
    for v in range(radius + 1, 8):
        out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return out


def _keys(radius=RADIUS, blocks=7):
    """Bit masks of which one at least is equal in any two fingerprints within the radius.

    Of seven blocks three stay equal, some 27 bits: few fingerprints meet by chance, also where there are many.
    """
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [sum(mask[i] for i in c) for c in itertools.combinations(range(blocks), blocks - radius)]


def compare_tasks(spark):
    """Four tasks for each shuffle partition while these are few; a session with many partitions keeps its own number."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(4 * n, 240))


def links(fps, radius=RADIUS):
    """A spanning set of links (a, b) between distinct fingerprints fps(fp); it joins exactly what all links join."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _keys(radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "v"))
    size = keyed.groupBy("k", "v").agg(F.count("*").alias("c")).where("c > 1").withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int"))
    mine = wide(keyed).join(wide(size), ["k", "v"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a row of tile i goes to every pair of tiles that holds i; a bucket of one tile keeps one copy
    dealt = mine.select("k", "v", "fp", "i", F.explode(F.expr("transform(sequence(0, tiles - 1), j -> named_struct('lo', least(i, j), 'hi', greatest(i, j)))")).alias("p"))
    dealt = dealt.select("k", "v", "p.lo", "p.hi", "i", "fp")

    def compare(pdf):
        lo, hi = pdf.lo.iat[0], pdf.hi.iat[0]
        x = pdf.fp[pdf.i == lo].to_numpy().view(np.uint64)
        y = x if lo == hi else pdf.fp[pdf.i == hi].to_numpy().view(np.uint64)
        a, b = near(x, y, radius)
        if lo == hi:
            a, b = a[a < b], b[a < b]
            both = x
        else:
            both, b = np.concatenate([x, y]), b + len(x)
        return [(both[i], both[j]) for i, j in forest(a, b, len(both))]

    def run(batches):
        """Groups arrive together and in order; many small groups share a batch."""
        names, rest = ["k", "v", "lo", "hi"], None
        for pdf in itertools.chain(batches, [None]):
            whole = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if whole is None or not len(whole):
                continue
            keys = whole[names].to_numpy()
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            ends = np.r_[new[1:], len(whole)]
            if pdf is not None:
                rest, new, ends = whole.iloc[new[-1]:], new[:-1], ends[:-1]
            out = [e for s, t in zip(new.tolist(), ends.tolist()) if t - s > 1 for e in compare(whole.iloc[s:t])]
            yield pd.DataFrame(np.array(out, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    # the rows are short and the comparisons many, so the number of tasks is set and not left to their bytes
    tasks = compare_tasks(fps.sparkSession)
    return dealt.repartition(tasks, "k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi").mapInPandas(run, "a long, b long")


def near_duplicates(docs, n=4, radius=RADIUS):
    """(doc_id, fp, component_id): smallest doc_id reachable by links of at most radius differing bits."""
    fps = staged(fingerprints(docs, n))
    groups = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(groups.select("fp"), radius))
    best = wide(groups).join(wide(comp.withColumnRenamed("id", "fp")), "fp", "left").withColumn("c", F.coalesce("component_id", "fp"))
    low = best.groupBy("c").agg(F.min("first").alias("component"))
    named = wide(best).join(wide(low), "c").select("fp", "component")
    return wide(fps).join(wide(named), "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def query(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
