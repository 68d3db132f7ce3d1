"""Near copies of a stage on word shingles: SimHash links confirmed by exact Jaccard similarity, completed by a prefix filter.

Two texts are linked at a similarity of 4/5 or more of their 5-word shingles. First the SimHash operator links fingerprints
of 5-word shingles. Links beyond the radius of the fingerprints are found exactly: in one order of all shingles, rare ones
first, linked texts share one of their first n - ceil(4n / 5) + 1 shingles, so texts that share such a shingle meet. Before
all of them meet, texts are chained: a text has one such shingle in each of 16 ranges of hashes, its least, and meets only
the next two texts there. Every pair is confirmed on the shingles themselves. The SimHash links and the chains join most of
a group of copies by a number of pairs linear in its texts; then only texts not joined yet meet, each with all others, so
chains lose no link. The order comes from a sketch of counts of fixed size; another order changes the cost and no result.
Documents stay in their shards; only shared shingles, links and the texts of candidate pairs move.
Null and empty texts have no shingles and link to one another; equal shingle sets collapse before any comparison; texts of
fewer than N words are one shingle; an empty table gives no rows. Shingles are known by a hash of HASH_BITS.
"""
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, Rolling, Shards, add_up, components, fill, mixed, plain_rows, raw, route, runs_of, split_by, staged, tidy, trim, wide, word_spans
from .substring import BASES, roll

N = 5
CELL_BITS = 18
CELLS = 1 << CELL_BITS
TILE = 512
SLOTS = 128
EARLY = ["e0", "e1", "e2"]  # the first keys of a text, in the order of all shingles
RANGE_BITS = 4  # a text stands in at most 2^RANGE_BITS chains
HASH_BITS = np.uint64(50)  # beside the number of a document, which is below MOST_DOCS
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20


def shingles(b, lens, n=N):
    """Sorted (document << HASH_BITS | hash) of the distinct n-word shingles of at most MOST_DOCS documents of these lengths."""
    b = LOWER[b]
    begin, end, doc = word_spans(b, lens)
    h, size = Rolling(b)(begin, end), np.bincount(doc, minlength=len(lens))
    first, keys = np.cumsum(size) - size, []
    for k in range(1, n + 1):
        if k == n:
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        else:
            at = first[size == k]  # a short text is one shingle
        if len(at):
            keys.append((doc[at].astype(np.uint64) << HASH_BITS) | (mixed(roll(h, BASES[0], k)[at] + np.uint64(k)) >> np.uint64(64 - int(HASH_BITS))))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return keys[runs_of(keys)]


def parts(keys):
    return (keys >> HASH_BITS).astype(np.int64), keys & ((np.uint64(1) << HASH_BITS) - np.uint64(1))


def _cell(h):
    return (h >> np.uint64(int(HASH_BITS) - CELL_BITS)).astype(np.int64)


def _after(doc, key):
    """For the least key of each document and range of keys: the one after it, 0 if there is none; -1 for all other keys."""
    both = (doc.astype(np.uint64) << HASH_BITS) | key
    by = np.argsort(both)
    part = both[by] >> (HASH_BITS - np.uint64(RANGE_BITS))
    at, out = runs_of(part), np.full(len(key), -1, np.int64)
    then = np.minimum(at + 1, len(by) - 1)
    out[by[at]] = np.where((then > at) & (part[then] == part[at]), key[by[then]], np.uint64(0)).view(np.int64)
    return out


def _early(doc, key):
    """For each key the first ones of its document, as many as EARLY has, the last again where there are fewer."""
    begin = runs_of(doc)
    size = np.diff(np.r_[begin, len(doc)])
    return [np.repeat(key[begin + np.minimum(k, size - 1)], size) for k in range(len(EARLY))]


class Shard:
    """The prefixes of a staged shard's documents."""

    def __init__(self, row, counts):
        self.row, self.lens = row, row["lens"].to_numpy()
        self.rows = (row["shard"] << 14) + np.arange(len(self.lens))
        self.doc, self.hash = parts(shingles(row["blob"], self.lens))
        self.size = np.bincount(self.doc, minlength=len(self.lens))
        first = np.cumsum(self.size) - self.size
        # by document, count and hash: the sort is stable and the hashes of a document stand in order
        by = np.argsort((self.doc << 40) + counts[_cell(self.hash)], kind="stable")
        at = np.arange(len(by)) - first[self.doc]
        short = at < (self.size - (4 * self.size + 4) // 5 + 1)[self.doc]
        self.key, self.of, self.pos = self.hash[by[short]], self.doc[short], at[short]

    def keys(self, spread):
        """Distinct prefix shingles by bucket, the index of each prefix entry among them, and the bounds of the buckets."""
        keys, place = np.unique(self.key, return_inverse=True)
        order, edge = split_by(route(keys, spread), spread)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return keys[order], rank[place], edge

    def sets(self):
        """Two hashes of each document's shingle set, and how many of its shingles fall in each of SLOTS slots."""
        out = []
        for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            sums = np.zeros(len(self.lens), np.uint64)
            np.add.at(sums, self.doc, mixed(self.hash ^ salt))
            out.append(mixed(sums + self.size.astype(np.uint64)).view(np.int64))
        slots = np.bincount(self.doc * SLOTS + (self.hash % np.uint64(SLOTS)).astype(np.int64), minlength=len(self.lens) * SLOTS)
        return *out, [x.tobytes() for x in slots.reshape(-1, SLOTS).astype(np.uint16 if slots.max(initial=0) < 65536 else np.uint32)]


def _settle_shared(asked):
    """Whether the shards together hold a prefix shingle in two documents or more."""
    keys, more = [], []
    for _, d in asked:
        n = int(np.frombuffer(d, np.uint32, 1)[0])
        keys.append(np.frombuffer(d, np.uint64, n, 4))
        more.append(np.unpackbits(np.frombuffer(d, np.uint8, offset=4 + 8 * n))[:n])
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, 1 + np.concatenate(more), len(every)) > 1
    for (s, _), part in zip(asked, np.split(shared[inverse], np.cumsum([len(k) for k in keys])[:-1])):
        if part.any():
            yield s, np.packbits(part).tobytes()


def _possible(batches):
    """Pairs(a, b, n_a, n_b, slots_a, slots_b) whose counts by slot let enough shingles be common."""
    for batch in batches:
        n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
        most = np.empty(batch.num_rows, np.int64)
        for k, (x, y, p, q) in enumerate(zip(batch.column("slots_a"), batch.column("slots_b"), *n)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint16 if len(z.as_buffer()) == 2 * SLOTS else np.uint32) for z in (x, y))
            most[k] = np.minimum(x, y).sum()
        ok = pa.array(9 * most >= 4 * (n[0] + n[1]))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in "ab"], ["a", "b"])


def _similar(batches):
    """Pairs(a, b, text_a, text_b) with a similarity of 4/5 or more; two texts without words are alike."""
    for batch in batches:
        sides = [raw(batch.column(c)) for c in ("text_a", "text_b")]
        grown = np.cumsum(sides[0][2] + sides[1][2])
        cut = [0, *(np.flatnonzero(np.diff(grown >> 20)) + 1).tolist(), batch.num_rows]  # some 1 MiB of texts at a time
        for lo, hi in zip(cut, cut[1:]):
            if lo == hi:
                continue
            keys, size = [], []
            for data, begin, lens in sides:
                keys.append(shingles(data[begin[lo] : begin[lo] + lens[lo:hi].sum()], lens[lo:hi]))
                size.append(np.bincount(parts(keys[-1])[0], minlength=hi - lo))
            both = np.sort(np.concatenate(keys))
            common = np.bincount(parts(both[1:][both[1:] == both[:-1]])[0], minlength=hi - lo)
            ok = pa.array(9 * common >= 4 * (size[0] + size[1]))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo).filter(ok) for c in "ab"], ["a", "b"])


def _chained(batches):
    """Pairs of a row and the next two of its key and tile, if their sizes and places allow the overlap.

    Rows come by (key, tile), alike ones next to each other.
    """
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        new, rest = 0 if rest is None else len(rest), pdf.iloc[-2:]
        key, tile, row, n, pos = (pdf[k].to_numpy() for k in ("key", "tile", "row", "n", "pos"))
        found = []
        for step in (1, 2):
            x = np.arange(max(0, new - step), max(0, len(pdf) - step))  # a pair within the rest was met before
            y = x + step
            ok = (key[x] == key[y]) & (tile[x] == tile[y]) & (9 * np.minimum((n - pos)[x], (n - pos)[y]) >= 4 * (n[x] + n[y]))
            found.append(np.stack([np.minimum(row[x], row[y])[ok], np.maximum(row[x], row[y])[ok]]))
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        yield pd.DataFrame({"a": a, "b": b})


def _meeting(batches):
    """Pairs of different components that share a prefix shingle and whose sizes and places still allow the overlap.

    Rows come by (key, lo, hi). In a tile of its own every row meets those after it; in a pair of tiles those of the other.
    Where the first keys of two rows have one in common, the first of these is the first of all they have in common, and
    the pair is given there alone; other pairs are given at every key they share.
    """
    def meet(p, x, y):
        n, left, c, row, key, *early = (p[k].to_numpy() for k in ("n", "left", "c", "row", "key", *EARLY))
        ok = (c[x] != c[y]) & (9 * np.minimum(left[x], left[y]) >= 4 * (n[x] + n[y]))
        x, y = x[ok], y[ok]
        here, known = np.ones(len(x), bool), np.zeros(len(x), bool)
        for one in early:
            new = ~known & np.logical_or.reduce([one[x] == two[y] for two in early])
            here[new] = (one[x] == key[x])[new]
            known |= new
        x, y = row[x[here]], row[y[here]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)])

    names, rest = ["key", "lo", "hi"], None
    for pdf in itertools.chain(batches, [None]):
        whole = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if whole is None or not len(whole):
            continue
        keys = whole[names].to_numpy()
        group = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) - 1
        end = len(whole) if pdf is None else int(np.searchsorted(group, group[-1]))
        rest, whole, group = whole.iloc[end:], whole.iloc[:end], group[:end]
        whole = whole.assign(left=whole.n - whole.pos)
        alone, found = (whole.lo == whole.hi).to_numpy(), []
        own, g, k = whole[alone], group[alone], 1
        while len(at := np.flatnonzero(g[k:] == g[:-k])) if k < len(g) else 0:
            found.append(meet(own, at, at + k))
            k += 1
        two, g = whole[~alone], group[~alone]
        for lo, hi in zip(begin := runs_of(g), np.r_[begin[1:], len(g)]):
            p = two.iloc[lo:hi]
            x, y = np.flatnonzero((p.i == p.lo).to_numpy()), np.flatnonzero((p.i == p.hi).to_numpy())
            found.append(meet(p, np.repeat(x, len(y)), np.tile(y, len(x))))
        if found:
            a, b = np.unique(np.concatenate(found, 1), axis=1)
            yield pd.DataFrame({"a": a, "b": b})


class Copies:
    """Documents docs(doc_id, text, ..) in shards, and the groups of near copies among them."""

    def __init__(self, docs, carried=None):
        self.shards = Shards(docs, lambda blob, lens, ids, flags: {"blob": blob.tobytes()}, "blob binary", SHARD_BYTES, carried)
        self.spread = max(1, -(-self.shards.bytes // BUCKET_BYTES))
        self.rows = self.shards.rows.select("shard", "ids", "lens", "blob")

    def texts(self, wanted=None):
        """(doc_id, text): every row by its number, or only the wanted(row); the shards stay where they are."""
        rows, some = self.rows, wanted is not None
        if some:
            asked = wanted.distinct().groupBy(F.shiftright("row", 14).alias("shard")).agg(F.collect_list("row").alias("got"))
            rows = self.shards.with_answers(rows, asked, "wanted").where("wanted is not null")

        def run(batches):
            for batch in batches:
                for row in plain_rows(batch):
                    lens = row["lens"].to_numpy()
                    at = np.r_[0, np.cumsum(lens)]
                    which = np.arange(len(lens)) if not some else row["wanted"].to_numpy() - (row["shard"] << 14)
                    text = [row["blob"][at[k] : at[k + 1]].tobytes() for k in which.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array((row["shard"] << 14) + which), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "text"])

        return rows.mapInArrow(tidy(run), "doc_id long, text string")

    def confirmed(self, pairs):
        """The pairs(a, b) of rows whose texts are similar."""
        pairs = staged(pairs.distinct())
        texts = staged(self.texts(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))))
        one, two = (texts.select(F.col("doc_id").alias(x), F.col("text").cast("binary").alias(f"text_{x}")) for x in "ab")
        return staged(pairs.join(wide(one), "a").join(wide(two), "b").mapInArrow(tidy(_similar), "a long, b long"))

    def groups(self):
        """(row, group): the least row of each set of rows joined by links."""
        shards, spread = self.shards, self.spread

        def count(batches):
            out = np.zeros(CELLS)
            for batch in batches:
                for row in plain_rows(batch):
                    out += np.bincount(_cell(parts(shingles(row["blob"], row["lens"].to_numpy()))[1]), minlength=CELLS)
            trim()
            return out

        shared = shards.spark.sparkContext.broadcast(add_up(self.rows, count, CELLS).astype(np.int64))  # CELLS numbers

        def ask(row):
            s = Shard(row, shared.value)
            keys, place, edge = s.keys(spread)
            twice = np.bincount(place, minlength=len(keys)) > 1
            for b in np.flatnonzero(np.diff(edge)).tolist():
                k = keys[edge[b] : edge[b + 1]]
                yield b, np.uint32(len(k)).tobytes() + k.tobytes() + np.packbits(twice[edge[b] : edge[b + 1]]).tobytes()

        both = shards.trip(self.rows, ask, _settle_shared, spread)

        def held(batches):
            """Prefix entries of shared shingles, and for each document one row without a key: its size and set hashes."""
            for batch in batches:
                for row in plain_rows(batch):
                    s = Shard(row, shared.value)
                    keys, place, edge = s.keys(spread)
                    bits = np.zeros(len(keys), np.uint8)
                    fill(bits, edge, row["both"], np.unpackbits)
                    at = np.flatnonzero(bits[place])
                    one, two, slots = s.sets()
                    none = len(s.rows)
                    after, early = _after(s.of[at], s.key[at]), _early(s.of[at], s.key[at].view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.r_[s.rows, s.rows[s.of[at]]]), pa.array(np.r_[s.size, s.size[s.of[at]]].astype(np.int64)), pa.array([None] * none + s.pos[at].tolist(), pa.int64()),
                         pa.array([None] * none + s.key[at].view(np.int64).tolist(), pa.int64()), pa.array(np.r_[one, np.zeros(len(at), np.int64)]), pa.array(np.r_[two, np.zeros(len(at), np.int64)]), pa.array(slots + [None] * len(at), pa.binary()), *(pa.array([None] * none + e.tolist(), pa.int64()) for e in (after, *early))],
                        ["row", "n", "pos", "key", "s", "t", "slots", "after", *EARLY])

        every = staged(shards.with_answers(self.rows, both, "both").mapInArrow(tidy(held), "row long, n long, pos long, key long, s long, t long, slots binary, after long, " + ", ".join(f"{e} long" for e in EARLY)))
        shared.unpersist()
        rows = every.where("key is null").select("row", "s", "t", "n")
        sets = staged(rows.groupBy("s", "t", "n").agg(F.min("row").alias("row")))
        lead = sets.select("row")
        slots = every.where("key is null").select("row", "n", "slots").join(wide(lead), "row", "left_semi")
        keyed = every.where("key is not null").select("row", "n", "pos", "key", "after", *EARLY).join(wide(lead), "row", "left_semi")
        tasks = simhash.compare_tasks(shards.spark)

        def possible(pairs):
            one, two = (slots.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("slots").alias(f"slots_{x}")) for x in "ab")
            return pairs.distinct().join(wide(one), "a").join(wide(two), "b").mapInArrow(tidy(_possible), "a long, b long")

        # chains of the rows of a shingle, in tiles where it has many
        starts = keyed.where("after >= 0")
        several = starts.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("c")).where("c > 1").drop("c")
        chains = starts.join(wide(several), "key").withColumn("tile", F.pmod(F.xxhash64("row", "key"), F.col("tiles")).cast("int")).select("key", "tile", "after", "row", "n", "pos")
        chained = chains.repartition(tasks, "key", "tile").sortWithinPartitions("key", "tile", "after", "row").mapInPandas(tidy(_chained), "a long, b long")
        # links of the SimHash operator between fingerprints, and of the rows of one fingerprint to their least one
        prints = staged(simhash.fingerprints(self.texts(lead), N).withColumnRenamed("doc_id", "row"))
        least = staged(prints.groupBy("fp").agg(F.min("row").alias("first")))
        near = simhash.links(least.select("fp"))
        a, b = (least.select(F.col("fp").alias(x), F.col("first").alias(f"row_{x}")) for x in "ab")
        near = near.join(wide(a), "a").join(wide(b), "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
        same = prints.join(wide(least), "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
        links = self.confirmed(near.unionByName(same).unionByName(possible(chained)))
        del near, same, chained
        trim()
        comp = components(links).withColumnRenamed("id", "row")
        met = staged(keyed.drop("after").join(wide(comp), "row", "left").withColumn("c", F.coalesce("component_id", "row")).drop("component_id"))
        mixed_ = met.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("lo < hi").select("key", "tiles")
        dealt = met.join(wide(mixed_), "key").withColumn("i", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("p", F.explode(F.expr("transform(sequence(0, tiles - 1), j -> named_struct('lo', least(i, j), 'hi', greatest(i, j)))")))
        dealt = dealt.select("key", "p.lo", "p.hi", "i", "row", "n", "pos", "c", *EARLY)
        pairs = dealt.repartition(tasks, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(tidy(_meeting), "a long, b long")
        comp = components(links.unionByName(self.confirmed(possible(pairs)))).withColumnRenamed("id", "row")
        named = sets.join(wide(comp), "row", "left").select("s", "t", "n", F.coalesce("component_id", "row").alias("group"))
        return rows.join(wide(named), ["s", "t", "n"]).select("row", "group")

    def firsts(self):
        """(doc_id, text, carried) of one row of each group: the smallest doc_id, null ids last, then the least row."""
        groups = staged(self.groups())
        # a shard's documents stand by doc_id, so the first of a group is known from its rows and their ids
        ids = self.rows.select("shard", F.posexplode("ids").alias("at", "doc_id")).select((F.shiftleft("shard", 14) + F.col("at")).alias("row"), "doc_id")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        kept = ids.join(wide(groups), "row").groupBy("group").agg(F.min(order).alias("o")).select("o.row")
        asked = staged(kept.groupBy(F.shiftright("row", 14).alias("shard")).agg(F.collect_list("row").alias("got")))
        rows = self.shards.with_answers(self.shards.rows.select("shard", "ids", "lens", "blob", "carried"), asked, "kept").where("kept is not null")

        def run(batches):
            for batch in batches:
                for row in plain_rows(batch):
                    at = np.r_[0, np.cumsum(row["lens"].to_numpy())]
                    which = np.sort(row["kept"].to_numpy() - (row["shard"] << 14))
                    text = pa.array([row["blob"][at[k] : at[k + 1]].tobytes() for k in which.tolist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([row["ids"].take(pa.array(which)), text, row["carried"].take(pa.array(which))], ["doc_id", "text", "carried"])

        return rows.mapInArrow(tidy(run), "doc_id long, text string, carried string")
