"""Substring dedup over word windows: count-min prefilter, then exact grouping of windows estimated repeated.

Documents are packed in shards. First, every shard sends its windows' 32-bit sketch values to the slice of the sketch that
they hash to; a slice holds two rows of counters for some BUCKET_BYTES of text, so the sketch grows with the input and is
never sent whole. Merged counts never fall short, so no repeat is lost. Then the windows estimated repeated are grouped
exactly, each distinct window once for a shard, by two 64-bit hashes made from two independent word hashes.
Null texts have no words; texts shorter than a window keep all words; equal doc_ids count as one document for what is
earlier; null doc_ids are never earlier and keep all words; an empty table gives no rows; extra columns are ignored.
"""
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import SPACE, Rolling, Shards, fill, mixed, pieces, plain_rows, route, row_orders, runs_of, settle_first, split_by, table, word_spans

WINDOW = 50
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
ROW_BITS = 24  # counters of a sketch row in a slice: some six for each window
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def roll(h, base, window):
    """A hash of every run of window values, by doubling."""
    power, n, out, done, left = np.uint64(base), 1, None, 0, window
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = h, n
                else:
                    k = len(h) - done
                    out, done = out[:k] * power + h[done:], done + n
            left >>= 1
            if left:
                h = h[:-n] * power + h[n:]
                power, n = power * power, 2 * n
    return mixed(out)


class Shard:
    """The words and windows of a staged shard; windows of documents without an id are left out."""

    def __init__(self, row, window):
        self.blob, self.lens, self.answers = row["blob"], row["lens"].to_numpy(), row
        self.begin, self.end, self.doc = word_spans(self.blob, self.lens)
        self.order = row_orders(row["ids"])
        has = row["ids"].is_valid().to_numpy(zero_copy_only=False)
        n = max(0, len(self.doc) - window + 1)
        self.at = np.flatnonzero((self.doc[:n] == self.doc[len(self.doc) - n :]) & has[self.doc[:n]]) if n else np.zeros(0, np.int64)
        self.window = window
        self.one = self.hashes(0, self.at)

    def hashes(self, which, at):
        if not len(at):
            return np.zeros(0, np.uint64)
        return roll(Rolling(self.blob, which)(self.begin, self.end), BASES[which], self.window)[at]

    def sketch(self, spread):
        """Order of the windows by bucket and sketch value, begin of each distinct value, the values, bounds of the buckets."""
        key = (route(self.one, spread).astype(np.uint64) << np.uint64(32)) | (self.one & np.uint64(0xFFFFFFFF))
        by = np.argsort(key)
        key = key[by]
        begin = runs_of(key)
        edge = np.searchsorted(key[begin], np.arange(spread + 1).astype(np.uint64) << np.uint64(32))
        return by, begin, key[begin].astype(np.uint32), edge

    def candidates(self, spread):
        """Windows estimated repeated: their index in at, group, and of each group the first window, fingerprint and bucket bounds."""
        by, begin, _, edge = self.sketch(spread)
        maybe = np.zeros(len(begin), np.uint8)
        fill(maybe, edge, self.answers["estimates"], np.unpackbits)
        hit = np.zeros(len(self.at), bool)
        hit[by] = np.repeat(maybe, np.diff(np.r_[begin, len(by)])) == 1
        hit = np.flatnonzero(hit)
        one, two = self.one[hit], self.hashes(1, self.at[hit])
        by = np.lexsort((two, one))  # stable: the first of a group is in the least document
        new = np.ones(len(by), bool)
        new[1:] = (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        first = by[new]
        order, edge = split_by(route(one[first], spread), spread)
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first = first[order]
        return hit, place[group], first, np.stack([one[first], two[first]], 1).astype(">u8"), edge


def _ask_estimates(row, spread, window):
    by, begin, value, edge = Shard(row, window).sketch(spread)
    twice = np.diff(np.r_[begin, len(by)]) > 1
    for b in np.flatnonzero(np.diff(edge)).tolist():
        v = value[edge[b] : edge[b + 1]]
        gaps = np.diff(v, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T  # planes: the upper ones are nearly all zero
        yield b, np.uint32(len(v)).tobytes() + np.ascontiguousarray(gaps).tobytes() + np.packbits(twice[edge[b] : edge[b + 1]]).tobytes()


def _settle_estimates(asked):
    """Merge the shards' parts of a slice of the sketch; one bit for each value: the least of its counters is two or more."""
    values, more = [], []
    for _, d in asked:
        n = int(np.frombuffer(d, np.uint32, 1)[0])
        gaps = np.ascontiguousarray(np.frombuffer(d, np.uint8, 4 * n, 4).reshape(4, n).T).view(np.uint32).ravel()
        values.append(np.cumsum(gaps, dtype=np.uint32))
        more.append(values[-1][np.unpackbits(np.frombuffer(d, np.uint8, offset=4 + 4 * n))[:n] == 1])
    every = np.concatenate(values + more)
    high, low = np.uint32(32 - ROW_BITS), np.uint32((1 << ROW_BITS) - 1)

    def full(slots):
        """Counters of a row that are two or more."""
        slots = np.sort(slots)
        out = np.zeros(1 << ROW_BITS, bool)
        out[slots[1:][slots[1:] == slots[:-1]]] = True
        return out

    rows = full(every & low), full(every >> high)
    for (s, _), v in zip(asked, values):
        found = rows[0][v & low] & rows[1][v >> high]
        if found.any():
            yield s, np.packbits(found).tobytes()


def _texts(pieces_, keep, size):
    """Arrow strings of each document's kept bytes."""
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(pieces_[keep].tobytes()))


def dedup(docs, window=WINDOW):
    """(doc_id, n_words, n_removed, kept): kept is the text left, words joined by one space."""
    shards = Shards(docs, lambda blob, lens, ids, flags: {"blob": blob.tobytes()}, "blob binary", SHARD_BYTES)
    spread = max(1, -(-shards.bytes // BUCKET_BYTES))

    def ask_first(row):
        s = Shard(row, window)
        hit, _, first, prints, edge = s.candidates(spread)
        return pieces(edge, prints, s.order[s.doc[s.at[hit[first]]]])

    plain = shards.rows.select("shard", "ids", "lens", "blob")
    estimates = shards.trip(plain, functools.partial(_ask_estimates, spread=spread, window=window), _settle_estimates, spread)
    plain = shards.with_answers(plain, estimates, "estimates")
    earlier = shards.trip(plain, ask_first, functools.partial(settle_first, kind="S16", ties=False), spread)
    plain = shards.with_answers(plain, earlier, "earlier")

    def cut(batches):
        for batch in batches:
            for row in plain_rows(batch):
                s = Shard(row, window)
                hit, group, first, _, edge = s.candidates(spread)
                again = np.zeros(len(first), np.uint8)
                fill(again, edge, row["earlier"], np.unpackbits)
                order = s.order[s.doc[s.at[hit]]]
                gone = s.at[hit[(order > order[first][group]) | (again[group] == 1)]] if len(hit) else hit
                d = np.zeros(len(s.doc) + 1, np.int64)
                d[gone] += 1
                d[gone + window] -= 1
                left = np.cumsum(d[:-1]) == 0
                keep = np.zeros(len(s.blob) + 1, np.int8)
                keep[s.begin[left]] += 1
                keep[s.end[left]] -= 1
                keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
                kept_doc = s.doc[left]
                gap = s.end[left][:-1][kept_doc[1:] == kept_doc[:-1]]  # the byte after a word that another kept word follows
                keep[gap] = True
                text = np.where(SPACE[s.blob], np.uint8(32), s.blob)
                n = len(s.lens)
                yield pa.RecordBatch.from_arrays(
                    [row["ids"], pa.array(np.bincount(s.doc, minlength=n)), pa.array(np.bincount(s.doc[~left], minlength=n)), _texts(text, keep, s.lens).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return plain.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(0, len(w) - 49)) as i from d),
k as (select doc_id, i, array_to_string(w[i + 1:i + 50], ' ') as s from p),
f as (select s, min(doc_id) as m from k group by s having count(distinct doc_id) > 1),
g as (select doc_id, i from k join f using (s) where doc_id > m),
gone as (select distinct doc_id, i + j as pos from g, range(50) t(j)),
l as (select doc_id, list(pos) as places from gone group by doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.pos) as t from words anti join gone on words.doc_id = gone.doc_id and words.pos = gone.pos group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join l using (doc_id) left join kept using (doc_id)
"""
