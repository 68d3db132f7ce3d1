"""Brown class-based n-grams: exchange clustering, class transitions and word emissions, smoothed log10 scores and perplexity.

Documents are packed in shards of token numbers with a dictionary for each shard, staged once. The SEEDS most frequent
words are clustered by sequential exchange: a word moves to the class that raises the class-bigram likelihood most, until
no word moves; only their SEEDS x SEEDS counts reach the driver. Every other word of the corpus then makes its exchange
move by its left and right class contexts over all training documents, in buckets by word hash, so the vocabulary is a
table and never on the driver or in a broadcast; ties go to the least class. The shards get their words' counts and
classes back; transitions of all classes are counted over all training documents.
A token has probability P(class | class before) P(word | class): transitions are smoothed towards the class frequencies,
emissions give up an absolute discount, and what they give up is the probability of an unknown word, which is one more
type. After an unknown word the classes have their frequencies.
Words are known by a 64-bit hash. Null and empty texts are one end token; an empty table gives no rows; without training
rows all tokens are unknown and have score 0; null ids train; repeated rows count each time; extra columns are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import LOWER, Rolling, Shards, add_up, fill, plain_rows, route, split_by, table, trim, word_spans

CLASSES = 32
SEEDS = 512
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
PRIOR = 5.0
END = np.uint64(0xFFFFFFFFFFFFFFFF)
OTHER = CLASSES  # the context class of all words but the seeds while these words have no class
WIDE = CLASSES + 1
NONE = 255


def _make(blob, lens, ids, flags):
    b = LOWER[blob]
    begin, end, doc = word_spans(b, lens)
    size = np.bincount(doc, minlength=len(lens)) + 1
    token = np.full(int(size.sum()), END, np.uint64)
    token[np.arange(len(doc)) + doc] = Rolling(b)(begin, end)
    vocab, at = np.unique(token, return_inverse=True)
    n = np.bincount(at[np.repeat(np.array(flags, bool), size)], minlength=len(vocab))
    return {"token": at.astype(np.uint32).tobytes(), "vocab": vocab.tobytes(), "n": n.astype(np.uint32).tobytes(), "size": size.astype(np.uint32).tobytes()}


class Shard:
    """Tokens of a staged shard as places in its dictionary."""

    def __init__(self, row):
        self.row = row
        self.token, self.vocab, self.n = row["token"].view(np.uint32), row["vocab"].view(np.uint64), row["n"].view(np.uint32)
        self.size = row["size"].view(np.uint32).astype(np.int64)
        self.train = np.repeat(row["flags"].to_numpy(zero_copy_only=False).astype(bool), self.size)
        self.begin = np.cumsum(self.size) - self.size

    def before(self, of_token, end):
        """The value before each token; end stands before a text's first token."""
        p = np.empty_like(of_token)
        p[1:] = of_token[:-1]
        p[self.begin] = end
        return p

    def seeds(self, seeds, values, other, end):
        """values of the dictionary's words that are seeds, end for the end token, other for the rest."""
        out = np.full(len(self.vocab), other, np.int64)
        if len(seeds):
            at = np.minimum(np.searchsorted(seeds, self.vocab), len(seeds) - 1)
            hit = seeds[at] == self.vocab
            out[hit] = values[at[hit]]
        out[self.vocab == END] = end
        return out

    def by_bucket(self, spread):
        return split_by(route(self.vocab, spread), spread)

    def known(self, spread):
        """Training count and class of each word of the dictionary."""
        order, edge = self.by_bucket(spread)
        both = np.zeros((len(order), 9), np.uint8)
        both[:, 8] = NONE
        fill(both, edge, self.row["words"], lambda d: d.reshape(9, -1).T)
        n, c = np.zeros(len(order), np.int64), np.empty(len(order), np.int64)
        n[order], c[order] = np.ascontiguousarray(both[:, :8]).view(np.int64).ravel(), both[:, 8]
        return n, c


def likelihood_terms(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(n, classes=CLASSES, sweeps=30):
    """Class of each word by exchange on bigram counts n, in which the last two rows are the other words and the end."""
    words, f = len(n) - 2, likelihood_terms
    cls = np.r_[np.arange(words) % (classes - 1) + 1, classes, 0]
    one = np.zeros((len(n), classes + 1))
    one[np.arange(len(n)), cls] = 1
    m = one.T @ n @ one
    for _ in range(sweeps):
        moved = False
        for w in range(words):
            best, m = best_class(n, m, cls, w, classes)
            moved |= best != cls[w]
            cls[w] = best
        if not moved:
            break
    return cls, m


def best_class(n, m, cls, w, classes):
    """The class in which word w gives the greatest class-bigram likelihood (the least one of equals), and the counts then."""
    f, own, k = likelihood_terms, n[w, w], np.arange(classes + 1)
    right, left = np.bincount(cls, n[w], classes + 1), np.bincount(cls, n[:, w], classes + 1)
    right[cls[w]] -= own
    left[cls[w]] -= own
    m = m.copy()
    m[cls[w]] -= right
    m[:, cls[w]] -= left
    m[cls[w], cls[w]] -= own
    rows, cols, diag = f(m + right) - f(m), f(m + left[:, None]) - f(m), m[k, k]
    gain = rows.sum(1) - rows[k, k] + cols.sum(0) - cols[k, k] + f(diag + right + left + own) - f(diag)
    a, b = m.sum(1) + left, m.sum(0) + right  # every other class keeps the word as a neighbour
    gain -= f(a + right.sum() + own) - f(a) + f(b + left.sum() + own) - f(b)
    best = int(np.argmax(np.round(gain[1:classes], 6))) + 1
    m[best] += right
    m[:, best] += left
    m[best, best] += own
    return best, m


def _seeds(rows):
    """The most frequent words (hashes, by rank): every shard gives the counts of all its words, so the totals are exact."""
    def counts(batches):
        for batch in batches:
            for row in plain_rows(batch):
                vocab, n = row["vocab"].view(np.uint64), row["n"].view(np.uint32)
                at = np.flatnonzero((n > 0) & (vocab != END))
                yield pa.RecordBatch.from_arrays([pa.array(vocab[at].view(np.int64)), pa.array(n[at].astype(np.int64))], ["h", "n"])
        trim()

    got = rows.select("vocab", "n").mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(SEEDS).toArrow()
    return got["h"].to_numpy().view(np.uint64)


def _bigrams(rows, seeds):
    wide = len(seeds) + 2
    order = np.argsort(seeds)

    def count(batches):
        out = np.zeros(wide * wide)
        for batch in batches:
            for row in plain_rows(batch):
                s = Shard(row)
                c = s.seeds(seeds[order], order, wide - 2, wide - 1)[s.token]
                out += np.bincount((s.before(c, wide - 1) * wide + c)[s.train], minlength=wide * wide)
        return out

    return add_up(rows, count, wide * wide).reshape(wide, wide)


def _ask_words(row, seeds, cls, spread):
    """Words of the dictionary by bucket, with training counts and, but for seeds, the classes around them."""
    s = Shard(row)
    c = s.seeds(seeds, cls, OTHER, 0)
    of = c[s.token]
    left = s.token.astype(np.int64) * (2 * WIDE) + s.before(of, 0)
    inner = np.ones(len(of), bool)
    inner[s.begin] = False
    at = np.flatnonzero(inner & s.train)
    right = s.token[at - 1].astype(np.int64) * (2 * WIDE) + WIDE + of[at]
    left = left[s.train]
    key, n = np.unique(np.concatenate([left[c[left // (2 * WIDE)] == OTHER], right[c[right // (2 * WIDE)] == OTHER]]), return_counts=True)
    word = key // (2 * WIDE)
    order, edge = s.by_bucket(spread)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[word], kind="stable")
    word, ctx, n = rank[word][by], (key % (2 * WIDE))[by].astype(np.uint8), n[by].astype(np.uint32)
    many = np.bincount(word, minlength=len(order)).astype(np.uint8)
    inside = np.searchsorted(word, edge)
    for b in np.flatnonzero(np.diff(edge)).tolist():
        o, i = slice(edge[b], edge[b + 1]), slice(inside[b], inside[b + 1])
        head = np.array([edge[b + 1] - edge[b], inside[b + 1] - inside[b]], np.uint32)
        yield b, b"".join(x.tobytes() for x in (head, s.vocab[order[o]], s.n[order[o]], many[o], ctx[i], n[i]))


def _settle_words(asked, seeds, cls, gain):
    """Counts and classes of the words of a bucket, and sums over its words for each class."""
    parts, sizes = [], []
    for _, d in asked:
        m, e = np.frombuffer(d, np.uint32, 2).tolist()
        at, out = 8, []
        for kind, k in (("u8", m), ("u4", m), ("u1", m), ("u1", e), ("u4", e)):
            out.append(np.frombuffer(d, kind, k, at))
            at += out[-1].nbytes
        parts.append(out)
        sizes.append(m)
    vocab, n, many, ctx, times = (np.concatenate(x) for x in zip(*parts))
    words = np.unique(vocab)
    place = np.searchsorted(words, vocab)
    total = np.bincount(place, n, len(words)).astype(np.int64)
    around = np.bincount(np.repeat(place, many) * (2 * WIDE) + ctx, times, len(words) * 2 * WIDE).reshape(len(words), 2 * WIDE)
    c = np.argmax(np.round((around @ gain)[:, 1:], 6), axis=1) + 1
    if len(seeds):
        at = np.minimum(np.searchsorted(seeds, words), len(seeds) - 1)
        c = np.where(seeds[at] == words, cls[at], c)
    c[words == END] = 0
    c[total == 0] = NONE
    for (s, _), p in zip(asked, np.split(place, np.cumsum(sizes)[:-1])):
        yield s, np.concatenate([np.ascontiguousarray(total[p].view(np.uint8).reshape(-1, 8).T).ravel(), c[p].astype(np.uint8)]).tobytes()
    has = total > 0
    sums = [np.bincount(c[has], total[has], CLASSES), np.bincount(c[has], minlength=CLASSES), [(total == 1).sum(), (total == 2).sum()]]
    yield -1 - int(words[0] & np.uint64(1023)), np.concatenate(sums).astype(np.float64).tobytes()


def _sums(answers):
    def run(batches):
        out = np.zeros(2 * CLASSES + 2)
        for batch in batches:
            for got in batch.column("got").to_pylist():
                for a in got:
                    out = out + np.frombuffer(a["data"])
        return out

    return add_up(answers.where("shard < 0").select("got"), run, 2 * CLASSES + 2)


def score(docs, train):
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs(doc_id, text).

    The boolean column expression train names the rows to learn from; null is false.
    """
    shards = Shards(docs, _make, "token binary, vocab binary, n binary, size binary", SHARD_BYTES, flags=F.coalesce(train, F.lit(False)))
    spread = max(1, -(-shards.bytes // BUCKET_BYTES))
    rows = shards.rows.select("shard", "ids", "flags", "token", "vocab", "n", "size")
    ranked = _seeds(rows)
    cls, m = exchange(_bigrams(rows, ranked))
    order = np.argsort(ranked)
    seeds, cls = ranked[order], cls[: len(ranked)][order]
    # the gain of a word's move to each class, from the classes before it and after it
    a, b = m.sum(1, keepdims=True) + 1, m.sum(0, keepdims=True) + 1
    g = np.log((m + 0.5) / (a * b))
    gain = np.concatenate([g, g.T])[:, :CLASSES]
    words = shards.trip(rows, lambda row: _ask_words(row, seeds, cls, spread), lambda asked: _settle_words(asked, seeds, cls, gain), spread)
    rows = shards.with_answers(rows, words, "words")
    sums = _sums(words)
    in_class, types, (n1, n2) = sums[:CLASSES], sums[CLASSES : 2 * CLASSES], sums[2 * CLASSES :]
    total, size = int(in_class.sum()), int(types.sum())

    def transitions(batches):
        out = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            for row in plain_rows(batch):
                s = Shard(row)
                c = s.known(spread)[1][s.token]
                out += np.bincount((s.before(c, 0) * CLASSES + c)[s.train], minlength=CLASSES * CLASSES)
        return out

    m = add_up(rows, transitions, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    share = m.sum(0) / max(m.sum(), 1)
    step = np.vstack([(m + PRIOR * share) / (m.sum(1, keepdims=True) + PRIOR), share])
    off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    missing = step @ (off * types / np.maximum(in_class, 1)) if total else np.ones(WIDE)

    def run(batches):
        with np.errstate(divide="ignore"):
            log_step, log_missing = np.log10(step), np.log10(missing)
        for batch in batches:
            for row in plain_rows(batch):
                s = Shard(row)
                n, c = s.known(spread)
                has = n > 0
                c = np.where(has, c, CLASSES)
                emit = np.zeros(len(n))
                emit[has] = np.log10((n[has] - off) / in_class[c[has]])
                base = np.log10((n + 1) / (total + size + 1.0))
                of = c[s.token]
                p = s.before(of, 0 if total else CLASSES)
                hit = of < CLASSES
                each = log_missing[p]
                each[hit] = log_step[p[hit], of[hit]] + emit[s.token[hit]]
                add = lambda x: np.add.reduceat(x, s.begin)
                whole = add(each)
                yield pa.RecordBatch.from_arrays(
                    [row["ids"], row["flags"], pa.array(s.size), pa.array(add(hit.astype(np.int64))), pa.array(np.full(len(s.size), total)), pa.array(add(base[s.token])), pa.array(whole), pa.array(10 ** (-whole / s.size))],
                    ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(docs, ~held).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


SQL = None
