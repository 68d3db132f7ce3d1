"""Benchmark decontamination by latent semantic retrieval.

Document passages are TF-IDF rows over hashed terms (a term counts once in a chunk); a distributed randomised SVD over all documents gives latent axes, in
which passages are folded with common directions damped by the singular values.
Benchmark passages and document windows meet in these axes: pairs of a cosine of at least NEAR are candidates. A candidate
is kept if the words that both hold leave it possible, and then if the longest common subsequence of the benchmark passage
and the window with its neighbourhood covers SHARE of the passage, or SHARE_WITH_ANSWER where the item's last words, its
answer, stand there as they are. Passages of up to SHORT words meet windows of SHORT words, longer ones windows of WINDOW;
items longer than a window are cut in overlapping passages. The benchmark is the stated query set, taken in blocks of BLOCK
passages, so what is broadcast is bounded.
Of several windows the one with the greatest share counts, the first of equals. Null and empty texts match nothing; null
item and document ids keep their matches under null; repeated rows match alike; empty tables give no matches; extra
columns are ignored; whole texts of any length are searched. Words are known by a 64-bit hash.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Rolling, add_up, raw, runs_of, table, trim, word_spans

CHUNK = 12
SHORT = 24
WINDOW = 48
ITEM_STRIDE = 16
TERM_BITS = 15
RANK = 48
NEAR = 0.4
SHARE = 0.6
SHARE_WITH_ANSWER = 0.45
ANSWER_WORDS = 5
BLOCK = 1 << 16
GROUP_BYTES = 1 << 20
FOLD = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
FOLD[65:91] += 32


class Words:
    """Word hashes of texts that follow one another in b, their documents, and their chunks of so many words."""

    def __init__(self, b, lens):
        b = FOLD[b]
        begin, end, self.doc = word_spans(b, lens)
        self.hash = Rolling(b)(begin, end)
        self.term = (self.hash >> np.uint64(64 - TERM_BITS)).astype(np.int64)
        self.size = np.bincount(self.doc, minlength=len(lens))

    def chunks(self, words):
        """Chunk of each word, first word of each chunk, and whether the chunk after it is of the same text."""
        inside = np.arange(len(self.doc)) - (np.cumsum(self.size) - self.size)[self.doc]
        first = np.flatnonzero(inside % words == 0)
        doc = self.doc[first]
        return np.cumsum(inside % words == 0) - 1, first, np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)

    def once(self, chunk):
        """Places of the words whose term is not there earlier in the chunk: a term counts once, or junk would drown a passage."""
        key = chunk << TERM_BITS | self.term
        if len(key) < 1 << 24:  # the place fits below the key, and a sort is cheaper than an order
            key = np.sort(key << 24 | np.arange(len(key)))
            return np.sort(key[runs_of(key >> 24)] & ((1 << 24) - 1))
        by = np.argsort(key)
        keep = np.ones(len(key), bool)
        keep[by[1:]] = key[by[1:]] != key[by[:-1]]
        return np.flatnonzero(keep)


def _groups(batches):
    """(first row, Words, batch) of consecutive texts of about GROUP_BYTES."""
    for batch in batches:
        data, begin, lens = raw(batch.column("text"))
        lo = 0
        for cut in [*np.flatnonzero(np.diff(np.cumsum(lens) // GROUP_BYTES)).tolist(), len(lens) - 1] if len(lens) else []:
            if cut + 1 > lo:
                part = lens[lo : cut + 1]
                w = Words(data[begin[lo] : begin[lo] + part.sum()], part)
                if len(w.doc):
                    yield lo, w, batch
                lo = cut + 1


def fit(docs, rank=RANK, seed=5):
    """Latent axes weighted by inverse document frequency, and these weights: one pass for frequencies, one for the sketch.

    A passage here is a chunk of 24 words with the chunk after it. The driver gets arrays of fixed size.
    """
    size, texts = 1 << TERM_BITS, docs.select(F.col("text").cast("binary").alias("text"))

    def frequencies(batches):
        out = np.zeros(size + 1)
        for _, w, _ in _groups(batches):
            chunk, first, joined = w.chunks(SHORT)
            before = np.append(False, joined)[chunk]
            key = np.concatenate([chunk * size + w.term, (chunk[before] - 1) * size + w.term[before]])
            key.sort()
            out[:size] += np.bincount(key[runs_of(key)] % size, minlength=size)
            out[size] += len(first)
        return out

    f = add_up(texts, frequencies, size + 1)
    idf = np.log((1 + f[size]) / (0.5 + f[:size]))  # above zero also for a term that all passages hold
    omega = padded((np.random.default_rng(seed).normal(size=(size, rank)) * idf[:, None]).astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(omega)

    def sketch(batches):
        out = np.zeros((size, rank))
        for _, w, _ in _groups(batches):
            chunk, first, joined = w.chunks(SHORT)
            at = w.once(chunk)
            chunk, terms = chunk[at], w.term[at]
            y = chunk_sums(shared.value, terms, chunk, len(first), SHORT)
            y[:-1] += y[1:] * joined[:-1, None]
            z = y.copy()
            z[1:] += y[:-1] * joined[:-1, None]
            # each term gets the sum of the rows of the passages that hold it
            order = np.argsort(terms.astype(np.uint16), kind="stable")
            term = terms[order]
            start = runs_of(term)
            inside = np.arange(len(term)) - np.repeat(start, np.diff(np.r_[start, len(term)]))
            block = np.cumsum(inside % 8 == 0) - 1
            z = chunk_sums(padded(z), chunk[order], block, block[-1] + 1, 8)
            out[term[start]] += np.add.reduceat(z, block[start], axis=0)
        return out.ravel()

    # one-pass eigenvectors of the term products G = A'A from Y = G omega (Nystroem); passages fold in as A U / sigma
    omega = np.random.default_rng(seed).normal(size=(size, rank))
    y = add_up(texts, sketch, size * rank).reshape(size, rank) * idf[:, None]
    w, v = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    root = y @ (v / np.sqrt(np.maximum(w, 1e-9 * max(w.max(), 1e-9))))  # G = root root'
    square, turn = np.linalg.eigh(root.T @ root)
    sigma = np.sqrt(np.maximum(square, 1e-18))
    fold = 1 / (sigma * np.sqrt(sigma + sigma.mean() + 1e-9))  # half a whitening, damped, so that no lone difference is blown up
    axes = (root @ (turn * np.where(sigma > 1e-6 * sigma.max(), fold, 0)) * idf[:, None]).astype(np.float32)
    del y, root, omega
    trim()
    return axes, idf


def padded(axes):
    """The axes and a row of zeros for the places that a short chunk leaves."""
    return np.concatenate([axes, np.zeros((1, axes.shape[1]), np.float32)])


def chunk_sums(axes, term, chunk, n, width):
    """Sums of the axes' rows of the terms of each of n chunks; a chunk has at most width terms, and chunk is sorted."""
    first = np.searchsorted(chunk, np.arange(n))
    at = np.full((n, width), len(axes) - 1, np.int32)
    at[chunk, np.arange(len(chunk)) - first[chunk]] = term
    out = np.zeros((n, axes.shape[1]), np.float32)
    for lo in range(0, n, 1024):
        for column in at[lo : lo + 1024].T:
            out[lo : lo + 1024] += np.take(axes, column, axis=0)
    return out


def lcs(a, b):
    """Length of the longest common subsequence of two word lists, on bits of one integer."""
    place = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & place.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Vocabulary:
    """Numbers of the words of the benchmark; any other word has the number after the last."""

    def __init__(self, hashes):
        self.hashes = np.unique(hashes)
        self.slots, left = [], np.arange(len(self.hashes))
        while len(left):  # words that share a slot go on to a further table
            slot = np.full(1 << 18, len(self.hashes), np.int32)
            slot[self.hashes[left] >> np.uint64(46)] = left
            self.slots.append(slot)
            left = left[slot[self.hashes[left] >> np.uint64(46)] != left]

    def __call__(self, h):
        at, known = (h >> np.uint64(46)).astype(np.int64), np.r_[self.hashes, np.uint64(0)]
        out = np.full(len(h), len(self.hashes), np.int32)
        for slot in self.slots:
            place = slot[at]
            some = np.flatnonzero(place < len(self.hashes))
            some = some[known[place[some]] == h[some]]
            out[some] = place[some]
        return out


class Passages:
    """Benchmark passages of one kind: items, words by number, answers, unit latent vectors."""

    def __init__(self, rows, vocab, axes, idf, short):
        self.window, self.stride = (SHORT, CHUNK) if short else (WINDOW, SHORT)
        self.items = [r[0] for r in rows]
        self.length = np.array([len(r[1]) for r in rows])
        self.answers = [vocab(r[2]) for r in rows]
        self.words = np.full((len(rows), self.length.max()), len(vocab.hashes))
        for row, (_, h, _) in zip(self.words, rows):
            row[: len(h)] = vocab(h)
        self.parts = [row[:n].tolist() for row, n in zip(self.words, self.length)]
        self.last = np.stack([np.resize(a, ANSWER_WORDS) for a in self.answers])  # an answer of fewer words repeats
        # a window that holds enough of a passage's words holds one of its rarest: postings of these
        rare = []
        for k, (_, h, _) in enumerate(rows):
            by = np.argsort(-idf[(h >> np.uint64(64 - TERM_BITS)).astype(np.int64)], kind="stable")
            rare.append(np.stack([(mine := np.unique(vocab(h[by[: len(h) - int(np.ceil(SHARE_WITH_ANSWER * len(h) - 1e-9)) + 1]]))), np.full(len(mine), k)], 1))
        rare = np.concatenate(rare)
        rare = rare[np.argsort(rare[:, 0], kind="stable")]
        self.holders, self.bounds = rare[:, 1], np.searchsorted(rare[:, 0], np.arange(len(vocab.hashes) + 2))
        self.vectors = unit(np.stack([axes[np.unique((r[1] >> np.uint64(64 - TERM_BITS)).astype(np.int64))].sum(0) for r in rows]))


def _passages(block, axes, idf):
    rows = []
    for item, text in block:
        b = np.frombuffer((text or "").encode(), np.uint8)
        h = Words(b, np.array([len(b)])).hash
        for at in range(0, max(1, len(h) - WINDOW + ITEM_STRIDE), ITEM_STRIDE) if len(h) else []:
            at = max(0, min(at, len(h) - WINDOW))
            rows.append((item, h[at : at + WINDOW], h[-ANSWER_WORDS:]))
    vocab = Vocabulary(np.concatenate([np.concatenate(r[1:]) for r in rows])) if rows else None
    kinds = [[r for r in rows if (len(r[1]) <= SHORT) == short] for short in (True, False)]
    return vocab, [Passages(r, vocab, axes, idf, short) for r, short in zip(kinds, (True, False)) if r]


def _windows(w, axes):
    """First word, document and latent sums of all chunks."""
    chunk, first, joined = w.chunks(CHUNK)
    at = w.once(chunk)
    return first, w.doc[first], chunk_sums(axes, w.term[at], chunk[at], len(first), CHUNK), joined


def search(w, vocab, kinds, axes, near):
    """(document, item, cosine, share, answer) of all verified pairs of a group, window by window."""
    first, doc, part, joined = _windows(w, axes)
    ends = np.cumsum(w.size)
    begins = ends - w.size
    place = vocab(w.hash)
    for p in kinds:
        use = np.flatnonzero((first - begins[doc]) % p.stride == 0)
        x, on = part[use], np.ones(len(use), bool)
        for k in range(1, p.window // CHUNK):
            on &= joined[np.minimum(use + k - 1, len(part) - 1)]  # the last chunk of a text is not joined to a further one
            x += part[np.minimum(use + k, len(part) - 1)] * on[:, None]
        x = unit(x)
        step = max(64, (1 << 22) // len(p.items))
        for at in range(0, len(use), step):
            cos = x[at : at + step] @ p.vectors.T
            i, j = np.divmod(np.flatnonzero((cos >= near) & _rare(p, use[at : at + step], first, place)), len(p.items))
            if len(i):
                yield from _verify(p, len(vocab.hashes), first[use[at + i]], doc[use[at + i]], j, cos[i, j], place, begins, ends)


def _rare(p, use, first, place):
    """Whether the neighbourhood of each window (by its first chunk) holds one of the rarest words of each passage."""
    reach = p.stride // CHUNK
    lo, hi = max(0, use[0] - reach), min(len(first), use[-1] + p.window // CHUNK + reach)
    begin, end = first[lo], first[hi] if hi < len(first) else len(place)
    word = place[begin:end]
    n = p.bounds[word + 1] - p.bounds[word]
    at = np.flatnonzero(n)
    n, word = n[at], word[at]
    chunk = np.searchsorted(first[lo:hi], at + begin, "right") - 1
    has = np.zeros((hi - lo + p.window // CHUNK + 2 * reach, len(p.items)), bool)
    has[np.repeat(chunk + reach, n), p.holders[np.arange(n.sum()) + np.repeat(p.bounds[word] - np.cumsum(n) + n, n)]] = True
    out = has[use - lo]
    for k in range(1, p.window // CHUNK + 2 * reach):
        out |= has[use - lo + k]
    return out


def _verify(p, size, start, doc, part, cos, place, begins, ends):
    """Of candidates (first word of the window, passage), those whose words, and then whose order, cover enough."""
    lo, hi = np.maximum(start - p.stride, begins[doc]), np.minimum(start + p.window + p.stride, ends[doc])
    window = np.cumsum(np.r_[True, start[1:] != start[:-1]]) - 1
    edge = np.searchsorted(window, np.arange(0, window[-1] + 257, 256))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        at = window[a:b] - window[a]
        head = a + np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = hi[head] - lo[head]
        have = np.zeros((len(head), size + 1), bool)
        have[np.repeat(np.arange(len(head)), n), place[np.arange(n.sum()) + np.repeat(lo[head] - np.cumsum(n) + n, n)]] = True
        have[:, -1] = False  # words of no passage
        mine, flat = part[a:b], have.ravel()
        base = (at * (size + 1))[:, None]
        most = np.count_nonzero(flat[base + p.words[mine]], axis=1) / p.length[mine]
        open_ = np.flatnonzero(most >= SHARE_WITH_ANSWER)
        answers = flat[base[open_] + p.last[mine[open_]]].all(1)
        for k, has in zip(open_.tolist(), answers.tolist()):
            if not has and most[k] < SHARE:
                continue
            c, j = a + k, int(mine[k])
            near = place[lo[c] : hi[c]]
            share = lcs(p.parts[j], near.tolist()) / p.length[j]
            found = has and share >= SHARE_WITH_ANSWER and _contains(near, p.answers[j])
            if share >= SHARE or found:
                yield int(doc[c]), p.items[j], float(cos[c]), float(share), found


def _contains(words, answer):
    n = len(words) - len(answer) + 1
    return n > 0 and bool(np.all([words[k : k + n] == a for k, a in enumerate(answer)], axis=0).any())


RESULT = "doc_id long, item_id long, cosine double, share double, answer boolean"


def matches(docs, benchmark, model=None, near=NEAR):
    """(doc_id, item_id, cosine, share, answer): best verified match of each document and item."""
    spark = docs.sparkSession
    axes, idf = fit(docs) if model is None else model
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.bool_())])

    def found(block):
        vocab, kinds = _passages(block, axes, idf)
        if not kinds:
            return None
        shared = spark.sparkContext.broadcast((padded(axes), vocab, kinds))  # at most BLOCK passages and axes of fixed size

        def run(batches):
            axes, vocab, kinds = shared.value
            for lo, w, batch in _groups(batches):
                best = {}
                for doc, item, *rest in search(w, vocab, kinds, axes, near):
                    if rest[1] > best.get((doc, item), (0, 0))[1]:
                        best[doc, item] = rest
                ids = batch.column("doc_id")
                rows = [(ids[lo + doc].as_py(), item, *rest) for (doc, item), rest in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, RESULT)

    out, block, size = None, [], 0
    for r in [*benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator(), None]:
        if r is not None:
            block.append((r[0], r[1]))
            size += 1 + len(r[1] or "") // (2 * ITEM_STRIDE)
        if block and (r is None or size >= BLOCK):
            part = found(block)
            out = part if out is None else out if part is None else out.unionByName(part)
            block, size = [], 0
    return out if out is not None else spark.createDataFrame([], RESULT)


def query(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = None
