"""Language identification: averaged hashed subword embeddings, linear softmax, SGD in numpy, calibrated rejection.

The classifier is fitted on at most TRAIN_ROWS labelled rows (a documented bound); prediction reads every whole text.
Texts that are null or hold no letter give 'und' with score 0; null langs never train; without any labelled row all
texts give 'und'. Of equal scores the first class in the order of its name counts. Null ids keep their row; repeated rows
predict alike; extra columns are ignored; an empty table gives no rows; texts of any length are read whole, in pieces.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import bounded_batches, table, trim

TRAIN_ROWS = 4000
BUCKETS = 1 << 14
DIM = 16
PIECE = 1 << 16
QUANTILE = 0.001


def features(text):
    """Bucket frequencies of the 1- to 3-letter subwords of the lower-cased text, digits and punctuation as gaps; None without letters."""
    if not isinstance(text, str) or not any(c.isalpha() for c in text):
        return None
    total = np.zeros(BUCKETS, np.float64)
    low = text.lower()
    for at in range(0, len(low), PIECE):
        c = np.frombuffer(low[max(0, at - 2) : at + PIECE].encode("utf-32-le"), np.uint32).astype(np.uint64)
        c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint64(32), c)
        h = np.zeros(len(c), np.uint64)
        for n in (1, 2, 3):
            if len(c) >= n:
                h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
                new = h[3 - n :] if at else h  # what ends before the piece was counted with the piece before
                total += np.bincount(((new * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total / total.sum()


def sparse(text):
    """Non-zero buckets and their frequencies; None without letters."""
    f = features(text)
    if f is None:
        return None
    hit = np.flatnonzero(f)
    return hit.astype(np.int32), f[hit].astype(np.float32)


def _dense(rows, which):
    out = np.zeros((len(which), BUCKETS), np.float32)
    for i, k in enumerate(which):
        out[i, rows[k][0]] = rows[k][1]
    return out


def train(rows, langs, epochs=30, rate=8.0, seed=7):
    """Fit (classes, embedding, weights, bias, temperature, floor) on sparse rows; temperature and floor on a held fifth."""
    classes = sorted(set(langs))
    both = [(f, classes.index(y)) for f, y in zip(rows, langs) if f is not None]
    if not both:
        return None
    x, y = [f for f, _ in both], np.array([k for _, k in both])
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    hold = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    fit = np.flatnonzero(~hold)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            d = _dense(x, k)
            v = d @ e
            z = v @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(k)), y[k]] -= 1
            p /= len(k)
            back = p @ w.T
            w -= step / 4 * (v.T @ p)
            b -= step / 80 * p.sum(0)
            e -= step * 20 * (d.T @ back)
    check = np.flatnonzero(hold) if hold.any() else fit
    parts = np.array_split(check, max(1, len(check) // 256))
    z = np.concatenate([_dense(x, k) @ e @ w + b for k in parts])

    def prob(t):
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        return q / q.sum(1, keepdims=True)

    temperature = min((-np.log(prob(t)[np.arange(len(check)), y[check]] + 1e-12).mean(), t) for t in (0.25, 0.5, 1, 2, 4, 8))[1]
    # letters outside what training saw are the other sign that a text is none of the classes; each fifth is held against the rest
    def known(part):
        seen = np.zeros(BUCKETS, bool)
        for k in np.flatnonzero(~part):
            seen[x[k][0]] = True
        return seen, [x[k][1][seen[x[k][0]]].sum() for k in np.flatnonzero(part)]

    fifths = [np.arange(len(x)) % 5 == i for i in range(5)]
    share = np.concatenate([known(part)[1] for part in fifths])
    floor = {"seen": known(fifths[4])[0], "share": float(np.quantile(share, QUANTILE)), "score": float(np.quantile(prob(temperature).max(1), QUANTILE))}
    return classes, e, w, b, temperature, floor


def fit(docs, limit=TRAIN_ROWS):
    """Train on at most limit rows with a text and a lang, chosen by hash of the id.

    The hash cut is found on ids alone; the chosen whole texts become subword counts on the executors, so the driver gets
    at most limit rows of at most BUCKETS numbers, however long the texts are.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    cut = rows.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if cut is None:
        return None

    def count(batches):
        for pdf in batches:
            found = [(h, g, t, f) for h, g, t, f in zip(pdf.h, pdf.lang, pdf.t, map(sparse, pdf.text)) if f is not None]
            yield pd.DataFrame([(h, g, t, f[0], f[1]) for h, g, t, f in found], columns=["h", "lang", "t", "ids", "part"])

    chosen = rows.where(F.col("h") <= cut).withColumn("t", F.xxhash64("text")).mapInPandas(count, "h long, lang string, t long, ids array<int>, part array<float>")
    got = chosen.orderBy("h", "t", "lang").limit(limit).toArrow()
    model = train([(i.values.to_numpy(), p.values.to_numpy()) for i, p in zip(got["ids"], got["part"])], got["lang"].to_pylist())
    del got
    trim()
    return model


def predict(docs, model, carry=()):
    """Adds lang_pred, score and rejected to (doc_id); with carry, also to text and the named columns of the row."""
    names = ["doc_id", *(("text", *carry) if carry else ())]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS * DIM floats

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                f = features(t) if m else None
                if f is None:
                    out.append(("und", 0.0, True))
                    continue
                classes, e, w, b, temperature, floor = m
                hit = np.flatnonzero(f)
                z = ((f[hit] @ e[hit]) @ w + b) / temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                out.append((classes[int(p.argmax())], float(p.max()), bool(f[floor["seen"]].sum() < floor["share"] or p.max() < floor["score"])))
            found = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "lang_pred", "score", "rejected"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names[1:]).schema)
    kind = "doc_id long, " + (kind and kind + ", ") + "lang_pred string, score double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, kind)


def _held(parts):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == 2


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict(docs, fit(docs.where(~F.coalesce(_held(4), F.lit(False)))))
    return out.select("doc_id", F.coalesce(_held(4), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


SQL = None
