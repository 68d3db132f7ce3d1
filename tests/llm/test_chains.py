"""A large group of near copies beyond the radius of the fingerprints is joined by pairs linear in its texts."""
import random

import numpy as np
import pandas as pd
from sparkloom.llm import jaccard
from test_pipeline import vocabulary


def test_pairs_of_a_large_group(spark, monkeypatch):
    r = random.Random(12)
    voc = vocabulary(r, 3000)
    base, texts = [r.choice(voc) for _ in range(200)], []
    for _ in range(240):
        w = list(base)
        for k in r.sample(range(len(w)), 2):
            w[k] = r.choice(voc)
        texts.append(" ".join(w))
    met, meeting = spark.sparkContext.accumulator(0), jaccard._meeting

    def counted(batches):
        for pdf in meeting(batches):
            met.add(len(pdf))
            yield pdf

    monkeypatch.setattr(jaccard, "_meeting", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert jaccard.Copies(docs).groups().select("group").distinct().count() == 1
    assert met.value < 5 * len(texts)


def test_chains_across_batches():
    rows = [(k, 0, row, 10, 0) for k, n in ((1, 5), (2, 1), (3, 4)) for row in range(10 * k, 10 * k + n)] + [(3, 1, 50, 10, 0), (3, 1, 51, 100, 0), (3, 1, 52, 10, 9)]
    pdf = pd.DataFrame(rows, columns=["key", "tile", "row", "n", "pos"])
    want = {(x, x + d) for a, b in ((10, 15), (30, 34)) for d in (1, 2) for x in range(a, b - d)}
    for size in (1, 2, 3, 20):
        got = [tuple(x) for p in jaccard._chained(iter([pdf.iloc[k : k + size] for k in range(0, len(pdf), size)])) for x in p.to_numpy().tolist()]
        assert sorted(got) == sorted(want)


def test_keys_that_start_chains():
    key = np.array([5, 3, 1 << 49, 7, 3], np.uint64)
    assert jaccard._after(np.array([0, 0, 0, 1, 0]), key).tolist()[2:4] == [0, 0]
    assert sorted(jaccard._after(np.array([0, 0, 0]), key[:3]).tolist()) == [-1, 0, 5]
    assert jaccard._after(np.zeros(0, np.int64), np.zeros(0, np.uint64)).tolist() == []


def test_a_pair_is_given_once():
    r = random.Random(13)
    docs, rows, want = [sorted(r.sample(range(12), r.randint(1, 7))) for _ in range(12)], [], set()
    for row, keys in enumerate(docs):
        doc, key = np.zeros(len(keys), np.int64), np.array(keys)
        rows += [(k, 0, 0, 0, row, 1, 0, row, *e) for k, *e in zip(keys, *(x.tolist() for x in jaccard._early(doc, key)))]
        want |= {(a, row) for a in range(row) if set(docs[a]) & set(keys)}
    pdf = pd.DataFrame(sorted(rows), columns=["key", "lo", "hi", "i", "row", "n", "pos", "c", *jaccard.EARLY])
    by_key = [p for _, p in pdf.groupby("key")]
    got = [tuple(x) for p in by_key for q in jaccard._meeting(iter([p])) for x in q.to_numpy().tolist()]
    assert set(got) == want
    early = [set(d[: len(jaccard.EARLY)]) for d in docs]
    assert all(got.count((a, b)) == 1 for a, b in want if early[a] & early[b])
