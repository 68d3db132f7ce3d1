"""Short benchmark items, verbatim and paraphrased, inside longer documents; recall of the cosine search."""
import random

import numpy as np

from sparkloom.llm import decontam


def n_words(text):
    b = np.frombuffer(text.encode(), np.uint8)
    return len(decontam.Words(b, np.array([len(b)])).hash)


def test_short_items(spark):
    r = random.Random(12)
    items = [x.text.split() for x in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    items = [w[: 15 + k % 11] for k, w in enumerate(items) if n_words(" ".join(w[:15])) == 15]
    hosts = [x.text.split() for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(200).collect()]
    docs, want = [], set()
    for k, item in enumerate(items):
        for planted in (item, [w for at, w in enumerate(item) if at % 5 != 1]):
            host = r.choice(hosts)
            at = r.randint(60, len(host) - 60) if len(host) > 120 else len(host) // 2
            want.add((len(docs), k))
            docs.append(host[:at] + planted + host[at:])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()}
    print("missed", len(want - got), "of", len(want), "more", len(got - want))
    assert want <= got


def test_recall_against_all_pairs(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    axes = decontam.fit(docs)
    every = {(x.doc_id, x.item_id): x.share for x in decontam.matches(docs, items, axes, -2).collect()}
    found = {(x.doc_id, x.item_id): x.share for x in decontam.matches(docs, items, axes).collect()}
    print("found", len(found), "of", len(every))
    assert len(every) > 10 and found.items() <= every.items() and len(found) >= 0.9 * len(every)


def test_ids_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, item, "x"), (None, "said " + item + " so", "y"), (3, None, "z"), (3, "", "z"), (4, "z " * 200_000 + item, "w"), (5, "other words", "w"), (5, item, "w")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(big, item, 1), (None, None, 2), (None, item, 3)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(docs, b).collect()}
    assert got == {(d, i) for d in (big, None, 4, 5) for i in (big, None)}
