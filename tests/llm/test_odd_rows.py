"""Null and large ids, repeated rows and ids, clashing columns, empty and very long texts, for each operator on documents."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, embed, langid, lmscore, simhash, substring, suffix

BIG = 2**53 + 1
KIND = "doc_id long, text string, lang string, shard string, blob string, lens string, got string, h string, n string, token string, fp string, row string, rep string, label string"


def prose(r, n, voc=400):
    return " ".join("w" + str(r.randrange(voc)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    long, copy = prose(r, 60_000, 50_000), prose(r, 90)
    return [(None, copy), (None, copy), (BIG, copy), (BIG + 1, copy), (5, copy + " end"), (5, "start " + copy), (5, "start " + copy), (6, None), (6, ""), (7, " \t\n"), (8, long), (9, "x " + long), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", *["clash"] * 11) for i, t in rows], KIND).repartition(3)


def pairs(found):
    return sorted(found, key=repr)


def test_suffix(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1 << 18)
    got = suffix.dedup(frame(spark, rows)).collect()
    assert pairs((r.doc_id, r.n_bytes) for r in got) == pairs((i, len((t or "").encode())) for i, t in rows)
    # null ids come first: one of the two equal null rows keeps the passage, all later ones lose it
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0, len(rows[0][1])]
    assert all(r.n_removed >= len(rows[0][1]) for r in got if r.doc_id in (BIG, BIG + 1, 5))
    assert [bytes(r.kept) for r in got if r.doc_id == 9] == [b"x "] or [r.n_removed for r in got if r.doc_id == 9][0] >= len(rows[10][1])
    assert [r.n_removed for r in got if r.doc_id == 8] == [0]


def test_substring(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_BYTES", 1 << 18)
    got = substring.dedup(frame(spark, rows)).collect()
    assert pairs((r.doc_id, r.n_words) for r in got) == pairs((i, len((t or "").split())) for i, t in rows)
    removed = lambda i: sorted(r.n_removed for r in got if r.doc_id == i)
    assert removed(None) == [0, 0, 0] and removed(5) == [0, 0, 0]  # null ids and equal ids are never earlier
    assert removed(BIG) == removed(BIG + 1) == [90] and removed(9) == [60_000] and removed(8) == [0]
    assert [r.kept for r in got if r.doc_id == 9] == ["x"]


def test_lm(spark, rows):
    got = lmscore.score(frame(spark, rows), F.col("doc_id").isNull() | (F.col("doc_id") > 5)).collect()
    assert pairs((r.doc_id, r.n_tokens, r.train) for r in got) == pairs((i, len((t or "").split()) + 1, i is None or i > 5) for i, t in rows)
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) and r.n_known <= r.n_tokens for r in got)


def test_language(spark, rows):
    docs = frame(spark, rows)
    model = langid.fit(docs)
    got = langid.predict(docs, model, carry=("shard",)).collect()
    assert pairs((r.doc_id, r.text, r["shard"]) for r in got) == pairs((i, t, "clash") for i, t in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_pieces_count_no_subword_twice(monkeypatch):
    text = "Grüße aus Köln " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(langid.features(text), whole)


def test_simhash(spark, rows):
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert pairs((r.doc_id, r.fp) for r in got) == pairs((i, simhash.fingerprint(t)) for i, t in rows)
    comp = {(r.doc_id, r.fp): r.component_id for r in got}
    copy, none = simhash.fingerprint(rows[0][1]), 0
    assert comp[None, copy] == comp[BIG, copy] == comp[BIG + 1, copy]
    assert comp[None, none] == comp[6, none] == comp[7, none] == 6
    assert simhash.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c")])).agg(F.count("component_id"), F.count("*")).first()[:] == (0, 2)


def test_embeddings(spark):
    v, far = [1.0, 2.0, 3.0], [-1.0, 5.0, 0.0]
    data = [(None, v, 1), (BIG, v, 1), (BIG + 1, [1.0, 2.0, 3.001], 1), (None, far, 1), (None, far, 1), (3, far, 2), (4, v, 1), (4, [0.0, 0.0, 1.0], 1), (7, v, None), (8, [1.0, float("inf"), 0.0], 1)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in data], "vec_id long, embedding array<float>, label int, rep int, gid int, v int").repartition(2)
    got = pairs((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df).collect())
    assert got == pairs([(None, 3, 4, False), (BIG, 3, 4, False), (BIG + 1, 3, 4, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True), (4, 3, 4, True), (4, 0, 4, True), (7, 0, 7, True), (8, 0, 8, True)])


def test_bucket_of_a_shard_is_known(spark):
    x = np.array([0, 1, -5, 2**40 + 7, BIG, -(2**63)])
    assert [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "a long").select(F.hash("a")).collect()] == common.long_hash(x).tolist()
    numbers = common.shard_numbers(11, 7)
    first = np.array([next(numbers) for _ in range(20)])
    assert len(set(first.tolist())) == 20 and set((common.long_hash(first) % 7).tolist()) == {4}


def test_shards_do_not_move(spark, rows):
    """Joins on the shard number need no exchange of the shards."""
    s = common.Shards(frame(spark, rows), lambda blob, lens, ids, flags: {"blob": blob.tobytes()}, "blob binary", 1 << 16)
    answers = spark.createDataFrame([], "shard long, got array<struct<bucket:int,data:binary>>")
    plan = s.with_answers(s.rows, answers, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_hash_of_kept_text(spark, rows):
    out = substring.dedup(frame(spark, rows)).select(F.sha2(F.col("kept").cast("binary"), 256).alias("k"), "kept").collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.k for r in out)
