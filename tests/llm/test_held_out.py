"""Held-out scores of the language model."""
from sparkloom.llm import lmscore


def test_classes_beat_the_unigram_base(spark):
    got = lmscore.query(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
    print("held-out log10 per token", got)
    assert got.s > got.b + 0.02
