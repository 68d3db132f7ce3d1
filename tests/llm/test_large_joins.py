"""Joins whose rows grow with the input are never broadcast, however small their files are."""
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, simhash
from sparkloom.llm.common import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven "), (F.col("id") % 20).cast("string")).alias("text"))


def test_simhash_keys(spark):
    fps = staged(spark.range(2000).select(F.col("id").alias("fp")))
    assert "Broadcast" not in plan(simhash.links(fps))
    out = simhash.near_duplicates(docs(spark))
    assert "Broadcast" not in plan(out) and out.count() == 60


def test_groups_of_copies(spark):
    copies = jaccard.Copies(docs(spark))
    groups = copies.groups()
    assert "Broadcast" not in plan(groups) and groups.count() == 60
    assert "Broadcast" not in plan(copies.firsts())
