"""Documents to a training mix in five stages; each stage reads what its predecessor wrote.

Each stage judges rows and not ids: null ids stay through every filter, and of the rows of one near-copy group one stays,
also where they repeat a doc_id. Null and empty texts are rejected by the first stage, since no language shows; an empty
table gives no rows; columns beyond those of documents are left out at the start, so none can clash.
"""
from pyspark.sql import functions as F

from sparkloom.llm import decontam, jaccard, langid, mixing, suffix
from sparkloom.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs, sf_dir):
    """Rejected documents (no letters, or unlike every language) go; lang becomes the prediction."""
    docs = docs.select(*COLUMNS)
    p = langid.predict(docs, langid.fit(docs), carry=("source", "n_chars")).where("not rejected")
    return p.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One row of each group of near copies (5-word Jaccard >= 0.8) stays: the smallest id, null ids last, then the first text."""
    own = F.struct(F.col("text").isNull().alias("bare"), "lang", "source", "n_chars")
    kept = jaccard.Copies(docs, F.to_json(own)).firsts().withColumn("own", F.from_json("carried", docs.select(own.alias("c")).schema[0].dataType))
    return kept.select("doc_id", F.when(~F.col("own.bare"), F.col("text")).alias("text"), "own.lang", "own.source", "own.n_chars").select(*COLUMNS)


def suffix_dedup(spark, docs, sf_dir):
    """Repeated 100-byte strings go from the texts; characters that lose a byte go whole. Each row keeps its own columns."""
    d = suffix.dedup(docs, carry=("text is null as bare", "lang", "source", "n_chars")).select("*", "carried.*")
    d = d.withColumn("text", F.when(~F.col("bare"), F.col("kept_text")))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark, docs, sf_dir):
    """Documents with a verified benchmark passage go."""
    # the verdict hangs on the text alone, so it is carried back by the text's hash; ids may be null or repeat
    bad = decontam.matches(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(bad.select(F.col("doc_id").alias("h")).distinct(), F.xxhash64("text") == F.col("h"), "left_anti").select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """All documents with their place in the mix."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("mix_sources", mix)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
