"""The most frequent words against plain counts, where no shard holds them among its own most frequent ones."""
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import lmscore
from sparkloom.llm.common import Shards


def test_words_rare_in_every_shard(spark):
    # each text has 4200 words of its own three times, and two words twice that all texts share
    texts = [" ".join([f"w{k}x{i}" for i in range(4200)] * 3 + ["all", "both"] * 2) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = Shards(docs, lmscore._make, "token binary, vocab binary, n binary, size binary", 1 << 10, flags=F.lit(True))
    got = lmscore._seeds(shards.rows)
    want = lmscore._make(np.frombuffer(b"all both", "u1"), np.array([8]), [0], [True])["vocab"]
    assert set(got[:2].tolist()) == set(np.frombuffer(want, "u8").tolist()) - {int(lmscore.END)}
    assert len(got) == lmscore.SEEDS
