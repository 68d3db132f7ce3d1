"""Pipeline stages on small rows: near copies by exact similarity, null ids, repeated ids, texts in no known language."""
import random

import corpus_pipeline
from sparkloom.llm import jaccard, langid

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], ROWS).repartition(3)


def test_near_groups(spark, monkeypatch):
    r = random.Random(8)
    voc = vocabulary(r, 3000)
    texts = [None, "", " \n", "one two", "ONE  two", "a b c d e", "a b c d e f"]
    common = [r.choice(voc) for _ in range(12)]
    for _ in range(6):
        base = [r.choice(voc) for _ in range(r.randint(60, 250))]
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for k in r.sample(range(len(w)), edits):
                w[k] = "zz"
            texts.append(" ".join(w + common))
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                    want[i] = min(want[i], want[j])
    assert 12 < len(set(want)) < len(texts) - 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for tile, size in ((jaccard.TILE, jaccard.SHARD_BYTES), (3, 3000)):
        monkeypatch.setattr(jaccard, "TILE", tile)
        monkeypatch.setattr(jaccard, "SHARD_BYTES", size)
        copies = jaccard.Copies(docs)
        ids = {(r.shard << 14) + k: i for r in copies.rows.collect() for k, i in enumerate(r.ids)}
        groups = {}
        for x in copies.groups().collect():
            groups.setdefault(x.group, set()).add(ids[x.row])
        expected = {}
        for i, g in enumerate(want):
            expected.setdefault(g, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
        assert sorted(x.doc_id for x in copies.firsts().collect()) == sorted(set(want))
    assert jaccard.Copies(docs.limit(0)).firsts().count() == 0


def test_near_dedup_stage(spark):
    r = random.Random(9)
    voc = vocabulary(r, 3000)
    prose = lambda n: [r.choice(voc) for _ in range(n)]
    base = prose(300)
    near = [w if k % 55 != 30 else "zz" for k, w in enumerate(base)]
    other, lone, one, two = (" ".join(prose(50)) for _ in range(4))
    rows = [(7, " ".join(base)), (9, " ".join(near)), (None, other), (None, other), (None, " ".join(base)), (3, lone), (3, lone), (4, one), (4, two)]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect()
    assert sorted((x.doc_id or -1, x.text) for x in got) == sorted([(7, rows[0][1]), (-1, other), (3, lone), (4, one), (4, two)])


def test_repeated_ids_keep_their_texts(spark):
    r = random.Random(10)
    voc = vocabulary(r, 3000)
    one, two, three = (" ".join(r.choice(voc) for _ in range(40)) for _ in range(3))
    rows = [(1, one), (1, two), (1, one + " " + three), (None, two + " end"), (None, None)]
    got = {x.source: x for x in corpus_pipeline.suffix_dedup(spark, frame(spark, rows), None).collect()}
    assert len(got) == 5 and sum(x.text == one for x in got.values()) == 1
    assert got["s1"].text in (two, "") and got["s4"].text is None
    assert three in got["s2"].text and got["s2"].n_chars == len(got["s2"].text)


def test_whole_characters_and_own_marks(spark):
    lone = "keep\ufffdme \u00e9"
    shared = "x" * 99 + "\u00e9" * 40
    rows = [(1, shared + " one"), (2, "\u00ea" + shared[5:] + "\ufffd two"), (2**53 + 1, lone), (None, "")]
    got = {x.source: x for x in corpus_pipeline.suffix_dedup(spark, frame(spark, rows), None).collect()}
    assert got["s0"].text == rows[0][1] and got["s2"].text == lone and got["s2"].doc_id == 2**53 + 1 and got["s3"].text == ""
    assert got["s1"].text == "\u00ea\ufffd two" and got["s1"].n_chars == len(got["s1"].text)


def test_null_ids_through_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    text = docs.where("doc_id is not null and lang = 'en' and length(text) > 400").orderBy("doc_id").first().text
    mine = " ".join(sorted(text.split(), key=lambda w: (len(w), w)))
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    more = spark.createDataFrame([(None, mine, "en", "web", len(mine)), (None, text + " " + item, "en", "web", 0)], docs.schema)
    docs.unionByName(more).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), None)
    assert got.where("doc_id is null").count() >= 2
    rows = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is null").collect()
    assert len(rows) >= 1
    left = corpus_pipeline.decontaminate(spark, more, "/root/testdata/sf0.001").collect()
    assert [x.text for x in left] == [mine]


def test_unlike_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null")
    held = docs.where("pmod(hash(doc_id), 10) = 3")
    model = langid.fit(docs.where("pmod(hash(doc_id), 10) <> 3"))
    assert held.count() - langid.predict(held, model).where("not rejected").count() <= 0.02 * held.count()
    r = random.Random(11)
    odd = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60)) for _ in range(100)]
    odd += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
            "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."]
    got = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert all(x.rejected for x in got)
