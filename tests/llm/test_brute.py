"""Operators of the training-data subpackage against brute force on small fixtures with nulls, ties and empties."""
import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontam, embed, langid, lmscore, mixing, simhash, substring, suffix, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int"


def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    shared, long = prose(70), prose(3000)
    near = prose(120).split()
    out = [None, "", "  \n", prose(5), "x" * 400, "ab" * 150, long, long[500:2500] + " " + long[:900], "12 34"]
    for k in range(12):
        out.append(prose(40) + " " + shared + "\t" + prose(30))
        w = list(near)
        w[k * 3] = "zz"
        out.append(" ".join(w))
    return out + [out[9], out[10], prose(300), "A b C d", "a B c D"]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 0, "clash", 1) for i, t in enumerate(rows)], DOCS).repartition(3)


def test_suffix(spark, monkeypatch):
    rows = texts()
    seen, want = set(), {}
    for i, t in enumerate(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        want[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g))
    for size in (suffix.SHARD_BYTES, 2000):
        monkeypatch.setattr(suffix, "SHARD_BYTES", size)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup(frame(spark)).collect()}
        assert got == want
    assert suffix.dedup(frame(spark, [])).count() == 0


def test_substring(spark):
    rows = texts()
    first, want = {}, {}
    for i, t in enumerate(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) < i:
                gone[s : s + 50] = [True] * 50
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(frame(spark)).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert substring.dedup(frame(spark, [])).count() == 0


def test_simhash(spark, monkeypatch):
    rows = texts()
    fps = []
    for t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = min(comp[i], comp[j])
    for tile in (simhash.TILE, 3):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame(spark)).collect()}
        assert got == {i: (fps[i], comp[i]) for i in range(len(rows))}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_is_exact():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    y = x[:200] ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 8), replace=False)) for _ in range(200)], np.uint64)
    a, b = simhash.near(x, y)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(300) for j in range(200) if (int(x[i]) ^ int(y[j])).bit_count() <= 4}


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 20))
    vs = [(base[i % 6] + r.normal(size=20) * r.choice([0.05, 0.2, 0.3])).tolist() for i in range(150)]
    rows = [(i, v, i % 2 if i % 11 else None) for i, v in enumerate(vs)]
    rows += [(200, None, 1), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, vs[1], 1), (204, vs[1], 1), (205, [None] * 20, 1), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = {i: np.array(v, np.float32).astype(float) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lab = {i: l for i, _, l in rows}
    links = {i: {j for j in good if j != i and i in good and lab[i] == lab[j] and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.93} for i, _, _ in rows}
    comp = {i: i for i in links}
    for _ in rows:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    for tile in (embed.TILE, 8):
        monkeypatch.setattr(embed, "TILE", tile)
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embed.near_duplicates(df).collect()}
        assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u1", "<é>"), (2, "u2", None), (3, None, ""), (4, "u4", "<é>"), (0, "u0", "x" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert got == {1: (4, digest("<é>"), "response", None), 2: (0, digest(""), "response", None), 3: (0, digest(""), "revisit", 2), 4: (4, digest("<é>"), "revisit", 1), 0: (9000, digest("x" * 9000), "response", None)}
    some = index.where("page_id in (0, 4)")
    assert {(r.page_id, bytes(r.payload), r.url) for r in warc.read(some).collect()} == {(0, b"x" * 9000, "u0"), (4, b"", "u4")}
    for r in index.collect():
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and r.digest.encode() in record
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_odd_rows(spark, monkeypatch):
    big = 2**53 + 1
    rows = [(None, "a\r\nb%0D", "x", "1"), (big, None, "x", "2"), (big + 1, "u", "x", "3"), (None, "n", None, "4"), (big, "again", "x", "5"), (7, "long", "é" * 3_000_000, "6")]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(1))
    assert index.select("archive").distinct().count() > 1
    got = sorted(((r.page_id or 0, r.url or "", r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(index).collect()), key=repr)
    assert got == sorted([(0, "a\r\nb%0D", "response", None, 1), (big, "", "response", None, 1), (big, "again", "response", None, 1), (big + 1, "u", "revisit", big, 1), (0, "n", "response", None, 0), (7, "long", "response", None, 6_000_000)], key=repr)


def test_ranges():
    r = np.random.default_rng(3)
    rows = sorted((int(a), int(n)) for a, n in zip(r.integers(0, 30 << 20, 400), r.integers(1, 100_000, 400)))
    runs = warc.ranges(rows)
    assert [x for run in runs for x in run[2]] == rows
    assert all(b <= a and a + n <= e and (e - b <= warc.READ_BYTES or len(inside) == 1) for b, e, inside in runs for a, n in inside)


def test_chat(spark, monkeypatch):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, None, None, "z"), (None, 0, "user", "q"), (4, 0, "user", "s"), (5, 0, "user", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"

    def cut(text, spans):
        return spans and [text[s.begin : s.end] for s in spans]

    got = {(r.pair_id, r.kind, r.prompt, r.chosen, r.rejected) for r in chat.format_preferences(df).collect()}
    assert got == {(0, "pair", say("user", "q"), say("assistant", "good"), say("assistant", "bad") + say("user", "")), (1, "half", "", say("unknown", "z"), ""),
                   (None, "unpaired", say("user", "q"), None, None), (2, "pair", say("user", "s"), "", "")}
    row = chat.format_preferences(df).where("pair_id = 0").first()
    assert cut(row.chosen, row.chosen_spans) == ["good<|end|>\n"] and cut(row.rejected, row.rejected_spans) == ["bad<|end|>\n"]
    assert chat.format_preferences(df.limit(0)).count() == 0
    big = 2**53
    long = [(big + s, t, "assistant" if t % 2 else "user", f"{t}" if t < 700 else f"{s}-{t}-{k}") for s in (0, 1) for t in range(800) for k in range(1 if t < 799 else 30)]
    monkeypatch.setattr(chat, "PART", 20)
    parts = chat.format_preferences(spark.createDataFrame(long, "conv_id long, turn int, role string, text string")).orderBy("block", "part").collect()
    assert len(parts) > 4 and {r.pair_id for r in parts} == {big // 2}
    assert sum(r.prompt.count("<|end|>") for r in parts) == 700
    assert sum(r.chosen.count("<|end|>") for r in parts) == sum(r.rejected.count("<|end|>") for r in parts) == 99 + 30


def assert_clashing_columns_stay(spark):
    big = 2**53 + 1
    rows = [(None, "b", "s", 5, "x"), (None, "a", "s", 6, "y"), (None, None, None, 7, "z"), (big, "c", "s", 8, "w"), (big, "c", "s", 9, "w")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, __end string"), block_docs=1)
    assert got.columns == ["doc_id", "text", "source", "slot", "__end", "block", "mix_slot", "in_mix"]
    out = got.collect()
    assert sorted(r.slot for r in out) == [5, 6, 7, 8, 9] and {r["__end"] for r in out} == set("xyzw")
    assert sorted(r.block for r in out if r.source == "s") == [0, 1, 2, 3] and {r.block for r in out if r.doc_id == big} == {2, 3}
    assert len({r.mix_slot for r in out}) == 5


def test_mixing(spark):
    rows = [(i, f"t{i}", "abc"[min(2, i % 5)] if i % 17 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert_clashing_columns_stay(spark)
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 7), ("", 1)], "source string, w int")
    out = mixing.mix(df, weights, 2).collect()
    assert len(out) == 600
    w = {"a": 5, "b": 3, "c": 7, "": 1}
    slots = {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source or "", r.block))
    assert all(len(v) == 1 for v in slots.values())
    end = min(s for s in range(10**6) if s not in slots)
    used = Counter()
    for t in range(end):
        used[next(iter(slots[t]))[0]] += 1
        for s in w:
            assert abs(used[s] - (t + 1) * w[s] / 16) < 1
    assert all(r.in_mix == (r.slot < end) for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_lm(spark):
    rows = texts()
    held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 7 == 2}
    toks = {i: [*((t or "").encode().lower().split()), None] for i, t in enumerate(rows)}
    c = Counter(x for i, v in toks.items() if i not in held for x in v)
    n, v = sum(c.values()), len(c)
    docs = frame(spark)
    train = F.expr("not (crc32(cast(cast(doc_id as string) as binary)) % 7 = 2)")
    got = {r.doc_id: r for r in lmscore.score(docs, train).collect()}
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (len(t), sum(c[x] > 0 for x in t), n, i not in held)
        assert r.base_score == pytest.approx(sum(log10((c[x] + 1) / (n + v + 1)) for x in t))
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(t)))
    empty = docs.limit(0)
    assert lmscore.score(empty, F.lit(True)).count() == 0
    assert lmscore.score(docs, F.lit(False)).agg(F.max("n_known"), F.min("score")).first()[:] == (0, 0.0)


def test_exchange_moves_as_the_whole_likelihood_says():
    r = np.random.default_rng(5)
    n = r.poisson(1.5, (14, 14)).astype(float)
    f = lmscore.likelihood_terms

    def whole(cls):
        one = np.eye(5)[cls]
        m = one.T @ n @ one
        return f(m).sum() - f(m.sum(1)).sum() - f(m.sum(0)).sum()

    cls = np.r_[np.arange(12) % 3 + 1, 4, 0]
    one = np.eye(5)[cls]
    m = one.T @ n @ one
    for w in [*range(12)] * 3:
        want = [whole(np.r_[cls[:w], k, cls[w + 1 :]]) for k in (1, 2, 3)]
        best, m = lmscore.best_class(n, m, cls, w, 4)
        assert want[best - 1] == pytest.approx(max(want))
        cls[w] = best
        one = np.eye(5)[cls]
        assert np.allclose(m, one.T @ n @ one)
    again, _ = lmscore.exchange(n, 4)
    assert all(whole(again) >= whole(np.r_[again[:w], k, again[w + 1 :]]) - 1e-6 for w in range(12) for k in (1, 2, 3))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) > 0
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark), langid.fit(docs)).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[8] == ("und", 0.0)
    assert langid.predict(frame(spark, []), None).count() == 0


def test_decontamination(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [prose(40) for _ in range(5)]
    para = [w for k, w in enumerate(items[1]) if k % 6]
    docs = [prose(300) for _ in range(20)] + [prose(90) + items[0] + prose(50), prose(33) + para + prose(99), items[2], None, ["..."]]
    d = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (9, None)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()} == {(20, 0), (21, 1), (22, 2)}
    assert decontam.matches(d, b.limit(0)).count() == 0
    assert decontam.matches(d.limit(0), b).count() == 0
