"""The composed pipeline, and the benchmark search, against plain versions of every stage on small tables."""
import math
import random
import re
from collections import defaultdict

import corpus_pipeline
from sparkloom.llm import decontam, langid


def folded(text):
    """Words of letters, digits and bytes above 127, lower-cased in ASCII."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], above + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_matches(words, item):
    """Whether any window of the words holds a passage of the item."""
    parts = [item[max(0, min(k, len(item) - 48)) :][:48] for k in range(0, max(1, len(item) - 32), 16)]
    for part in parts:
        window, stride = (24, 12) if len(part) <= 24 else (48, 24)
        for at in range(0, len(words), stride):
            near = words[max(0, at - stride) : at + window + stride]
            if 0.45 * len(part) > len(set(part) & set(near)) and len(set(part)) == len(part):
                continue
            share = plain_lcs(part, near) / len(part)
            answer = item[-5:]
            has = any(near[k : k + len(answer)] == answer for k in range(len(near)))
            if share >= 0.6 or (has and share >= 0.45):
                return True
    return False


def plain_near(rows):
    """One row of each group of texts that chains of similarity 4/5 join: the smallest id, null ids last."""
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    best = {}
    for i, r in enumerate(rows):
        g = find(i)
        if g not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (rows[best[g]]["doc_id"] is None, rows[best[g]]["doc_id"] or 0):
            best[g] = i
    return [rows[i] for i in sorted(best.values())]


def plain_suffix(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        text, at = "", 0
        for c in r["text"]:
            n = len(c.encode())
            text += "" if any(gone[at : at + n]) else c
            at += n
        out.append(r | {"text": text, "n_chars": len(text) if any(gone) else r["n_chars"]})
    return out


def plain_mix(rows):
    """Slots of earliest deadline first over a period of about 256 blocks of 8 documents."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"] or ""].append(r)
    total = sum(math.sqrt(len(v)) for v in by.values())
    w = {s: max(1, int(math.sqrt(len(v)) / total * 256 + 0.5)) for s, v in by.items()}
    q, used, at = sum(w.values()), dict.fromkeys(w, 0), defaultdict(list)
    for t in range(q):
        s = min((x for x in w if used[x] < w[x] and used[x] * q // w[x] <= t), key=lambda x: (-(-(used[x] + 1) * q // w[x]), x))
        at[s].append(t)
        used[s] += 1
    slot = lambda s, b: b // w[s] * q + at[s][b % w[s]]
    end = min(slot(s, -(-len(v) // 8)) for s, v in by.items())
    return {(r["doc_id"], r["text"]): (k // 8, slot(s, k // 8), slot(s, k // 8) < end) for s, v in by.items() for k, r in enumerate(sorted(v, key=lambda r: r["doc_id"]))}


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rows = [r.asDict() for r in langid.predict(docs, model, carry=("source", "n_chars")).where("not rejected").withColumnRenamed("lang_pred", "lang").select(*corpus_pipeline.COLUMNS).collect()]
    items = [folded(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = plain_near(rows)
    assert len(kept) < len(rows)
    kept = plain_suffix(kept)
    clean = [r for r in kept if not any(plain_matches(folded(r["text"]), item) for item in items)]
    assert len(clean) < len(kept)
    mix = plain_mix(clean)
    want = {(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *mix[r["doc_id"], r["text"]]) for r in clean}
    got = {tuple(r[c] for c in (*corpus_pipeline.COLUMNS, "block", "slot", "in_mix")) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_matches_against_plain_search(spark):
    r = random.Random(31)
    voc = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda n: [r.choice(voc) for _ in range(n)]
    items = [prose(n) for n in (12, 18, 24, 25, 40, 48, 60, 100)]
    docs = [prose(r.randint(0, 250)) for _ in range(25)]
    for item in items:
        for cut in (1, 3, 4, 6):
            docs.append(prose(r.randint(0, 90)) + [w for k, w in enumerate(item) if cut == 1 or k % cut] + prose(r.randint(0, 90)))
        docs.append(prose(30) + item[len(item) // 2 :] + prose(30))
    d = spark.createDataFrame([(i, ", ".join(t).title()) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    low = lambda t: [w.encode() for w in t]
    want = {(i, k) for i, t in enumerate(docs) for k, item in enumerate(items) if plain_matches(low(t), low(item))}
    got = {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()}
    every = {(x.doc_id, x.item_id) for x in decontam.matches(d, b, near=-2).collect()}
    assert len(want) > 25 and every == want and got <= want and len(got) >= 0.95 * len(want)
