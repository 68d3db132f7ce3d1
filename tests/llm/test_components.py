"""Components of chains, stars and random graphs against union-find."""
import random

from sparkloom.llm import common


def test_components(spark):
    r = random.Random(17)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(280)] + [(-5, 2**53 + 1), (7, 7)]
    r.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for parts in (5, 1):
        df = df.repartition(parts)
        got = {x.id: x.component_id for x in common.components(df).collect()}
        assert {k: v for k, v in got.items() if k != v} == want
    assert common.components(df.limit(0)).count() == 0
