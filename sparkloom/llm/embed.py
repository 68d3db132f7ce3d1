"""Embedding near-dedup inside labels: PCA-ordered tiles, residual bounds by suffix norms, exact links.

Vectors are rotated to the principal axes. The first two axes are cut in cells as wide as two linked vectors can lie
apart, so only neighbouring cells meet; a full cell is cut in as many tiles as it needs. A pair's product is summed from
the leading axes on and given up once the norms of what is left cannot reach the threshold; products at the threshold
are made again from the vectors as they came.
Null labels and null, zero or non-finite vectors (or null components) link with nothing and keep their rows; equal vectors
of a label collapse before any comparison; vectors of other lengths never link; repeated rows, also under one vec_id,
count as further vectors; a null vec_id keeps its row, its component is the least vec_id it reaches, null if there is
none, and it is kept only then; an empty table gives no rows; extra columns are ignored.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import add_up, components, forest, staged, table

THRESHOLD = 0.93
TILE = 2048
LEAD = 16
AXES = 2


def _rotation(groups, dim):
    """Principal axes, by falling variance, from d x d sums that are added up in a shuffle."""

    def run(batches):
        s = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(batch.column("v").flatten().to_numpy().reshape(-1, dim))
            s += x.T @ x
        return s.ravel()

    return np.linalg.eigh(add_up(groups.select("v"), run, dim * dim).reshape(dim, dim))[1][:, ::-1]


def _unit(x):
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(x, y, axes, threshold=THRESHOLD, lead=LEAD):
    """Index pairs of unit rows with product >= threshold; partial sums on the axes are bounded by suffix norms."""
    p, q = x @ axes, y @ axes
    ends = [*range(lead, x.shape[1], lead), x.shape[1]] if x.shape[1] > lead else [x.shape[1]]
    rest = lambda z: [np.sqrt(np.maximum(0, (z[:, e:] ** 2).sum(1))) for e in ends]
    rp, rq, found = rest(p), rest(q), []
    for lo in range(0, len(p), 256):
        part = p[lo : lo + 256, : ends[0]] @ q[:, : ends[0]].T
        a, b = np.nonzero(part + np.outer(rp[0][lo : lo + 256], rq[0]) >= threshold - 1e-9)
        dot, a = part[a, b], a + lo
        for k in range(1, len(ends)):
            dot = dot + np.einsum("ij,ij->i", p[a, ends[k - 1] : ends[k]], q[b, ends[k - 1] : ends[k]])
            live = dot + rp[k][a] * rq[k][b] >= threshold - 1e-9
            a, b, dot = a[live], b[live], dot[live]
        close = dot < threshold + 1e-9
        dot[close] = np.einsum("ij,ij->i", x[a[close]], y[b[close]])
        found.append((a[dot >= threshold], b[dot >= threshold]))
    return tuple(np.concatenate(z) for z in zip(*found))


def near_duplicates(emb, threshold=THRESHOLD):
    """(vec_id, n_links, component_id, kept) for emb(vec_id, embedding, label)."""
    e = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    e = e.withColumn("ok", F.coalesce(good, F.lit(False)))
    groups = e.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = staged(groups.withColumn("gid", F.monotonically_increasing_id()))  # vec_ids may be null or repeat
    found = None
    for dim in [r[0] for r in groups.select(F.size("v")).distinct().collect()]:
        part = _links(groups.where(F.size("v") == dim), dim, threshold)
        found = part if found is None else found.unionByName(part)
    alone = e.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = staged(found)
    counts = found.where("b < 0").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("id", "gid")
    whole = groups.join(counts, "gid", "left").join(comp, "gid", "left").withColumn("c", F.coalesce("component_id", "gid")).drop("component_id")
    least = whole.groupBy("c").agg(F.min("rep").alias("component_id"))
    reps = whole.join(least, "c").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = e.where("ok").join(reps, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def _links(groups, dim, threshold):
    """Rows (a, -1, n): a has n links to other vectors' copies; (a, b, 0): spanning links."""
    axes = _rotation(groups, dim)
    lead = min(AXES, dim)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def cells(batches):
        for pdf in batches:
            at = np.floor((_unit(np.array(pdf.v.tolist())) @ axes[:, :lead]) / reach).astype(int)
            yield pd.DataFrame({"label": pdf.label, "gid": pdf.gid, "copies": pdf.copies, "v": pdf.v, "cell": list(at)})

    kind = dict(groups.dtypes)["label"]
    rows = staged(groups.select("label", "gid", "copies", "v").mapInPandas(cells, f"label {kind}, gid long, copies long, v array<double>, cell array<int>"))
    # cells of a label are at most a few hundred, whatever its size
    tiles = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t")).groupBy("label").agg(F.collect_list(F.struct("cell", "t")).alias("all"))
    near = F.expr("filter(all, o -> forall(zip_with(o.cell, cell, (p, q) -> abs(p - q)), d -> d <= 1))")
    mine = F.expr("filter(all, o -> o.cell = cell)[0].t")
    placed = rows.join(tiles, "label").withColumn("near", near).withColumn("me", F.struct("cell", F.pmod(F.xxhash64("gid"), mine).cast("int").alias("tile"))).drop("all", "cell")
    # a row goes to every pair of tiles that holds its own; the lesser tile of a pair is its left side
    other = F.expr("flatten(transform(near, o -> transform(sequence(0, o.t - 1), k -> named_struct('cell', o.cell, 'tile', cast(k as int)))))")
    dealt = placed.withColumn("other", F.explode(other)).select("label", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), (F.col("me") <= F.col("other")).alias("left"), (F.col("me") >= F.col("other")).alias("right"), "gid", "copies", "v")

    def compare(pdf):
        one, two = pdf[pdf.left], pdf[pdf.right]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
        same = bool(pdf.left.iat[0] and pdf.right.iat[0])
        a, b = near_pairs(_unit(np.array(one.v.tolist())), _unit(np.array(two.v.tolist())), axes, threshold)
        if same:
            a, b = a[a != b], b[a != b]
        ra, rb, ca, cb = one.gid.to_numpy(), two.gid.to_numpy(), one.copies.to_numpy(), two.copies.to_numpy()
        rows = [(int(ra[i]), -1, int(v)) for i, v in enumerate(np.bincount(a, cb[b], len(ra))) if v]
        if not same:
            rows += [(int(rb[i]), -1, int(v)) for i, v in enumerate(np.bincount(b, ca[a], len(rb))) if v]
        both, shift = (ra, 0) if same else (np.concatenate([ra, rb]), len(ra))
        rows += [(int(both[s]), int(both[t]), 0) for s, t in forest(a, b + shift, len(both))]
        return pd.DataFrame(rows, columns=["a", "b", "n"], dtype=np.int64)

    return dealt.groupBy("label", "lo", "hi").applyInPandas(compare, "a long, b long, n long")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with u as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
g as (select * from u where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
p as (select a.vec_id as x, b.vec_id as y from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
r as (with recursive w(x, y) as (select x, y from p union select w.x, p.y from w join p on w.y = p.x) select x, min(y) as m from w group by 1)
select u.vec_id, coalesce(k.n, 0) as n_links, least(u.vec_id, coalesce(r.m, u.vec_id)) as component_id, u.vec_id <= coalesce(r.m, u.vec_id) as kept
from u left join (select x, count(*) as n from p group by 1) k on k.x = u.vec_id left join r on r.x = u.vec_id
"""
