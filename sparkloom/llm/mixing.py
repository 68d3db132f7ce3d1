"""Mixing sources by Pfair scheduling, native SQL functions only.

Each source is cut into blocks of documents; a source of weight w slots in a period of q gets for its block i the release
floor(i q / w) and the deadline ceil((i + 1) q / w). Earliest deadline first over the released blocks fills the q slots of
one period, so at every time each source is less than one block off its share; the period then repeats without end.
Every document keeps its row: slot orders the mix, in_mix says that no source has run out before this slot.
Documents of a source are numbered by doc_id: counts of small chunks of ids are summed up in two levels, so neither a hot
source nor its chunks meet in one task. Null ids come first; null and equal doc_ids are ordered by a hash of the text;
null sources are the source ''; null texts are empty; an empty table gives no rows. Columns of docs keep their names and
values; where one is called block, slot or in_mix, it stays and the new column is called mix_block, mix_slot or mix_in_mix.
The schedule's size depends on the sources alone; it is broadcast up to MANY sources and joined by source beyond that.
"""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

PERIOD = 256
BLOCK_DOCS = 8
CHUNK_BITS = 8
MANY = 10_000


def shares(docs, period=PERIOD):
    """Default targets (source, w): slots by the square root of each source's size, at least one each."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum(F.sqrt("n")).alias("t"))
    return n.join(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.round(F.sqrt("n") / F.col("t") * period)).cast("int").alias("w"))


def schedule(weights):
    """Earliest-deadline-first slots of one period: (source, w, q, nth, pos)."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("source", "w"))).alias("s")).withColumn("q", F.aggregate("s", F.lit(0), lambda a, x: a + x["w"]))
    step = """aggregate(sequence(0, q - 1), named_struct('used', transform(s, x -> 0), 'plan', cast(array() as array<int>)),
      (a, t) -> transform(array(array_min(filter(transform(s, (x, k) -> named_struct('d', ceil((a.used[k] + 1) * q / x.w), 'k', k, 'r', floor(a.used[k] * q / x.w), 'f', a.used[k] < x.w)), y -> y.r <= t and y.f)).k),
        p -> named_struct('used', transform(a.used, (u, k) -> if(k = p, u + 1, u)), 'plan', a.plan || array(p)))[0])"""
    flat = one.withColumn("plan", F.expr(f"({step}).plan")).select("s", "q", F.posexplode("plan").alias("pos", "k"))
    w = Window.partitionBy("source").orderBy("pos")
    return flat.select(F.expr("s[k].source").alias("source"), F.expr("s[k].w").alias("w"), "q", "pos").withColumn("nth", F.row_number().over(w) - 1)


def mix(docs, weights=None, block_docs=BLOCK_DOCS):
    """All columns of docs and block, slot, in_mix."""
    names = [c if c not in docs.columns else f"mix_{c}" for c in ("block", "slot", "in_mix")]
    at = {c: F.col(f"__in_{i}") for i, c in enumerate(docs.columns)}
    h = F.xxhash64(F.coalesce(at["text"], F.lit("")))
    # chunks of null ids come first, by hash of the text
    small = F.when(at["doc_id"].isNull(), F.shiftright(h, 44) - 2**60).otherwise(F.shiftright(at["doc_id"].cast("long"), CHUNK_BITS))
    d = docs.select(*(F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(docs.columns)))
    d = d.withColumns({"__s": F.coalesce(at["source"], F.lit("")), "__c": small, "__h": h}).withColumn("__k", F.shiftright("__c", 10))
    size = d.groupBy("__s", "__k", "__c").agg(F.count("*").alias("__n"))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    big = size.groupBy("__s", "__k").agg(F.sum("__n").alias("n"))
    big = big.select("__s", "__k", F.coalesce(F.sum("n").over(run(Window.partitionBy("__s").orderBy("__k"))), F.lit(0)).alias("__b"))
    inner = F.coalesce(F.sum("__n").over(run(Window.partitionBy("__s", "__k").orderBy("__c"))), F.lit(0))
    start = size.withColumn("__i", inner).join(big, ["__s", "__k"]).select("__s", "__c", (F.col("__b") + F.col("__i")).alias("__b"))
    place = Window.partitionBy("__s", "__c").orderBy(at["doc_id"].asc_nulls_first(), "__h")
    numbered = d.drop("__k").join(start, ["__s", "__c"]).withColumn("__i", F.row_number().over(place) - 1 + F.col("__b"))
    numbered = numbered.withColumn("__block", F.floor(F.col("__i") / block_docs).cast("long"))
    plan = schedule(weights if weights is not None else shares(docs))
    slots = plan.groupBy("source", "w", "q").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    total = size.groupBy("__s").agg(F.sum("__n").alias("n")).join(slots, F.col("__s") == F.col("source"))
    last = total.withColumn("blocks", F.ceil(F.col("n") / block_docs)).withColumn("e", F.expr("floor(blocks / w) * q + at[cast(blocks % w as int)]"))
    last = last.select("__s", F.col("w").alias("__w"), F.col("q").alias("__q"), F.col("at").alias("__at"), F.min("e").over(Window.partitionBy(F.lit(0))).alias("__end"))
    few = (weights if weights is not None else docs.select(F.coalesce("source", F.lit("")).alias("source"))).select("source").distinct().limit(MANY + 1).count() <= MANY
    out = numbered.join(F.broadcast(last) if few else last, "__s").withColumn("__slot", F.expr("floor(__block / __w) * __q + __at[cast(__block % __w as int)]").cast("long"))
    kept = [F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*kept, F.col("__block").alias(names[0]), F.col("__slot").alias(names[1]), (F.col("__slot") < F.col("__end")).alias(names[2]))


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "in_mix")


SQL = """
with recursive d as (select doc_id, text, source, coalesce(source, '') as s from documents),
n as (select s, count(*) as n from d group by s),
w as (select s, n, cast(greatest(1, round(sqrt(n) / (select sum(sqrt(n)) from n) * 256)) as int) as w, row_number() over (order by s) as k from n),
q as (select cast(sum(w) as int) as q from w),
edf(t, used, k) as (
 select -1, list_transform(range((select count(*) from w)), lambda x: 0), 0
 union all
 select t + 1, list_transform(range(len(used)), lambda i: used[i + 1] + case when i + 1 = p then 1 else 0 end), p from (
  select t, used, (select w.k from w, q where used[w.k] < w.w and floor(used[w.k] * q.q / w.w) <= e.t + 1 order by ceil((used[w.k] + 1) * q.q / w.w), w.k limit 1) as p from edf e, q where e.t + 1 < q.q) z),
slots as (select k, list(t order by t) as places from edf where t >= 0 group by k),
b as (select d.*, w.w, w.k, (row_number() over (partition by d.s order by doc_id nulls first, text) - 1) // 8 as block from d join w on d.s = w.s),
o as (select b.*, block // b.w * q.q + places[block % b.w + 1] as slot from b join slots on b.k = slots.k, q),
e as (select min((n + 7) // 8 // w.w * q.q + places[(n + 7) // 8 % w.w + 1]) as last from w join slots on w.k = slots.k, q)
select doc_id, source, cast(block as bigint) as block, cast(slot as bigint) as slot, slot < last as in_mix from o, e
"""
