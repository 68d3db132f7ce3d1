"""Preference formatting, native: the common turn prefix once as prompt, then the paired masked completions.

Conversations 2k (chosen) and 2k + 1 (rejected) form pair k. Turns are aligned by their turn number and match if both
sides have the same (role, text) there; the prompt ends before the first turn that does not match. A pair is one row:
prompt, chosen and rejected, and for each completion the spans of characters to train on, which are the assistant's texts
with their end marks. A pair of more than BLOCK turn numbers, or of more than PART rows in such a block, continues in
further rows (block, part), so no row and no task grows with a conversation.
Turns of one number stand in the order of role and text; rows repeated in full count once; null turns count as turn -1, a
null text is empty, a null role is 'unknown'. kind is 'pair', 'half' where one conversation of the two is missing (its
turns are its completion), or 'unpaired' for rows without a conv_id, each of which stands alone as a prompt. An empty
table gives no rows; extra columns are ignored.
"""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BLOCK = 256
PART = 4096


def _rendered(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _turns(conversations):
    """(pair_id, turn, role, text, c, r): distinct turns of a pair, and whether the chosen and the rejected side have them."""
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    second = F.pmod("conv_id", F.lit(2)) == 1
    return t.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), "turn", "role", "text").agg(F.bool_or(~second).alias("c"), F.bool_or(second).alias("r"))


def format_preferences(conversations):
    """(pair_id, block, part, kind, prompt, chosen, chosen_spans, rejected, rejected_spans)."""
    turns = _turns(conversations)
    n = turns.where("pair_id is not null").withColumn("block", F.floor(F.col("turn") / BLOCK).cast("long"))
    pair = Window.partitionBy("pair_id")
    m = n.groupBy("pair_id", "block").agg(F.count("*").alias("rows"), F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("first"), F.bool_or("c").alias("any_c"), F.bool_or("r").alias("any_r"))
    m = m.select("pair_id", "block", "rows", F.coalesce(F.min("first").over(pair), F.lit(2**62)).alias("cut"), (F.bool_or("any_c").over(pair) & F.bool_or("any_r").over(pair)).alias("whole"))
    j = n.join(m, ["pair_id", "block"]).withColumn("part", F.expr(f"pmod(xxhash64(role, text), ceil(rows / {PART}))").cast("long"))
    sides = F.when(F.col("turn") < F.col("cut"), F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected")))))
    s = j.repartition("pair_id", "block", "part").withColumn("side", F.explode(sides)).withColumn("rendered", _rendered(F.col("role"), F.col("text")))
    before = Window.partitionBy("pair_id", "block", "part", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("role") + 5).alias("begin"), (F.col("at") + F.length("rendered")).alias("end")))

    def text(side):
        rows = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "rendered"))))
        return F.array_join(F.transform(rows, lambda x: x["rendered"]), "").alias(side)

    def spans(side):
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, span))).alias(f"{side}_spans")

    pairs = s.groupBy("pair_id", "block", "part").agg(
        F.when(F.bool_and("whole"), "pair").otherwise("half").alias("kind"), text("prompt"), text("chosen"), spans("chosen"), text("rejected"), spans("rejected"))
    none = F.lit(None)
    alone = turns.where("pair_id is null").select(
        "pair_id", none.cast("long").alias("block"), none.cast("long").alias("part"), F.lit("unpaired").alias("kind"), _rendered(F.col("role"), F.col("text")).alias("prompt"),
        *(none.cast(pairs.schema[c].dataType).alias(c) for c in ("chosen", "chosen_spans", "rejected", "rejected_spans")))
    return pairs.unionByName(alone)


def query(spark, sf_dir):
    out = format_preferences(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return out.select("pair_id", "block", "part", "kind", "prompt", "chosen", flat("chosen_spans"), "rejected", flat("rejected_spans"))


SQL = """
with t as (select cast(floor(conv_id / 2.0) as bigint) as pair_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
  ((conv_id % 2) + 2) % 2 = 1 as second from conversations),
n as (select pair_id, cast(turn as bigint) as turn, role, text, bool_or(not second) as c, bool_or(second) as r, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered from t group by all),
m as (select pair_id, coalesce(min(turn) filter (where c <> r), 4611686018427387904) as cut, bool_or(c) and bool_or(r) as whole from n where pair_id is not null group by 1),
j as (select n.*, cut, whole, cast(floor(turn / 256.0) as bigint) as block from n join m using (pair_id)),
s as (select *, 'prompt' as side from j where turn < cut union all select *, 'chosen' from j where turn >= cut and c union all select *, 'rejected' from j where turn >= cut and r),
w as (select *, coalesce(sum(length(rendered)) over (partition by pair_id, block, side order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as pos from s),
x as (select *, case when role = 'assistant' then cast(cast(pos + length(role) + 5 as bigint) as varchar) || '-' || cast(cast(pos + length(rendered) as bigint) as varchar) end as span from w)
select pair_id, block, cast(0 as bigint) as part, case when bool_and(whole) then 'pair' else 'half' end as kind,
 coalesce(string_agg(rendered, '' order by pos) filter (where side = 'prompt'), '') as prompt,
 coalesce(string_agg(rendered, '' order by pos) filter (where side = 'chosen'), '') as chosen, coalesce(string_agg(span, ',' order by pos) filter (where side = 'chosen'), '') as chosen_spans,
 coalesce(string_agg(rendered, '' order by pos) filter (where side = 'rejected'), '') as rejected, coalesce(string_agg(span, ',' order by pos) filter (where side = 'rejected'), '') as rejected_spans
from x group by pair_id, block
union all select pair_id, null, null, 'unpaired', rendered, null, null, null, null from n where pair_id is null
"""
