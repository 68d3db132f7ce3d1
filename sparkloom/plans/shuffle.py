"""Queries over the block relation, with their SQL."""
from pyspark.sql import functions as F

from ..operators import blocks as B

_BLOCKS = """blocks as (select *, seq * 140737488355328 + partition_id * 8388608 + task_attempt_id as block_id from (
 select 'app_' || cast(l_suppkey % 5 as varchar) as app_id, l_linenumber as shuffle_id, cast(l_partkey % 16 as int) as partition_id, l_suppkey as task_attempt_id,
 cast(trunc(l_quantity) as int) as length, cast(trunc(l_extendedprice) as int) as uncompress_length,
 row_number() over (partition by l_suppkey % 5, l_linenumber, l_partkey % 16 order by l_orderkey, l_partkey, l_suppkey, cast(trunc(l_extendedprice) as int), cast(trunc(l_quantity) as int)) as seq from lineitem) t)"""
_SIZES = _BLOCKS + """, sizes as (select app_id, shuffle_id, partition_id, cast(sum(length) as bigint) as bytes, count(*) as n_blocks, sum(length) > 2500 as is_huge, sum(length) > 2000 as is_split from blocks group by all)"""


def _blocks(spark, d):
    return B.blocks_from_lineitem(spark.read.parquet(f"{d}/lineitem.parquet"))


def _sizes(spark, d):
    return B.partition_sizes(_blocks(spark, d), 2000, 2500)


def _nodes(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit(".1")).alias("ip"), F.round(F.col("s_acctbal") * 100).cast("long").alias("free_memory"),
                    F.array(F.lit("ssd")).alias("tags"), F.lit(True).alias("is_healthy"))


def _flushes(spark, d):
    """Flushes of partitions under all kinds of health, retries and earlier failures."""
    k, p = F.col("shuffle_id"), F.col("partition_id")
    return _sizes(spark, d).withColumns({"warm_healthy": k % 3 != 0, "cold_healthy": k % 4 != 1, "retries": p % 3, "failed_cold": p % 2 == 0})


def _index(spark, d):
    cols = [F.col(c) for c in ("seq", "length", "uncompress_length", "seq", "block_id", "task_attempt_id")]
    b = _blocks(spark, d).withColumn("r", B.decode_index(B.encode_index(*cols)))
    return b.select("app_id", "shuffle_id", "r.*")


def _cursors(spark, d):
    """The third block of each partition; every fifth partition has a cursor that is not there, and some have none."""
    b = _blocks(spark, d).where("seq = 3 and partition_id % 5 <> 1")
    return b.select(*B.UID, F.when(F.col("partition_id") % 5 == 0, 12345).otherwise(F.col("block_id")).alias("last_block_id"))


_CURSOR = "b as (select *, max(case when seq = 3 and partition_id % 5 > 1 then 1 else 0 end) over (partition by app_id, shuffle_id, partition_id) as k from blocks)"
_PAGE_COLUMNS = ("app_id", "shuffle_id", "partition_id", "block_id", "length", "offset", "is_end")
QUERIES = {
    "block_ids": (lambda s, d: _blocks(s, d).select("app_id", "shuffle_id", "block_id", B.partition_of(F.col("block_id")).cast("int").alias("partition_id"), B.task_of(F.col("block_id")).alias("task_attempt_id")),
                  f"with {_BLOCKS} select app_id, shuffle_id, block_id, partition_id, task_attempt_id from blocks"),
    "index_codec": (_index, f"with {_BLOCKS} select app_id, shuffle_id, seq as \"offset\", cast(length as bigint) as length, cast(uncompress_length as bigint) as uncompress_length, seq as crc, block_id, task_attempt_id from blocks"),
    "cursor_page": (lambda s, d: B.cursor_read(_blocks(s, d), _cursors(s, d), 500).select(*_PAGE_COLUMNS),
                    f"with {_BLOCKS}, {_CURSOR}, p as (select *, cast(coalesce(sum(length) over (partition by app_id, shuffle_id, partition_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", sum(length) over (partition by app_id, shuffle_id, partition_id) as t from b where k = 0 or seq > 3) select app_id, shuffle_id, partition_id, block_id, length, \"offset\", t < 500 as is_end from p where \"offset\" < 500"),
    "task_filtered_page": (lambda s, d: B.cursor_read(_blocks(s, d), -1, 300, s.range(1, 20).withColumnRenamed("id", "task_attempt_id")).select(*_PAGE_COLUMNS),
                           f"with {_BLOCKS}, p as (select *, cast(coalesce(sum(length) over (partition by app_id, shuffle_id, partition_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", sum(length) over (partition by app_id, shuffle_id, partition_id) as t from blocks where task_attempt_id between 1 and 19) select app_id, shuffle_id, partition_id, block_id, length, \"offset\", t < 300 as is_end from p where \"offset\" < 300"),
    "page_read_cursor_filtered": (lambda s, d: B.cursor_read(_blocks(s, d), _cursors(s, d), 300, s.range(1, 20).withColumnRenamed("id", "task_attempt_id")).select(*_PAGE_COLUMNS),
                                  f"with {_BLOCKS}, {_CURSOR}, p as (select *, cast(coalesce(sum(length) over (partition by app_id, shuffle_id, partition_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", sum(length) over (partition by app_id, shuffle_id, partition_id) as t from b where (k = 0 or seq > 3) and task_attempt_id between 1 and 19) select app_id, shuffle_id, partition_id, block_id, length, \"offset\", t < 300 as is_end from p where \"offset\" < 300"),
    "partition_sizes": (_sizes, f"with {_SIZES} select * from sizes"),
    "app_history": (lambda s, d: B.app_history(_sizes(s, d)), f"with {_SIZES} select app_id, cast(sum(bytes) as bigint) as total_bytes, count(*) as partition_num, count(case when is_huge then 1 end) as huge_partition_num, cast(coalesce(floor(avg(case when is_huge then bytes end)), 0) as bigint) as avg_huge_partition_bytes, coalesce(max(case when is_huge then bytes end), 0) as max_huge_partition_bytes, coalesce(cast(min(case when is_huge then bytes end) as decimal(20,0)), cast('18446744073709551615' as decimal(20,0))) as min_huge_partition_bytes, bool_or(is_split) as partition_split_triggered from sizes group by app_id"),
    "spill_candidates": (lambda s, d: B.spill_candidates(_sizes(s, d), 0.5), f"with {_SIZES}, r as (select *, cast(coalesce(sum(bytes) over (partition by app_id order by bytes desc, shuffle_id, partition_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before, sum(bytes) over (partition by app_id) as t from sizes where bytes > 0) select app_id, shuffle_id, partition_id, bytes, before from r where before < t * 0.5"),
    "tier_routing": (lambda s, d: B.route(_flushes(s, d), 2700, 2400, True).select("app_id", "shuffle_id", "partition_id", "tier"),
                     f"with {_SIZES}, f as (select *, shuffle_id % 3 <> 0 as w, shuffle_id % 4 <> 1 as c, partition_id % 3 as r, partition_id % 2 = 0 as h from sizes) select app_id, shuffle_id, partition_id, case when is_huge and bytes > 2400 and h and r > 1 and w then 'warm' when (is_huge and bytes > 2400) or r >= 1 or not w or bytes > 2700 then case when c then 'cold' else 'warm' end else 'warm' end as tier from f"),
    "record_stats": (lambda s, d: B.record_stats(_blocks(s, d).select(*B.UID, "task_attempt_id", F.col("length").alias("record_number"), F.col("block_id").alias("report_seq"))),
                     f"with {_BLOCKS} select app_id, shuffle_id, partition_id, task_attempt_id, max_by(length, block_id) as record_number from blocks group by all"),
    "block_id_sets": (lambda s, d: _blocks(s, d).groupBy("app_id", "shuffle_id").agg(F.count("block_id").alias("reported"), F.count_distinct("block_id").alias("distinct_ids")),
                      f"with {_BLOCKS} select app_id, shuffle_id, count(block_id) as reported, count(distinct block_id) as distinct_ids from blocks group by all"),
    "server_ranking": (lambda s, d: B.pick_servers(B.rank_servers(_nodes(s, d), ["ssd"]), 12).select("id", "ip", "free_memory"),
                       "with n as (select s_suppkey as id, '10.0.' || cast(s_nationkey as varchar) || '.1' as ip, cast(round(s_acctbal * 100) as bigint) as free_memory from supplier), r as (select *, row_number() over (partition by ip order by free_memory desc, id) as h from n where free_memory > 0) select id, ip, free_memory from r order by h > 1, free_memory desc, id limit 12"),
    "round_assignment": (lambda s, d: B.assign_rounds(s, 7, 2, ["s1", "s2", "s3"], 2),
                         "select r * 2 as start_partition, (r + 1) * 2 - 1 as end_partition, cast(p as int) as replica, ['s1', 's2', 's3'][(r * 2 + p) % 3 + 1] as server from range(4) a(r), range(2) b(p)"),
    "asof_event_value": (lambda s, d: (lambda e: B.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value").select("event_id", "asof_value"))(s.read.parquet(f"{d}/events.parquet")),
                         "select p.event_id, v.value as asof_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts"),
}


def queries():
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql():
    return {k: v[1] for k, v in QUERIES.items()}
