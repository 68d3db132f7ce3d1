"""Queries over cluster relations, node state and event-time activity, with their SQL."""
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import state as S
from ..sources import cluster as C
from ..streaming import activity as A

_NODES = """nodes as (select '10.0.' || cast(s_nationkey as varchar) || '.1' as ip, cast(21000 + s_suppkey as int) as grpc_port, cast(20000 + s_suppkey % 7 as int) as http_port,
 case s_suppkey % 4 when 0 then 'ACTIVE' when 1 then 'HEALTHY' when 2 then 'DECOMMISSIONING' else 'UNHEALTHY' end as state from supplier),
 apps as (select '10.0.' || cast(c_nationkey as varchar) || '.1' as ip, cast(20000 + c_custkey % 7 as int) as http_port from customer where c_acctbal > 5000),
 instances as (select n.*, a.running_apps, case when state in ('ACTIVE', 'HEALTHY') then 'Active' else 'Unhealthy' end as status
 from nodes n left join (select ip, http_port, count(*) as running_apps from apps group by all) a on n.ip = a.ip and n.http_port = a.http_port)"""


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _ip(c):
    return F.concat(F.lit("10.0."), F.col(c).cast("string"), F.lit(".1")).alias("ip")


def _port(c):
    return (F.col(c) % 7 + 20000).cast("int").alias("http_port")


def _instances(s, d):
    k = F.col("s_suppkey") % 4
    state = F.when(k == 0, "ACTIVE").when(k == 1, "HEALTHY").when(k == 2, "DECOMMISSIONING").otherwise("UNHEALTHY").alias("state")
    nodes = s.read.parquet(f"{d}/supplier.parquet").select(_ip("s_nationkey"), (F.col("s_suppkey") + 21000).cast("int").alias("grpc_port"), _port("s_suppkey"), state)
    apps = s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").select(_ip("c_nationkey"), _port("c_custkey"))
    return C.running_apps(nodes, apps).withColumn("status", S.mapped_status(F.col("state")))


_STATEMENT = "select status, count(*) as n, count(running_apps) as answered, cast(sum(running_apps) as bigint) as apps from instances group by status"


def _requests(s, d):
    return _events(s, d).select(F.col("user_id").cast("string").alias("app_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", -F.floor("value")).otherwise(F.floor("value")).alias("size"))


QUERIES = {
    "cluster_instances": (lambda s, d: _instances(s, d), f"with {_NODES} select * from instances"),
    "cluster_statement": (lambda s, d: C.run_sql(s, _STATEMENT, {"instances": lambda: _instances(s, d)}), f"with {_NODES} {_STATEMENT}"),
    "session_activity": (lambda s, d: A.sessions(_events(s, d), "user_id", "ts", "6 hours"),
                         "select user_id, min(ts) as began, max(ts) + interval '6' hour as ended, count(*) as n from (select *, sum(chg) over (partition by user_id order by ts rows unbounded preceding) as grp from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '6' hour then 0 else 1 end as chg from events) a) b group by user_id, grp"),
    "tumbling_windows": (lambda s, d: A.tumbling(_events(s, d), "event_type", "ts", "1 day", "value"), "select event_type, cast(date_trunc('day', ts) as timestamp) as began, count(*) as n, min(value) as low, max(value) as high from events group by 1, 2"),
    "sliding_windows": (lambda s, d: A.sliding(_events(s, d), "event_type", "ts", "2 days", "1 day"), "select event_type, cast(date_trunc('day', ts) as timestamp) - to_days(cast(k as int)) as began, count(*) as n from events, range(2) r(k) group by 1, 2"),
    "capacity_hysteresis": (lambda s, d: S.hysteresis(_events(s, d).select("user_id", "event_id", "ts", "value"), "user_id", ["ts"], "value", 200, 20).select("event_id", "healthy"),
                            "select event_id, coalesce(last_value(case when value > 200 then false when value < 20 then true end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row), true) as healthy from events"),
    "app_registry": (lambda s, d: S.app_registry(_events(s, d).select(F.col("user_id").alias("app_id"), F.col("event_id").alias("ts"), F.col("event_type").alias("user")), 10**9, 10**9 - 50),
                     "select user_id as app_id, min(event_id) as registered, max(event_id) as last_seen, max_by(event_type, event_id) as \"user\" from events group by 1 having 1000000000 - max(event_id) < 999999950"),
    "continuous_assignment": (lambda s, d: B.assign_continuous(s, 52, 2, ["s1", "s2", "s3", "s4", "s5"], 2, 20),
                              "select i * 2 as start_partition, i * 2 + 1 as end_partition, cast(r as int) as replica, 's' || cast((case when i < 22 then i // 2 else i - 11 end + r) % 5 + 1 as varchar) as server from range(26) a(i), range(2) b(r)"),
    "budget_grants": (lambda s, d: S.budget_grants(_requests(s, d), 2000),
                      """with recursive r as (select cast(user_id as varchar) as app_id, event_id as seq, cast(case when event_type = 'view' then -floor(value) else floor(value) end as bigint) as size, row_number() over (partition by user_id order by event_id) as k from events where value is not null),
 f(app_id, seq, size, k, granted, used) as (select app_id, seq, size, k, 2000 >= size, greatest(0, case when 2000 >= size then size else 0 end) from r where k = 1
 union all select r.app_id, r.seq, r.size, r.k, 2000 - f.used >= r.size, case when 2000 - f.used >= r.size then greatest(0, f.used + r.size) else f.used end from f join r on r.app_id = f.app_id and r.k = f.k + 1)
 select app_id, seq, size, granted, cast(2000 - used as bigint) as remaining from f"""),
}


def queries():
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql():
    return {k: v[1] for k, v in QUERIES.items() if v[1]}
