"""Analytic queries over the relational tables; one text is both the Spark query, rewritten where Spark needs it, and its SQL check."""
from . import dialect

TABLES = "region nation customer supplier part orders lineitem events".split()

M = "cast(sum(cast({} as decimal(18,2))) as decimal(28,2))"
PRICE = M.format("l_extendedprice")

SQL = {
    "pricing_summary": f"select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, {PRICE} as sum_price, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "star_join_topk": f"select n_name, o_orderpriority, {PRICE} as revenue from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and l_shipdate >= timestamp '1996-01-01 00:00:00' group by n_name, o_orderpriority order by revenue desc, n_name, o_orderpriority limit 20",
    "in_between_like": "select p_brand, count(*) as n from part where p_size between 5 and 20 and p_brand in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') and p_name like '%a%' and p_retailprice <> 0 group by p_brand",
    "or_of_ands": "select count(*) as n from lineitem, part where (p_partkey = l_partkey and p_size < 10 and l_quantity > 20) or (p_partkey = l_partkey and p_size > 40 and l_quantity < 10)",
    "case_pivot": "select o_orderstatus, sum(case when o_orderpriority like '1%' then 1 else 0 end) as urgent, sum(case o_orderpriority when '5-LOW' then 1 else 0 end) as low from orders group by o_orderstatus",
    "left_join_null": "select o_orderkey from orders left outer join lineitem on o_orderkey = l_orderkey where l_orderkey is null",
    "full_join": "select count(*) as n, count(a.k) as a, count(b.k) as b from (select o_orderkey as k from orders where o_orderstatus = 'F') a full outer join (select distinct l_orderkey as k from lineitem where l_quantity > 40) b on a.k = b.k",
    "scalar_product": "select a.n as low, b.n as high, cast(a.n as decimal(15,4)) / cast(nullif(b.n, 0) as decimal(15,4)) > 1 as more from (select count(*) as n from lineitem where l_quantity < 10) a, (select count(*) as n from lineitem where l_quantity > 40) b",
    "theta_join": "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_quantity < b.l_quantity",
    "exists_semi": "select count(*) as n from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 45)",
    "in_subquery": "select count(*) as n from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)",
    "exists_or": "select count(*) as n from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'P') or exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey = 1)",
    "not_exists": "select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)",
    "semi_residual": "select count(*) as n from lineitem a where exists (select 1 from lineitem b where a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey)",
    "correlated_scalar": "select count(*) as n from lineitem l where l_quantity > (select 1.2 * avg(l_quantity) from lineitem m where m.l_partkey = l.l_partkey)",
    "cte_self_join": "with y as (select o_custkey as k, year(o_orderdate) as y, count(*) as n from orders group by 1, 2) select a.k, a.y, a.n, b.n as next_n from y a join y b on a.k = b.k and b.y = a.y + 1 where b.n > a.n",
    "stddev_cov": "select l_suppkey, round(stddev_samp(l_quantity), 4) as sd, round(avg(l_quantity), 4) as mean from lineitem group by l_suppkey having stddev_samp(l_quantity) / nullif(avg(l_quantity), 0) > 0.5",
    "distinct_counts": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, count(l_tax) as taxed from lineitem group by l_returnflag",
    "rollup_grouping": "select n_regionkey, n_name, grouping(n_regionkey) + grouping(n_name) as level, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_name)",
    "cube_counts": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "having_scalar": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select 1.5 * avg(n) from (select count(*) as n from orders group by o_custkey) t)",
    "select_distinct": "select distinct l_returnflag, l_linestatus from lineitem",
    "group_by_key_sum": "select id % 5 as k, sum(id) as s from (select n_nationkey * 4 + r_regionkey as id from nation cross join region where r_regionkey < 4) t group by id % 5",
    "rank_topn": "select * from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk from orders) t where rk <= 3",
    "ratio_to_total": "select l_suppkey, l_returnflag, q, round(q * 100 / sum(q) over (partition by l_returnflag), 6) as share from (select l_suppkey, l_returnflag, sum(l_quantity) as q from lineitem group by 1, 2) t",
    "sum_of_sums": "select l_suppkey, l_returnflag, sum(l_quantity) as q, sum(sum(l_quantity)) over (partition by l_suppkey) as total from lineitem group by l_suppkey, l_returnflag",
    "cumulative": "select user_id, event_id, count(*) over (partition by user_id order by ts rows between unbounded preceding and current row) as n, max(value) over (partition by user_id order by ts rows between unbounded preceding and current row) as top from events",
    "rank_over_rollup": "select p_brand, p_size, n, rank() over (partition by lvl order by n desc, p_brand nulls first, p_size nulls first) as rk from (select p_brand, p_size, grouping(p_brand) + grouping(p_size) as lvl, count(*) as n from part group by rollup (p_brand, p_size)) t",
    "lag_lead": "select user_id, event_id, lag(event_type) over (partition by user_id order by ts) as prev, lead(event_type) over (partition by user_id order by ts) as nxt, dense_rank() over (partition by user_id order by event_type) as dr, ntile(4) over (partition by user_id order by ts) as nt from events",
    "union_all": "select 'o' as t, o_custkey as k from orders where o_totalprice > 200000 union all select 'c', c_custkey from customer where c_acctbal < 0",
    "union_distinct": "select o_custkey as k from orders union select c_custkey from customer",
    "intersect": "select c_custkey as k from customer where c_acctbal > 0 intersect select o_custkey from orders",
    "except_": "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'",
    "scalar_functions": "select c_custkey, upper(substr(c_name, 1, 4)) as u, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg, abs(c_acctbal) as a, round(c_acctbal, 1) as r, c_name || '-' || c_mktsegment as tag, length(trim(c_name)) as n, cast(c_acctbal as decimal(15,2)) as d from customer",
    "date_interval": "select count(*) as n from orders where o_orderdate between timestamp '1997-01-01 00:00:00' and timestamp '1997-01-01 00:00:00' + interval '30' day",
    "is_distinct": "select count(*) as n from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 48 where l_suppkey is distinct from 3 and (l_suppkey > 5) is not true",
    "lateral_top": "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t",
    "health_gaps": "select user_id, grp, count(*) as n, min(ts) as began from (select *, sum(chg) over (partition by user_id order by ts rows unbounded preceding) as grp from (select user_id, ts, case when event_type = lag(event_type) over (partition by user_id order by ts) then 0 else 1 end as chg from events) a) b group by user_id, grp",
    "latency_buckets": "select case when l_extendedprice <= 20000 then '0-1m' else '1m+' end as bucket, count(*) as n, max(l_quantity) as top from lineitem group by 1",
    "tumbling_hours": "select date_trunc('hour', ts) as w, event_type, count(*) as n from events group by 1, 2",
}


def _run(sql):
    def query(spark, sf_dir):
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(dialect.rewrite(sql))

    return query


def queries():
    return {k: _run(v) for k, v in SQL.items()}


def oracle_sql():
    return dict(SQL)
