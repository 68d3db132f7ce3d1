"""Relational and dialect forms: what Spark runs after rewriting, next to the SQL of the check."""
from . import dialect
from .corpus import TABLES

# name: (statement, check); a check of None is the statement itself
FORMS = {
    "join_right_using": ("select r_name, count(n_name) as n from (select n_regionkey as r_regionkey, n_name from nation where n_nationkey < 12) n right join region r using (r_regionkey) group by r_name", None),
    "join_natural": ("select r_name, count(*) as n from region natural join (select n_regionkey as r_regionkey, n_name from nation) t group by r_name", None),
    "join_cross_explicit": ("select count(*) as n, sum(n_nationkey * r_regionkey) as s from nation cross join region", "select count(*) as n, cast(sum(n_nationkey * r_regionkey) as bigint) as s from nation cross join region"),
    "join_semi_anti_syntax": ("select count(*) as n, 'semi' as kind from orders o left semi join lineitem l on l.l_orderkey = o.o_orderkey and l_quantity > 45 union all select count(*), 'anti' from orders o left anti join lineitem l on l.l_orderkey = o.o_orderkey and l_quantity > 45",
                              "select count(*) as n, 'semi' as kind from orders o semi join (select * from lineitem where l_quantity > 45) l on l.l_orderkey = o.o_orderkey union all select count(*), 'anti' from orders o anti join (select * from lineitem where l_quantity > 45) l on l.l_orderkey = o.o_orderkey"),
    "dialect_right_semi": ("select c_custkey from orders o right semi join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 200000", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)"),
    "dialect_right_anti": ("select c_custkey from orders o right anti join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 250000 where c.c_acctbal > 0", "select c_custkey from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 250000)"),
    "dialect_straight_prewhere": ("select n_name, count(*) as n from customer straight_join nation on c_nationkey = n_nationkey prewhere c_acctbal > 100 where n_regionkey < 3 group by n_name", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal > 100 and n_regionkey < 3 group by n_name"),
    "dialect_qualify": ("select user_id, event_id, row_number() over (partition by user_id order by ts desc) as rn from events where event_type = 'view' qualify rn <= 2", None),
    "dialect_qualify_window": ("select o_custkey, o_orderkey from orders qualify rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1 order by o_custkey limit 500", None),
    "dialect_any_all": ("select count(*) as n from part where p_retailprice > all (select p_retailprice from part where p_size = 7) or p_size = any (select n_nationkey from nation where n_regionkey = 2)", None),
    "dialect_any_order": ("select o_orderkey from orders where o_totalprice < any (select o_totalprice / 40 from orders where o_orderstatus = 'P')", None),
    "dialect_apply": ("select c_custkey, t.top from customer c cross apply (select max(o_totalprice) as top from orders o where o.o_custkey = c.c_custkey) t where t.top > 100000", "select o_custkey as c_custkey, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey group by 1 having max(o_totalprice) > 100000"),
    "dialect_outer_apply": ("select c_custkey, t.n from customer c outer apply (select o_custkey as k, count(*) as n from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'F' group by o_custkey) t", "select c_custkey, n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) t on o_custkey = c_custkey"),
    "dialect_asof": ("select p.event_id, v.value as seen from (select * from events where event_type = 'purchase' and user_id < 40) p asof join views v match_condition (p.ts >= v.ts) on p.user_id = v.user_id",
                     "select p.event_id, v.value as seen from (select * from events where event_type = 'purchase' and user_id < 40) p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts"),
    "dialect_similar": ("select count(*) as n from part where p_type similar to '%(STEEL|BRASS)' or p_brand similar to 'Brand#_1'", "select count(*) as n from part where regexp_full_match(p_type, '.*(STEEL|BRASS)') or regexp_full_match(p_brand, 'Brand#.1')"),
    "dialect_time_zone": ("select event_id, ts at time zone 'Asia/Tokyo' as local from events where user_id < 10", "select event_id, ts + interval '9' hour as local from events where user_id < 10"),
    "dialect_array_order": ("select o_custkey, array_join(array_agg(cast(o_orderkey as string) order by o_totalprice desc limit 3), ',') as top from orders group by o_custkey", "select o_custkey, array_to_string(list(cast(o_orderkey as varchar) order by o_totalprice desc)[1:3], ',') as top from orders group by o_custkey"),
    "range_group_sum": ("select id % 5 as k, sum(id) as s from range(1, 101) group by id % 5", "select id % 5 as k, cast(sum(id) as bigint) as s from range(1, 101) r(id) group by 1"),
    "is_not_null_backtick": ("select count(*) as `rows there` from orders left join (select l_orderkey from lineitem where l_quantity > 49) t on l_orderkey = o_orderkey where l_orderkey is not null", "select count(*) as \"rows there\" from orders left join (select l_orderkey from lineitem where l_quantity > 49) t on l_orderkey = o_orderkey where l_orderkey is not null"),
    "constant_arithmetic": ("select count(*) as n from orders where o_totalprice between 1200 + 11 and 1200 * 100 and o_custkey < 100 - 1", None),
    "rank_neighbours": ("with r as (select o_custkey as k, o_orderkey as o, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) select a.k, a.o, p.o as before, q.o as after from r a join r p on a.k = p.k and a.rn = p.rn + 1 join r q on a.k = q.k and a.rn = q.rn - 1", None),
    "grouping_sets": ("select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())", None),
    "rank_global": ("select p_brand, n, rank() over (order by n desc, p_brand) as rk from (select p_brand, count(*) as n from part group by p_brand) t", None),
    "window_values": ("""select event_id, first_value(event_type) over w as a, last_value(event_type) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as z, dense_rank() over (partition by user_id order by event_type) as d,
 ntile(3) over (partition by user_id order by event_id) as t, sum(user_id) over (partition by user_id order by event_id range between 100 preceding and 100 following) as near from events window w as (partition by user_id order by event_id)""",
                      """select event_id, first_value(event_type) over w as a, last_value(event_type) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as z, dense_rank() over (partition by user_id order by event_type) as d,
 ntile(3) over (partition by user_id order by event_id) as t, cast(sum(user_id) over (partition by user_id order by event_id range between 100 preceding and 100 following) as bigint) as near from events window w as (partition by user_id order by event_id)"""),
    "order_by_case": ("select o_orderkey, o_orderpriority from orders order by case when o_orderpriority like '1%' then 0 else 1 end, o_totalprice desc, o_orderkey limit 25", None),
    "concat_casts": ("select c_custkey, concat(c_name, ', ', c_mktsegment) as full, cast(c_acctbal as int) as whole, cast(cast('1997-03-05' as date) as string) as day from customer where c_acctbal = floor(c_acctbal) or c_custkey < 50",
                     "select c_custkey, concat(c_name, ', ', c_mktsegment) as full, cast(trunc(c_acctbal) as int) as whole, cast(cast('1997-03-05' as date) as varchar) as day from customer where c_acctbal = floor(c_acctbal) or c_custkey < 50"),
    "string_predicates": ("select count(*) filter (where p_name ilike '%A%') as a, count(*) filter (where p_type rlike '^S.*L$') as b, count_if(position('#' in p_brand) = 6) as c, min(overlay(p_brand placing 'X' from 1 for 5)) as d, count(*) filter (where (p_size, p_brand) in ((1, 'Brand#11'), (2, 'Brand#12'))) as e from part",
                          "select count(*) filter (where p_name ilike '%A%') as a, count(*) filter (where regexp_matches(p_type, '^S.*L$')) as b, count(*) filter (where position('#' in p_brand) = 6) as c, min('X' || substr(p_brand, 6)) as d, count(*) filter (where (p_size, p_brand) in ((1, 'Brand#11'), (2, 'Brand#12'))) as e from part"),
    "number_forms": ("select extract(year from o_orderdate) as y, o_orderstatus, sum(ceil(o_totalprice)) as up, sum(floor(o_totalprice)) as down, count(*) as n from orders group by all", "select cast(extract(year from o_orderdate) as int) as y, o_orderstatus, cast(sum(ceil(o_totalprice)) as bigint) as up, cast(sum(floor(o_totalprice)) as bigint) as down, count(*) as n from orders group by all"),
    "within_group": ("select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as mid from lineitem group by l_returnflag", "select l_returnflag, quantile_cont(l_quantity, 0.5) as mid from lineitem group by 1"),
    "collate_compare": ("select count(*) as n from customer where c_mktsegment collate utf8_lcase = 'building'", "select count(*) as n from customer where lower(c_mktsegment) = 'building'"),
    "distribute_sort": ("select l_suppkey, count(*) as n from (select * from lineitem distribute by l_suppkey sort by l_quantity) t group by l_suppkey", "select l_suppkey, count(*) as n from lineitem group by 1"),
    "truth_tests": ("select count(*) as n from orders left join (select l_orderkey, l_quantity from lineitem where l_quantity > 47) t on l_orderkey = o_orderkey where (l_quantity > 49) is not false and (l_quantity > 48) is unknown", "select count(*) as n from orders left join (select l_orderkey, l_quantity from lineitem where l_quantity > 47) t on l_orderkey = o_orderkey where coalesce(l_quantity > 49, true) and (l_quantity > 48) is null"),
    "except_all_set": ("select o_custkey as k from orders except all select c_custkey from customer", None),
}


def _run(sql):
    def query(spark, sf_dir):
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        spark.sql("create or replace temp view views as select * from events where event_type = 'view'")
        return spark.sql(dialect.rewrite(sql))

    return query


def queries():
    return {k: _run(v[0]) for k, v in FORMS.items()}


def oracle_sql():
    return {k: v[1] or v[0] for k, v in FORMS.items()}
