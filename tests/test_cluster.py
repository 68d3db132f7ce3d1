"""Cluster tables, state rules, the budget fold, and streams against their batch twins."""
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import blocks, files, state
from sparkloom.plans import dialect
from sparkloom.sources import cluster
from sparkloom.streaming import activity

SF = "/root/testdata/sf0.001"


def test_required_tables(spark):
    sql = "with y as (select ip from instances) select * from y where ip in (select app_id from active_apps)"
    assert cluster.required_tables(spark, sql) == {"instances", "active_apps"}


def test_empty_relations_and_sink(spark, tmp_path):
    rows, failed = cluster.union_all(spark, [None, None], cluster.ACTIVE_APPS)
    assert failed == 2 and rows.count() == 0
    empty = cluster.run_sql(spark, "select * from instances where ip = 'none'", {"instances": lambda: spark.createDataFrame([], cluster.INSTANCES)})
    assert cluster.write_ndjson(empty, str(tmp_path / "out")) is False and not (tmp_path / "out").exists()


def test_payload_and_targets(spark):
    body = '{"code": 0, "data": [{"id": "a", "ip": "h", "grpcPort": 1, "jettyPort": 2, "tags": ["x"], "status": "ACTIVE"}]}'
    n = cluster.nodes_of_payload(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert [(r.ip, r.grpcPort, r.tags) for r in n] == [("h", 1, ["x"])]
    lines = spark.createDataFrame([("[",), ('{"ip": "h", "http_port": 3},',), ("",), ("]",)], "value string")
    assert [tuple(r) for r in cluster.targets(lines).collect()] == [("h", 3)]


def test_config(spark):
    c = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": "x"}}, "e": true}')], "id int, body string")
    flat = state.flatten_config(c)
    assert {(r.key, r.value) for r in flat.collect()} == {("a.b", "1"), ("a.c.d", "x"), ("e", "true")}
    new = spark.createDataFrame([(1, "a.b", "2"), (1, "z", "1"), (1, "e", "true")], "id int, key string, value string")
    assert [(r.key, r.after) for r in state.changed_options(flat, new).collect()] == [("a.b", "2")]
    m = spark.range(1).select(F.create_map(F.lit("k"), F.lit("bad")).alias("m")).select(state.option(F.col("m"), "k", "int", 5), state.option(F.col("m"), "q", "int", 5))
    assert tuple(m.first()) == (None, 5)


def test_disk_check(spark):
    d = spark.createDataFrame([(True, None, "a", "a"), (False, "x: No space left on device", "a", None), (False, None, "a", "b"), (False, None, "a", "a")], "t boolean, e string, w string, r string")
    assert [r[0] for r in d.select(state.disk_check(F.col("t"), F.col("e"), F.col("w"), F.col("r"))).collect()] == ["abnormal", "no_space", "corrupted", "normal"]


def test_continuous_group_sizes(spark):
    rows = blocks.assign_continuous(spark, 52, 2, list("abcde"), 1, 20).orderBy("start_partition").collect()
    sizes, last = [], None
    for r in rows:
        if r.server == last:
            sizes[-1] += 1
        else:
            sizes.append(1)
        last = r.server
    assert sizes == [2] * 11 + [1] * 4


def test_budget_fold(spark):
    rows = [("a", 1, 60), ("a", 2, 60), ("a", 3, -30), ("a", 4, 70), ("a", 5, -500), ("a", 6, 100), ("b", 1, 101), ("b", 2, 100)]
    out = state.budget_grants(spark.createDataFrame(rows, "app_id string, seq long, size long"), 100).orderBy("app_id", "seq").collect()
    assert [(r.granted, r.remaining) for r in out] == [(True, 40), (False, 40), (True, 70), (True, 0), (True, 100), (True, 0), (False, 100), (True, 0)]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (activity.tumbling(stream, "event_type", "ts", "1 day", "value").writeStream.format("memory").queryName("tumbled").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("tumbled")) == rows(activity.tumbling(batch, "event_type", "ts", "1 day", "value")) != []


def test_sinks_and_actions(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("h1", 1, None), ("h2", 2, "x")], "ip string, http_port int, note string")
    assert cluster.write_ndjson(rows, str(tmp_path / "out")) is True
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"ip":"h1","http_port":1,"note":null}', '{"ip":"h2","http_port":2,"note":"x"}']
    assert cluster.write_ndjson(rows.where("ip = 'none'"), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    cluster.show(rows)
    assert "|h2 |2        |x   |" in capsys.readouterr().out

    def act(ip, port):
        if port == 2:
            raise RuntimeError("no answer")

    said = cluster.for_each(rows, act)
    assert tuple(cluster.tally(said).first()) == (2, 1, 1)
    assert [(r.ip, r.error) for r in said.where("not ok").collect()] == [("h2", "RuntimeError: no answer")]
    urls = lambda *a: [r[0] for r in rows.where("http_port = 1").select(cluster.admin_url(*a)).collect()]
    assert urls("force_kill") == ["http://h1:1/admin?kill=force"] and urls("update_tags", ["a", "b"]) == ["http://h1:1/admin?update_tags=a,b"]


def test_failed_nodes_are_counted(spark):
    body = spark.createDataFrame([('[{"app_id": "a", "received_bytes": 5}]',), ("{broken",), (None,), ("[]",)], "body string")
    rows, failed = cluster.answers(body, cluster.ACTIVE_APPS)
    assert failed == 2 and [(r.app_id, r.received_bytes, r.resident_bytes) for r in rows.collect()] == [("a", 5, None)]


def test_cluster_names():
    assert cluster.resolve_cluster("http://x:1", {}) == "http://x:1" and cluster.resolve_cluster("prod", {"prod": "http://p"}) == "http://p"
    with pytest.raises(KeyError):
        cluster.resolve_cluster("none", {"prod": "http://p"})


def test_dialect_leaves_other_statements_alone():
    for sql in ("select a . b from t where x is distinct from 1", "select 'qualify any (select' as s , `at time zone` from t -- note".replace(" -- note", "")):
        assert dialect.rewrite(sql).replace(" ", "") == sql.replace(" ", "")
    parts = ["/*+ broadcast(t) */", "10L", ".5", "1e3", r"'it\'s  so'", r"r'a\d'", "x == 1", "x <=> y", '"q  q"']
    sql = "select {} {} as a , {} as b , {} as c , {} as d , {} as e , {} as f , {} as g , {} as h from t".format(*parts)
    assert dialect.rewrite(sql) == sql
    with pytest.raises(ValueError):
        dialect.rewrite("select (1")
    assert dialect.rewrite("select 1 /* qualify */") == "select 1"


def test_cluster_statement_in_another_dialect(spark):
    nodes = spark.createDataFrame([("a", "x", 3), ("b", "x", 5), ("c", "y", 1)], "ip string, rack string, running_apps long")
    got = cluster.run_sql(spark, "select ip, rack from instances qualify row_number() over (partition by rack order by running_apps desc) = 1", {"instances": lambda: nodes})
    assert sorted(tuple(r) for r in got.collect()) == [("b", "x"), ("c", "y")]


def test_errors_of_requests(spark):
    with pytest.raises(ValueError):
        blocks.partition_sizes(spark.createDataFrame([], "app_id string, shuffle_id int, partition_id int, length int"), 10, 10)
    bad = spark.createDataFrame([("a", 1, 2, [(0, [1, 2], [5, 6])])], "app_id string, shuffle_id int, task_attempt_id int, partitions array<struct<partition_id:int,block_ids:array<long>,record_numbers:array<long>>>")
    with pytest.raises(Exception, match="exactly one record count"):
        blocks.result_reports(bad).collect()
    kind = "app_id string, shuffle_id int, partition_ids array<int>, block_counts array<int>, block_ids array<long>, lengths array<int>, uncompress_lengths array<int>, crcs array<long>, task_attempt_ids array<long>, data binary"
    with pytest.raises(Exception, match="do not fit"):
        blocks.combined_blocks(spark.createDataFrame([("a", 1, [0], [2], [7, 8], [1, 2], [1, 2], [0, 0], [1, 1], b"ab")], kind)).collect()
    got = blocks.combined_blocks(spark.createDataFrame([("a", 1, [0, 4], [1, 1], [7, 8], [1, 2], [1, 2], [0, 0], [1, 1], b"abc")], kind)).collect()
    assert [(r.partition_id, r.block_id, bytes(r.data)) for r in got] == [(0, 7, b"a"), (4, 8, b"bc")]
    with pytest.raises(Exception, match="unknown server"):
        blocks.with_endpoints(spark.createDataFrame([(1,)], "server int"), spark.createDataFrame([], "id int, ip string, port int")).collect()
    short = spark.createDataFrame([(b"x" * 39, 1)], "r binary, k int")
    with pytest.raises(Exception, match="40 bytes"):
        short.select(blocks.decode_index(F.col("r")).alias("d")).collect()


def test_cursor_of_a_filtered_block(spark):
    rows = [("a", 1, 0, s, s % 2, 10) for s in range(1, 7)]
    b = spark.createDataFrame([(*r, r[3] * 100) for r in rows], "app_id string, shuffle_id int, partition_id int, seq long, task_attempt_id int, length int, block_id long")
    keep = spark.createDataFrame([(0,)], "task_attempt_id int")
    page = lambda *a: [(r.block_id, r.offset, r.is_end) for r in blocks.cursor_read(b, *a).orderBy("seq").collect()]
    assert page(300, 1000, keep) == [(400, 0, True), (600, 10, True)]  # the cursor block belongs to another task
    assert page(-1, 20) == [(100, 0, False), (200, 10, False)]
    assert page(77, 1000, keep) == [(200, 0, True), (400, 10, True), (600, 20, True)]  # unknown: from the start
    assert page(600, 10) == []
    assert page(500, 10) == [(600, 0, False)]  # an exact fill is no end


def test_node_rules(spark):
    d = spark.createDataFrame([("n", 0.5, True, True, False), ("n", 0.7, True, False, False), ("m", 0.95, True, True, False), ("k", 0.1, True, True, True)], "node string, used_ratio double, normal boolean, has_space boolean, corrupted boolean")
    assert {r.node: r.healthy for r in state.server_health(d, 0.9, 1).collect()} == {"n": True, "m": False, "k": False}
    s = spark.createDataFrame([("DECOMMISSIONING", 0, 700), ("DECOMMISSIONING", 0, 600), ("DECOMMISSIONING", 1, 700), ("ACTIVE", 0, 700)], "state string, n int, sec int")
    assert [r[0] for r in s.select(state.decommission_done(F.col("state"), F.col("n"), F.col("sec"))).collect()] == [True, False, False, False]
    assert [r[0] for r in s.select(state.reported_health(F.lit(True), F.col("state"))).collect()] == [False, False, False, True]
    e = spark.createDataFrame([(0, False), (3, False), (1, True)], "n int, terminal boolean")
    assert [r[0] for r in e.select(state.retry_class(F.col("n"), F.col("terminal"))).collect()] == ["requeue", "drop_lost", "drop"]


def test_balance_counters(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 9)], "id string, start_time int")
    first = state.balance(spark.createDataFrame([("a",), ("a",), ("gone",)], "server string"), spark.createDataFrame([("a", 1), ("b", 5), ("gone", 1)], "id string, start_time int"))
    got = {r.server: r.n for r in state.balance(spark.createDataFrame([("a",), ("b",)], "server string"), nodes, first.withColumn("n", F.col("n") + 4)).collect()}
    assert got == {"a": 7, "b": 1}  # b has restarted, the vanished server is gone


def test_config_reload(spark):
    old = spark.createDataFrame([(1, "a.b", "1"), (1, "c", "x")], "id int, key string, value string")
    new = spark.createDataFrame([(1, "a.b", "2"), (1, "zz", "9")], "id int, key string, value string")
    assert {(r.key, r.value) for r in state.known_changes(old, new).collect()} == {("a.b", "2"), ("c", "x")}


def test_files_are_written_by_partition(spark, tmp_path):
    b = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 2, 6)], "app_id string, shuffle_id int, partition_id int, block_id int")
    for _ in range(2):
        files.write_files(b, str(tmp_path / "f"))
    assert (tmp_path / "f" / "app_id=a" / "shuffle_id=1" / "partition_id=2").is_dir() and spark.read.parquet(str(tmp_path / "f")).count() == 4


def stream_of(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_totals_in_update_mode(spark, tmp_path):
    b = spark.createDataFrame([("a", 1, k % 2, 10) for k in range(20)], "app_id string, shuffle_id int, partition_id int, length long").repartition(4)
    seen = {}

    def keep(batch, _):
        seen.update({r.partition_id: (r.bytes, r.n) for r in batch.collect()})

    q = activity.every(activity.running_totals(stream_of(spark, tmp_path, b)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")), "500 milliseconds").start()
    q.processAllAvailable()
    q.stop()
    assert seen == {r.partition_id: (r.bytes, r.n) for r in activity.running_totals(b).collect()} == {0: (100, 10), 1: (100, 10)}


def test_event_bus_retries_and_loses_nothing(spark, tmp_path):
    events = spark.createDataFrame([(k, "warm" if k % 3 else "cold") for k in range(30)], "id int, tier string").repartition(3)
    got, fails = {"warm": set(), "cold": set()}, [0]

    def cold(rows):
        fails[0] += 1
        if fails[0] < 3:
            raise OSError("busy")
        got["cold"] |= {r.id for r in rows.collect()}

    bus = activity.dispatch(stream_of(spark, tmp_path, events), "tier", {"warm": lambda rows: got["warm"].update(r.id for r in rows.collect()), "cold": cold})
    bus.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert got["warm"] | got["cold"] == set(range(30)) and got["cold"] == {k for k in range(30) if k % 3 == 0} and fails[0] >= 3


def test_reports_liveness_and_quantiles(spark):
    r = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 2, 7)], "app string, task int, ts int")
    assert activity.first_reports(r, ["app", "task"], "ts").count() == 2
    h = spark.createDataFrame([("n", 10, "ACTIVE"), ("n", 40, "UNHEALTHY"), ("m", 20, "ACTIVE")], "node string, at long, status string").withColumn("ts", F.timestamp_seconds("at"))
    live = activity.liveness(h, "node", "ts")
    assert {(x.node, x.status) for x in live.collect()} == {("n", "UNHEALTHY"), ("m", "ACTIVE")}
    assert [x.node for x in activity.silent(live, "1970-01-01 00:00:50", 15).collect()] == ["m"]
    v = spark.range(1, 101).select(F.timestamp_seconds(F.col("id") % 2 * 3600).alias("ts"), F.col("id").cast("double").alias("v"))
    q = {x.began.hour: (x.p50, x.p99) for x in activity.latency_summary(v, "ts", "v", "1 hour").collect()}
    assert q == {0: (50.0, 100.0), 1: (49.0, 99.0)}


def numbered(spark, n, length=10, first=0):
    rows = [("a", 0, 0, k, k, k, length) for k in range(first, first + n)]
    return spark.createDataFrame(rows, "app_id string, shuffle_id int, partition_id int, seq long, block_id long, task_attempt_id long, length int")


def test_pages_of_ten_blocks(spark):
    def page(cursor, budget):
        r = blocks.cursor_read(numbered(spark, 10), cursor, budget).orderBy("seq").collect()
        return [x.block_id for x in r], r[-1].is_end

    assert page(-1, 20)[0] == [0, 1] and page(100, 20)[0] == [0, 1] and page(3, 20)[0] == [4, 5]
    assert page(-1, 101) == (list(range(10)), True)
    assert page(-1, 49) == (list(range(5)), False)
    assert page(5, 100) == ([6, 7, 8, 9], True)
    five = numbered(spark, 5, 5)
    first, rest = (blocks.cursor_read(five, c, 15).collect() for c in (-1, 2))
    assert (len(first), first[0].is_end, len(rest), rest[0].is_end) == (3, False, 2, True)


def test_block_ids_of_layouts(spark):
    bits = (18, 24, 21)
    one = spark.range(1).select(blocks.pack(F.lit(123), F.lit(45), F.lit(67), bits).alias("id"))
    assert one.select(blocks.partition_of(F.col("id"), bits), blocks.task_of(F.col("id"), bits)).first()[:] == (45, 67)


def test_block_id_sets(spark):
    ids = spark.range(2000).select(F.lit("a").alias("app_id"), F.lit(1).alias("shuffle_id"), (F.col("id") % 100).cast("int").alias("partition_id"), F.col("id").alias("block_id"))
    wanted = lambda n: spark.range(n).select(F.lit("a").alias("app_id"), F.lit(1).alias("shuffle_id"), F.col("id").cast("int").alias("partition_id"))
    assert [blocks.id_union(ids, wanted(n)).count() for n in (1, 4)] == [20, 80]
    none = spark.createDataFrame([], "app_id string, shuffle_id int")
    assert blocks.id_counter(ids, none).first().n == 2000
    assert blocks.id_counter(ids, spark.createDataFrame([("a", 1)], "app_id string, shuffle_id int")).first().n == 0


def test_reports_of_tasks(spark):
    r = spark.createDataFrame([("a", 1, p, t, 10, k) for p in range(20) for t in (10, 20) for k in range(2)], "app_id string, shuffle_id int, partition_id int, task_attempt_id long, record_number long, report_seq int")
    latest = blocks.record_stats(r)
    assert latest.count() == 40 and latest.agg(F.sum("record_number")).first()[0] == 400
    two = r.unionByName(r.withColumn("app_id", F.lit("b")).withColumn("record_number", F.lit(7)))
    assert {(x.app_id, x.record_number) for x in blocks.record_stats(two).collect()} == {("a", 10), ("b", 7)}
    got = blocks.stats_of(latest, spark.createDataFrame([("a", 1, 3), ("a", 1, 99)], "app_id string, shuffle_id int, partition_id int")).collect()
    assert [(x.partition_id, x.record_numbers) for x in got] == [(3, {10: 10, 20: 10})]


def test_host_policies_of_three_servers(spark):
    n = spark.createDataFrame([("s1", "host-a"), ("s2", "host-a"), ("s3", "host-b")], "id string, ip string").withColumns({"free_memory": F.lit(100), "tags": F.array(F.lit("x")), "is_healthy": F.lit(True)})
    pick = lambda want, policy: [r.id for r in blocks.pick_servers(blocks.rank_servers(n, ["x"]), want, policy).collect()]
    assert pick(2, "NONE") == ["s1", "s2"] and pick(3, "MUST_DIFF") == ["s1", "s3"] and pick(3, "PREFER_DIFF") == ["s1", "s3", "s2"]
    assert blocks.rank_servers(n, ["y"]).count() == 0
    assert {r.id for r in blocks.rank_servers(n, faulty=spark.createDataFrame([("s1",)], "id string")).collect()} == {"s2", "s3"}
