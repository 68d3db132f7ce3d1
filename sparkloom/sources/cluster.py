"""Cluster relations: fixed schemas, fan-out union, lookup of running apps, selective loading, NDJSON sink and pipe source.

Every relation has a fixed schema, so an empty fan-out gives an empty table and not a failure.
"""
import functools
import re

from pyspark.sql import functions as F

from ..functions.scalars import human_bytes
from ..plans import dialect

INSTANCES = "ip string, grpc_port int, urpc_port int, http_port int, total_memory string, used_memory string, running_apps bigint, tags string, status string"
ACTIVE_APPS = ("app_id string, registry_timestamp bigint, duration_minutes double, resident_bytes bigint, partition_number bigint, huge_partition_number bigint, "
               "reported_block_id_number bigint, received_bytes bigint, partition_split_triggered boolean")
HISTORICAL_APPS = ("app_id string, total_bytes bigint, partition_num bigint, huge_partition_num bigint, avg_huge_partition_bytes decimal(20,0), max_huge_partition_bytes decimal(20,0), "
                   "min_huge_partition_bytes decimal(20,0), start_timestamp bigint, end_timestamp bigint, partition_split_triggered boolean")
TABLES = {"instances": INSTANCES, "active_apps": ACTIVE_APPS, "historical_apps": HISTORICAL_APPS}
PAYLOAD = "data array<struct<id string, ip string, grpcPort int, nettyPort int, jettyPort int, totalMemory bigint, usedMemory bigint, availableMemory bigint, tags array<string>, status string>>"


def nodes_of_payload(payloads):
    """One row per node of recorded coordinator answers, payloads(body)."""
    return payloads.select(F.inline(F.from_json("body", PAYLOAD)["data"]))


def instances(nodes, counts):
    """The table of instances: nine columns, sizes as people read them, tags joined by commas."""
    n = nodes.select("ip", F.col("grpcPort").alias("grpc_port"), F.col("nettyPort").alias("urpc_port"), F.col("jettyPort").alias("http_port"), human_bytes(F.col("totalMemory")).alias("total_memory"),
                     human_bytes(F.col("usedMemory")).alias("used_memory"), F.array_join("tags", ",").alias("tags"), "status")
    j = n.join(counts.select("ip", "http_port", "running_apps"), ["ip", "http_port"], "left")
    return j.select(*[c.split()[0] for c in INSTANCES.split(", ")])


def counted_apps(numbers, apps):
    """(ip, http_port, running_apps): the node's own number, or where it gave none the length of its list of apps(ip,
    http_port, app_id); nodes that gave neither are not there."""
    listed = apps.groupBy("ip", "http_port").agg(F.count("app_id").alias("listed"))
    j = numbers.where("n is not null").join(listed, ["ip", "http_port"], "full")
    return j.select("ip", "http_port", F.coalesce("n", "listed").alias("running_apps"))


def answers(payloads, schema):
    """(rows of the table schema, number of failed nodes) of payloads(body), one answer of a node each; an answer that is
    missing or no list of objects is a failure and leaves no rows."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^(]*\))", schema)]
    rows = payloads.select(F.from_json("body", f"array<struct<{', '.join(re.sub(r'^(\S+) ', r'\1: ', c) for c in re.split(r',\s*(?![^(]*\))', schema))}>>").alias("r"))
    return rows.where("r is not null").select(F.inline("r")).select(*names), rows.where("r is null").count()


def running_apps(nodes, apps):
    """Adds running_apps by (ip, http_port); nodes that gave no answer get null, not 0."""
    n = apps.groupBy("ip", "http_port").agg(F.count("*").alias("running_apps"))
    return nodes.join(n, ["ip", "http_port"], "left")


def union_all(spark, frames, schema):
    """The union of per-node answers; failed nodes are None and leave no rows. Returns (rows, number of failed nodes)."""
    good = [f for f in frames if f is not None]
    empty = spark.createDataFrame([], schema)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good, empty), len(frames) - len(good)


def required_tables(spark, sql):
    """Names of the relations a statement reads, subqueries included and CTE names left out."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    named = set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", tree))
    local = {x.strip() for group in re.findall(r"(?:CTE|UnresolvedWith) \[([^\]]+)\]", tree) for x in group.split(",")}
    return {n.replace(", ", ".") for n in named} - local


def run_sql(spark, sql, loaders):
    """Registers only the tables that sql names, through loaders[name](), and returns its rows; no named table loads all.

    Forms that Spark's parser does not take are rewritten first.
    """
    sql = dialect.rewrite(sql)
    wanted = {n.split(".")[-1].lower() for n in required_tables(spark, sql)} & set(loaders) or set(loaders)
    for name in wanted:
        loaders[name]().createOrReplaceTempView(name)
    return spark.sql(sql)


def show(df, rows=1000):
    """The rows as a table on the console."""
    df.show(rows, truncate=False)


def write_ndjson(df, path):
    """One JSON object per line; nulls are written, so every line has every key. No rows, no output; tells which it was."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return True


def for_each(targets_, action):
    """(ip, http_port, ok, error) of the action on each target, on the executors; a failure stops no other target."""
    def run(batches):
        for pdf in batches:
            said = []
            for ip, port in zip(pdf.ip, pdf.http_port):
                try:
                    action(ip, int(port))
                    said.append(None)
                except Exception as e:
                    said.append(f"{type(e).__name__}: {e}")
            yield pdf[["ip", "http_port"]].assign(ok=[x is None for x in said], error=said)

    return targets_.select("ip", "http_port").where("ip is not null and http_port is not null").mapInPandas(run, "ip string, http_port int, ok boolean, error string")


# fixed values: the administrative requests of a server
ADMIN = {"kill": "kill", "force_kill": "kill=force", "update_tags": "update_tags={}", "add_tag": "add_tag={}", "delete_tag": "delete_tag={}"}


def admin_url(kind, value=None):
    """The address column of an administrative request for rows (ip, http_port)."""
    if kind == "update_tags":
        value = ",".join(value)
    return F.format_string("http://%s:%d/admin?" + ADMIN[kind].format(value).replace("%", "%%"), "ip", "http_port")


def targets(lines):
    """(ip, http_port) of JSON lines(value); array brackets, blank lines and trailing commas are passed over."""
    body = F.regexp_replace(F.trim("value"), ",$", "")
    rows = lines.select(body.alias("body")).where("body not in ('', '[', ']')")
    return rows.select(F.from_json("body", "ip string, http_port int").alias("t")).select("t.*")


def tally(results):
    """(total, success, failed) of results(ok); the failed rows are results.where('not ok')."""
    return results.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))


def resolve_cluster(name, known):
    """The address itself, or the one known under that name."""
    if name.startswith(("http://", "https://")):
        return name
    if name not in known:
        raise KeyError(f"unknown cluster {name!r}; known: {sorted(known)}")
    return known[name]
