"""Node, tag, disk, configuration and application state as column expressions and small relations."""
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the states and what they count as
ACTIVE_STATES = ("ACTIVE", "HEALTHY", "CANCEL_DECOMMISSION")
UNHEALTHY_STATES = ("DECOMMISSIONING", "DECOMMISSIONED", "UNHEALTHY")


def all_tags(builtin, custom):
    return F.concat(builtin, custom)


def add_tags(custom, tags):
    return F.array_union(custom, tags)


def replace_tags(tags):
    return F.array_distinct(tags)


def delete_tags(custom, tags):
    return F.array_except(custom, tags)


def may_delete(builtin, custom, tag):
    """Only custom tags that are there can go; a built-in tag never."""
    return ~F.array_contains(builtin, tag) & F.array_contains(custom, tag)


def mapped_status(state):
    return F.when(state.isin(*ACTIVE_STATES), "Active").when(state.isin(*UNHEALTHY_STATES), "Unhealthy")


def reported_health(healthy, state):
    return healthy & F.coalesce(mapped_status(state) == "Active", F.lit(False))


def decommission_done(state, n_apps, seconds_in_state, limit=600):
    return (state == "DECOMMISSIONING") & (n_apps == 0) & (seconds_in_state > limit)


def server_health(disks, max_used_ratio, min_usable):
    """(node, healthy) of disks(node, used_ratio, normal, has_space, corrupted): every disk under the ratio, and enough usable ones."""
    usable = F.col("normal") & F.col("has_space") & ~F.col("corrupted")
    return disks.groupBy("node").agg((F.bool_and(F.col("used_ratio") <= max_used_ratio) & (F.count_if(usable) >= min_usable)).alias("healthy"))


def health_reason(app_limit=None, allocated_limit=None):
    """The first rule that a server(panicked, disks_ok, store_ok, n_apps, allocated, hangs) breaks, or null if it is healthy."""
    wrong = F.when(F.col("panicked"), "panic").when(~F.col("disks_ok"), "disk").when(~F.col("store_ok"), "store")
    if app_limit is not None:
        wrong = wrong.when(F.col("n_apps") > app_limit, "apps")
    if allocated_limit is not None:
        wrong = wrong.when(F.col("allocated") > allocated_limit, "allocated")
    return wrong.when(F.col("hangs"), "hang")


def hangs(samples, node, ms, used, apps, least_apps=50, limit=300_000):
    """Adds hangs: from a sample on whose memory use, not zero and with enough apps, has stood still for more than limit ms."""
    w = Window.partitionBy(node).orderBy(ms)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    still = F.coalesce((F.col(used) == F.lag(used).over(w)) & (F.col(used) != 0) & (F.col(apps) >= least_apps), F.lit(False))
    s = samples.withColumn("still", still).withColumn("since", F.last(F.when(~F.col("still"), F.col(ms)), True).over(so_far))
    late = F.col("still") & (F.col(ms) - F.col("since") > limit)
    return s.withColumn("hangs", F.bool_or(late).over(so_far)).drop("still", "since")


def tickets(issued, now, timeout):
    """(tickets that stay, (app_id, freed, n) of those older than timeout seconds) of issued(app_id, size, created)."""
    old = F.lit(now) - F.col("created") > timeout
    return issued.where(~old), issued.where(old).groupBy("app_id").agg(F.sum("size").alias("freed"), F.count("*").alias("n"))


def retained(history, now_ms, days):
    """Historical apps whose end lies no more than so many days back."""
    return history.where(F.lit(now_ms) - F.col("end_timestamp") <= days * 86_400_000)


def idle_apps(heartbeats, now, minutes):
    """Apps whose last heartbeat is more than so many minutes old; now is seconds."""
    return heartbeats.groupBy("app_id").agg(F.max("ts").alias("last_seen")).where(F.lit(now) - F.col("last_seen") > minutes * 60)


def still_idle(idle, heartbeats):
    """Of idle(app_id, last_seen) those without a heartbeat since: a purge asks again before it acts."""
    newer = heartbeats.select("app_id", "ts").alias("h")
    return idle.alias("i").join(newer, (F.col("i.app_id") == F.col("h.app_id")) & (F.col("h.ts") > F.col("i.last_seen")), "left_anti")


def available(nodes, tags=()):
    """Healthy, active nodes with free memory that have all tags."""
    has = F.size(F.array_except(F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>"), "tags")) == 0
    return nodes.where((F.col("is_healthy") & (F.col("status") == "Active") & (F.col("free_memory") > 0)) & has)


def access(nodes, tags=()):
    """One row: GRANTED if any available node has all tags, else ACCESS_DENIED."""
    return available(nodes, tags).agg(F.when(F.count("*") > 0, "GRANTED").otherwise("ACCESS_DENIED").alias("access"))


def cluster_counts(nodes):
    """One row (nodes, available, up)."""
    n = F.count_if(F.col("is_healthy") & (F.col("status") == "Active") & (F.col("free_memory") > 0))
    return nodes.agg(F.count("*").alias("nodes"), n.alias("available"), (F.count("*") > 0).alias("up"))


def known_changes(old, new):
    """Every key of old with its value after a reload; keys that only new has are not taken up."""
    n = new.withColumnRenamed("value", "after")
    return old.join(n, ["id", "key"], "left").select("id", "key", F.coalesce("after", "value").alias("value"))


def disk_check(timed_out, error, written, read):
    """abnormal, no_space, corrupted or normal, in this order of precedence."""
    return (F.when(timed_out, "abnormal").when(F.contains(error, F.lit("No space left on device")), "no_space")
            .when(error.isNotNull() | ~written.eqNullSafe(read), "corrupted").otherwise("normal"))


def flatten_config(configs, depth=6):
    """(id, key, value) with dotted keys of configs(id, body); objects nested deeper than depth stay as text."""
    level = configs.select("id", F.explode(F.from_json("body", "map<string,string>")).alias("key", "value"))
    done = None
    for _ in range(depth):
        nested = F.coalesce(F.startswith("value", F.lit("{")), F.lit(False))
        plain = level.where(~nested)
        done = plain if done is None else done.unionByName(plain)
        inner = F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")
        level = level.where(nested).select("id", "key", inner).select("id", F.concat_ws(".", "key", "k").alias("key"), F.col("v").alias("value"))
    return done.unionByName(level)


def changed_options(old, new):
    """(id, key, before, after): options of old whose value in new differs; keys unknown to old are passed over."""
    a, b = old.withColumnRenamed("value", "before"), new.withColumnRenamed("value", "after")
    return a.join(b, ["id", "key"]).where(~F.col("before").eqNullSafe(F.col("after")))


def option(options, key, kind, default):
    """A missing key gives the default; an unparsable value gives null."""
    return F.coalesce(options[key], F.lit(str(default))).try_cast(kind)


def hysteresis(samples, key, order, used, high, low):
    """Adds healthy: false after a sample above high until one below low."""
    turn = F.when(F.col(used) > high, False).when(F.col(used) < low, True)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("healthy", F.coalesce(F.last(turn, True).over(w), F.lit(True)))


def retry_class(retries, terminal, limit=3):
    return F.when(terminal, "drop").when(retries >= limit, "drop_lost").otherwise("requeue")


def app_registry(events, now, ttl):
    """(app_id, registered, last_seen, user) of events(app_id, ts, user); ages below ttl seconds stay."""
    a = events.groupBy("app_id").agg(F.min("ts").alias("registered"), F.max("ts").alias("last_seen"), F.coalesce(F.max_by("user", F.when(F.col("user").isNotNull(), F.col("ts"))), F.lit("")).alias("user"))
    return a.where(F.lit(now) - F.col("last_seen") < ttl)


def balance(assigned, nodes, before=None):
    """(server, n): counts of assigned(server) added to before(server, n, start_time), restarted servers from 0, vanished ones gone."""
    n = nodes.select(F.col("id").alias("server"), "start_time").join(assigned.groupBy("server").agg(F.count("*").alias("add")), "server", "left")
    if before is None:
        return n.select("server", F.coalesce("add", F.lit(0)).alias("n"), "start_time")
    old = before.select("server", F.col("n").alias("old"), F.col("start_time").alias("old_start"))
    kept = F.when(F.col("start_time") > F.col("old_start"), 0).otherwise(F.coalesce("old", F.lit(0)))
    return n.join(old, "server", "left").select("server", (kept + F.coalesce("add", F.lit(0))).alias("n"), "start_time")


def budget_grants(requests, capacity):
    """Adds granted and remaining to requests(app_id, seq, size): a request is granted if the rest covers it; negative sizes release.

    A fold in order cannot be cut into windows. Rows stream through sorted partitions with one number kept per app, so an
    app of any size needs constant memory.
    """

    def fold(batches):
        app, used = None, 0
        for pdf in batches:
            granted, rest = [], []
            for a, size in zip(pdf.app_id, pdf["size"]):
                if a != app:
                    app, used = a, 0
                ok = capacity - used >= size
                used = max(0, used + size) if ok else used
                granted.append(bool(ok))
                rest.append(capacity - used)
            yield pd.DataFrame({"app_id": pdf.app_id, "seq": pdf.seq, "size": pdf["size"], "granted": granted, "remaining": rest})

    r = requests.select("app_id", F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size")).where("app_id is not null and size is not null")
    return r.repartition("app_id").sortWithinPartitions("app_id", "seq").mapInPandas(fold, "app_id string, seq long, size long, granted boolean, remaining long")
