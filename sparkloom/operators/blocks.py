"""Shuffle-block relations as DataFrame operators: layout, cursor reads, statistics, spill, routing and assignment.

All functions take and return DataFrames built from built-in expressions. Windows are keyed by partition of the block
relation, whose size the split threshold bounds.
"""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UID = ("app_id", "shuffle_id", "partition_id")
SEQ_BITS, PARTITION_BITS, TASK_BITS = 16, 24, 23
RECORD = 40


def pack(seq, partition, task, bits=(SEQ_BITS, PARTITION_BITS, TASK_BITS)):
    return F.shiftleft(seq.cast("long"), bits[1] + bits[2]).bitwiseOR(F.shiftleft(partition.cast("long"), bits[2])).bitwiseOR(task.cast("long"))


def partition_of(block_id, bits=(SEQ_BITS, PARTITION_BITS, TASK_BITS)):
    return F.shiftrightunsigned(block_id, bits[2]).bitwiseAND(F.lit((1 << bits[1]) - 1))


def task_of(block_id, bits=(SEQ_BITS, PARTITION_BITS, TASK_BITS)):
    return block_id.bitwiseAND(F.lit((1 << bits[2]) - 1))


def blocks_from_lineitem(lineitem):
    """The block relation on the driver's tables."""
    b = lineitem.select(
        F.concat(F.lit("app_"), (F.col("l_suppkey") % 5).cast("string")).alias("app_id"), F.col("l_linenumber").alias("shuffle_id"),
        (F.col("l_partkey") % 16).cast("int").alias("partition_id"), F.col("l_suppkey").alias("task_attempt_id"),
        F.col("l_quantity").cast("int").alias("length"), F.col("l_extendedprice").cast("int").alias("uncompress_length"), "l_orderkey", "l_partkey")
    seq = F.row_number().over(Window.partitionBy(*UID).orderBy("l_orderkey", "l_partkey", "task_attempt_id", "uncompress_length", "length"))
    b = b.withColumn("seq", seq.cast("long"))
    return b.withColumn("block_id", pack(F.col("seq"), F.col("partition_id"), F.col("task_attempt_id"))).drop("l_orderkey", "l_partkey")


def cursor_read(blocks, cursors, max_bytes, task_ids=None):
    """One page per partition after its cursor block, until the budget is filled; adds offset and is_end.

    cursors is a block id for all partitions, or (app_id, shuffle_id, partition_id, last_block_id); -1, no cursor and an
    unknown one start at the beginning. The cursor is looked up before the task filter, and the filter precedes the budget,
    so filtered blocks cost nothing. One block may overshoot; is_end is false on an exact fill.
    """
    uid = Window.partitionBy(*UID)
    if isinstance(cursors, int):
        b = blocks.withColumn("last_block_id", F.lit(cursors).cast("long"))
    else:
        b = blocks.join(cursors.select(*UID, "last_block_id"), list(UID), "left")
    after = F.coalesce(F.max(F.when(F.col("block_id") == F.col("last_block_id"), F.col("seq"))).over(uid), F.lit(-1))
    b = b.withColumn("after", after).where("seq > after").drop("after", "last_block_id")
    if task_ids is not None:
        b = b.join(task_ids, "task_attempt_id", "left_semi")
    run = uid.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0))).withColumn("total", F.sum("length").over(uid))
    return b.where(F.col("offset") < max_bytes).withColumn("is_end", F.col("total") < max_bytes).drop("total")


def of_partitions(blocks, partitions):
    """Blocks whose id holds one of these partition numbers."""
    return blocks.where(partition_of(F.col("block_id")).isin(*partitions))


def purge(blocks, keys):
    """(blocks left, (app_id, removed_bytes)) for keys(app_id, shuffle_id); a null shuffle stands for the whole app."""
    b, k = blocks.alias("b"), keys.distinct().alias("k")
    hit = (F.col("b.app_id") == F.col("k.app_id")) & (F.col("k.shuffle_id").isNull() | (F.col("b.shuffle_id") == F.col("k.shuffle_id")))
    return b.join(k, hit, "left_anti"), b.join(k, hit, "left_semi").groupBy("app_id").agg(F.sum("length").alias("removed_bytes"))


def partition_sizes(blocks, split_bytes, limit_bytes):
    """Bytes, block count, huge and split flag of each partition; a split threshold must lie below the limit."""
    if split_bytes >= limit_bytes:
        raise ValueError(f"the split threshold {split_bytes} must be below the partition limit {limit_bytes}")
    s = blocks.groupBy(*UID).agg(F.sum("length").alias("bytes"), F.count("*").alias("n_blocks"))
    return s.withColumn("is_huge", F.col("bytes") > limit_bytes).withColumn("is_split", F.col("bytes") > split_bytes)


def app_totals(blocks, kept, limit_bytes):
    """(app_id, received, resident, partitions, huge_partitions, block_ids): kept are the blocks that purges have left."""
    sizes = blocks.groupBy(*UID).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))
    all_ = sizes.groupBy("app_id").agg(F.sum("bytes").alias("received"), F.count("*").alias("partitions"), F.count_if(F.col("bytes") > limit_bytes).alias("huge_partitions"))
    left = kept.groupBy("app_id").agg(F.sum("length").alias("resident"), F.count_distinct("shuffle_id", "block_id").alias("block_ids"))
    return all_.join(left, "app_id", "left").select("app_id", "received", F.coalesce("resident", F.lit(0)).alias("resident"), "partitions", "huge_partitions", F.coalesce("block_ids", F.lit(0)).alias("block_ids"))


def id_counter(reports, purged):
    """(app_id, n): reported block ids, repeats included, less the distinct ids of purged(app_id, shuffle_id)."""
    n = reports.groupBy("app_id", "shuffle_id").agg(F.count("block_id").alias("all"), F.count_distinct("block_id").alias("once"))
    gone = purged.select("app_id", "shuffle_id", F.lit(True).alias("gone")).distinct()
    left = F.when(F.col("gone"), F.col("all") - F.col("once")).otherwise(F.col("all"))
    return n.join(gone, ["app_id", "shuffle_id"], "left").groupBy("app_id").agg(F.sum(left).alias("n"))


def id_union(reports, wanted):
    """Distinct block ids of the wanted(app_id, shuffle_id, partition_id)."""
    return reports.join(wanted.distinct(), list(UID), "left_semi").select("app_id", "shuffle_id", "block_id").distinct()


def result_reports(reports):
    """Rows (app_id, shuffle_id, partition_id, task_attempt_id, block_id, record_number) of reports(.., partitions array<
    struct<partition_id, block_ids, record_numbers>>); a partition must come with exactly one record count."""
    p = reports.select("app_id", "shuffle_id", "task_attempt_id", F.inline("partitions"))
    one = F.when(F.size("record_numbers") == 1, F.col("record_numbers")[0]).otherwise(F.raise_error(F.lit("a partition needs exactly one record count")))
    return p.withColumn("record_number", one).select(*UID, "task_attempt_id", F.explode("block_ids").alias("block_id"), "record_number")


def partition_sizes(blocks, split_bytes, limit_bytes):
    """Bytes, block count, huge and split flag of each partition; a split threshold must lie below the limit."""
    if split_bytes >= limit_bytes:
        raise ValueError(f"the split threshold {split_bytes} must be below the partition limit {limit_bytes}")
    s = blocks.groupBy(*UID).agg(F.sum("length").alias("bytes"), F.count("*").alias("n_blocks"))
    return s.withColumn("is_huge", F.col("bytes") > limit_bytes).withColumn("is_split", F.col("bytes") > split_bytes)


def app_totals(blocks, kept, limit_bytes):
    """(app_id, received, resident, partitions, huge_partitions, block_ids): kept are the blocks that purges have left."""
    sizes = blocks.groupBy(*UID).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))
    all_ = sizes.groupBy("app_id").agg(F.sum("bytes").alias("received"), F.count("*").alias("partitions"), F.count_if(F.col("bytes") > limit_bytes).alias("huge_partitions"))
    left = kept.groupBy("app_id").agg(F.sum("length").alias("resident"), F.count_distinct("shuffle_id", "block_id").alias("block_ids"))
    return all_.join(left, "app_id", "left").select("app_id", "received", F.coalesce("resident", F.lit(0)).alias("resident"), "partitions", "huge_partitions", F.coalesce("block_ids", F.lit(0)).alias("block_ids"))


def id_counter(reports, purged):
    """(app_id, n): reported block ids, repeats included, less the distinct ids of purged(app_id, shuffle_id)."""
    n = reports.groupBy("app_id", "shuffle_id").agg(F.count("block_id").alias("all"), F.count_distinct("block_id").alias("once"))
    gone = purged.select("app_id", "shuffle_id", F.lit(True).alias("gone")).distinct()
    left = F.when(F.col("gone"), F.col("all") - F.col("once")).otherwise(F.col("all"))
    return n.join(gone, ["app_id", "shuffle_id"], "left").groupBy("app_id").agg(F.sum(left).alias("n"))


def id_union(reports, wanted):
    """Distinct block ids of the wanted(app_id, shuffle_id, partition_id)."""
    return reports.join(wanted.distinct(), list(UID), "left_semi").select("app_id", "shuffle_id", "block_id").distinct()


def result_reports(reports):
    """Rows (app_id, shuffle_id, partition_id, task_attempt_id, block_id, record_number) of reports(.., partitions array<
    struct<partition_id, block_ids, record_numbers>>); a partition must come with exactly one record count."""
    p = reports.select("app_id", "shuffle_id", "task_attempt_id", F.inline("partitions"))
    one = F.when(F.size("record_numbers") == 1, F.col("record_numbers")[0]).otherwise(F.raise_error(F.lit("a partition needs exactly one record count")))
    return p.withColumn("record_number", one).select(*UID, "task_attempt_id", F.explode("block_ids").alias("block_id"), "record_number")


def combined_blocks(requests):
    """Blocks of requests(app_id, shuffle_id, partition_ids, block_counts, block_ids, lengths, uncompress_lengths, crcs,
    task_attempt_ids, data): the columns are cut by partition and the data by running length; uneven columns are an error.

    The running length takes as many passes as the number of blocks has bits. The data are read from the row once and held
    by a lambda while they are cut; a column would be copied whole for each block.
    """
    same = F.lit(True)
    for c in ("lengths", "uncompress_lengths", "crcs", "task_attempt_ids"):
        same = same & (F.size(c) == F.size("block_ids"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    fits = same & (F.size("partition_ids") == F.size("block_counts")) & (total("block_counts") == F.size("block_ids")) & (total("lengths") <= F.octet_length("data"))
    owners = F.flatten(F.transform(F.arrays_zip("partition_ids", "block_counts"), lambda x: F.array_repeat(x["partition_ids"], x["block_counts"])))
    r = requests.withColumn("owners", F.when(fits, owners).otherwise(F.raise_error(F.lit("the columns of a combined request do not fit"))))
    ends = F.expr("aggregate(sequence(0, length(bin(size(lengths))) - 1), cast(lengths as array<long>), (a, k) -> transform(a, (x, i) -> x + coalesce(get(a, i - shiftleft(1, k)), 0L)))")
    columns = F.arrays_zip("owners", "block_ids", "lengths", "uncompress_lengths", "crcs", "task_attempt_ids", "ends")
    block = lambda x, d: F.struct(x["owners"].alias("partition_id"), x["block_ids"].alias("block_id"), x["lengths"].alias("length"), x["uncompress_lengths"].alias("uncompress_length"),
                                  x["crcs"].alias("crc"), x["task_attempt_ids"].alias("task_attempt_id"), F.substring(d, (x["ends"] - x["lengths"] + 1).cast("int"), x["lengths"].cast("int")).alias("data"))
    rows = F.transform(F.array("data"), lambda d: F.transform(columns, lambda x: block(x, d)))[0]
    return r.withColumn("ends", ends).select("app_id", "shuffle_id", F.inline(rows))


def app_history(sizes):
    h = F.when(F.col("is_huge"), F.col("bytes"))
    return sizes.groupBy("app_id").agg(
        F.sum("bytes").alias("total_bytes"), F.count("*").alias("partition_num"), F.count(h).alias("huge_partition_num"),
        F.coalesce(F.floor(F.avg(h)), F.lit(0)).cast("long").alias("avg_huge_partition_bytes"), F.coalesce(F.max(h), F.lit(0)).alias("max_huge_partition_bytes"),
        F.coalesce(F.min(h).cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)")).alias("min_huge_partition_bytes"),
        F.bool_or("is_split").alias("partition_split_triggered"))


def spill_candidates(sizes, target_share):
    """Largest partitions of each app until target_share of its bytes is reached; empty partitions never."""
    w = Window.partitionBy("app_id")
    order = w.orderBy(F.col("bytes").desc(), "shuffle_id", "partition_id").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.where("bytes > 0").withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).withColumn("all", F.sum("bytes").over(w))
    return s.where(F.col("before") < F.col("all") * target_share).select(*UID, "bytes", "before")


def spill_trigger(nodes, high, low, sensitive=False):
    """Adds ratio and target to nodes(used, in_flight, capacity, allocated): bytes to spill from the high watermark on,
    down to the low one, and null where nothing is to do. Bytes in flight count only if sensitive."""
    real = F.col("used") - F.col("in_flight")
    ratio = (real + (F.col("in_flight") if sensitive else 0)) / (F.col("capacity") - F.col("allocated"))
    target = real - F.floor(F.col("capacity") * F.lit(low)).cast("long")
    return nodes.withColumn("ratio", ratio).withColumn("target", F.when((F.col("ratio") >= high) & (target > 0), target))


def single_buffer_spill(sizes, threshold, huge_threshold=None):
    """Partitions whose staged bytes exceed their threshold; huge ones have their own where it is set."""
    limit = F.when(F.col("is_huge"), F.lit(huge_threshold)).otherwise(F.lit(threshold)) if huge_threshold is not None else F.lit(threshold)
    return sizes.where(F.col("bytes") > limit)


def route(sizes, cold_bytes=None, huge_bytes=None, fallback=False):
    """Adds tier to sizes(bytes, is_huge, warm_healthy, cold_healthy, retries, failed_cold).

    An unhealthy cold tier stands in as warm. Warm is the rule, cold for large flushes or where warm is unhealthy. A huge
    partition over its threshold goes to cold (back to warm after a second failed try there, if the fallback is on), and
    only where that rule did not speak does any retry go to cold.
    """
    cold = F.when(F.col("cold_healthy"), "cold").otherwise("warm")
    large = F.col("bytes") > F.lit(cold_bytes) if cold_bytes is not None else F.lit(False)
    huge = F.col("is_huge") & (F.col("bytes") > F.lit(huge_bytes)) if huge_bytes is not None else F.lit(False)
    back = F.lit(fallback) & F.col("failed_cold") & (F.col("retries") > 1) & F.col("warm_healthy")
    plain = F.when(~F.col("warm_healthy") | large, cold).otherwise("warm")
    return sizes.withColumn("tier", F.when(huge & back, "warm").when(huge | (F.col("retries") >= 1), cold).otherwise(plain))


def disk_of(disks):
    """Adds disk to partitions: one of the healthy disks(disk), the same for a partition each time."""
    names = disks.where("healthy").agg(F.array_sort(F.collect_list("disk")).alias("disks"))  # a server's disks are few

    def place(partitions):
        at = (F.pmod(F.xxhash64(*UID), F.size("disks")) + 1).cast("int")
        return partitions.join(F.broadcast(names)).withColumn("disk", F.element_at("disks", at)).drop("disks")

    return place


def record_stats(reports):
    """Last report wins for a task of a partition of an app's shuffle."""
    return reports.groupBy(*UID, "task_attempt_id").agg(F.max_by("record_number", "report_seq").alias("record_number"))


def stats_of(stats, wanted):
    """Record counts of the wanted(app_id, shuffle_id, partition_id), as a map by task; partitions without any are left out."""
    s = stats.join(wanted.distinct(), list(UID), "left_semi")
    return s.groupBy(*UID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_attempt_id", "record_number")))).alias("record_numbers"))


def rank_servers(nodes, tags=(), faulty=None):
    """Available nodes with all tags and not faulty, by free memory then id; host_round counts earlier nodes of the host."""
    n = nodes.where("is_healthy and free_memory > 0").where(F.size(F.array_except(F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>"), "tags")) == 0)
    if faulty is not None:
        n = n.join(faulty, "id", "left_anti")
    host = F.row_number().over(Window.partitionBy("ip").orderBy(F.col("free_memory").desc(), "id"))
    return n.withColumn("host_round", host)


def rank_balanced(ranked, assigned, partitions, replicas, most):
    """Adds score to ranked servers: free memory for each partition that a server of assigned(id, n) would then have."""
    width = max(1, partitions * replicas // most)
    return ranked.join(assigned, "id", "left").withColumn("score", F.col("free_memory") / (F.coalesce("n", F.lit(0)) + width)).drop("n")


def pick_servers(ranked, want, policy="PREFER_DIFF", most=None, by="free_memory"):
    """The first `want` servers, or `most` at most: NONE takes them by rank, MUST_DIFF one of each host, PREFER_DIFF hosts
    that are not there yet before others."""
    if policy == "MUST_DIFF":
        ranked = ranked.where("host_round = 1")
    first = [F.col("host_round") > 1] if policy == "PREFER_DIFF" else []
    n = min(x for x in (want, most) if x is not None)
    return ranked.orderBy(*first, F.col(by).desc(), "id").limit(n)


def request_error(available=None):
    """What is wrong with a request(app_id, shuffle_id, partition_num, partition_num_per_range, data_replica), or null."""
    wrong = F.when(F.coalesce(F.col("app_id"), F.lit("")) == "", "app_id is empty").when(F.col("shuffle_id") < 0, "shuffle_id is negative")
    for c in ("partition_num", "partition_num_per_range", "data_replica"):
        wrong = wrong.when(F.col(c) <= 0, f"{c} is not positive")
    return wrong if available is None else wrong.when(F.lit(available) == 0, "no server").when(F.col("data_replica") > available, "too few servers for the replicas")


def with_endpoints(assignment, nodes):
    """Adds ip and port of each assigned server; a server that nodes(id, ip, port) do not have is an error."""
    j = assignment.join(nodes.select(F.col("id").alias("server"), "ip", "port"), "server", "left")
    return j.withColumn("ip", F.when(F.col("port").isNotNull(), F.col("ip")).otherwise(F.raise_error(F.concat(F.lit("unknown server "), F.col("server").cast("string")))))


def assign_rounds(spark, partitions, per_range, servers, replicas):
    """(start_partition, end_partition, replica, server): the cursor moves on for every replica."""
    ids = F.array(*[F.lit(s) for s in servers])
    r = spark.range(-(-partitions // per_range)).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return r.select((F.col("id") * per_range).alias("start_partition"), ((F.col("id") + 1) * per_range - 1).alias("end_partition"), "replica",
                    F.element_at(ids, (F.pmod(F.col("id") * replicas + F.col("replica"), F.lit(len(servers))) + 1).cast("int")).alias("server"))


def encode_index(offset, length, uncompressed, crc, block_id, task):
    """A 40-byte big-endian index record."""
    part = lambda c, n: F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - n, n)
    return F.to_binary(F.concat(part(offset, 16), part(length, 8), part(uncompressed, 8), part(crc, 16), part(block_id, 16), part(task, 16)), F.lit("hex"))


def decode_index(record):
    """Struct (offset, length, uncompress_length, crc, block_id, task_attempt_id) of a record; more than 40 bytes are ignored,
    fewer are an error."""
    record = F.when(F.octet_length(record) >= RECORD, record).otherwise(F.raise_error(F.lit("an index record has 40 bytes")).cast("binary"))
    at, fields = 1, []
    for name, n in (("offset", 8), ("length", 4), ("uncompress_length", 4), ("crc", 8), ("block_id", 8), ("task_attempt_id", 8)):
        value = F.conv(F.hex(F.substring(record, at, n)), 16, -10).cast("long")
        fields.append(value.alias(name))
        at += n
    return F.struct(*fields)


def as_of_join(left, right, key, left_ts, right_ts, value):
    """The value of the last right row of the key at or before each left row: one union and one window, no range join."""
    l = left.withColumns({"__t": F.col(left_ts), "__v": F.lit(None).cast(dict(right.dtypes)[value]), "__side": F.lit(1)})
    r = right.select(key, F.col(right_ts).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(f"asof_{value}", F.last("__v", True).over(w)).where("__side = 1").drop("__t", "__v", "__side")


def assign_continuous(spark, partitions, per_range, servers, replicas, concurrency):
    """(start_partition, end_partition, replica, server): neighbouring ranges share a server while the concurrency allows.

    The group of a range is a closed form of its number: full rounds give each server `wide` ranges in a row, and the last
    round deals what is left as evenly as it goes.
    """
    n, total = len(servers), -(-partitions // per_range)
    wide = max(1, min(concurrency, partitions) // (n * per_range))
    full = total // (wide * n) * n
    least, extra = divmod(total - full * wide, n)
    i, rest = F.col("id"), F.col("id") - full * wide
    div = lambda c, by: F.floor(c / max(1, by))
    tail = F.when(rest < extra * (least + 1), div(rest, least + 1)).otherwise(extra + div(rest - extra * (least + 1), least))
    group = F.when(i < full * wide, div(i, wide)).otherwise(full + tail)
    ids = F.array(*[F.lit(s) for s in servers])
    r = spark.range(total).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return r.select((i * per_range).alias("start_partition"), ((i + 1) * per_range - 1).alias("end_partition"), "replica",
                    F.element_at(ids, (F.pmod(group + F.col("replica"), F.lit(n)) + 1).cast("int")).alias("server"))
