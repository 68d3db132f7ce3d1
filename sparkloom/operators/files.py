"""Data and index files of partitions as relations: offsets, order at flush, validation, ranges and purge scopes."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import RECORD, UID, decode_index


def flushed(blocks, local_order=False):
    """Adds place, the order of blocks(flush_id, seq) in the file; with local order tasks stand together in a flush."""
    keys = ["flush_id", "task_attempt_id", "seq"] if local_order else ["flush_id", "seq"]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*UID).orderBy(*keys)))


def offsets(blocks, pointers=None):
    """Adds offset: what lies before a block of blocks(place, length) in the file, which starts at pointers(.., pointer)."""
    run = Window.partitionBy(*UID).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)))
    if pointers is None:
        return b
    return b.join(pointers, list(UID), "left").withColumn("offset", F.col("offset") + F.coalesce("pointer", F.lit(0))).drop("pointer")


def data_files(blocks):
    """(app_id, shuffle_id, partition_id, data) of blocks(place, data); a partition's size is bounded by its split limit."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", "data"))), lambda x: x["data"])
    return blocks.groupBy(*UID).agg(rows.alias("parts"), F.count_if(F.col("data").isNull()).alias("gaps")).select(*UID, F.when(F.col("gaps") == 0, joined("parts")).alias("data"))


def joined(parts):
    """The bytes of an array of binaries, in one pass; a fold of || would copy all bytes so far for each part."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def _held(column, read):
    """read of a binary column, taken from the row once; inside a lambda the column itself would be copied for each element."""
    return F.transform(F.array(column), read)[0]


def records(raw):
    """The decoded records of raw(.., index binary); a partial record at the end is ignored."""
    at = _held("index", lambda d: F.when(F.octet_length(d) < RECORD, F.array().cast("array<binary>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(d) / RECORD).cast("int") - 1), lambda i: F.substring(d, i * RECORD + 1, F.lit(RECORD)))))
    rest = [c for c in raw.columns if c != "index"]
    return raw.select(*rest, F.explode(at).alias("r")).select(*rest, decode_index(F.col("r")).alias("r")).select(*rest, "r.*")


def validate(index, files):
    """(app_id, shuffle_id, partition_id, n_blocks, whole, bad): whether the lengths add up to the data, and how many blocks
    have another checksum than index(offset, length, crc) says."""
    r = index.groupBy(*UID).agg(F.count("*").alias("n_blocks"), F.sum("length").alias("indexed"), F.collect_list(F.struct("offset", "length", "crc")).alias("records"))
    other = lambda d: lambda x: F.crc32(F.substring(d, (x["offset"] + 1).cast("int"), x["length"].cast("int"))) != x["crc"]
    bad = _held("data", lambda d: F.size(F.filter("records", other(d))))
    return r.join(files, list(UID)).select(*UID, "n_blocks", (F.col("indexed") == F.octet_length("data")).alias("whole"), bad.cast("long").alias("bad"))


def consistent(files):
    """Adds consistent to files(index, data_length): the last record ends where the data does; asked of more than one record."""
    last = decode_index(F.expr(f"substring(index, cast((octet_length(index) div {RECORD} - 1) * {RECORD} + 1 as int), {RECORD})"))
    return files.withColumn("consistent", F.when(F.octet_length("index") > RECORD, last["offset"] + last["length"] == F.col("data_length")).otherwise(True))


def read_range(files, wanted):
    """Adds part: the bytes (offset, length) of each wanted range; an unknown partition or no length gives no bytes."""
    j = wanted.join(files, list(UID), "left")
    part = F.when(F.col("data").isNotNull() & (F.col("length") > 0), F.expr("substring(data, cast(offset + 1 as int), cast(length as int))"))
    return j.withColumn("part", F.coalesce(part, F.lit("").cast("binary"))).drop("data")


def write_files(blocks, path):
    """Append blocks to the folders of their partitions, app_id=/shuffle_id=/partition_id=."""
    blocks.write.mode("append").partitionBy(*UID).parquet(path)


def purge_scope(files, app_id, server, shuffle_id=None, timed_out=False):
    """What is left of files(app_id, shuffle_id, server): a purge of a shuffle or an explicit one of an app takes all, one
    after a missing heartbeat takes this server's files alone."""
    hit = F.col("app_id") == app_id
    if shuffle_id is not None:
        hit = hit & (F.col("shuffle_id") == shuffle_id)
    elif timed_out:
        hit = hit & F.col("server").startswith(server)
    return files.where(~hit)


def admitted(segments, plan_offset):
    """(segments beyond plan_offset in list order, one row with the plan offset after them: the last one's, not the greatest)."""
    s = segments.where(F.col("offset") > plan_offset)
    return s, s.agg(F.coalesce(F.max_by("offset", "place"), F.lit(plan_offset)).alias("plan_offset"))


def read_ahead(reads, number, size):
    """Adds loaded to reads(file, place, offset): bytes read ahead after each read. The first read at 0 loads number x size,
    a later one 2 x size where less than that, but something, is left before the reader. The state of a file is one number."""
    step = f"""aggregate(places, named_struct('l', cast(0 as long), 'on', false, 'out', cast(array() as array<struct<place:long,loaded:long>>)), (a, x) ->
      named_struct('l', a.l + if(not a.on, if(x.offset = 0, {number * size}, 0), if(a.l - x.offset > 0 and a.l - x.offset < {2 * size}, {2 * size}, 0)), 'on', a.on or x.offset = 0,
        'out', a.out || array(named_struct('place', x.place, 'loaded', a.l + if(not a.on, if(x.offset = 0, {number * size}, 0), if(a.l - x.offset > 0 and a.l - x.offset < {2 * size}, {2 * size}, 0))))))"""
    r = reads.select("file", F.col("place").cast("long").alias("place"), F.col("offset").cast("long").alias("offset"))
    return r.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "offset"))).alias("places")).select("file", F.inline(F.expr(f"({step}).out")))
