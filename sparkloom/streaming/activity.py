"""Event-time operators that run alike on batch and streaming DataFrames."""
from pyspark.sql import functions as F


def watermarked(df, ts, delay):
    """Late rows are bounded only where the input is a stream."""
    return df.withWatermark(ts, delay) if df.isStreaming else df


def sessions(events, key, ts, gap, delay="10 minutes"):
    """(key, began, ended, n): activity sessions closed by a silent gap."""
    s = watermarked(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def tumbling(events, key, ts, width, value, delay="10 minutes"):
    """(key, began, n, low, high) for each window of the width."""
    t = watermarked(events, ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return t.select(key, F.col("w.start").alias("began"), "n", "low", "high")


def sliding(events, key, ts, width, step, delay="10 minutes"):
    t = watermarked(events, ts, delay).groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count("*").alias("n"))
    return t.select(key, F.col("w.start").alias("began"), "n")


def latency_summary(samples, ts, value, width, delay="10 minutes"):
    """Approximate quantiles of each interval, which then starts anew."""
    q = F.percentile_approx(value, F.array(*map(F.lit, (0.5, 0.8, 0.9, 0.95, 0.99))), 10000).alias("q")
    s = watermarked(samples, ts, delay).groupBy(F.window(ts, width).alias("w")).agg(q)
    return s.select(F.col("w.start").alias("began"), *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 80, 90, 95, 99))])


def first_reports(reports, keys, ts, delay="10 minutes"):
    """One row for each key; in a stream, within the watermark."""
    return reports.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if reports.isStreaming else reports.dropDuplicates(keys)


def liveness(heartbeats, node, ts):
    """(node, last_seen, status) by the newest heartbeat."""
    return heartbeats.groupBy(node).agg(F.max(ts).alias("last_seen"), F.max_by("status", ts).alias("status"))


def silent(live, now, seconds):
    """Nodes or apps whose last sign is more than so many seconds old."""
    return live.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp")) > seconds)


def running_totals(blocks):
    """(app_id, shuffle_id, partition_id, bytes, n): totals that a stream updates as blocks come in."""
    return blocks.groupBy("app_id", "shuffle_id", "partition_id").agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))


def dispatch(events, tier, sinks, attempts=3):
    """A writer that sends each batch of spill events to the sink of its tier, sinks[tier](rows).

    A sink that fails is tried again, and after the last try the batch fails, so the stream reads it anew and loses none.
    """
    def send(batch, batch_id):
        batch.persist()
        try:
            for name, sink in sinks.items():
                rows = batch.where(F.col(tier) == name)
                for left in reversed(range(attempts)):
                    try:
                        sink(rows)
                        break
                    except Exception:
                        if not left:
                            raise
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(send)


def every(writer, interval):
    """The writer with a processing-time trigger, as the watermark spill has it each 500 milliseconds."""
    return writer.trigger(processingTime=interval)


def registered(heartbeats):
    """(id, start_time, last columns) of heartbeats(id, ts, start_time, ..): the newest of each node, whose start time is the
    newest that was given at all."""
    rest = [c for c in heartbeats.columns if c not in ("id", "start_time")]
    last = [F.max_by(c, "ts").alias(c) for c in rest]
    return heartbeats.groupBy("id").agg(F.max_by("start_time", F.when(F.col("start_time").isNotNull(), F.col("ts"))).alias("start_time"), *last)
