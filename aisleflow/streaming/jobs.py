"""Structured Streaming forms of the event engine. Event time is a TIMESTAMP column ``event_time``; state is bounded by
the watermark or by timeouts, and lives in the query's checkpoint, which replaces the buffers of a single process."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import round_half_away
from ..operators.events import checked
from ..sources.events import LINES, flatten


def event_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Event lines that land in a folder, as the flat table with ``event_time``."""
    raw = spark.readStream.schema(LINES).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_at_once).json(folder)
    return flatten(raw).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def windowed_summary(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts by store and window; distinct people are approximate (HyperLogLog), as streams know no exact ones."""
    timed = events.withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window), "store_id").agg(
        F.count("*").alias("events"),
        F.approx_count_distinct("global_id").alias("people"),
        F.count_if(F.col("event_type") == "product_interaction").alias("interactions"),
        F.count_if("needs_review").alias("needs_review"),
        F.round(F.avg("dwell_seconds"), 2).alias("avg_dwell_s"),
    )


def windowed_health(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """A camera's decisions by window: how many, how sure, how many to review, how many people."""
    timed = events.withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window), "store_id", "camera_id").agg(
        F.count("*").alias("decisions"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.count_if("needs_review") / F.count("*"), 6).alias("review_ratio"),
        F.approx_count_distinct("global_id").alias("people"),
    )


def _counts(what: Column) -> Column:
    """what, as a filter that is looked at above the watermark, so that the rows it drops still move that."""
    return what | F.col("event_time").isNull()


def shelf_engagement(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """By window, store and shelf zone: customers who came, how many of the zone's interacted, and their rate, when the watermark
    has passed the window. Visits and interactions are two sets of one group, so the join of both needs no second shuffle or
    state; a zone without visitors gives no row. A window's state is the people seen in it."""
    customer, kind = F.col("role") == "customer", F.col("event_type")
    came, acted = customer & (kind == "zone_entered") & (F.col("zone_kind") == "shelf"), customer & (kind == "product_interaction")
    people = lambda which: F.size(F.collect_set(F.when(which, F.col("global_id")))).cast("long")
    wanted = events.where(_counts(F.col("zone").isNotNull() & (came | acted)))
    each = wanted.groupBy(F.window("event_time", window), "store_id", "zone").agg(people(came).alias("visitors"), people(acted).alias("interacting")).where("visitors > 0")
    rate = round_half_away(F.col("interacting") * F.lit(100.0) / F.col("visitors"), 1)
    return each.select(F.col("window.start").alias("window_start"), "store_id", "zone", "visitors", "interacting", rate.alias("interaction_rate_pct"))


def journeys(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits of people to a store that end when they are away for the gap, of those seen by more than one camera: cameras, their
    list and how long it took, when the watermark has passed the gap. State is the people of the last gap."""
    near = events.where(_counts(F.col("global_id").isNotNull())).groupBy(F.session_window("event_time", gap), "store_id", "global_id", "role")
    each = near.agg(F.collect_set("camera_id").alias("seen"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("size(seen) > 1")
    took = round_half_away(F.col("last_ts") - F.col("first_ts"), 1)
    return each.select("store_id", "global_id", "role", F.size("seen").cast("long").alias("cameras"), F.array_join(F.array_sort("seen"), ",").alias("camera_list"), "first_ts", took.alias("journey_s"))


def _timeout(seconds: int | None) -> str:
    """State timeouts suit streams that go on; a stream that ends with the available data would never end with them."""
    return GroupStateTimeout.ProcessingTimeTimeout if seconds else GroupStateTimeout.NoTimeout


def _in_order(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, whose size the source's files per trigger bound."""
    held = [p for p in parts if len(p)]
    return pd.concat(held).sort_values(order, kind="stable") if held else pd.DataFrame()


def deduplicate(events: DataFrame, keys: list[str], window: float, tie: str = "event_id", ts: str = "ts", timeout_s: int | None = None) -> DataFrame:
    """Keeps an event unless it comes within ``window`` after the last kept one of its key, or before it."""
    kinds = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ts, tie])

    def each(key, parts: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(parts, [ts, tie])
        last, keep = state.get[0] if state.exists else None, []
        for at in rows[ts] if len(rows) else []:
            keep.append(last is None or at - last >= window)
            last = at if keep[-1] else last
        if last is not None:
            state.update((float(last),))
            if timeout_s:
                state.setTimeoutDuration(timeout_s * 1000)
        if any(keep):
            yield rows[keep][[*keys, ts, tie]]

    return events.select(*keys, ts, tie).groupBy(*keys).applyInPandasWithState(each, schema, "last double", "append", _timeout(timeout_s))


def replay(rows: DataFrame, folder: str, tie: str, parts: int = 5, late: int = 4) -> DataFrame:
    """rows (with ``event_time``) as a stream of more than ``parts`` micro-batches with a watermark: they land in the folder
    in slices of event time, every ``late``-th one (by digest; none for 0) a slice too late, which the watermark's delay allows for. A last
    row of nulls, far enough ahead, lets the watermark pass all others; nothing ever passes that one."""
    us = F.unix_micros("event_time")
    lo, hi = rows.agg(F.min(us), F.max(us)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = (hi - lo) // parts + 1
    slot = F.floor((us - lo) / width)
    slot = slot + F.when(F.pmod(F.xxhash64(tie), F.lit(late)) == 0, 1).otherwise(0) if late else slot
    for k in range(parts + 1):
        rows.where(slot == k).write.mode("append").parquet(folder)
    spark = rows.sparkSession
    end = spark.range(1).select(*[(F.timestamp_micros(F.lit(hi + 3 * width)) if f.name == "event_time" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    end.write.mode("append").parquet(folder)
    files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // (parts + 2))).parquet(folder)
    # a slice may come in several micro-batches, so that its late rows wait for two slices
    return raw.withWatermark("event_time", f"{2 * width + 1_000} microseconds")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Processes what the source holds now, then gives what was written."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert_latest(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str):
    """Keeps the newest row of each key (camera heartbeats) in a table, as small as there are keys, that each batch writes anew under its number;
    only the last two are kept."""

    def merge(batch: DataFrame, n: int) -> None:
        spark, own = batch.sparkSession, batch
        if n:
            own = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={n - 1}"))
        newest = own.groupBy(*keys).agg(F.max_by(F.struct(*own.columns), F.col(ts)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n > 1:  # a batch that is repeated reads the one before, so that one stays
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def ingest(stream: DataFrame, good: str, aside: str, checkpoint: str):
    """Incoming events into two tables: the good ones, and the others with what is wrong with them. A micro-batch replaces its
    own part of both tables, so one that is repeated after a failure leaves them as they were; either part may be there
    without the other only until the repeat."""

    def split(batch: DataFrame, n: int) -> None:
        rows = checked(batch).persist()
        try:
            rows.where("fault IS NULL").drop("fault").write.mode("overwrite").parquet(f"{good}/batch={n}")
            rows.where("fault IS NOT NULL").write.mode("overwrite").parquet(f"{aside}/batch={n}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def post_batches(stream: DataFrame, post: Callable[[list[str]], None], checkpoint: str, rows: int = 50):
    """Hands JSON lines to ``post`` in batches of ``rows`` from the executors; a batch that raises is repeated by Spark
    (at least once, nothing dropped)."""

    def send(batch: DataFrame, n: int) -> None:
        def part(it):
            held: list[str] = []
            for r in it:
                held.append(r["line"])
                if len(held) == rows:
                    post(held)
                    held = []
            if held:
                post(held)

        batch.select(F.to_json(F.struct(*batch.columns), {"ignoreNullFields": "false"}).alias("line")).foreachPartition(part)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def writer(stream: DataFrame, kind: str, checkpoint: str, path: str | None = None, name: str = "events", post: Callable | None = None):
    """The stream writer of a sink kind: memory, stdout, jsonl or http."""
    if kind == "http":
        if post is None:
            raise ValueError("an http sink needs a function that posts")
        return post_batches(stream, post, checkpoint)
    if kind == "jsonl" and not path:
        raise ValueError("a jsonl sink needs a path")
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    if kind == "memory":
        return w.format("memory").queryName(name)
    if kind == "stdout":
        return w.format("console")
    if kind == "jsonl":
        return w.format("json").option("path", path).option("ignoreNullFields", "false")
    raise ValueError(f"unknown sink kind: {kind}")
