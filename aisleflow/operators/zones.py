"""Zone events from observations, by window functions: hysteresis, interaction, dwell, session flush, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import edges_contain, polygon_edges, round_half_away


def in_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Each point with each zone of its store's camera; zones are few for a camera, and their edges are built once."""
    sides = zones.withColumn("edges", polygon_edges(F.col("polygon"))).drop("polygon")
    joined = points.join(sides, ["store_id", "camera_id"])
    return joined.withColumn("inside", edges_contain(F.col("edges"), F.col("x"), F.col("y"))).drop("edges")


def mark_visits(obs: DataFrame, keys: list[str], order: list[str], enter: int, leave: int, interact: int) -> DataFrame:
    """obs with ``step`` (enter or exit, at the observation that confirms it), ``visit`` (its number, 0 before the first),
    ``visit_last`` (the number of the key's last one), ``rl`` (how long the run inside or outside is), ``at`` and ``acted``."""
    w = W.partitionBy(*keys).orderBy(*order)
    runs = obs.withColumn("flip", F.when(F.col("inside") == F.lag("inside").over(w), 0).otherwise(1)).withColumn("run", F.sum("flip").over(w))
    runs = runs.withColumn("rl", F.row_number().over(W.partitionBy(*keys, "run").orderBy(*order))).withColumn("at", F.row_number().over(w))
    turn = F.when(F.col("inside") & (F.col("rl") == enter), "enter").when(~F.col("inside") & (F.col("rl") == leave), "exit")
    marked = runs.withColumn("turn", turn)
    before = F.last("turn", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    valid = F.col("turn").isNotNull() & F.when(F.col("turn") == "enter", F.coalesce(before, F.lit("exit")) == "exit").otherwise(F.coalesce(before, F.lit("exit")) == "enter")
    steps = marked.withColumn("step", F.when(valid, F.col("turn"))).withColumn("visit", F.sum(F.when(F.col("step") == "enter", 1).otherwise(0)).over(w))
    ended = F.sum(F.when(F.col("step") == "exit", 1).otherwise(0)).over(w)
    steps = steps.withColumn("acted", (F.col("visit") > ended) & F.col("inside") & (F.col("rl") >= interact))
    return steps.withColumn("visit_last", F.max("visit").over(W.partitionBy(*keys))).drop("flip", "run", "turn")


def visits(obs: DataFrame, keys: list[str], order: list[str], enter: int = 2, leave: int = 4, interact: int = 6) -> DataFrame:
    """One row for each visit: keys, enter_ts, exit_ts (null while open), dwell_s, interaction_ts, run_frames.

    obs has the boolean ``inside``, ``ts`` and the order columns. A person is in after ``enter`` observations inside in a
    row and out after ``leave`` outside in a row.
    """
    out = mark_visits(obs, keys, order, enter, leave, interact).where("visit > 0").groupBy(*keys, "visit").agg(
        F.min(F.when(F.col("step") == "enter", F.col("ts"))).alias("enter_ts"),
        F.min(F.when(F.col("step") == "exit", F.col("ts"))).alias("exit_ts"),
        F.min(F.when(F.col("acted"), F.struct("at", "ts", "rl"))).alias("act"),
    )
    return out.select(*keys, F.col("visit").cast("int").alias("visit"), "enter_ts", "exit_ts", round_half_away(F.col("exit_ts") - F.col("enter_ts"), 3).alias("dwell_s"), F.col("act.ts").alias("interaction_ts"), F.col("act.rl").alias("run_frames"))


def deduplicate(events: DataFrame, keys: list[str], window: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Keeps an event unless it comes within ``window`` after the last KEPT one of its key. Null keys are values.

    Within a key only events closer than the window to their predecessor can fall, so a chain starts anew after each
    longer gap: chains, not keys, are the groups that are folded, which bounds a hot key's group by its density.
    """
    w = W.partitionBy(*keys).orderBy(ts, tie)
    apart = F.coalesce(F.col(ts) - F.lag(ts).over(w) >= window, F.lit(True))
    chained = events.withColumn("_chain", F.sum(apart.cast("int")).over(w))

    def earlier(a: Column, b: Column) -> Column:
        one, two = F.struct(a[ts], a[tie]), F.struct(b[ts], b[tie])
        return F.when(one < two, -1).when(one > two, 1).otherwise(0)

    def fold(acc: Column, e: Column) -> Column:
        keep = F.coalesce(e[ts] - acc["last"] >= window, F.lit(True))
        return F.when(keep, F.struct(e[ts].alias("last"), F.array_append(acc["kept"], e).alias("kept"))).otherwise(acc)

    row = F.struct(F.col(ts), F.col(tie), F.struct(*events.columns).alias("row"))
    grouped = chained.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_chain").agg(F.array_sort(F.collect_list(row), earlier).alias("es"))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.slice("es", 1, 0).alias("kept"))
    return grouped.select(F.explode(F.aggregate("es", zero, fold, lambda a: a["kept"])).alias("e")).select("e.row.*")
