"""Health of cameras from their frames: counts, latencies, people, confidence, and the gauges made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import round_half_away as rnd
from .identity import drift

CAMERA = ["store_id", "camera_id"]
#: What a camera's gauges show.
GAUGES = ("latency_p50", "mean_people", "review_ratio", "drift")


def _last(rows: DataFrame, order: list[str], n: int, chunk: str) -> DataFrame:
    """A camera's last n rows. Each chunk of it gives up its own last ones first, so that a hot camera isn't one task."""
    down = [F.desc(c) for c in order]
    for keys in ([*CAMERA, chunk], CAMERA):
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*down))).where(F.col("_r") <= n)
    return rows.drop("_r")


def camera_health(frames: DataFrame, detections: DataFrame, window: int = 300) -> DataFrame:
    """One row for each camera. frames: store, camera, frame, latency, chunk; detections: store, camera, frame, id,
    confidence, needs_review, chunk. Frames are all counted; latencies and people are of the last ``window`` frames,
    confidence of the last ``window`` detections, whatever frames these are in; review_ratio is of all."""
    per_frame = detections.groupBy(*CAMERA, "frame").agg(F.count("*").alias("people"))
    lately = _last(frames, ["frame"], window, "chunk").join(per_frame, [*CAMERA, "frame"], "left")
    rates = lately.groupBy(*CAMERA).agg(
        rnd(F.expr("percentile(latency, 0.5)"), 6).alias("latency_p50"),
        rnd(F.expr("percentile(latency, 0.95)"), 6).alias("latency_p95"),
        rnd(F.avg(F.coalesce("people", F.lit(0))), 6).alias("mean_people"),
    )
    sure = _last(detections, ["frame", "id"], window, "chunk").groupBy(*CAMERA).agg(rnd(F.avg("confidence"), 6).alias("mean_confidence"))
    total = frames.groupBy(*CAMERA).agg(F.count("*").alias("frames"))
    doubt = detections.groupBy(*CAMERA).agg(F.count("*").alias("decisions"), rnd(F.count_if("needs_review") / F.greatest(F.count("*"), F.lit(1)), 6).alias("review_ratio"))
    return total.join(rates, CAMERA).join(sure, CAMERA, "left").join(doubt, CAMERA, "left")


def camera_report(health: DataFrame, events: DataFrame, samples: DataFrame, size: int = 200, least: int = 10) -> DataFrame:
    """camera_health with each camera's number of events (events: store, camera) and how far what it sees has drifted
    (samples: store, camera, n for the order, embedding; null where ``size`` first ones and ``least`` later ones aren't there)."""
    cam = F.struct(*CAMERA)
    told = events.groupBy(*CAMERA).agg(F.count("*").alias("events"))
    moved = drift(samples.select(cam.alias("cam"), "n", "embedding"), size, least).select("cam.*", "drift")
    return health.join(told, CAMERA, "left").join(moved, CAMERA, "left").withColumn("events", F.coalesce("events", F.lit(0)))


def gauges(health: DataFrame) -> DataFrame:
    """(store_id, camera_id, metric, value) of those gauges that a camera has; an unknown drift gives none."""
    own = [c for c in GAUGES if c in health.columns]
    long = health.select(*CAMERA, *[F.col(c).cast("double") for c in own]).unpivot(CAMERA, own, "metric", "value")
    return long.where("value IS NOT NULL")
