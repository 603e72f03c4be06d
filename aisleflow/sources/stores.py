"""Store configuration and enrolled galleries as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CAMERAS = "store_id string, camera_id string, width double, height double, fps double"
ZONES = "store_id string, camera_id string, zone_idx int, zone string, kind string, polygon array<struct<x:double,y:double>>"


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def store_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(cameras, zones); polygons have at least three points of two coordinates, camera ids are unique."""
    cameras, zones = [], []
    store = config["store_id"]
    for c in config.get("cameras", []):
        if any(c["camera_id"] == k[1] for k in cameras):
            raise ValueError(f"camera {c['camera_id']} is named twice")
        cameras.append((store, c["camera_id"], float(c.get("width", 640)), float(c.get("height", 480)), float(c.get("fps", 10))))
        for n, z in enumerate(c.get("zones", [])):
            if len(z["polygon"]) < 3 or any(len(p) != 2 for p in z["polygon"]):
                raise ValueError(f"zone {z['name']} needs three points of two coordinates or more")
            zones.append((store, c["camera_id"], n, z["name"], z.get("kind", "area"), [(float(x), float(y)) for x, y in z["polygon"]]))
    return spark.createDataFrame(cameras, CAMERAS), spark.createDataFrame(zones, ZONES)


def camera(cameras: DataFrame, camera_id: str) -> DataFrame:
    """The row of one camera; a name that no camera has raises KeyError."""
    row = cameras.where(F.col("camera_id") == camera_id)
    if row.isEmpty():
        raise KeyError(camera_id)
    return row


def with_camera(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """Events with their camera's size and rate; an event of an unknown camera raises when it is read."""
    found = events.join(F.broadcast(cameras), ["store_id", "camera_id"], "left")  # cameras come from a configuration file
    return found.where(F.assert_true(F.col("fps").isNotNull(), F.concat(F.lit("unknown camera "), F.col("store_id"), F.lit("/"), F.col("camera_id"))).isNull())


def save_gallery(gallery: DataFrame, path: str, identity: str = "identity_id", order: str = "seq", most: int = 20) -> None:
    """Writes a gallery, each identity's last ``most`` vectors."""
    newest_vectors(gallery, identity, order, most).write.mode("overwrite").parquet(path)


def load_gallery(spark: SparkSession, path: str, identity: str = "identity_id", order: str = "seq", most: int = 20) -> DataFrame:
    """A written gallery, under the limit that holds now."""
    return newest_vectors(spark.read.parquet(path), identity, order, most)


def newest_vectors(gallery: DataFrame, identity: str = "identity_id", order: str = "seq", most: int = 20) -> DataFrame:
    """A gallery keeps the last ``most`` vectors of an identity."""
    w = W.partitionBy(identity).orderBy(F.desc(order))
    return gallery.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines of five tokens: file, class, cx, cy, w, h; other lines are left out."""
    t = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), t.alias("t")).where(F.size("t") == 5)
    return lines.select("file", F.col("t")[0].cast("int").alias("class"), *[F.col("t")[n + 1].cast("double").alias(c) for n, c in enumerate(("cx", "cy", "w", "h"))])
