"""Training sets of photos and box labels as DataFrames: listings, pairs, label lines, geometric expansion, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings that count as images.
IMAGES = ["jpg", "jpeg", "png", "bmp", "webp"]


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def enrolment_photos(spark: SparkSession, root: str) -> DataFrame:
    """(employee_id, path, content) of the images below root/<employee_id>/."""
    return photos(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content"))


def photos(files: DataFrame) -> DataFrame:
    """files (path, ...) that are images, with the folder that they lie in as employee_id."""
    return files.where(ending(F.col("path")).isin(IMAGES)).withColumn("employee_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def photo_counts(files: DataFrame) -> DataFrame:
    """How many images each employee's folder holds; a folder without any counts 0."""
    own = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("employee_id"), ending(F.col("path")).isin(IMAGES).alias("image"))
    return own.groupBy("employee_id").agg(F.count_if("image").alias("photos"))


def enrol(files: DataFrame, embed) -> DataFrame:
    """A gallery (identity_id, seq, embedding) of photos by an embedder: a function of a pandas series of image bytes to one
    of vectors, null where an image can't be read."""
    vector = F.pandas_udf(embed, "array<float>")
    rows = photos(files).select(F.col("employee_id").alias("identity_id"), F.col("path").alias("seq"), vector("content").alias("embedding"))
    return rows.where("embedding IS NOT NULL")


def flat_gallery(gallery: DataFrame) -> DataFrame:
    """One row for each vector of galleries that hold a list of them: identity_id, n, embedding."""
    return gallery.select("identity_id", F.posexplode("embeddings").alias("n", "embedding"))


def pair_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Each image file with the label file of the same stem, if there is one. Both have ``path``."""
    own = images.where(ending(F.col("path")).isin(IMAGES)).select(F.col("path").alias("image"), stem(F.col("path")).alias("stem"))
    return own.join(labels.where(ending(F.col("path")) == "txt").select(F.col("path").alias("labels"), stem(F.col("path")).alias("stem")), "stem", "left")


def label_line(kind: Column, box: Column, w: float, h: float) -> Column:
    """A box as a label line: class, and centre and size as shares of the frame, to six digits."""
    parts = [(box["x1"] + box["x2"]) / (2 * w), (box["y1"] + box["y2"]) / (2 * h), (box["x2"] - box["x1"]) / w, (box["y2"] - box["y1"]) / h]
    return F.format_string("%d %.6f %.6f %.6f %.6f", kind.cast("int"), *[F.bround(p, 6) for p in parts])


def write_labels(lines: DataFrame, path: str) -> None:
    """Writes (stem, line) as text, a folder for each stem."""
    lines.select("stem", F.col("line").alias("value")).repartition("stem").write.mode("append").partitionBy("stem").text(path)


def expand(boxes: DataFrame, w: float, h: float, factor: int = 20, least_visible: float = 0.3, least_area: float = 64.0) -> DataFrame:
    """``factor`` changed copies of each image's boxes (image, id, box): copy n is mirrored if n is odd and moved by up to a
    fifth of the frame each way, which follows from the digest of the image's name and n. ``kept`` says whether enough of a box stays in the frame."""
    rows = boxes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", "image", "copy", F.lit(k)).cast("binary")), 1, 7), 16, 10).cast("long")
    dx, dy = ((drawn(k) % 41 - 20) / 100.0 * side for k, side in ((1, w), (2, h)))
    x1 = F.when(F.col("copy") % 2 == 1, w - F.col("box.x2")).otherwise(F.col("box.x1")) + dx
    wide, high = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    rows = rows.withColumns({"_x": x1, "_y": F.col("box.y1") + dy, "_w": wide, "_h": high})
    cut = lambda v, hi: F.greatest(F.lit(0.0), F.least(v, F.lit(float(hi))))
    new = F.struct(cut(F.col("_x"), w).alias("x1"), cut(F.col("_y"), h).alias("y1"), cut(F.col("_x") + F.col("_w"), w).alias("x2"), cut(F.col("_y") + F.col("_h"), h).alias("y2"))
    left = (F.col("new.x2") - F.col("new.x1")) * (F.col("new.y2") - F.col("new.y1"))
    rows = rows.withColumn("new", new).withColumn("kept", (left >= least_area) & (left >= least_visible * (F.col("_w") * F.col("_h"))))
    return rows.select("image", "id", "copy", F.col("new").alias("box"), "kept")


def expansion_stats(boxes: DataFrame, expanded: DataFrame, factor: int, keep_originals: bool = True) -> DataFrame:
    """source_images, written_images and dropped_boxes of an expansion."""
    source = boxes.agg(F.count_distinct("image").alias("source_images"))
    dropped = expanded.agg(F.count_if(~F.col("kept")).alias("dropped_boxes"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  each side is a single row
    return one(source).join(one(dropped), "one").select("source_images", (F.col("source_images") * (factor + keep_originals)).alias("written_images"), "dropped_boxes")


def write_report(report: dict[str, DataFrame], path: str, most: int = 1000) -> None:
    """Small reports as one readable JSON file; a report of more than ``most`` rows is refused."""
    out = {}
    for name, df in report.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, default=str)
