"""Boxes that overlap, frame by frame, without looking at all pairs of a crowded frame.

A frame of no more than CROWD boxes is one place, in which all meet. A crowded one is laid out in square tiles: a box goes to
each tile it touches, boxes meet in tiles, and a pair counts only in the tile that holds the upper left corner of what they
share, so it is found once. Work follows the boxes that lie near each other, and a crowded frame is spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The side of a tile in pixels, about the size of a person's box: smaller ones copy boxes, larger ones pair strangers.
TILE = 96.0
#: Boxes of a frame, of both tables together, up to which copying them to tiles costs more than looking at all pairs.
CROWD = 512


def _tiles(rows: DataFrame, box: Column, tile: float) -> DataFrame:
    """A row for each tile that a box touches."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(box[lo] / tile), F.floor(box[hi] / tile)))
    return rows.select("*", span("x1", "x2").alias("_tx")).select("*", span("y1", "y2").alias("_ty"))


def meeting(one: DataFrame, two: DataFrame, frame: list[str], a: str, b: str, tile: float = TILE, crowd: int = CROWD) -> DataFrame:
    """The pairs that are looked at: rows of one and two, in the same frame, in a crowded one in the same tile (``_tx``, ``_ty``,
    null elsewhere). Boxes without an area, or with a null or non-finite side, meet nothing. The tables share no column names
    but those of ``frame``."""

    def fine(rows: DataFrame, c: str) -> DataFrame:
        box = F.col(c)
        sides = [F.abs(box[k]) < float("inf") for k in ("x1", "y1", "x2", "y2")]
        return rows.where(sides[0] & sides[1] & sides[2] & sides[3] & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"]))

    one, two = fine(one, a), fine(two, b)
    crowded = one.select(*frame).unionAll(two.select(*frame)).groupBy(*frame).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*frame)
    none = F.lit(None).cast("long")
    calm = one.join(crowded, frame, "left_anti").join(two, frame).withColumns({"_tx": none, "_ty": none})
    placed = lambda rows, c: _tiles(rows.join(crowded, frame, "left_semi"), F.col(c), tile)
    return calm.unionByName(placed(one, a).join(placed(two, b), [*frame, "_tx", "_ty"]))


def overlapping(one: DataFrame, two: DataFrame, frame: list[str], a: str, b: str, tile: float = TILE, crowd: int = CROWD) -> DataFrame:
    """The pairs of rows of one and two, of the same frame, whose boxes a and b share an area, each pair once."""
    p, q = F.col(a), F.col(b)
    shared = (p["x1"] < q["x2"]) & (q["x1"] < p["x2"]) & (p["y1"] < q["y2"]) & (q["y1"] < p["y2"])
    corner = lambda k: F.floor(F.greatest(p[k], q[k]) / tile)
    owner = F.col("_tx").isNull() | (corner("x1") == F.col("_tx")) & (corner("y1") == F.col("_ty"))
    return meeting(one, two, frame, a, b, tile, crowd).where(shared & owner).drop("_tx", "_ty")
