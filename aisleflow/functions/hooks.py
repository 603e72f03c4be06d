"""Where models of the user's own come in: detectors of frames, embedders and role classifiers of crops, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTIONS = "store_id string, camera_id string, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, class int"


def detect_with(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], least: float = 0.4, kind: int = 0, min_side: float = 4.0) -> DataFrame:
    """Detections of frames (store_id, camera_id, frame, ...). ``load`` is called once in a task, which is when a model is
    read and warmed up, and gives a function of a batch of frames to DETECTIONS. Kept are those of ``least`` confidence, of
    the class asked for, and of ``min_side`` pixels a side."""

    def run(batches):
        model = None
        for batch in batches:
            model = model or load()
            yield model(batch)

    return keep_detections(frames.mapInPandas(run, DETECTIONS), least, kind, min_side)


def keep_detections(found: DataFrame, least: float = 0.4, kind: int = 0, min_side: float = 4.0, min_area: float = 0.0) -> DataFrame:
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return found.where((F.col("confidence") >= least) & (F.col("class") == kind) & (wide >= min_side) & (high >= min_side) & (wide * high >= min_area))


def embed_with(embed: Callable[[pd.Series], pd.Series], crop: Column) -> Column:
    """Vectors of crops (bytes); a null crop has none."""

    def run(crops: pd.Series) -> pd.Series:
        known = crops.notna()
        out = pd.Series([None] * len(crops), index=crops.index, dtype=object)
        if known.any():
            out[known] = embed(crops[known])
        return out

    return F.pandas_udf(run, "array<float>")(crop)


def classify_with(classify: Callable[[pd.Series], pd.DataFrame], crop: Column) -> Column:
    """(role, confidence) of crops."""
    return F.pandas_udf(classify, "role string, confidence double")(crop)
