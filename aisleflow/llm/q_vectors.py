"""Query op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import whiten
from .common import small_batches, table


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 4096)
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
