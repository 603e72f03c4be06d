"""Query op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .common import table


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kind(F.col("base"), n)).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.as_text(F.concat("base", "extra")).alias("spans"),
    )
