"""Query op12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .common import small_batches, table


def repeated(text: Column, doc_id: Column) -> Column:
    """The text, but for each tenth document (by digest) its words from one on repeat a stretch of words to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    chosen, g = h % 10 == 0, F.floor(h / 10)
    words = F.when(chosen, F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    n = F.size(words)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when(chosen & F.when(chosen, n > 0).otherwise(False), planted).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find_runs(docs)
    # runs come by start, then period, so that the first of equal exponents is the one asked for
    longer = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
