"""Corpus pipeline: language identification, toxicity, near-duplicates, personal data, packing.

Each stage takes what its predecessor kept and was written as Parquet. All but the last return the columns of documents.
Defined results: null and empty texts have no language and go in the first stage; null ids are kept but never linked as
near-duplicates; an empty table stays empty; repeated rows stay until the third stage keeps one of them; columns beside
those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleflow.llm import bpe, langid, neardup, packing, pii, toxicity
from aisleflow.llm.common import held_out, materialise, small_batches, table
from aisleflow.llm.q_text import tokenizer


#: The corpus's languages are those of at least this share of the rows that name one; texts of so many letters can be told.
LEAST_SHARE, TELLING_LETTERS = 0.01, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose predicted language is one of the corpus's. Rejected are texts without a letter, texts that are likest a
    language which few rows name, and long texts that the nearest two languages fit alike (mixtures and noise); short ones
    that fit two alike hold too little to tell and stay."""
    small_batches(spark)
    learn = docs.where(~held_out(F.col("doc_id")))
    model = langid.fit(learn)
    named = {r["lang"]: r["n"] for r in learn.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).limit(langid.MOST_LANGS).collect()}
    wanted = [k for k, n in named.items() if n >= LEAST_SHARE * sum(named.values())]
    # the outputs' names must not clash with columns of the documents
    out = [f"_{'_' * max(map(len, docs.columns))}{c}" for c in ("lang", "score", "unsure")]
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    told = langid.predict(docs, model, out=tuple(out))
    return told.where(F.col(out[0]).isin(wanted) & ~(F.col(out[2]) & (letters >= TELLING_LETTERS))).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are likelier toxic than not."""
    small_batches(spark)
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, out=("_score", "_evidence")).where(F.col("_score") < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left."""
    small_batches(spark)
    ids = bpe.encode(docs.select("doc_id", "text"), tokenizer()).select("doc_id", "ids")
    return packing.pack(ids)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: SQL expresses neither the models nor the tokenizer; tests hold the operators, and the last stage's ids, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
