"""Secret scans: pattern candidates, and a random forest that removes false positives.

A candidate is a run of at least 16 key characters, or a value of 6 to 15 that is assigned to a key word. Its features are
length, shares of character classes and transitions between them, entropy, how much of it words of the corpus' dictionary
cover, whether it looks like a path, what stands right before it, and the neighbouring words of its line (three before,
two after), hashed to SLOTS. The forest (Spark's own) learns from labelled findings and never sees a rule, only the
features. The tables hold no labelled findings, so the query labels on learning rows what is sure on either side
(``labelled``): issuers' formats and assigned values of high entropy on one, and on the other words and paths, and runs of
the very same formats that their neighbours call a commit, a digest or an example. What is unclear is left out.

Defined results: null and empty texts give no finding; overlapping candidates can't arise (runs are maximal, and a short
value lies outside them); rows with a null id are scanned too; without
findings of both labels every candidate keeps the rate of label 1; repeated rows are scanned each; only the id and the
text are read, so other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_.=-]{16,}")
KEY_WORDS = ("password", "passwd", "secret", "token", "api", "key", "auth", "credential")
#: A short value behind a key word.
ASSIGNED = re.compile(r"(?i)(?:" + "|".join(KEY_WORDS) + r")[A-Za-z0-9_.-]{0,16}[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_.=-]{6,15})(?![A-Za-z0-9+/_.=-])")
#: Issuers' fixed formats, in upper or lower case.
FORMATS = r"(?i)^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|password=[0-9a-f]{18}|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_(?:live|test)_[0-9A-Za-z]{10,}|xox[abeoprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_=-]+)$"
#: Neighbours that say that what follows is no secret, whatever it looks like.
HARMLESS = r"(?i)\b(?:commit|rev|revision|sha|sha1|sha256|md5|digest|checksum|etag|blob|tree|hash|example|dummy|sample|placeholder)\b[^A-Za-z0-9\n]{0,4}$"
SLOTS, NEAR = 16, re.compile("[a-z]+")
SCHEMA = "doc_id long, start int, end int, finding string, before string, features array<double>"


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def neighbours(before: str, after: str) -> list[float]:
    """The words around a run, on its line, hashed to SLOTS."""
    out = [0.0] * SLOTS
    for w in [*NEAR.findall(before.lower())[-3:], *NEAR.findall(after.lower())[:2]]:
        out[xxhash.xxh32_intdigest(w) % SLOTS] += 1.0
    return out


def features(run: str, before: str, common: frozenset[str], after: str = "") -> list[float]:
    kinds = [_kind(c) for c in run]
    n = len(run)
    shares = [kinds.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(run).values())
    low, covered, at = run.lower(), 0, 0
    while at < n:
        size = next((k for k in (6, 5, 4, 3) if low[at : at + k] in common), 0)
        covered += size
        at += size or 1
    near = before.lower()
    return [float(n), *shares, moves, entropy, covered / n, float("/" in run or "." in run), float("=" in run or near.rstrip("\"' ").endswith(("=", ":"))), float(any(w in near or w in low for w in KEY_WORDS)), float(sum(c in "0123456789abcdef" for c in low) / n), *neighbours(before, after)]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 2000) -> frozenset[str]:
    """The commonest pieces of 3 to 6 letters that start words, counted over all texts; the size is bounded."""

    def count(batches):
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                for w, n in Counter(re.findall(r"[a-z]{3,}", (t or "").lower())).items():
                    for k in (3, 4, 5, 6):
                        if len(w) >= k:
                            total[w[:k]] += n
            if len(total) > 200_000:
                yield pd.DataFrame(list(total.items()), columns=["piece", "n"])
                total.clear()
        yield pd.DataFrame(list(total.items()), columns=["piece", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return frozenset(r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(size).collect())


def candidates(docs: DataFrame, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                t = t or ""
                runs = [(m.start(), m.end(), m.group()) for m in RUN.finditer(t)]
                ends = [e for _, e, _ in runs]
                places = []
                for m in ASSIGNED.finditer(t):
                    k = bisect_right(ends, m.start(1))
                    if k == len(runs) or runs[k][0] >= m.end(1):
                        places.append((m.start(1), m.group(1), 6))
                places += [(start, run, 16) for start, _, run in runs]
                for start, run, least in places:
                    run = run if run.endswith("==") else run.rstrip(".-=")
                    if len(run) >= least:
                        end = start + len(run)
                        before, after = t[max(0, start - 96) : start].rsplit("\n", 1)[-1], t[end : end + 48].split("\n", 1)[0]
                        out.append((i, start, end, run, before, features(run, before, shared.value, after)))
            found = pd.DataFrame(out, columns=["doc_id", "start", "end", "finding", "before", "features"], dtype=object)
            yield found.assign(doc_id=pd.array([None if i is None else int(i) for i in found["doc_id"]], dtype="Int64"))

    # ids go as strings, since Pandas would make a batch with a null id inexact
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, SCHEMA)


def labelled(found: DataFrame) -> DataFrame:
    """found with label: 0 for what its neighbours call harmless, 1 for issuers' formats and assigned values of high entropy,
    0 for runs of dictionary words and paths, null for what is unclear."""
    at = lambda k: F.col("features")[k]
    assigned = (at(9) == 1) & (at(10) == 1) & (at(3) >= 0.15) & (at(7) < 0.5) & (at(6) >= 0.8 * F.log2(F.least(at(0), F.lit(16.0))))
    plain = ((at(3) == 0) & (at(7) >= 0.6)) | ((at(8) == 1) & (at(3) < 0.1) & (at(7) >= 0.4))
    return found.withColumn("label", F.when(F.col("before").rlike(HARMLESS), 0).when(F.col("finding").rlike(FORMATS) | assigned, 1).when(plain, 0))


def fit(labelled: DataFrame, max_findings: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 1):
    """labelled: features and label (0/1). At most about max_findings are used, in equal shares; those without a label
    are left out. None with one label."""
    labelled = labelled.where("label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return counts.get(1, 0) / max(1, sum(counts.values()))
    part = F.when(F.col("label") == 1, F.lit(max_findings / 2 / counts[1])).otherwise(F.lit(max_findings / 2 / counts[0]))
    rows = labelled.where(unit_hash(F.col("finding"), F.col("doc_id"), F.col("start")) < part)
    rows = rows.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def score(found: DataFrame, model) -> DataFrame:
    """found with score, the forest's share of votes for a true secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    scored = model.transform(found.withColumn("x", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
