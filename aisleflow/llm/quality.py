"""Quality by ordinal cumulative-link regression.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector over hashed words and a few shape marks is shared by all
grades, and the ordered thresholds (their gaps are kept positive) cut its scale. The model is fitted on at most about
``max_docs`` rated keys, dealt evenly to the grades by a hash of the key; counts of grades cover all keys. The keys are
drawn from the ratings alone, so texts are read once and only those of drawn keys are shuffled.

Defined results: a null text counts as empty; empty texts are scored by their shape marks; without rated texts every
expected grade is 0 and every tail 0; with one grade it is that grade; a key rated several times has its lowest grade, and
of texts that share a key the smallest is learnt from; null keys and null grades teach nothing; repeated rows are scored
each; other columns pass through, but for those named like an output, which are replaced; an empty table gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import materialise, unit_hash

DIMS = 1 << 12
WORD = re.compile(r"\S+")
_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    got = _slots.get(word)
    if got is None:
        if len(_slots) > 300_000:
            _slots.clear()
        got = _slots[word] = xxhash.xxh32_intdigest(word) % DIMS
    return got


def features(text: str | None) -> np.ndarray:
    """Root counts of hashed words, scaled to length 1, then shape marks: length, repetition, symbols, digits, line repeats."""
    text = text or ""
    words = WORD.findall(text.lower())
    out = np.zeros(DIMS + 6, np.float32)
    if words:
        counts = np.bincount(np.fromiter(map(_slot, words), np.int64, len(words)), minlength=DIMS)
        out[:DIMS] = np.sqrt(counts)
        out[:DIMS] /= np.linalg.norm(out[:DIMS])
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    out[DIMS:] = (np.log1p(len(words)) / 8, len(set(words)) / n, 5 * same / n, 1 - letters / chars, 5 * sum(map(str.isdigit, text)) / chars if any(map(text.__contains__, "0123456789")) else 0, 1 - len(set(lines)) / len(lines))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest."""
        return 1 - _sigmoid(self.thresholds - features(text) @ self.weights)

    def predict(self, text: str | None, tail_at: int) -> tuple[float, float]:
        if not self.grades:
            return 0.0, 0.0
        tails = self.tails(text) if len(self.grades) > 1 else np.zeros(0)
        expected = self.grades[0] + float((tails * np.diff(self.grades)).sum())
        at = next((k for k, g in enumerate(self.grades) if g >= tail_at), None)
        return expected, 0.0 if at is None else 1.0 if at == 0 else float(tails[at - 1])


def fit(docs: DataFrame, ratings: DataFrame, text_col: str = "text", grade_col: str = "grade", key_col: str = "doc_id", max_docs: int = 4000, rounds: int = 300) -> Model:
    """docs: where rated texts may be learnt from; ratings: key and grade. Both have ``key_col``."""
    known = ratings.where(F.col(grade_col).isNotNull() & F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key")).agg(F.min(grade_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    grades = sorted(counts)
    if not grades:
        return Model([], np.zeros(DIMS + 6), np.zeros(0))
    share = max(1, max_docs // len(grades))
    part = F.create_map(*[F.lit(v) for g in grades for v in (g, share / counts[g])])[F.col("y")]
    drawn = materialise(known.where(unit_hash(F.col("key"), F.lit(13)) < part), "quality-keys")
    own = docs.select(F.col(key_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own.join(F.broadcast(drawn) if drawn.count() <= 2 * max_docs else drawn, "key")
    own = own.groupBy("key", "y").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in batch["text"].to_pylist()], pa.binary()), batch["y"]], ["x", "y"])

    rows = own.mapInArrow(vectors, "x binary, y int").collect()
    if len(seen := sorted({r["y"] for r in rows})) < 2:
        return Model(seen, np.zeros(DIMS + 6), np.zeros(0))
    grades = seen
    X = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    y = np.array([grades.index(r["y"]) for r in rows])
    # each drawn row stands for as many as its grade was thinned by
    weight = np.array([counts[g] for g in grades])[y] / np.bincount(y, minlength=len(grades))[y]
    weight = weight / weight.sum()
    k = len(grades) - 1
    below = (y[:, None] <= np.arange(k)[None, :]).astype(np.float64)
    share_below = np.clip((weight[:, None] * below).sum(0), 1e-3, 1 - 1e-3)
    start = np.log(share_below / (1 - share_below))
    first, gaps, w = start[0], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(X.shape[1])
    m = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    v = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    for step in range(1, rounds + 1):
        cut = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = X @ w.astype(np.float32)
        # log P(grade = j) = log(s_j - s_{j-1}), s the cumulative probabilities with 0 and 1 at the ends
        s = np.concatenate([np.zeros((len(y), 1)), _sigmoid(cut[None, :] - score[:, None]), np.ones((len(y), 1))], 1)
        d = s * (1 - s)
        at = np.arange(len(y))
        p = np.maximum(s[at, y + 1] - s[at, y], 1e-9)
        up, down = d[at, y + 1] / p, d[at, y] / p
        g_score = weight * (up - down)
        g_cut = np.zeros(k)
        np.add.at(g_cut, np.minimum(y, k - 1), np.where(y < k, -weight * up, 0))
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, weight * down, 0))
        grads = [X.T @ g_score.astype(np.float32) + 1e-5 * w, g_cut.sum(), np.array([g_cut[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)]
        new = []
        for n, (value, g) in enumerate(zip((w, first, gaps), grads, strict=True)):
            m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.99 * v[n] + 0.01 * g * g
            new.append(value - 0.05 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8))
        w, first, gaps = new
    return Model(grades, w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def score(df: DataFrame, model: Model, text_col: str = "text", tail_at: int = 1, out: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """df with the expected grade and P(grade >= tail_at)."""
    df = df.drop(*[c for c in out if c in df.columns])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in out)])

    def each(batches):
        for batch in slices(batches):
            got = [shared.value.predict(t, tail_at) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))], [*batch.schema.names, *out])

    return df.mapInArrow(each, schema)
