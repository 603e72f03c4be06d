"""Language identification by error-correcting output codes.

Each language gets a codeword of +1 and -1; for each bit a logistic classifier over hashed character n-grams of the
whole text predicts it. Decoding takes the codeword of the smallest logistic loss, summed over the bits with weights
from their accuracy in training; a small gap to the second nearest is flagged as ambiguous.

The model is fitted on at most about ``max_docs`` labelled keys, dealt evenly to the languages by a hash of the key;
counts of languages cover all rows. Its size is bounded by DIMS x bits. More than MOST_LANGS languages are refused, as
their codewords would grow with them.

Defined results: a text that is null or has no letter gives `und` with score 0 and isn't ambiguous; without any
training row all texts give `und`; a key that is repeated in a language teaches its smallest text; with one language every text with a letter is that language, score 1; repeated rows
are predicted each; other columns pass through, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import unit_hash

DIMS, MOST_LANGS, BLOCK = 1 << 13, 1000, 256
UNDECIDED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Root of the counts of hashed 1- to 3-grams of the letters, scaled to length 1; None without a letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    x = np.where(_is_letter()[x], x, np.uint32(32))
    if not (x != 32).any():
        return None
    x = np.concatenate([[np.uint32(32)], x[(x != 32) | (np.append(x[1:], np.uint32(33)) != 32)], [np.uint32(32)]]).astype(np.uint32)
    two = x[:-1] * np.uint32(0x85EBCA6B) + x[1:]
    three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:]
    counts = np.zeros(DIMS, np.int64)
    for grams, seed in ((x, 1), (two, 2), (three, 3)):
        counts += np.bincount(((grams * np.uint32(0x9E3779B1) + np.uint32(seed * 0x27D4EB2F)) >> np.uint32(19)), minlength=DIMS)
    v = np.sqrt(counts, dtype=np.float32)
    return v / np.linalg.norm(v)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all ways to split k languages for small k, else the most distant of some random codes."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        n = (1 << (k - 1)) - 1
        code = np.ones((k, n), np.float32)
        for row in range(1, k):
            code[row] = [1 - 2 * ((c >> (row - 1)) & 1) for c in range(1, n + 1)]
        return code
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (k, int(12 * np.ceil(np.log2(k)))))
        least = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * 1e9).min()
        if least > far:
            best, far = code, least
    return best


class Vectors:
    """Training rows as they come, places and values of what isn't zero; BLOCK of them are spread out at a time, in one buffer."""

    def __init__(self, at: list[bytes], x: list[bytes]):
        self.sizes = np.array([len(v) // 4 for v in x])
        self.at, self.x = np.frombuffer(b"".join(at), np.uint16), np.frombuffer(b"".join(x), np.float32)
        self.ends = np.append(0, np.cumsum(self.sizes))

    def blocks(self):
        """(rows, their vectors), which hold until the next are asked for."""
        room = np.zeros((min(BLOCK, len(self.sizes)), DIMS), np.float32)
        for lo in range(0, len(self.sizes), BLOCK):
            hi = min(lo + BLOCK, len(self.sizes))
            own = slice(self.ends[lo], self.ends[hi])
            at = np.repeat(np.arange(hi - lo), self.sizes[lo:hi]), self.at[own]
            room[at] = self.x[own]
            yield slice(lo, hi), room[: hi - lo]
            room[at] = 0


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    bit_weights: np.ndarray
    min_gap: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = features(text) if self.langs else None
        if x is None:
            return UNDECIDED, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        f = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.code * f) * self.bit_weights).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.langs[first], float(p[first]), bool(p[first] - p[second] < self.min_gap)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_docs: int = 2000, min_gap: float = 0.2) -> Model:
    """Learn from rows with a language; at most about max_docs of them are used, in equal shares."""
    train = train.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key"))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    langs = sorted(counts)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    empty = Model([], np.ones((0, 1)), np.zeros((DIMS, 1), np.float32), np.zeros(1), np.ones(1), min_gap)
    if not langs:
        return empty
    share = max(1, max_docs // len(langs))
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(share / counts[k]))])

    def vectors(batches):
        for batch in slices(batches):
            out_at, out_x, out_y = [], [], []
            for t, y in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if (x := features(t)) is not None:
                    at = np.flatnonzero(x)
                    out_at.append(at.astype(np.uint16).tobytes()), out_x.append(x[at].tobytes()), out_y.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out_at, pa.binary()), pa.array(out_x, pa.binary()), pa.array(out_y, pa.string())], ["at", "x", "y"])

    drawn = train.where(unit_hash(F.col("key"), F.lit(11)) < part[F.col("lang")]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    rows = drawn.mapInArrow(vectors, "at binary, x binary, y string").toArrow()
    if not rows.num_rows:
        return empty
    X = Vectors(rows["at"].to_pylist(), rows["x"].to_pylist())
    y = np.array([langs.index(k) for k in rows["y"].to_pylist()])
    del rows
    code = codewords(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((DIMS, 1), np.float32), np.zeros(1), np.ones(1), min_gap)
    target = code[y]
    share_of = 1 / np.bincount(y, minlength=len(langs))[y]
    row_weight = (share_of / share_of.sum()).astype(np.float32)[:, None]
    W, b, step, speed_w, speed_b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.float32(20), 0, 0
    for _ in range(150):
        slope_w, slope_b = np.float32(1e-5) * W, np.zeros_like(b)
        for at, x in X.blocks():
            g = -target[at] * row_weight[at] / (1 + np.exp(np.clip(target[at] * (x @ W + b), -30, 30)))
            slope_w, slope_b = slope_w + x.T @ g, slope_b + g.sum(0)
        speed_w, speed_b = np.float32(0.9) * speed_w + slope_w, np.float32(0.9) * speed_b + slope_b
        W, b = W - step * speed_w, b - step * speed_b
    right = sum(((np.sign(x @ W + b) == target[at]) * row_weight[at]).sum(0) for at, x in X.blocks())
    bit_weights = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.05)
    return Model(langs, code, W.astype(np.float32), b, bit_weights / bit_weights.mean(), min_gap)


def predict(df: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """df with the language, its score from 0 to 1 and the flag of ambiguity."""
    df = df.drop(*[c for c in out if c in df.columns])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])

    def score(batches):
        m = shared.value
        for batch in slices(batches):
            got = [m.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *out])

    return df.mapInArrow(score, schema)
