"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A text's terms are all its lower-case words, and the first STEM letters of longer ones, which stand for a word's other forms.
A term weighs (1 + log n) times its idf over the whole corpus times what it tells of the label among the examples: FLOOR
for one that tells nothing, so no term is left out, and more with the square of its log odds in standard errors, so that
the label and not the topic says which texts are near. A term that no example holds weighs as one that no text holds and
tells nothing; it only lengthens its text's vector.

Examples are a bounded sample of labelled keys (``max_examples`` for each label, a documented bound). They lie in inverted
lists cut into blocks of BLOCK examples, alike ones together; a term's entry for a block holds its largest weight there. Terms that many
examples hold lie in a matrix, by which all examples are multiplied at once. A
query bounds every block by its greatest sum there and the sum over its other terms, reads the blocks of the greatest bounds and then all whose bound is no
less than its kth cosine, so the neighbours are exact. Votes are weighted by the distance (cosine to a power) and by how
many labelled rows an example stands for, drawn to the base rate, and calibrated by the examples' own scores without
themselves (a logistic curve through their log odds); the neighbours are returned as evidence.

Defined results: a text without a word (empty and null ones too), or without a term in common with any example, gets the
labelled rate; without labelled texts of both kinds every text gets the rate of label 1 (0 without labels); ties in cosine go to the smaller
example number; a key labelled twice counts with its highest label, and of texts that share a key the smallest is learnt
from; null keys and labels teach nothing; repeated rows are scored each; other columns pass through, but for those named
like an output, which are replaced; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import materialise, unit_hash

WORDS = re.compile(r"[^\W\d_]+")
BLOCK, FLOOR, STEM = 128, 0.05, 5
#: Terms held by one example in COMMON are rows of a matrix of at most CELLS places.
COMMON, CELLS = 8, 1 << 22
#: Lists of fewer examples to a block than this are read as a whole.
SHORT = 12


def terms(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(WORDS.findall((text or "").lower())).items():
        out[w] += n
        if len(w) > STEM:
            out[f"{w[:STEM]}*"] += n
    return out


class Space:
    """The terms that examples hold, by number; others have none. Of what it reads it remembers known words with their
    punctuation, up to a bound, and nothing of unknown ones, of which there is no end."""

    def __init__(self, names: list[str]):
        self.word = {t: k for k, t in enumerate(names) if t[-1] != "*"}
        self.part = {t: k for k, t in enumerate(names) if t[-1] == "*"}
        self.room = 50_000
        self.stem = np.full(len(names), -1)  # of each word, where it is longer than its stem
        for t, k in self.word.items():
            if len(t) > STEM:
                self.stem[k] = self.part[f"{t[:STEM]}*"]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the known terms, how often they occur, and how often the unknown ones do."""
        # what stands between white space is looked up as it is, and cut into words only where that is not known
        tokens = Counter((text or "").lower().split())
        at, n = np.fromiter(map(self.word.get, tokens, repeat(-1)), np.int64, len(tokens)), np.fromiter(tokens.values(), np.float64, len(tokens))
        known, words, many, stems, often, other = at >= 0, [], [], [], [], Counter()
        for token, k in compress(tokens.items(), (~known).tolist()):
            found = WORDS.findall(token)
            for w in found:
                if (i := self.word.get(w)) is not None:
                    words.append(i), many.append(k)
                    if len(found) == 1 and self.room:
                        self.word[token], self.room = i, self.room - 1
                    continue
                other[w] += k
                if len(w) > STEM:
                    if (i := self.part.get(s := f"{w[:STEM]}*")) is not None:
                        stems.append(i), often.append(k)
                    else:
                        other[s] += k
        at, n = np.concatenate([at[known], np.array(words, np.int64)]), np.concatenate([n[known], many])
        stem = self.stem[at]
        longer = stem >= 0
        at, place = np.unique(np.concatenate([at, stem[longer], np.array(stems, np.int64)]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, n[longer], often]), len(at))
        return at, n, np.fromiter(other.values(), np.float64, len(other))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray  # of each term
    other: float  # weight of a term that no example holds
    labels: np.ndarray
    stands_for: np.ndarray
    ids: list
    base: float
    k: int = 15
    pull: float = 0.5
    power: float = 2.0
    curve: tuple[float, float] = (1.0, 0.0)

    def index(self, example: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """The examples' unit vectors, given as (example, term, value) in any order: rows of a matrix for the terms that at least
        one in COMMON examples holds (the commonest of them, up to CELLS places), inverted lists for all others."""
        held = np.bincount(term, minlength=len(self.terms))
        often = np.argsort(-held, kind="stable")[: CELLS // max(1, len(self.labels))]
        often = often[held[often] * COMMON >= max(1, len(self.labels))]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        common = self.row[term] >= 0
        self.matrix = np.zeros((len(often), len(self.labels)))
        self.matrix[self.row[term[common]], example[common]] = value[common].astype(np.float32)
        example, term, value = example[~common], term[~common], value[~common]
        order = np.lexsort((example, term))
        self.posting, term, self.value = example[order].astype(np.int32), term[order], value[order].astype(np.float32)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(self.posting // BLOCK) != 0)])) if len(term) else np.empty(0, np.int64)
        self.start = np.concatenate([new, [len(term)]])
        self.block = self.posting[new] // BLOCK
        self.most = np.maximum.reduceat(self.value, new) if len(new) else np.empty(0, np.float32)
        self.entry = np.searchsorted(term[new], np.arange(len(self.terms) + 1))
        self.blocks = -(-len(self.labels) // BLOCK)

    def vector(self, at: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Values of a text's known terms, scaled by the length of all its terms."""
        x = (1 + np.log(n)) * self.weight[at]
        return x / max(1e-12, math.sqrt(float((x * x).sum() + (((1 + np.log(other)) * self.other) ** 2).sum())))

    def nearest(self, at: np.ndarray, x: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(cosines, examples) of the k nearest with a cosine over 0, other than ``but``, and the number of blocks read."""
        row = self.row[at]
        common = row >= 0
        cosine = x[common] @ self.matrix[row[common]]
        if but >= 0:
            cosine[but] = 0
        lo, sizes = self.entry[at], self.entry[at + 1] - self.entry[at]
        first, many = self.start[lo], self.start[self.entry[at + 1]] - self.start[lo]
        if SHORT * sizes.sum() > many.sum():  # the blocks' bounds would cost as much as their lists
            p = _spread(first, many)
            cosine += np.bincount(self.posting[p], np.repeat(x, many) * self.value[p], len(cosine))
            if but >= 0:
                cosine[but] = 0
            return *self._best(cosine, self._kth(cosine)), self.blocks
        most = np.maximum.reduceat(cosine, np.arange(0, len(cosine), BLOCK))
        e, x = _spread(lo, sizes), np.repeat(x, sizes)
        block = self.block[e]
        bound = (most + np.bincount(block, x * self.most[e], self.blocks)) * (1 + 1e-6)
        todo = np.argsort(-bound, kind="stable")
        todo = todo[bound[todo] > 0]
        kth, step, read = 0.0, 4, 0
        while len(todo):
            now, todo = todo[:step], todo[step:]
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            own = np.flatnonzero(chosen[block])
            many = self.start[e[own] + 1] - self.start[e[own]]
            p = _spread(self.start[e[own]], many)
            got = np.bincount(self.posting[p], np.repeat(x[own], many) * self.value[p], len(self.labels))
            cosine += got
            read += len(now)
            if but >= 0:
                cosine[but] = 0
            kth = self._kth(cosine)
            todo, step = todo[bound[todo] >= kth - 1e-9], 4 * step
        return *self._best(cosine, kth), read

    def _kth(self, cosine: np.ndarray) -> float:
        return max(0.0, float(np.partition(cosine, -self.k)[-self.k])) if len(cosine) > self.k else 0.0

    def _best(self, cosine: np.ndarray, kth: float) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero((cosine > 0) & (cosine >= kth - 1e-9))
        found = found[np.lexsort((found, -np.round(cosine[found], 9)))][: self.k]
        return cosine[found], found

    def vote(self, cosine: np.ndarray, found: np.ndarray) -> float:
        """The share of label 1 among the neighbours."""
        if not len(found):
            return self.base
        w = cosine**self.power * self.stands_for[found]
        w = w / (self.stands_for[found].mean() * max(1e-12, float((cosine**self.power).max())))
        return float(((w * self.labels[found]).sum() + self.pull * self.base) / (w.sum() + self.pull))

    def score(self, at: np.ndarray, n: np.ndarray, other: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The score, and cosines and numbers of the neighbours that gave it."""
        none = np.empty(0), np.empty(0, np.int64)
        if not len(at):
            return self.base, *none
        cosine, found, _ = self.nearest(at, self.vector(at, n, other))
        if not len(found):
            return self.base, *none
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * _odds(self.vote(cosine, found)) + b)))), cosine, found


def _odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from log odds of p to y, by Newton steps, drawn a little to (1, 0)."""
    z, (a, b) = _odds(p), (1.0, 0.0)
    w = w / w.sum() * len(w)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (q - y), np.maximum(w * q * (1 - q), 1e-9)
        grad = np.array([(g * z).sum() + (a - 1), g.sum() + b])
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - float(da), b - float(db)
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if 0.05 < a < 20 else (1.0, 0.0)


def fit(docs: DataFrame, corpus: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "toxic", max_examples: int = 1000, k: int = 15) -> Model:
    """docs: where labelled texts may be learnt from; corpus: all texts, for document frequencies; labels: key and 0/1, of
    keys that may be learnt from."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    base = n1 / (n1 + n0) if n1 + n0 else 0.0
    none = Model([], np.zeros(0), 1.0, np.zeros(0, np.int64), np.zeros(0), [], base, k)
    if not n1 or not n0:
        return none
    part = F.when(F.col("y") == 1, F.lit(max_examples / n1)).otherwise(F.lit(max_examples / n0))
    drawn = materialise(known.where(unit_hash(F.col("key"), F.lit(5)) < part), "toxicity-keys")
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = texts.join(F.broadcast(drawn) if drawn.count() <= 3 * max_examples else drawn, "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    # a copied text is one example
    texts = materialise(texts.groupBy("text", "y").agg(F.min("key").alias("key")), "toxicity-examples")

    def split(batches):
        for batch in slices(batches):
            got = [terms(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["y"], pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))], ["key", "y", "terms", "n"])

    examples = texts.mapInArrow(split, T.StructType([texts.schema["key"], T.StructField("y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))
    held = examples.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).toArrow().sort_by("term")
    names = held["term"].to_pylist()
    shared = spark.sparkContext.broadcast(names)

    def frequency(batches):
        space, total, n = Space(shared.value), np.zeros(len(shared.value), np.int64), 0
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                n += 1
                total[space.counts(t)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["term", "n"])

    df = corpus.select(text_col).mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(names) + 1, np.int64)
    seen[df["term"].to_numpy()] = df["n"].to_numpy()
    n_docs = int(seen[-1])

    def vectors(batches):
        space = Space(shared.value)
        for batch in slices(batches):
            got = [space.counts(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["y"], pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["key", "y", "t", "n"])

    kept = texts.mapInArrow(vectors, T.StructType([texts.schema["key"], T.StructField("y", T.IntegerType()), T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))])).toArrow()
    shared.unpersist()
    y, keys = kept["y"].to_numpy(), kept["key"].to_pylist()
    m1, m0 = int(y.sum()), int((1 - y).sum())
    if not m1 or not m0 or not names:
        return none
    a, b = held["a"].to_numpy().astype(float) + 0.5, held["b"].to_numpy().astype(float) + 0.5
    spread = 1 / a + 1 / b + 1 / np.maximum(m1 + 1 - a, 0.5) + 1 / np.maximum(m0 + 1 - b, 0.5)
    tells = np.log(a / np.maximum(m1 + 1 - a, 0.5) * np.maximum(m0 + 1 - b, 0.5) / b) ** 2 / spread
    weight = (np.log((1 + n_docs) / (1 + seen[:-1])) + 1) * (FLOOR + np.maximum(0, tells - 4))
    lists, many = kept["t"].combine_chunks(), kept["n"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    t, n, row = lists.flatten().to_numpy(), many.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(np.arange(len(y)), sizes)
    x = (1 + np.log(n)) * weight[t]
    x /= np.maximum(1e-12, np.sqrt(np.bincount(row, x * x, len(y))))[row]
    # examples that are alike lie in one block: by the commonest term that they hold (a language's), by label, by their heaviest term
    heaviest, commonest = np.full(len(y), -1), np.full(len(y), -1)
    held_by = np.bincount(t, minlength=len(names))
    for at, by in ((heaviest, x), (commonest, held_by[t])):
        rank = np.argsort(by, kind="stable")
        at[row[rank]] = t[rank]
    order = np.lexsort((np.array([str(key) for key in keys]), heaviest, y, commonest))
    number = np.empty(len(y), np.int64)
    number[order] = np.arange(len(y))
    model = Model(names, weight, (math.log(1 + n_docs) + 1) * FLOOR, y[order], np.where(y[order] > 0, n1 / m1, n0 / m0), [keys[i] for i in order], base, k)
    model.index(number[row], t, x)
    whole = spark.sparkContext.broadcast(model)

    def votes(batches):
        m = whole.value
        space, own = Space(m.terms), {key: i for i, key in enumerate(m.ids)}
        for batch in slices(batches):
            out = []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                at, n, other = space.counts(text)
                out.append(m.vote(*m.nearest(at, m.vector(at, n, other), own[key])[:2]) if len(at) else None)
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(out, pa.float64())], ["y", "p"])

    own = texts.mapInArrow(votes, "y int, p double").where("p IS NOT NULL").toArrow()
    whole.unpersist()
    q = own["y"].to_numpy()
    if 0 < q.sum() < len(q):
        model.curve = _curve(own["p"].to_numpy(), q, np.where(q > 0, n1 / m1, n0 / m0))
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """df with the score from 0 to 1 and the neighbours that gave it (example key, cosine, label)."""
    df = df.drop(*[c for c in out if c in df.columns])
    shared = df.sparkSession.sparkContext.broadcast(model)
    evidence = T.ArrayType(T.StructType([T.StructField("example", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    schema = T.StructType([*df.schema.fields, T.StructField(out[0], T.DoubleType()), T.StructField(out[1], evidence)])

    def each(batches):
        m = shared.value
        space, known = Space(m.terms), {}
        ids, labels = np.array([str(i) for i in m.ids], dtype=object), np.asarray(m.labels, np.int32)
        for batch in slices(batches):
            got = []
            for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                # a text's copies are scored once by a task, as far as it remembers
                if t not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[t] = m.score(*space.counts(t)) if m.terms else (m.base, np.empty(0), np.empty(0, np.int64))
                got.append(known[t])
            near = np.concatenate([g[2] for g in got]).astype(np.int64)
            fields = [pa.array(ids[near], pa.string()), pa.array(np.concatenate([g[1] for g in got]), pa.float64()), pa.array(labels[near], pa.int32())]
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[1]) for g in got)]), pa.int32()), pa.StructArray.from_arrays(fields, ["example", "cosine", "label"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.float64()), found], [*batch.schema.names, *out])

    return df.mapInArrow(each, schema)
