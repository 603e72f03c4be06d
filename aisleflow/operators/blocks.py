"""Scores of two sets of vectors by blocks: both sides are dealt out, each pair of blocks is one matrix product in a task,
and what leaves a task is what a report needs of it (the best of each query, counts), never a row for each pair.

A side has a block for each BLOCK vectors, but no more than SIDE blocks until these hold MOST vectors each, so a vector, which
travels once for each block of the other side, travels up to SIDE times whatever the tables' size, and a task holds up to MOST
vectors of each side. Their scores are made in tiles of TILE at a time. The work is the product of both sizes, as every query
asks about every vector of a gallery.

Vectors that are null, empty, or hold a null or non-finite entry have no score and take no part, on either side (``unusable``
counts them); vectors of different lengths have none with each other. Rows without an id or a label take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
SIDE, MOST = 16, 131_072
#: Scores that a task holds at once.
TILE = 4_000_000
#: Vectors of a gallery, of about 1 KB each, that a task may hold whole.
WHOLE = 524_288


def _fine() -> Column:
    entries = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & entries, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows (vec_id, label, embedding) that have scores."""
    return vectors.where(_fine())


def unusable(vectors: DataFrame) -> DataFrame:
    """One row: how many rows there are, and how many of them take no part."""
    return vectors.agg(F.count("*").alias("rows"), F.count_if(~_fine()).alias("left_out"))


def _dealt(df: DataFrame, own: str, other: str, blocks: int, others: int, id_col: str) -> DataFrame:
    rows = df.select(*[F.col(c).alias(c) for c in df.columns])  # columns of their own, as both sides may come from one table
    rows = rows.withColumn("dim", F.size("embedding")).withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _blocks(rows: int) -> int:
    return max(1, min(-(-rows // BLOCK), SIDE), -(-rows // MOST))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(np.float64)


def block_scores(queries: DataFrame, gallery: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, halves: bool = False, merge: Callable[[Iterator[pd.DataFrame]], pd.DataFrame] = pd.concat, whole: bool = False) -> DataFrame:
    """``fn`` gets some rows of a block of queries, those of a block of the gallery, and their scores, rounded to six digits,
    which makes ties between engines equal; a row's score with itself is -inf. What it gives for the rows of a block of queries,
    ``merge`` makes one. Rows have vec_id, label, embedding; queries may have more. ``halves``: of one set with itself, each
    pair of rows in one task alone, the other half -inf. ``whole``: rows of queries meet the whole gallery at once."""
    queries, gallery = usable(queries), usable(gallery)
    n, m = (_blocks(df.count()) for df in (queries, gallery))
    if whole:
        n, m = 4 * n, 1
    one, two = _dealt(queries, "qb", "gb", n, m, "vec_id"), _dealt(gallery.select("vec_id", "label", "embedding"), "gb", "qb", m, n, "vec_id")
    if halves:
        one, two = one.where("qb <= gb"), two.where("qb <= gb")

    def each(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame()
        q, g = q.sort_values("vec_id"), g.sort_values("vec_id")
        within = halves and q["qb"].iloc[0] == q["gb"].iloc[0]
        ids, turned = g["vec_id"].to_numpy()[None], _matrix(g["embedding"]).T
        g = g.drop(columns="embedding")

        def tiles():
            size = max(1, TILE // len(g))
            for lo in range(0, len(q), size):
                part = q.iloc[lo : lo + size]
                scores = np.round(_matrix(part["embedding"]) @ turned, 6)
                own = part["vec_id"].to_numpy()[:, None]
                scores[(own >= ids) if within else (own == ids)] = -np.inf
                yield fn(part, g, scores)

        return merge(tiles())

    return one.groupBy("qb", "gb", "dim").cogroup(two.groupBy("qb", "gb", "dim")).applyInPandas(each, schema)


def top_labels(k: int):
    """The k labels of the best scores of each query, a label's being that of its best vector; ties go to the smaller label."""

    def fn(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        names, at = np.unique(g["label"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        best = np.maximum.reduceat(scores[:, order], np.searchsorted(at[order], np.arange(len(names))), axis=1) if len(names) else np.zeros((0, 0))
        first = np.argsort(-best, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"q": np.repeat(q["vec_id"].to_numpy(), first.shape[1]), "g_label": names[first].ravel(), "sim": np.take_along_axis(best, first, 1).ravel() if first.size else []})
        return out[np.isfinite(out["sim"].to_numpy(float))]

    return fn


def top_rows(k: int):
    """The k best rows of each query; ties go to the smaller id."""

    def fn(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        most = scores.shape[1]
        least = np.partition(scores, most - k, axis=1)[:, most - k : most - k + 1] if most > k else -np.inf
        at, to = np.nonzero((scores >= least) & (scores > -np.inf))
        order = np.lexsort((to, -scores[at, to], at))
        at, to = at[order], to[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, to = at[best], to[best]
        take = lambda df, c, rows: df[c].to_numpy()[rows]
        return pd.DataFrame({"q": take(q, "vec_id", at), "q_label": take(q, "label", at), "g": take(g, "vec_id", to), "g_label": take(g, "label", to), "sim": scores[at, to]})

    return fn


def hit_ranks(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
    """For each query, against a whole gallery: whether the first and the first five hold its label, and its average precision."""
    n, real = len(g), np.isfinite(scores)
    hit = (q["label"].to_numpy()[:, None] == g["label"].to_numpy()[None]) & real
    if max(np.abs(scores[real]).max(initial=0) * 1e6, 1) * n < 2**60:
        # score, place among the ids and hit in one number, which sorts faster than places do
        place = np.where(real, -np.rint(np.where(real, scores, 0) * 1e6), np.floor(2**60 / n)).astype(np.int64)
        hit = np.sort((place * n + np.arange(n)) * 2 + hit, axis=1) & 1 == 1
    else:
        hit = np.take_along_axis(hit, np.argsort(-scores, axis=1, kind="stable"), 1)
    of, at = np.nonzero(hit)
    nth = np.arange(len(of)) - np.searchsorted(of, of) + 1
    precision = np.bincount(of, nth / (at + 1), len(q)) / np.maximum(np.bincount(of, minlength=len(q)), 1)
    return pd.DataFrame({"q": q["vec_id"].to_numpy(), "r1": hit[:, :1].any(1).astype(int), "r5": hit[:, :5].any(1).astype(int), "ap": precision})


def label_hits(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
    """For each query its rows of the same label, as lists."""
    same = (q["label"].to_numpy()[:, None] == g["label"].to_numpy()[None]) & np.isfinite(scores)
    ids = g["vec_id"].to_numpy()
    return pd.DataFrame({"q": q["vec_id"].to_numpy(), "hits": [[{"sim": -s, "g": int(i)} for s, i in zip(scores[n, k].tolist(), ids[k], strict=True)] for n, k in enumerate(same)]})


def ahead_of_hits(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
    """For each hit that a query brings along, how many rows here rank before it: of a higher score, or of the same and a
    smaller id."""
    ids, out = g["vec_id"].to_numpy(), []
    for n, hits in enumerate(q["hits"]):
        row = scores[n]
        row = row[np.isfinite(row)]
        up = np.sort(row)
        counts = []
        for h in hits:
            s = -h["sim"]
            higher = len(up) - np.searchsorted(up, s, "right")
            counts.append(int(higher + ((scores[n] == s) & (ids < h["g"])).sum()))
        out.append(counts)
    return pd.DataFrame({"q": q["vec_id"].to_numpy(), "ahead": out})


#: Different scores that are counted in one array.
COUNTED = 1 << 23


def score_counts(q: pd.DataFrame, g: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
    """How many pairs have each score, in millionths, of one label and of two."""
    real = np.isfinite(scores)
    same = q["label"].to_numpy()[:, None] == g["label"].to_numpy()[None] if len(q) else real
    parts = []
    for flag in (True, False):
        each = np.rint(scores[real & (same == flag)] * 1e6).astype(np.int64)
        lo = each.min(initial=0)
        if each.max(initial=0) - lo < COUNTED:
            counted = np.bincount(each - lo)
            value = np.flatnonzero(counted)
            value, n = value + lo, counted[value]
        else:
            value, n = np.unique(each, return_counts=True)
        parts.append(pd.DataFrame({"same": flag, "millionths": value, "n": n.astype(np.int64)}))
    return pd.concat(parts)


def merged_counts(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Counts of all tiles, of those near each other in one row."""
    held: dict[bool, tuple[int, np.ndarray]] = {}
    apart = []
    for part in parts:
        for flag in (True, False):
            own = part[part["same"] == flag]
            if not len(own):
                continue
            value, n = own["millionths"].to_numpy(), own["n"].to_numpy()
            start, counted = held.get(flag, (int(value[0]), np.zeros(0, np.int64)))
            lo, hi = min(start, int(value[0])), max(start + len(counted), int(value[-1]) + 1)
            if hi - lo > COUNTED:
                apart.append(own)
                continue
            if (lo, hi) != (start, start + len(counted)):
                counted = np.pad(counted, (start - lo, hi - start - len(counted)))
            counted[value - lo] += n
            held[flag] = lo, counted
    for flag, (lo, counted) in held.items():
        value = np.flatnonzero(counted)
        apart.append(pd.DataFrame({"same": flag, "millionths": value + lo, "n": counted[value]}))
    return pd.concat(apart) if apart else pd.DataFrame()
