"""Exact top-k by inner product: ball trees over shards of near vectors, searched by branch and bound.

Vectors become integers floor(scale * x). At most PIVOTS of them, drawn by a hash, split space into cells; a cell's vectors
are dealt to shards of about SHARD, and one task builds a shard's tree: nodes hold a centre and a radius, leaves up to LEAF
vectors. No inner product in a node exceeds q.centre + |q| radius. Queries travel in blocks of up to BLOCK of one cell.

A block first meets a shard of its own cell, which gives its queries a kth score. Then all shards' root balls are held
against all blocks' balls, slim rows without vectors; shards whose bound lies below a block's least kth score fall out, the
others are ordered by it. Rounds follow, of 4 shards, then 16, and so on: each round's tasks start from the kth scores that
the rounds before have given, so they skip shards and nodes that can no longer matter. Within a tree nodes are visited in
falling order of their bound, and the kth score rises as leaves are read. Each pair of block and shard is a row of its own,
so a lost task repeats little; a block's state is written after each round.

Defined results: vectors that are null, empty, or hold null or non-finite components (or ones beyond 1e150, whose products
doubles don't hold) take no part, nor do rows with a null id; products and sums are exact however large, and a score beyond
64 bits is given as the end of their range; a vector of another length
than the query's isn't its candidate; rows with the query's own id aren't either; a repeated query id counts once (with
the smallest vector of that id); repeated candidate rows all count; ties go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialise

LEAF, BLOCK, SHARD, PIVOTS = 64, 256, 4096, 1024


def _matrix(rows) -> np.ndarray:
    """Rows as doubles, which hold these integers and their products exactly; Python integers where they would not."""
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    if m.size and float(np.abs(m).max()) >= (2.0**52 / m.shape[1]) ** 0.5:
        return np.array([[int(x) for x in r] for r in rows], dtype=object)
    return m


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """(order of the vectors, nodes); a node is (begin, end, centre, radius, left, right) with -1 for no child."""
    flat = vectors.astype(np.float64)
    order, nodes = np.arange(len(flat)), []

    def grow(lo: int, hi: int) -> int:
        own = flat[order[lo:hi]]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        me = len(nodes)
        nodes.append(None)
        left = right = -1
        if hi - lo > leaf:
            a = own[np.argmax(away)]
            b = own[np.argmax(((own - a) ** 2).sum(1))]
            rank = np.argsort(own @ (b - a), kind="stable")
            order[lo:hi] = order[lo:hi][rank]
            mid = (lo + hi) // 2
            left, right = grow(lo, mid), grow(mid, hi)
        nodes[me] = (lo, hi, centre, float(np.sqrt(away.max())) * (1 + 1e-9) + 1e-6, left, right)
        return me

    if len(flat):
        grow(0, len(flat))
    return order, nodes


def search(queries: np.ndarray, own_ids: list[int], best: list[list[tuple[int, int]]], ids: np.ndarray, vectors: np.ndarray, nodes: list[tuple], k: int) -> int:
    """Improve best, lists of (-score, id) in order, by a tree whose vectors and ids lie in its order; the number of leaf visits."""
    if not nodes or not len(queries):
        return 0
    flat = queries.astype(np.float64)
    lengths = np.sqrt((flat**2).sum(1)) * (1 + 1e-9)
    kth = np.array([-float(b[k - 1][0]) if len(b) >= k else -np.inf for b in best])
    centres = np.stack([n[2] for n in nodes])
    radii = np.array([n[3] for n in nodes])
    bounds = flat @ centres.T + lengths[:, None] * radii
    visits = 0

    def walk(node: int, who: np.ndarray) -> None:
        nonlocal visits
        who = who[bounds[who, node] >= kth[who] - 1e-6 * (1 + np.abs(kth[who]))] if np.isfinite(kth[who]).any() else who
        if not len(who):
            return
        lo, hi, _, _, left, right = nodes[node]
        if left >= 0:
            first = bounds[who, left].sum() >= bounds[who, right].sum()
            for child in (left, right) if first else (right, left):
                walk(child, who)
            return
        visits += len(who)
        scores = queries[who] @ vectors[lo:hi].T
        for row, q in enumerate(who):
            got = scores[row]
            hit = np.flatnonzero(got >= kth[q]) if np.isfinite(kth[q]) else np.arange(hi - lo)
            new = [(-int(got[i]), int(ids[lo + i])) for i in hit if ids[lo + i] != own_ids[q]]
            if new:
                best[q] = sorted(best[q] + new)[:k]
                if len(best[q]) >= k:
                    kth[q] = -float(best[q][k - 1][0])

    walk(0, np.arange(len(queries)))
    return visits


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as a double; from 2^53 on doubles are integers already."""

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def _in_range(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), the id of the candidate, score."""
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= 1e150), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    totals = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots = {d: _matrix([r["v"] for r in rows.where(F.col("dim") == d).orderBy(F.xxhash64("id", F.lit(4)), "id").limit(min(PIVOTS, -(-n // SHARD))).collect()]).astype(np.float64) for d, n in totals.items()}

    def cell(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                v, p = np.array(batch["v"].take(pa.array(own)).to_pylist(), np.float64), pivots[int(d)]
                out[own] = np.argmin((p * p).sum(1)[None] - 2 * (v @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    placed = lambda part: part.mapInArrow(cell, T.StructType([*part.schema.fields, T.StructField("cell", T.LongType())]))
    # at most PIVOTS rows for a length of vectors
    sizes = placed(rows).groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).alias("shards"), F.greatest(F.ceil(F.count_if("q") / BLOCK), F.lit(1)).alias("blocks"))
    sizes = F.broadcast(materialise(sizes, "topk-sizes"))
    dealt = lambda part, seed, n: F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))

    def ball(m: np.ndarray) -> tuple[list[float], float]:
        centre = m.astype(np.float64).mean(0)
        return centre.tolist(), float(np.sqrt(((m.astype(np.float64) - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = _matrix(pdf["v"])
        order, nodes = build(m)
        centre, radius = ball(m)
        blob = pickle.dumps((pdf["id"].to_numpy()[order], m[order].astype(np.int32) if m.dtype == float and np.abs(m).max() < 2**31 else m[order], nodes))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "centre": [centre], "radius": [radius], "tree": [blob]})

    trees = placed(rows.select("id", "v", "dim")).join(sizes, ["dim", "cell"]).withColumn("shard", dealt(rows, 3, "shards")).groupBy("dim", "shard")
    trees = materialise(trees.applyInPandas(plant, "dim int, shard long, centre array<double>, radius double, tree binary"), "topk-trees")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = _matrix(pdf["v"])
        centre, radius = ball(m)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "centre": [centre], "radius": [radius], "least": [-np.inf], "queries": [pickle.dumps((pdf["id"].tolist(), m))], "best": [pickle.dumps([[] for _ in range(len(pdf))])]})

    state_schema = "dim int, block long, shards long, centre array<double>, radius double, least double, queries binary, best binary"
    asked = rows.where("q").groupBy("id", "dim").agg(F.min("v").alias("v")).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.v", "s.dim")
    state = placed(asked).join(sizes, ["dim", "cell"]).withColumn("block", dealt(asked, 9, "blocks")).groupBy("dim", "block").applyInPandas(gather, state_schema)
    state = materialise(state, "topk-state")

    def meet(batches):
        """What a shard adds to a block's best."""
        for pdf in batches:
            for dim, block, raw, held, tree in zip(pdf["dim"], pdf["block"], pdf["queries"], pdf["best"], pdf["tree"], strict=True):
                own, q = pickle.loads(raw)
                best = pickle.loads(held)
                ids, vectors, nodes = pickle.loads(tree)
                given = [set(b) for b in best]
                search(q, own, best, ids, vectors if vectors.dtype == object else vectors.astype(np.float64), nodes, k)
                yield pd.DataFrame({"dim": [dim], "block": [block], "added": [pickle.dumps([[x for x in b if x not in g] for b, g in zip(best, given, strict=True)])]})

    def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        best = pickle.loads(old["best"].iloc[0])
        for raw in new["added"]:
            best = [sorted(b + x)[:k] for b, x in zip(best, pickle.loads(raw), strict=True)]
        least = min((-float(b[k - 1][0]) if len(b) >= k else -np.inf for b in best), default=-np.inf)
        return old.assign(best=[pickle.dumps(best)], least=[least])

    def after(state: DataFrame, pairs: DataFrame) -> DataFrame:
        added = state.join(pairs, ["dim", "block"]).join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).select("dim", "block", "queries", "best", "tree").mapInPandas(meet, "dim int, block long, added binary")
        return materialise(state.groupBy("dim", "block").cogroup(added.groupBy("dim", "block")).applyInPandas(merge, state_schema), "topk-state")

    home = F.shiftright("block", 32) * (1 << 32) + F.pmod(F.xxhash64("block"), F.col("shards"))
    state = after(state, state.select("dim", "block", home.alias("shard")))

    def bounds(batches):
        """No inner product of a block's query and a shard's vector is greater."""
        for pdf in batches:
            bs = []
            for c, r, o, s in zip(pdf["centre"], pdf["radius"], pdf["c"], pdf["r"], strict=True):
                c, o = np.asarray(c), np.asarray(o)
                bs.append(float(c @ o + r * np.sqrt(o @ o) + (np.sqrt(c @ c) + r) * s))
            yield pdf[["dim", "block", "shard"]].assign(bound=np.array(bs) + 1e-6 * (1 + np.abs(bs)))

    roots = trees.select("dim", "shard", F.col("centre").alias("c"), F.col("radius").alias("r"))
    others = state.withColumn("home", home).select("dim", "block", "home", "centre", "radius").join(roots, "dim").where("shard <> home")
    order = W.partitionBy("dim", "block").orderBy(F.desc("bound"), "shard")
    reach = others.select("dim", "block", "shard", "centre", "radius", "c", "r").mapInPandas(bounds, "dim int, block long, shard long, bound double")
    reach = reach.join(state.select("dim", "block", "least"), ["dim", "block"]).where("bound >= least").withColumn("rank", F.row_number().over(order))
    reach = materialise(reach.select("dim", "block", "shard", "bound", "rank"), "topk-pairs")
    last, done, step = reach.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0], 0, 4
    while done < last:
        now = reach.where((F.col("rank") > done) & (F.col("rank") <= done + step)).join(state.select("dim", "block", "least"), ["dim", "block"]).where("bound >= least")
        state = after(state, now.select("dim", "block", "shard"))
        done, step = done + step, 4 * step

    def given(batches):
        for pdf in batches:
            out = [(q, n, c, _in_range(-s)) for raw, held in zip(pdf["queries"], pdf["best"], strict=True) for q, b in zip(pickle.loads(raw)[0], pickle.loads(held), strict=True) for n, (s, c) in enumerate(b, 1)]
            yield pd.DataFrame(out, columns=["query_id", "rank", id_col, "score"]).astype({"query_id": "int64", "rank": "int32", id_col: "int64", "score": "int64"})

    return state.select("queries", "best").mapInPandas(given, f"query_id long, rank int, `{id_col}` long, score long")
