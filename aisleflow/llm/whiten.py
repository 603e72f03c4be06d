"""Whitening of embeddings: components of their covariance, to double precision.

1. Entries c become whole numbers floor(256 c). The fit list is each distinct vector once, so copies have no weight. Counts
   and sums are exact; the covariance is of centred vectors, in double precision, by partial matrices of each task.
2. Eigenvectors of the covariance in single precision are corrected by matrix products in higher precision (Ogita and
   Aishima): with R = I - X'X and S = X'AX the eigenvalues are S_ii / (1 - R_ii), and X moves by X E, where E_ij is
   (S_ij + l_j R_ij) / (l_j - l_i) for eigenvalues that are apart, and R_ij / 2 for those closer than what the products'
   errors can tell. Each step squares the error.
3. Eigenvalues that stay so close form clusters. A cluster's vectors are right as a space by then; A, shifted by their mean
   eigenvalue, is solved inside that space, where the differences are no longer small, and the steps go on.

The matrices are as large as the vectors' length, never as the table; they are the only things that meet in one place.

Defined results: rows whose vector is null, empty, or holds a null, non-finite or very large entry (256 c beyond 2^52) are left
out, and so are vectors of another length than the commonest (ties: the longer). Repeated rows and ids stay, each with its
components. A component without variance has whitened null (identity_error is over the others); without any variance explained
is null. Fewer entries than ``components`` give as many as there are. A deviation beyond a long is null. An empty table gives
an empty result. Other columns are left to a join by id.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Beyond it, differences of doubles no longer tell entries apart.
LARGEST = float(1 << 52)
_ROWS = 4096


def whole(vector: Column) -> Column:
    """The entries as whole numbers; null where the vector can't take part."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * 256) + 0)
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * 256) < LARGEST, F.lit(False)))
    return F.when((F.size(vector) > 0) & fine, scaled)


def _blocks(batch, name: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    lists = batch[name]
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(batches):
    """One row for each entry: how many rows a task read, and their exact sum there."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _blocks(batch, "x")
            for k in range(0, len(x), 1024):  # 1,024 numbers below 2^52 sum exactly in 64 bits
                part = x[k : k + 1024].sum(0).astype(object)
                total = part if total is None else total + part
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["n", "at", "total"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n. n x - S is exact where it fits 64 bits, so that equal entries give zeros."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (x * n - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the entries of (n x - S)^2, exact; None beyond a long."""
    if (2 * n * int(np.abs(x).max(initial=0))) ** 2 * x.shape[1] < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    found = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in found]


def _products(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all rows of y y', y being what ``make`` gives for a batch: partial matrices of the tasks, added by their rows."""

    def each(batches):
        total = np.zeros((size, size))
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen, y = True, make(_blocks(batch, "x"))
                for k in range(0, len(y), _ROWS):
                    total += y[k : k + _ROWS].T @ y[k : k + _ROWS]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(pdf):
        return pdf.iloc[:1].assign(row=[np.sum(pdf["row"].tolist(), 0)])

    parts = rows.select("x").mapInArrow(each, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    out = np.zeros((size, size))
    for r in parts:
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Indices of eigenvalues in chains closer than ``near``, two or more in each."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(a: np.ndarray, steps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric matrix, falling, and unit eigenvectors (columns), to double precision."""
    size = float(np.abs(a).max(initial=0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    high = np.longdouble
    unit = (a / size).astype(high)
    x = np.linalg.eigh(unit.astype(np.float32))[1].astype(high)
    eye, tiny = np.eye(len(a), dtype=high), np.finfo(np.float64).eps
    scale = np.sqrt((unit * unit).sum())

    def measure():
        r, s = eye - x.T @ x, x.T @ (unit @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding must not turn a pair's two vectors by different angles
        values = np.diag(s) / (1 - np.diag(r))
        # eigenvalues closer than this aren't told apart by a step: the products are too rough yet, or the rounding of
        # these products over the difference would move the vectors by more than a step corrects
        open_yet = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + scale * np.sqrt((r * r).sum()))
        return r, s, values, max(open_yet, scale * np.sqrt(np.finfo(high).eps))

    last = np.inf
    for _ in range(steps):
        r, s, values, near = measure()
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        if np.sqrt((r * r).sum()) < 1e-9:  # the clusters' spaces are found: solve inside them
            for c in _clusters(values, near):
                mean = values[c].mean()
                inner = x[:, c].T @ (unit @ x[:, c] - mean * x[:, c])
                width = np.abs(inner).max()
                if width > 0:
                    x[:, c] = x[:, c] @ np.linalg.eigh(((inner + inner.T) / (2 * width)).astype(np.float64))[1].astype(high)
        # vectors of close eigenvalues stay as uncertain as the rounding of the products over their difference
        change, last = np.abs(e).max(), min(last, np.abs(e).max())
        if change < tiny or (change > last and np.abs(r).max() < 16 * tiny):
            break
    x = x + x @ ((eye - x.T @ x) / 2)
    values = measure()[2]
    order = np.argsort(-values, kind="stable")
    vectors = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return (values[order] * size).astype(np.float64), vectors.astype(np.float64)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each row of df that takes part and each component: id, component, n, deviation, whitened, explained,
    identity_error."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = df.select(F.col(id_col).alias("id"), whole(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    common = vectors.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    size = common["size"]
    vectors = vectors.where(F.size("x") == size)

    fit = materialise(vectors.select("x").distinct(), "whiten-fit")
    totals = fit.mapInArrow(_sums, "n long, at int, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    n, sums = totals[0]["n"], [int(t["total"]) for t in totals]
    covariance = _products(fit, lambda x: centred(x, n, sums), size) / n
    values, axes = eigen(covariance)
    trace, kept = float(np.trace(covariance)), min(components, size)
    flat = np.array([e <= size * np.finfo(np.float64).eps * max(trace, 0) for e in values[:kept]])
    by = np.where(flat, 0, 1 / np.sqrt(np.where(flat, 1, values[:kept])))
    project = axes[:, :kept] * by
    error = None
    if not flat.all():
        again = _products(fit, lambda x: centred(x, n, sums) @ project, kept) / n
        error = float(np.abs((again - np.eye(kept))[~flat][:, ~flat]).max())
    discard(fit)
    explained = [e / trace if trace > 0 else None for e in np.maximum(values[:kept], 0).tolist()]

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _blocks(batch, "x")
            y = centred(x, n, sums) @ project
            rows = np.repeat(np.arange(len(x)), kept)
            none = np.tile(flat, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array([n] * len(rows), pa.int64()),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                    pa.array(y.reshape(-1), mask=none),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * len(rows), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(each, schema)
