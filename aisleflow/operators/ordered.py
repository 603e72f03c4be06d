"""Ordered folds: stateful work over the rows of a key, in order, that holds one state rather than one group.

Rows are shuffled by key and sorted inside their partitions; a task then reads Arrow batches and keeps the state of the
key at hand alone, so a hot key costs time but no memory, and a lost task is repeated from the shuffle.

Where the state is empty after an idle gap, a key's unbroken stretches are keys of their own (``idle_segments``), so that a
hot key's history is folded by as many tasks as it has stretches; what counts on (numbers of tracks and people) is added
afterwards from the stretches' totals (``carried_totals``).

A machine is an object with ``step(rows, last)`` -> output rows, ``held()`` -> what it remembers (picklable) and
``resume(held)``; the same machines are folded here and in streams (streaming/ordered.py).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Callable[[pd.DataFrame, bool], pd.DataFrame]], schema: str) -> DataFrame:
    """``make(key)`` gives a function of (rows of that key that came next, whether they are its last) to output rows."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def parts(batch: pd.DataFrame):
        if not len(batch):
            return
        change = pd.Series(False, index=batch.index)
        for k in keys:
            now, before = batch[k], batch[k].shift()
            change |= ~((now == before) | (now.isna() & before.isna()))
        starts = [int(i) for i in change.to_numpy().nonzero()[0]]
        starts = starts if starts and starts[0] == 0 else [0, *starts]
        for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
            yield tuple(None if pd.isna(x) else x for x in batch[keys].iloc[lo]), batch.iloc[lo:hi]

    def run(batches):
        key, step, held = None, None, None
        for batch in batches:
            for k, part in parts(batch.reset_index(drop=True)):
                if held is not None:
                    yield step(held, k != key)
                if step is None or k != key:
                    key, step = k, make(k)
                held = part
        if held is not None:
            yield step(held, True)

    return rows.mapInPandas(run, schema)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> list:
    """Conditions that the columns are equal, nulls being values."""
    return [left[n].eqNullSafe(right[f"_r_{n}"]) for n in names]


def idle_segments(rows: DataFrame, keys: list[str], at: str, gap: float, span: float) -> DataFrame:
    """rows with ``_segment``: the value of ``at`` (not null) with which its unbroken stretch began. A stretch of a key ends
    where its next row is more than ``gap`` later.

    Chunks of ``span`` are looked at by themselves and meet as one row each, so no task holds a key's whole history.
    """
    own = W.partitionBy(*keys, "_chunk").orderBy(at)
    apart = F.col(at) - F.lag(at).over(own) > gap
    marked = rows.withColumn("_chunk", F.floor(F.col(at) / span)).withColumn("_starts", F.when(apart, F.col(at)))
    marked = marked.withColumn("_within", F.last("_starts", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    chunks = marked.groupBy(*keys, "_chunk").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("_starts").alias("late"))
    over = W.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("first", F.when(F.coalesce(F.col("lo") - F.lag("hi").over(over) > gap, F.lit(True)), F.col("lo")))
    before = F.last(F.coalesce("late", "first"), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    names = [*keys, "_chunk"]
    chunks = chunks.select(*[F.col(k).alias(f"_r_{k}") for k in names], F.coalesce("first", before).alias("_carry"))
    joined = marked.join(chunks, _same(marked, chunks, names))
    return joined.withColumn("_segment", F.coalesce("_within", "_carry")).select(*rows.columns, "_segment")


def carried_totals(folded: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """The rows of folded (those with an id) with ``_before_<total>``: the sum of what the key's earlier segments counted.
    A segment says its totals in one row without an id."""
    over = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    names = [*keys, "_segment"]
    sums = folded.where("id IS NULL").select(*[F.col(k).alias(f"_r_{k}") for k in names], *[F.coalesce(F.sum(t).over(over), F.lit(0)).alias(f"_before_{t}") for t in totals])
    rows = folded.where("id IS NOT NULL")
    return rows.join(sums, _same(rows, sums, names)).select(*folded.columns, *[f"_before_{t}" for t in totals])
