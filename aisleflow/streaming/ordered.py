"""Ordered folds over streams: rows that come in any order, within the watermark's delay, are worked on in order.

Each key keeps the rows that the watermark hasn't passed, and the state of its machine (the same kind of object that
operators/ordered.py folds in batch). When the watermark passes rows, by new data or by an event-time timer set for the
earliest row that waits, they are taken in order and go. So a row is worked on once, after all that belong before it; a row
that comes later than the delay is dropped by Spark. State is what the machine remembers and the rows of the delay; it lives
in the query's checkpoint. Rows wait in pieces of a few slices of event time, and a machine is given about HELD rows of such at
a time, as every piece costs calls to the state store and every step costs the machine's own. Many small keys share
a key of their own (``slots``), for the same reason. A machine with a method ``idle_from()`` says from which time on (in microseconds) what it remembers
makes no difference; when the watermark passes that, the key's state goes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of event time that are never parted, and rows that are held before they are put to wait or worked on.
SLICE, HELD = 3_600_000_000, 100_000
#: Slices wait together while they have no more than this part of HELD rows.
PIECES = 16
#: Keys that many small keys are dealt to, whose few rows wait by the day.
SLOTS, DAY = 256, 24 * SLICE


def slots(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def _packed(keys: list[str]):
    """A row for each key of about HELD rows: the key, and its rows that count, pickled."""

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        rows = rows.filter(rows["at_us"].is_valid())
        if not len(rows):
            return
        codes = [rows[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
        order = np.lexsort(codes)
        rows = rows.take(pa.array(order))
        begins = np.flatnonzero(np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in codes], 0)]))
        own = rows.drop_columns(keys).to_pandas()
        many = [pickle.dumps(own.iloc[lo:hi]) for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(rows[k].take(pa.array(begins)).combine_chunks() for k in keys), pa.array(many, pa.binary())], [*keys, "packed"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    return each


class _Ordered(StatefulProcessor):
    def __init__(self, make: Callable[[tuple], Any], order: list[str], span: int | None = None, packed: bool = False):
        self.make, self.order, self.span, self.packed = make, order, span or SLICE, packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, n long, first long, size long", "rows binary")
        self.machine = handle.getValueState("machine", "held binary")
        if self.packed:
            self.passed = handle.getValueState("passed", "ms long")

    def _in_time(self, packs: Iterator[pd.DataFrame], passed: int) -> Iterator[pd.DataFrame]:
        """The rows of packs, without those that come after what is later than they was worked on."""
        since = self.passed.get()[0] if self.passed.exists() else -1
        for own in (pickle.loads(x) for part in packs for x in part["packed"]):
            yield own[own["at_us"] // 1000 > since]
        self.passed.update((max(passed, since),))

    def _wait(self, rows: Iterator[pd.DataFrame], held: set[tuple]) -> None:
        """Rows into pieces, each of some slices; held: the keys of what waits."""
        n, kept, size = max((k[1] for k in held), default=0), [], 0

        def flush() -> None:
            nonlocal n, kept, size
            if not size:
                return
            own = pd.concat(kept, ignore_index=True)
            own = own.take(np.argsort(own["at_us"].to_numpy(), kind="stable"))
            at = own["at_us"].to_numpy()
            begins = np.flatnonzero(np.diff(at // self.span, prepend=at[0] // self.span - 1))
            cuts = [0]
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
                if lo > cuts[-1] and hi - cuts[-1] > HELD // PIECES:
                    cuts.append(lo)
            for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
                n += 1
                key = int(at[lo]) // self.span, n, int(at[lo]), hi - lo
                held.add(key)
                self.waiting.updateValue(key, (pickle.dumps(own.iloc[lo:hi]),))
            kept, size = [], 0

        for part in rows:
            kept.append(part)
            size += len(part)
            if size >= HELD:
                flush()
        flush()

    def _ready(self, passed: int, held: set[tuple]) -> Iterator[pd.DataFrame]:
        """The rows that the watermark has passed, in order of time, about HELD at a time; the others of their pieces wait on."""
        due, at, left = sorted(k for k in held if k[2] // 1000 <= passed), 0, []
        while at < len(due):
            size = 0
            while at < len(due):
                upto = next((k for k in range(at, len(due)) if due[k][0] > due[at][0]), len(due))
                more = sum(k[3] for k in due[at:upto])
                if size and size + more > HELD:
                    break
                for k in due[at:upto]:
                    left.append(pickle.loads(self.waiting.getValue(k)[0]))
                    self.waiting.removeKey(k)
                    held.remove(k)
                size, at = size + more, upto
            rows = pd.concat(left, ignore_index=True)
            now = rows["at_us"] // 1000 <= passed
            if at < len(due):
                now &= rows["at_us"] // self.span < due[at][0]
            left = [rows[~now]]
            yield rows[now].sort_values(["at_us", *self.order], kind="stable").drop(columns="at_us")
        self._wait(iter(left), held)

    def _release(self, key: tuple, passed: int, fresh: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {tuple(k) for k in self.waiting.keys()}
        self._wait(fresh, held)
        if not held:
            self._forget(key, passed)
            return
        machine, out = None, None
        for now in self._ready(passed, held):
            if machine is None:
                machine = self.make(key)
                if self.machine.exists():
                    machine.resume(pickle.loads(self.machine.get()[0]))
            made = machine.step(now, True)
            if out is not None and len(out) and not getattr(machine, "snapshots", False):
                yield out
            out = made
        if held:
            first = min(k[2] for k in held) // 1000
            if first not in set(self.handle.listTimers()):
                self.handle.registerTimer(first)
        if machine is None:
            return
        self.machine.update((pickle.dumps(machine.held()),))
        if hasattr(machine, "idle_from"):
            self.handle.registerTimer(int(machine.idle_from() // 1000) + 1)
        if len(out):
            yield out

    def _forget(self, key: tuple, passed: int) -> None:
        """Drop the key's state if the watermark has passed the time from which on it makes no difference."""
        if self.machine.exists():
            machine = self.make(key)
            if hasattr(machine, "idle_from"):
                machine.resume(pickle.loads(self.machine.get()[0]))
                if machine.idle_from() // 1000 < passed:
                    self.machine.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # what this batch brings counts only when the watermark has passed it
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = self._in_time(rows, passed) if self.packed else (r[r["at_us"].notna()].astype({"at_us": "int64"}) for r in rows)
        yield from self._release(key, passed, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        yield from self._release(key, passed, self._in_time(iter(()), passed) if self.packed else iter(()))


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Any], schema: str, counts: Column | None = None, event_time: str = "event_time", span: int = SLICE, packed: bool = False) -> DataFrame:
    """What the keys' machines give for the rows of a stream with a watermark on ``event_time``, worked on by that time,
    then by ``order``. Rows for which ``counts`` isn't true move the watermark and nothing else (a filter would be pushed
    below the watermark, which then wouldn't see them). ``span``: the microseconds of a slice of waiting rows.

    ``packed``, for keys of many rows: these travel packed, as Spark hands rows to a processor one at a time. A machine sees
    neither the keys nor the event time then; a row is late, and dropped, where its key's state has passed its time."""
    # timers need a store that knows them
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = F.unix_micros(event_time)
    # names that begin with an underscore do not reach a processor
    timed = rows.withColumn("at_us", at if counts is None else F.when(counts, at))
    if packed:
        timed = timed.drop(event_time).mapInArrow(_packed(keys), StructType([*(timed.schema[k] for k in keys), StructField("packed", BinaryType())]))
    return timed.groupBy(*keys).transformWithStateInPandas(_Ordered(make, order, span, packed), schema, "append", "EventTime")
