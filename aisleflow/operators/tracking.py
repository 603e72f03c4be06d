"""Boxes over time: suppression of overlapping detections, assignment, and tracks of a camera."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iou
from ..sources.events import written
from .ordered import carried_totals, idle_segments

CAMERA = ["store_id", "camera_id"]
TRACKS = "store_id string, camera_id string, frame long, id long, track_id long, hits long, age long"


def suppress(detections: DataFrame, frame: list[str], least: float = 0.4, overlap: float = 0.5) -> DataFrame:
    """Greedy suppression in each frame: by falling confidence (ties: smaller id), a box stays unless one that stayed
    overlaps it by more than ``overlap``; boxes below ``least`` confidence go. A group is one frame's detections."""
    e = F.struct((-F.col("confidence")).alias("c"), "id", "box")

    def keep(kept: Column, d: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k["box"], d["box"]) > overlap), kept).otherwise(F.array_append(kept, d))

    boxes = detections.where(F.col("confidence") >= least).groupBy(*frame).agg(F.array_sort(F.collect_list(e)).alias("ds"))
    return boxes.select(*frame, F.explode(F.aggregate(F.slice("ds", 2, F.size("ds")), F.slice("ds", 1, 1), keep)).alias("d")).select(*frame, "d.id", (-F.col("d.c")).alias("confidence"), "d.box")


def best_pairs(edges: list[list[tuple[int, float]]], columns: int) -> list[tuple[int, int]]:
    """The (column, row) of the highest total gain, each once, of rows given as [(column, gain over 0), ...] by column.
    Shortest augmenting paths, row by row, over what gains alone: a row may stay without a column."""
    price, owner, worth = [0.0] * columns, [-1] * columns, [0.0] * len(edges)
    for start, own in enumerate(edges):
        least, at = 0.0, -1
        for c, g in own:
            d = -g - price[c]
            if d < least:
                least, at = d, c
        if at < 0:
            continue
        if owner[at] < 0:
            owner[at], worth[start] = start, least
            continue
        # a shorter way may lead through rows that give up their columns, the last of which takes a free one or none
        dist, via, done, heap = {}, {}, {}, []
        row, at, level, end, last = start, -1, 0.0, 0.0, -1
        while True:
            own = worth[row]
            if level - own < end:
                end, last = level - own, at
            for c, g in edges[row]:
                d = level - g - own - price[c]
                if d < end and c not in done and d < dist.get(c, end):
                    dist[c], via[c] = d, at
                    heappush(heap, (d, c))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= end:
                level, at = end, last
                break
            level, at = heappop(heap)
            if owner[at] < 0:
                break
            done[at] = level
            row = owner[at]
        worth[start] += level
        for c, d in done.items():
            price[c] += d - level
            worth[owner[c]] += level - d
        while at >= 0:
            before = via[at]
            owner[at] = start if before < 0 else owner[before]
            at = before
    return [(c, r) for c, r in enumerate(owner) if r >= 0]


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the highest total gain, each row and column once: shortest augmenting paths."""
    flipped = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flipped else gain)
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, level = start, -1, 0.0
        seen = [start]
        while True:
            slack = level + cost[row] - row_price[row] - col_price
            better = ~done & (slack < dist)
            dist[better], via[better] = slack[better], at
            at = int(np.argmin(np.where(done, np.inf, dist)))
            level = dist[at]
            done[at] = True
            if owner[at] < 0:
                break
            row = int(owner[at])
            seen.append(row)
        for r in seen:
            row_price[r] += level - (0.0 if r == start else dist[np.flatnonzero(owner == r)[0]])
        col_price[done] += dist[done] - level
        while at >= 0:
            before = int(via[at])
            owner[at] = start if before < 0 else owner[before]
            at = before
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(hi - lo, 0, None).prod(-1)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return both / np.clip(size(a)[:, None] + size(b)[None, :] - both, 1e-9, None)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Motion:
    """Constant-velocity filters of many tracks at once. The state is (cx, cy, area, aspect and the velocities of the first
    three). No noise is shared between these four, so the covariance falls into a block of place and velocity for each of
    three, and the aspect's: (place, place), (place, velocity), (velocity, place), (velocity, velocity), three rows each."""

    #: Noise of measurement, of motion, and of a new track.
    SEEN = np.array([1.0, 1.0, 10.0, 10.0])[:, None]
    DRIFT = np.array([0.01, 0.01, 0.0001])[:, None]
    START = np.array([10.0] * 3 + [0.0] * 6 + [1e4] * 3 + [10.0])[:, None]

    def __init__(self):
        self.x, self.p = np.zeros((7, 0)), np.zeros((13, 0))

    @staticmethod
    def measure(b: np.ndarray) -> np.ndarray:
        w, h = np.maximum(b[:, 2] - b[:, 0], 1e-6), np.maximum(b[:, 3] - b[:, 1], 1e-6)
        return np.stack([b[:, 0] + w / 2, b[:, 1] + h / 2, w * h, w / h])

    def predict(self) -> np.ndarray:
        """The boxes (x1, y1, x2, y2; a row for each of the four) where the tracks are next."""
        x, p = self.x, self.p
        x[6, x[2] + x[6] <= 0] = 0.0
        x[:3] += x[4:]
        p[3:6] += p[9:12]
        p[:3] += p[6:9]
        p[:3] += p[3:6]
        p[:3] += 1.0
        p[6:9] += p[9:12]
        p[9:12] += self.DRIFT
        p[12] += 1.0
        w = np.sqrt(np.maximum(x[2] * x[3], 1e-6))
        h = x[2] / np.maximum(w, 1e-6)
        return np.stack([x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2])

    def correct(self, who: np.ndarray, boxes: np.ndarray) -> None:
        x, p = self.x[:, who], self.p[:, who]
        place, own = p[:3].copy(), p[3:6].copy()
        part = 1 / (p[[0, 1, 2, 12]] + self.SEEN)
        gain, speed, aspect = place * part[:3], p[6:9] * part[:3], p[12] * part[3]
        off = self.measure(boxes) - x[:4]
        x[:3] += gain * off[:3]
        x[3] += aspect * off[3]
        x[4:] += speed * off[:3]
        p[:3] -= gain * place
        p[3:6] -= gain * own
        p[6:9] -= speed * place
        p[9:12] -= speed * own
        p[12] -= aspect * p[12]
        self.x[:, who], self.p[:, who] = x, p

    def add(self, boxes: np.ndarray) -> None:
        self.x = np.concatenate([self.x, np.pad(self.measure(boxes), ((0, 3), (0, 0)))], 1)
        self.p = np.concatenate([self.p, np.repeat(self.START, len(boxes), 1)], 1)

    def keep(self, which: np.ndarray) -> None:
        self.x, self.p = self.x[:, which], self.p[:, which]


#: What a stretch remembers between frames: filters (x, p), (track, hits, age, frames missed) of its live tracks in the order
#: in which they began, its newest frame, and how many tracks it has begun.
State = tuple[np.ndarray, np.ndarray, np.ndarray, int, int]
FRESH: State = (np.zeros((7, 0)), np.zeros((13, 0)), np.zeros((4, 0), np.int64), -1, 0)
#: Rows and pairs of a box and a track that are looked at together.
ROWS, PAIRS = 1 << 17, 1 << 21


class Tracks:
    """The live tracks of many stretches, each of which goes on by a frame at a time, all of them together."""

    def __init__(self, states: list[State], max_age: int, min_hits: int, overlap: float):
        self.max_age, self.min_hits, self.overlap = max_age, min_hits, overlap
        self.motion = Motion()
        self.motion.x, self.motion.p, self.live = (np.concatenate([s[k] for s in states], 1) for k in range(3))
        self.lane = np.repeat(np.arange(len(states)), [s[2].shape[1] for s in states])
        self.frame, self.created = (np.array([s[k] for s in states], np.int64) for k in (3, 4))

    def _keep(self, which: np.ndarray) -> None:
        self.motion.keep(which)
        self.live, self.lane = self.live[:, which], self.lane[which]

    def fold(self, lane: np.ndarray, frame: np.ndarray, ids: np.ndarray, boxes: np.ndarray, remembered: int = -1) -> tuple[np.ndarray, State | None]:
        """What is reported of rows by lane, frame and id: (lane, frame, id, track, hits, age), a row for each of these, and
        how the lane that is ``remembered`` goes on. Rows of one frame and id are taken by their boxes, in whatever order they come."""
        if np.any((lane[1:] == lane[:-1]) & (frame[1:] == frame[:-1]) & (ids[1:] == ids[:-1])):
            order = np.lexsort((*boxes.T[::-1], ids, frame, lane))
            lane, frame, ids, boxes = lane[order], frame[order], ids[order], boxes[order]
        new = np.flatnonzero(np.concatenate([[True], (lane[1:] != lane[:-1]) | (frame[1:] != frame[:-1])])) if len(lane) else np.empty(0, int)
        begins, sizes, frames = new, np.diff(np.append(new, len(lane))), frame[new]
        todo, stop = (np.searchsorted(lane[new], np.arange(len(self.frame)), side) for side in ("left", "right"))
        out, state = [np.empty((6, 0), np.int64)], None

        def recall(lane_: int) -> State:
            own = self.lane == lane_
            return self.motion.x[:, own], self.motion.p[:, own], self.live[:, own], int(self.frame[lane_]), int(self.created[lane_])

        while True:
            busy = todo < stop
            if remembered >= 0 and state is None and not busy[remembered]:
                state = recall(remembered)
            if not busy.any():
                return np.concatenate(out, 1), state
            if not busy.all():
                self._keep(busy[self.lane])
            at = np.flatnonzero(busy)
            following = frames[todo[at]]
            # frames without a row count as frames without detections, and change nothing where no track is left
            alive = np.bincount(self.lane, minlength=len(busy))[at] > 0
            self.frame[at] = np.where(alive, np.minimum(self.frame[at] + 1, following), following)
            at = at[self.frame[at] == following]
            self._advance(_spread(begins[todo[at]], sizes[todo[at]]), np.repeat(at, sizes[todo[at]]), ids, boxes, out)
            todo[at] += 1

    def _advance(self, rows: np.ndarray, lane: np.ndarray, ids: np.ndarray, boxes: np.ndarray, out: list) -> None:
        """A frame of each stretch, with the rows that it has (``lane`` is their stretch)."""
        motion, live = self.motion, self.live
        where = motion.predict()
        live[2:] += 1
        ids, boxes = ids[rows], boxes[rows]
        given, new = np.full(live.shape[1], -1, np.int64), np.ones(len(rows), bool)
        if len(rows) and live.shape[1]:
            seen, hit = self._matched(lane, boxes, where)
            motion.correct(hit, boxes[seen])
            live[1, hit] += 1
            live[3, hit] = 0
            given[hit], new[seen] = ids[seen], False
        if new.any():
            begun = lane[new]
            motion.add(boxes[new])
            nth = np.arange(len(begun)) - np.searchsorted(begun, begun) + 1
            none = np.zeros(len(begun), np.int64)
            live = np.concatenate([live, np.stack([self.created[begun] + nth, none + 1, none, none])], 1)
            given, self.lane = np.concatenate([given, ids[new]]), np.concatenate([self.lane, begun])
            self.created += np.bincount(begun, minlength=len(self.created))
        self.live = live
        told = np.flatnonzero((live[3] == 0) & ((live[1] >= self.min_hits) | (self.frame[self.lane] < self.min_hits)))
        out.append(np.concatenate([np.stack([self.lane[told], self.frame[self.lane[told]], given[told]]), live[:3, told]]))
        stay = live[3] <= self.max_age
        if not stay.all():
            self._keep(stay)

    def _matched(self, lane: np.ndarray, boxes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes (by lane) and the tracks that they are assigned to."""
        # tracks that lie in the span of their stretch's boxes, by stretch
        first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        span = np.full((4, len(self.frame)), np.nan)
        for k, least in enumerate((np.fmin, np.fmin, np.fmax, np.fmax)):
            span[k, lane[first]] = least.reduceat(boxes[:, k], first)
        own = span[:, self.lane]
        near = np.flatnonzero((where[0] < own[2]) & (where[2] > own[0]) & (where[1] < own[3]) & (where[3] > own[1]))
        near = near[np.argsort(self.lane[near], kind="stable")]
        bounds = np.searchsorted(self.lane[near], np.arange(len(self.frame) + 1))
        # pairs (box, track among the near ones) that overlap, and by how much
        size, parts, many = np.diff(bounds)[lane], [], 0
        ends = np.cumsum(size)
        while many < len(lane):
            upto = max(many + 1, int(np.searchsorted(ends, (ends[many - 1] if many else 0) + PAIRS, "right")))
            d, t = np.repeat(np.arange(many, upto), size[many:upto]), _spread(bounds[lane[many:upto]], size[many:upto])
            for low, high in ((0, 2), (1, 3)):
                both = (boxes[d, low] < where[high][near[t]]) & (boxes[d, high] > where[low][near[t]])
                d, t = d[both], t[both]
            a, b = boxes[d].T, where[:, near[t]]
            inner = (np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * (np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
            over = inner / np.maximum((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner, 1e-9)
            parts.append((d[over > 0], t[over > 0], over[over > 0]))
            many = upto
        d, t, over = (np.concatenate([p[k] for p in parts]) for k in range(3))
        if not len(d):
            return d, t
        # rows are what a stretch has less of: boxes, or tracks that meet one
        own = lane[d]
        met = np.zeros(len(near), bool)
        met[t] = True
        flipped = (np.bincount(lane, minlength=len(self.frame)) > np.bincount(self.lane[near[met]], minlength=len(self.frame)))[own]
        begin = np.searchsorted(lane, own)
        row, column = np.where(flipped, t - bounds[own], d - begin), np.where(flipped, d - begin, t - bounds[own])
        order = np.lexsort((column, row, own))
        d, t, over, own, row, column = (x[order] for x in (d, t, over, own, row, column))
        group = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
        lanes = np.flatnonzero(np.concatenate([[True], own[group][1:] != own[group][:-1]]))
        # equal gains of one box or of one track may make several ways the best
        equal, rank = np.zeros(len(self.frame), bool), np.lexsort((over, own))
        one, two = rank[1:], rank[:-1]
        equal[own[one][(own[one] == own[two]) & (over[one] - over[two] < 1e-12) & ((d[one] == d[two]) | (t[one] == t[two]))]] = True
        edges, cuts, places = list(zip(column.tolist(), over.tolist(), strict=True)), np.append(group, len(own)).tolist(), (np.maximum.reduceat(column, group[lanes]) + 1).tolist()
        chosen, which, tied = [], [], []
        for lo, hi, n, ties in zip(lanes.tolist(), [*lanes[1:].tolist(), len(group)], places, equal[own[group[lanes]]].tolist(), strict=True):
            rows_ = [edges[a:b] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)]
            pairs = best_pairs(rows_, n)
            if ties:  # were there another way as good, it would be the better one if these pairs gained a little less
                taken = set(pairs)
                ties = best_pairs([[(c, g - 1e-9 if (c, r) in taken else g) for c, g in row_] for r, row_ in enumerate(rows_)], n) != pairs
            if ties:  # with all pairs, gains or not, whose order says which way is taken
                k, begin = slice(cuts[lo], cuts[hi]), int(np.searchsorted(lane, own[cuts[lo]]))
                tracks, place = np.unique(t[k], return_inverse=True)
                gain = np.zeros((np.searchsorted(lane, own[cuts[lo]], "right") - begin, len(tracks)))
                gain[d[k] - begin, place] = over[k]
                among = set(assign(gain))
                tied += [cuts[lo] + i for i, pair in enumerate(zip((d[k] - begin).tolist(), place.tolist(), strict=True)) if pair in among]
                continue
            for c, r in pairs:
                chosen.append(lo + r), which.append(c)
        wide = int(column.max()) + 1
        at = np.searchsorted(np.repeat(np.arange(len(group)), np.diff(cuts)) * wide + column, np.array(chosen, np.int64) * wide + np.array(which, np.int64))
        at = np.concatenate([at, np.array(tied, np.int64)])
        at = at[over[at] >= self.overlap]
        return d[at], near[t[at]]


class Tracker:
    """The live tracks of one camera, frame after frame."""

    COLUMNS = ["store_id", "camera_id", "frame", "id", "track_id", "hits", "age"]

    def __init__(self, key: tuple, max_age: int = 15, min_hits: int = 2, overlap: float = 0.3):
        self.key, self.limits, self.state = key, (max_age, min_hits, overlap), FRESH
        self.open: list[pd.DataFrame] = []

    def held(self) -> State:
        return self.state

    def resume(self, held: State) -> None:
        self.state = held

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        """What is reported of the rows' frames; of the newest one only if nothing more of it can come (``last``)."""
        rows = pd.concat([*self.open, part]) if self.open else part
        self.open = []
        if not last:  # a frame may go on in the next batch
            newest = rows["frame"] == rows["frame"].iloc[-1]
            self.open = [rows[newest]]
            rows = rows[~newest]
        frame, ids = rows["frame"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
        # no track outlives an idle gap: the stretches between such go on together, and number their tracks on afterwards
        lane = np.cumsum(np.diff(frame, prepend=frame[:1]) > self.limits[0] + 1)
        newest = int(lane[-1]) if len(lane) else 0
        folded = Tracks([self.state, *[FRESH] * newest], *self.limits)
        out, (x, p, live, at, created) = folded.fold(lane, frame, ids, rows[["x1", "y1", "x2", "y2"]].to_numpy(float), newest)
        before = np.cumsum(folded.created) - folded.created
        out[3] += before[out[0]]
        live[0] += before[newest]
        self.state = x, p, live, at, created + int(before[newest])
        return pd.DataFrame({"store_id": self.key[0], "camera_id": self.key[1], **dict(zip(self.COLUMNS[2:], out[1:], strict=True))}, columns=self.COLUMNS, index=range(out.shape[1]))


def _stretches(max_age: int, min_hits: int, overlap: float):
    """Tracks of stretches whose rows come one stretch after the other, and how many each began (a row without an id). Whole
    stretches of about ROWS rows are folded together; one that goes on in the next rows is remembered by its state."""

    def folded(rows: pa.Table, state: State, last: bool) -> tuple[pa.RecordBatch, pa.Table, State]:
        keys = [rows["store_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), rows["camera_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), rows["_segment"].to_numpy()]
        frame = rows["frame"].to_numpy().astype(np.int64)
        change = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)])
        lane, upto, goes_on = np.cumsum(change) - 1, len(rows), -1
        if not last:  # the newest frame may go on in the next batch, and its stretch does
            upto = int(np.flatnonzero(change | np.concatenate([[True], frame[1:] != frame[:-1]]))[-1])
            goes_on = int(lane[upto])
        starts = np.flatnonzero(change)
        work = Tracks([state, *[FRESH] * (len(starts) - 1)], max_age, min_hits, overlap)
        boxes = np.stack([np.asarray(rows[c].to_numpy(), float) for c in ("x1", "y1", "x2", "y2")], 1)
        out, state_ = work.fold(lane[:upto], frame[:upto], rows["id"].to_numpy().astype(np.int64)[:upto], boxes[:upto], goes_on)
        ended = np.setdiff1d(np.arange(len(starts)), goes_on)
        whole = lambda a, n: pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64())])
        key = rows.select(["store_id", "camera_id", "_segment"]).take(pa.array(starts[np.concatenate([out[0], ended])])).combine_chunks()
        begun = pa.concat_arrays([pa.nulls(out.shape[1], pa.int64()), pa.array(work.created[ended], pa.int64())])
        columns = [*(key[c].combine_chunks() for c in ("store_id", "camera_id")), *(whole(x, len(ended)) for x in out[1:]), begun, key["_segment"].combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, [*Tracker.COLUMNS, "begun", "_segment"]), rows.slice(upto), FRESH if state_ is None else state_

    def each(batches):
        held, n, state = [], 0, FRESH
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += len(batch)
            if n >= ROWS:
                out, rest, state = folded(pa.concat_tables(held), state, False)
                held, n = [rest], 0
                yield out
        rows = pa.concat_tables(held) if held else None
        if rows is not None and len(rows):
            yield folded(rows, state, True)[0]

    return each


INPUT = ["store_id", "camera_id", "frame", "id", "x1", "y1", "x2", "y2"]
#: Frames that are looked at together when idle gaps are searched.
CHUNK = 4096


def track(detections: DataFrame, max_age: int = 15, min_hits: int = 2, overlap: float = 0.3) -> DataFrame:
    """Track ids of detections (store_id, camera_id, frame, id, x1, y1, x2, y2), each camera by itself.

    Each frame: tracks move on, detections are assigned to them by the highest total overlap, pairs below ``overlap``
    are undone, detections left over begin tracks, tracks unseen for more than ``max_age`` frames end. Reported are
    tracks seen in the frame that have ``min_hits`` hits (or any in the first ``min_hits`` frames, frame 0 being the
    first). Frames without a row count as frames without detections. State is the live tracks alone.

    No track outlives ``max_age`` + 1 frames without a detection, so a camera's stretches between such gaps are folded in
    parallel, many of them by one task frame by frame together, and its tracks are numbered on from stretch to stretch. A box
    without one of its sides overlaps nothing. Rows without a frame or an id are left out.
    """
    rows = detections.select(*INPUT).where("frame IS NOT NULL AND id IS NOT NULL")
    cut = idle_segments(rows, CAMERA, "frame", max_age + 1, CHUNK)
    keys = [*CAMERA, "_segment"]
    folded = cut.repartition(*keys).sortWithinPartitions(*keys, "frame", "id").mapInArrow(_stretches(max_age, min_hits, overlap), f"{TRACKS}, begun long, _segment long")
    numbered = carried_totals(written(folded, "tracks"), CAMERA, ["begun"])
    return numbered.select("store_id", "camera_id", "frame", "id", (F.col("track_id") + F.col("_before_begun")).alias("track_id"), "hits", "age")
