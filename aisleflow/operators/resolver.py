"""Identities across a store's cameras: enrolled employees by gallery, anyone else by the vectors seen lately."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.events import written
from .ordered import carried_totals, fold_in_order, idle_segments

INPUT = ["store_id", "camera_id", "track_id", "id", "role", "embedding", "ts"]
MADE = "store_id string, id long, name string, number long, employee_id string, confidence double, needs_review boolean"
#: Names of those who aren't enrolled, by whether they are staff.
KINDS = ("person", "employee-unknown")
#: Seconds that are looked at together when idle gaps are searched.
SPAN = 3600.0


def _similar(gallery: dict, vector: np.ndarray, k: int) -> list[tuple[float, str]]:
    """The k identities nearest to the vector; an identity is as near as its nearest vector, ties go to the smaller name."""
    return sorted(((float(max(v @ vector for v in vs)), name) for name, vs in gallery.items() if len(vs)), key=lambda s: (-s[0], s[1]))[:k]


#: The margin between the best two, and after how many observations a track is looked at again.
MARGIN, REVERIFY = 0.02, 30


class Resolver:
    """Identities of one store: who was seen lately, with their vectors, and the tracks bound to them."""

    COLUMNS = ["store_id", "id", "name", "number", "employee_id", "confidence", "needs_review"]

    def __init__(self, key: tuple, employees: dict[str, list], match: float, review: float, ttl: float, capacity: int, margin: float, reverify: int):
        self.key, self.enrolled = key, {n: [np.asarray(v, float) for v in vs[-capacity:]] for n, vs in employees.items()}
        self.match, self.review, self.ttl, self.capacity, self.margin, self.reverify = match, review, ttl, capacity, margin, reverify
        self.seen: dict[tuple, dict] = {}  # by name: role, employee, time
        self.recent: dict[tuple, deque] = {}  # by name: vectors
        self.bound: dict[str, dict] = {}  # by camera: track -> [name, observations]
        self.count = dict.fromkeys(KINDS, 0)
        self.frame: tuple = (None, None)  # camera and time of the frame at hand
        self.present: set = set()

    def held(self) -> tuple:
        return self.seen, self.recent, self.bound, self.count, self.frame, self.present

    def resume(self, held: tuple) -> None:
        self.seen, self.recent, self.bound, self.count, self.frame, self.present = held

    def _fresh(self, kind: str) -> tuple:
        self.count[kind] += 1
        return kind, self.count[kind]

    def _nearest(self, vector: np.ndarray, role: str) -> tuple:
        near = [(s, n) for s, n in _similar(self.recent, vector, 5) if n in self.seen and self.seen[n]["role"] == role]
        return near[0] if near else (-1.0, None)

    def _decide(self, role: str, vector: np.ndarray) -> tuple:
        """(name, employee, confidence, whether to review); a name is (employee, None) or (kind, number)."""
        if role == "employee":
            top = _similar(self.enrolled, vector, 2)
            best = top[0][0] if top else -1.0
            gap = best - (top[1][0] if len(top) > 1 else -1.0)
            if best >= self.review:
                return (top[0][1], None), top[0][1], best, not (best >= self.match and gap > self.margin)
        s, name = self._nearest(vector, role)
        known = s >= self.match
        return name if known else self._fresh(KINDS[role == "employee"]), None, s if known else 0.0, role == "employee"

    def _learn(self, name: tuple, vector: np.ndarray) -> None:
        have = self.recent.setdefault(name, deque(maxlen=self.capacity))
        if not have or max(float(v @ vector) for v in have) >= self.review:
            have.append(vector)

    def _turn(self, camera, ts: float) -> None:
        """A new frame: tracks that the last frame of a camera didn't show lose their binding, the long unseen are forgotten."""
        before, at = self.frame
        if before in self.bound:
            self.bound[before] = {t: b for t, b in self.bound[before].items() if t in self.present}
        self.frame, self.present = (camera, ts), set()
        if at != ts:
            late = {n for n, s in self.seen.items() if ts - s["ts"] > self.ttl}
            for n in late:
                self.seen.pop(n)
                self.recent.pop(n, None)
            if late:
                self.bound = {c: {t: b for t, b in own.items() if b[0] not in late} for c, own in self.bound.items()}

    def one(self, r) -> tuple | None:
        if self.frame != (r.camera_id, r.ts):
            self._turn(r.camera_id, r.ts)
        if r.track_id is None or r.track_id != r.track_id:
            return None  # a frame without people
        self.present.add(r.track_id)
        if r.embedding is None:
            return None
        vector, own = np.asarray(r.embedding, float), self.bound.setdefault(r.camera_id, {})
        role = "employee" if r.role == "employee" else "customer"
        old = own.get(r.track_id)
        if old:
            old[1] += 1
            if old[1] % self.reverify:
                self.seen[old[0]]["ts"] = r.ts
                self._learn(old[0], vector)
                return *old[0], self.seen[old[0]]["employee"], 1.0, False
        name, employee, confidence, doubt = self._decide(role, vector)
        if old and (doubt or confidence <= 0):
            self.seen[old[0]]["ts"] = r.ts
            return *old[0], self.seen[old[0]]["employee"], 1.0, False
        known = self.seen.setdefault(name, {"role": role, "employee": employee})
        known["ts"] = r.ts
        self._learn(name, vector)
        own[r.track_id] = [name, 1]
        return *name, employee, confidence, doubt

    def resolved(self, part: pd.DataFrame) -> list[tuple]:
        found = ((r, self.one(r)) for r in part.itertuples())
        return [(self.key[0], int(r.id), *f) for r, f in found if f is not None]

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        return pd.DataFrame(self.resolved(part), columns=self.COLUMNS).astype({"number": "Int64"})


class _Segment(Resolver):
    """The identities of one unbroken stretch, which says at its end how many names it gave."""

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = [(*r, None, None, self.key[1]) for r in self.resolved(part)]
        if last:
            out.append((self.key[0], *[None] * 6, *(self.count[k] for k in KINDS), self.key[1]))
        whole = dict.fromkeys(["id", "number", "people", "unknown"], "Int64")
        return pd.DataFrame(out, columns=[*self.COLUMNS, "people", "unknown", "_segment"]).astype(whole)


def named(rows: DataFrame, people=None, unknown=None) -> DataFrame:
    """The rows with global_id in place of name and number; ``people`` and ``unknown`` were named before."""
    zero = F.lit(0)
    earlier = F.when(F.col("name") == KINDS[0], zero if people is None else people).otherwise(zero if unknown is None else unknown)
    written_out = F.when(F.col("number").isNull(), F.col("name")).otherwise(F.format_string("%s-%04d", F.col("name"), F.col("number") + earlier))
    return rows.select("store_id", "id", written_out.alias("global_id"), "employee_id", "confidence", "needs_review")


def usable() -> Column:
    """Rows that count have a time, and an id unless they are of a frame without people."""
    return F.expr("ts IS NOT NULL AND (id IS NOT NULL OR track_id IS NULL)")


def resolve(tracks: DataFrame, employees: dict[str, list[list[float]]], match: float = 0.9, review: float = 0.75, ttl: float = 20.0, capacity: int = 20, margin: float = MARGIN, reverify: int = REVERIFY) -> DataFrame:
    """Global ids of observations (store_id, camera_id, track_id, id, role, embedding, ts), each store by itself in the
    order of ts, camera, track. ``employees`` is the enrolled gallery, at most ``capacity`` vectors each (the last ones):
    its size is that of a store's staff, not of the data.

    A track keeps its identity; each ``reverify``-th observation looks again and changes it only on a sure answer. A track
    that one frame of its camera (the rows of one ts) doesn't show is released, and resolved anew when it comes again; rows
    without a track are frames without people, rows without an embedding show their track and resolve to nobody.
    Identities unseen for more than ``ttl`` seconds are forgotten, with their vectors and bindings, so that the state is
    the people of the last ``ttl`` seconds; a store's stretches between longer gaps are folded in parallel, and its people
    are numbered on from stretch to stretch. Rows without a ts, or with a track but no id, are left
    out.
    """
    rows = tracks.where(usable()).withColumn("id", F.coalesce("id", F.lit(-1))).select(*INPUT)
    cut = idle_segments(rows, ["store_id"], "ts", ttl, SPAN)
    make = lambda key: _Segment(key, employees, match, review, ttl, capacity, margin, reverify).step
    folded = fold_in_order(cut, ["store_id", "_segment"], ["ts", "camera_id", "track_id", "id"], make, f"{MADE}, people long, unknown long, _segment double")
    numbered = carried_totals(written(folded, "identities"), ["store_id"], ["people", "unknown"])
    return named(numbered, F.col("_before_people"), F.col("_before_unknown"))
