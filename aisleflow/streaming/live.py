"""The live engine on streams: zone events, tracks, identities, kept events and cameras' health as they happen. Each equals its batch form on the rows that
the watermark has passed, whatever the cuts into micro-batches and the order of rows within the delay."""

from __future__ import annotations

from collections import OrderedDict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edges_contain, polygon_edges, round_half_away as rnd
from ..operators import events as E
from ..operators import resolver as R
from ..operators import tracking as T
from .ordered import DAY, fold_stream, slots

STEPS = "store_id string, camera_id string, global_id string, zone string, kind string, step string, ts double, role string, employee_id string, confidence double, needs_review boolean, frames int, dwell_s double"


class ZoneMachine:
    """The people before one camera and where they are; frame after frame."""

    COLUMNS = [c.split()[0] for c in STEPS.split(", ")]

    def __init__(self, key: tuple, gap: float, enter: int, leave: int, interact: int):
        self.key, self.gap, self.enter, self.leave, self.interact = key, gap, enter, leave, interact
        #: person -> [last seen, identity, zone -> [kind, run inside, run outside, since, acted]], the longest unseen first
        self.people: OrderedDict[str, list] = OrderedDict()

    def held(self) -> list:
        return list(self.people.items())

    def resume(self, held: list) -> None:
        self.people = OrderedDict(held)

    def _see(self, r, out: list) -> None:
        person = self.people.setdefault(r.global_id, [r.ts, None, {}])
        person[0], person[1] = r.ts, (r.role, r.employee_id, r.confidence, r.needs_review)
        self.people.move_to_end(r.global_id)
        for z in r.zones:
            say = lambda step, frames=None, dwell=None: out.append((*self.key, r.global_id, z["zone"], z["kind"], step, r.ts, *person[1], frames, dwell))  # noqa: B023, E731
            at = person[2].setdefault(z["zone"], [z["kind"], 0, 0, None, False])
            if z["inside"]:
                at[1], at[2] = at[1] + 1, 0
                if at[3] is None and at[1] >= self.enter:
                    at[3], at[4] = r.ts, False
                    say("enter")
                if at[3] is not None and z["kind"] == "shelf" and not at[4] and at[1] >= self.interact:
                    at[4] = True
                    say("interaction", frames=at[1])
            else:
                at[1], at[2] = 0, at[2] + 1
                if at[3] is not None and at[2] >= self.leave:
                    say("exit", dwell=r.ts - at[3])
                    at[3] = None

    def _close(self, ts: float, out: list) -> None:
        """People unseen for more than the gap leave the zones they are in, at the time of the frame that shows it."""
        while self.people:
            who, (seen, identity, zones) = next(iter(self.people.items()))
            if not ts > seen + self.gap:
                break
            self.people.popitem(last=False)
            out.extend((*self.key, who, zone, kind, "exit", ts, *identity, None, ts - since) for zone, (kind, _, _, since, _) in zones.items() if since is not None)

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        out: list = []
        before = None
        for r in part.itertuples():
            if before is not None and r.ts != before:
                self._close(before, out)
            before = r.ts
            if r.global_id is not None:  # else a frame without people, which moves the camera's clock alone
                self._see(r, out)
        if before is not None:
            self._close(before, out)
        return pd.DataFrame(out, columns=self.COLUMNS).astype({"frames": "Int64"})


def zone_events(obs: DataFrame, zones: DataFrame, gap: float, enter: int = 2, leave: int = 4, interact: int = 6, min_dwell: float = 1.0) -> DataFrame:
    """operators.events.zone_events on a stream with a watermark on ``event_time``: the same input, rows, names and payloads.
    A visit is also closed by a frame without people, a row without a global_id. Rows without a store, camera or ts are left
    out; a camera without zones gives nothing."""
    z = F.struct("zone", "kind", polygon_edges(F.col("polygon")).alias("edges"))
    of = zones.groupBy(*E.CAMERA).agg(F.array_sort(F.collect_list(z)).alias("zs"))
    placed = obs.join(of, E.CAMERA, "left")
    inside = F.transform("zs", lambda z: F.struct(z["zone"].alias("zone"), z["kind"].alias("kind"), F.coalesce(edges_contain(z["edges"], F.col("x"), F.col("y")), F.lit(False)).alias("inside")))
    rows = placed.select(*E.CAMERA, "global_id", "event_id", "ts", "event_time", *E.IDENTITY, inside.alias("zones"))
    steps = fold_stream(rows, E.CAMERA, ["event_id"], lambda key: ZoneMachine(key, gap, enter, leave, interact), STEPS, F.expr("ts IS NOT NULL AND zones IS NOT NULL"))
    kind, dwell = F.col("kind"), F.round("dwell_s", 3)
    name = F.when(F.col("step") == "enter", E.entered(kind)).when(F.col("step") == "interaction", "product_interaction").otherwise(E.left(kind))
    body = E.payload(zone_kind=kind, needs_review=F.col("needs_review"), frames=F.col("frames"), dwell_seconds=dwell)
    names = F.array(name, F.when(F.col("dwell_s") >= min_dwell, F.lit("dwell")))
    return steps.select("*", body.alias("payload"), F.explode(F.array_compact(names)).alias("event_type")).select(*E.EVENT)


def tracks(detections: DataFrame, max_age: int = 15, min_hits: int = 2, overlap: float = 0.3) -> DataFrame:
    """operators.tracking.track on a stream with a watermark on ``event_time``, which is the same for the rows of a frame: a
    camera's filters and live tracks are its state."""
    rows, whole = detections.select(*T.INPUT, "event_time"), F.expr("frame IS NOT NULL AND id IS NOT NULL")
    return fold_stream(rows, T.CAMERA, ["frame", "id"], lambda key: T.Tracker(key, max_age, min_hits, overlap), T.TRACKS, whole, packed=True)


def identities(observations: DataFrame, employees: dict[str, list[list[float]]], match: float = 0.9, review: float = 0.75, ttl: float = 20.0, capacity: int = 20, margin: float = R.MARGIN, reverify: int = R.REVERIFY) -> DataFrame:
    """operators.resolver.resolve on a stream with a watermark on ``event_time``: a store's people of the last ``ttl``
    seconds, their vectors and the tracks bound to them are its state."""
    rows = observations.withColumn("usable", R.usable()).withColumn("id", F.coalesce("id", F.lit(-1))).select(*R.INPUT, "event_time", "usable")
    make = lambda key: R.Resolver(key, employees, match, review, ttl, capacity, margin, reverify)
    return R.named(fold_stream(rows, ["store_id"], ["ts", "camera_id", "track_id", "id"], make, R.MADE, F.col("usable")))


class Kept:
    """The time of the last event of a key that was kept."""

    def __init__(self, key: tuple, window: float):
        self.window, self.last, self.at_us = window, None, 0

    def held(self) -> tuple:
        return self.last, self.at_us

    def resume(self, held: tuple) -> None:
        self.last, self.at_us = held

    def idle_from(self) -> float:
        """An event a window later is kept whatever came before."""
        return self.at_us + self.window * 1e6

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        keep = []
        for ts, at in zip(part["ts"], part["us"], strict=True):
            keep.append(self.last is None or ts - self.last >= self.window)
            if keep[-1]:
                self.last, self.at_us = float(ts), int(at)
        return part[keep].drop(columns=["us", "event_time"])


def _keys(part: pd.DataFrame, keys: list[str]) -> list[tuple]:
    """The rows' keys; nulls are values."""
    return list(zip(*(part[k].astype(object).where(part[k].notna(), None) for k in keys), strict=True))


class KeptOfSlot:
    """The time of the last kept event of each key of a slot; a key is forgotten a window after that."""

    def __init__(self, keys: list[str], window: float):
        self.keys, self.window, self.last = keys, window, {}

    def held(self) -> dict:
        return self.last

    def resume(self, held: dict) -> None:
        self.last = held

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        # rows come in the order of event time, so a key of a window before the first one keeps whatever comes
        since = int(part["us"].iloc[0]) - self.window * 1e6
        self.last = {k: v for k, v in self.last.items() if v[1] >= since}
        keep = []
        for key, ts, at in zip(_keys(part, self.keys), part["ts"], part["us"], strict=True):
            held = self.last.get(key)
            keep.append(held is None or ts - held[0] >= self.window)
            if keep[-1]:
                self.last[key] = float(ts), int(at)
        return part[keep].drop(columns=["us", "event_time", "slot"])


def deduplicate(events: DataFrame, keys: list[str], window: float, tie: str = "event_id") -> DataFrame:
    """operators.zones.deduplicate (keys, ts and tie) on a stream with a watermark on ``event_time``, whatever the order of rows
    within the delay. A key is forgotten a window after its last kept event."""
    rows = events.select(*keys, "ts", tie, "event_time", F.unix_micros("event_time").alias("us"), slots(keys).alias("slot"))
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in [*keys, "ts", tie])
    return fold_stream(rows, ["slot"], [tie], lambda slot: KeptOfSlot(keys, window), schema, F.col("ts").isNotNull(), span=DAY)


class StepsOfSlot:
    """How long each key of a slot has been inside or outside, since when it is in, and whether it has interacted."""

    def __init__(self, keys: list[str], enter: int, leave: int, interact: int):
        self.keys, self.enter, self.leave, self.interact, self.at = keys, enter, leave, interact, {}

    def held(self) -> dict:
        return self.at

    def resume(self, held: dict) -> None:
        self.at = held

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = []
        for key, now, ts in zip(_keys(part, self.keys), part["inside"], part["ts"], strict=True):
            run, inside, since, acted = self.at.get(key, (0, None, None, False))
            run, inside = run + 1 if inside is not None and now == inside else 1, bool(now)
            if inside and since is None and run >= self.enter:
                since, acted = float(ts), False
                out.append((*key, "enter", ts, None))
            if inside and since is not None and not acted and run >= self.interact:
                acted = True
                out.append((*key, "interaction", ts, None))
            if not inside and since is not None and run >= self.leave:
                out.append((*key, "exit", ts, ts - since))
                since = None
            self.at[key] = run, inside, since, acted
        return pd.DataFrame(out, columns=[*self.keys, "step", "ts", "dwell_s"]).astype({"ts": float, "dwell_s": float})


def zone_steps(obs: DataFrame, keys: list[str], enter: int = 2, leave: int = 4, interact: int = 6, tie: str = "event_id") -> DataFrame:
    """Zone entries, interactions and exits (keys, step, ts, dwell_s) of a stream with a watermark on ``event_time``, whatever
    the order of rows within the delay. obs: keys, inside, ts, tie; rows without inside or ts are left out."""
    rows = obs.select(*keys, "inside", "ts", tie, "event_time", slots(keys).alias("slot"))
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys) + ", step string, ts double, dwell_s double"
    steps = fold_stream(rows, ["slot"], [tie], lambda slot: StepsOfSlot(keys, enter, leave, interact), schema, F.expr("ts IS NOT NULL AND inside IS NOT NULL"), span=DAY)
    return steps.withColumn("dwell_s", rnd(F.col("dwell_s"), 3))


SNAPSHOT = "store_id string, camera_id string, us long, frames long, latency_p50 double, latency_p95 double, mean_people double, mean_confidence double, decisions long, review_ratio double, events long, drift double"


class Health:
    """One camera's counts and rings: the last ``window`` frames and detections, its first ``size`` samples and the last others."""

    snapshots = True  # the newest one tells all

    def __init__(self, key: tuple, window: int, size: int, least: int):
        self.key, self.size, self.least = key, size, least
        self.frames = self.decisions = self.doubts = self.events = 0
        self.latency, self.people, self.sure = (deque(maxlen=window) for _ in range(3))
        self.first: list = []  # samples until there are ``size``, then their mean
        self.mean, self.recent = None, deque(maxlen=size)

    def held(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("key", "size", "least")}

    def resume(self, held: dict) -> None:
        self.__dict__.update(held)

    def _drift(self) -> float | None:
        if self.mean is None or len(self.recent) < self.least:
            return None
        now = np.mean(self.recent, axis=0)
        both = np.linalg.norm(self.mean) * np.linalg.norm(now)
        return float(1 - self.mean @ now / both) if both else None

    def step(self, part: pd.DataFrame, last: bool) -> pd.DataFrame:
        own = part[(part["kind"] == "detection") & part["frame"].notna()].sort_values("frame", kind="stable")
        seen = own.groupby("frame", sort=True)["latency"]
        self.frames += seen.ngroups
        self.latency.extend(seen.sum().tolist())
        self.people.extend(seen.size().tolist())
        self.sure.extend(own["confidence"].tolist())
        self.decisions += len(own)
        self.doubts += int(own["needs_review"].sum())
        self.events += int((part["kind"] == "event").sum())
        for x in part.loc[part["kind"] == "sample", "embedding"]:
            if x is None:
                continue
            if self.mean is not None:
                self.recent.append(np.asarray(x, float))
                continue
            self.first.append(np.asarray(x, float))
            if len(self.first) == self.size:
                self.mean, self.first = np.mean(self.first, axis=0), []
        p50, p95 = np.percentile(self.latency, [50, 95]) if self.latency else (None, None)
        mean = lambda xs: float(np.mean(xs)) if len(xs) else None
        row = (*self.key, int(part["us"].max()), self.frames, p50, p95, mean(self.people), mean(self.sure), self.decisions, self.doubts / self.decisions if self.decisions else None, self.events, self._drift())
        return pd.DataFrame([row], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])


HEALTH_INPUT = ["store_id", "camera_id", "kind", "frame", "id", "latency", "confidence", "needs_review", "embedding"]


def camera_reports(rows: DataFrame, window: int = 300, size: int = 200, least: int = 10) -> DataFrame:
    """Snapshots of operators.health.camera_report, one for each camera whenever the watermark moves on, with ``us``, the time
    of its newest row. rows: store, camera, event_time (the same for a frame's rows) and kind: detection (frame, id, its part
    of the frame's latency, confidence, needs_review), event, or sample (id, embedding)."""
    made = rows.select(*HEALTH_INPUT, "event_time", F.unix_micros("event_time").alias("us"))
    out = fold_stream(made, E.CAMERA, ["frame", "id"], lambda key: Health(key, window, size, least), SNAPSHOT, F.col("kind").isNotNull(), packed=True)
    six = ["latency_p50", "latency_p95", "mean_people", "mean_confidence", "review_ratio"]
    return out.select(*[rnd(F.col(c), 6).alias(c) if c in six else rnd(F.col(c), 4).alias(c) if c == "drift" else F.col(c) for c in out.columns])
