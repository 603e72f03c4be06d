"""Stateful operators against small cases worked out by hand, and streams against their batch forms."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleflow.operators import events as E
from aisleflow.operators import ordered, resolver, tracking
from aisleflow.operators import zones as Z
from aisleflow.plans import catalog
from aisleflow.sources.stores import store_tables
from aisleflow.streaming import jobs, live

SF = "/root/testdata/sf0.001"
DET = "store_id string, camera_id string, frame long, id long, x1 double, y1 double, x2 double, y2 double"


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 4), (4, 2), (4, 4), (5, 3)]:
        for _ in range(40):
            g = rng.random((n, m)).round(1)
            got = sum(g[r, c] for r, c in tracking.assign(g))
            best = max(sum(g[r, c] for r, c in zip(range(n), p)) if n <= m else sum(g[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert got == pytest.approx(best)


def boxes(rows):
    return [("s", "c", f, i, float(x), float(y), float(x + 40), float(y + 90)) for f, i, x, y in rows]


def ids(spark, rows, **kw):
    """track_id of each row id."""
    return {r.id: r.track_id for r in tracking.track(spark.createDataFrame(boxes(rows), DET), **kw).collect()}


def test_tracks_of_three_people_one_of_whom_stops(spark):
    rows = []
    for f in range(24):
        rows += [(f, 10 * f, 30 + 4 * f, 20), (f, 10 * f + 1, 400 - 3 * min(f, 9), 20), (f, 10 * f + 2, 30, 300 + 2 * f)]
    got = ids(spark, rows)
    assert len(got) == 72 and [{got[10 * f + k] for f in range(24)} for k in range(3)] == [{1}, {2}, {3}]


def test_two_become_one_box_and_part_again(spark):
    """While they are one box, one of the two is unseen; it comes back under its own number, since it is no older than allowed."""
    rows = [(f, 10 * f, 100 + 5 * f, 50) for f in range(20)] + [(f, 10 * f + 1, 280 - 5 * f, 90) for f in range(20) if not 8 <= f <= 12]
    got = ids(spark, rows, max_age=6)
    assert {got[10 * f] for f in range(20)} == {1} and {got[10 * f + 1] for f in range(20) if not 8 <= f <= 12} == {2}
    late = ids(spark, rows, max_age=3)  # five frames unseen are too many: a new number, reported from its second sight on
    assert {late[10 * f + 1] for f in range(14, 20)} == {3} and 131 not in late


def test_swapping_places_at_once_swaps_numbers(spark):
    """Boxes alone tell nobody apart: two that change places between frames are taken for each other."""
    rows = [(f, 10 * f + k, [60, 400][k if f < 6 else 1 - k], 70) for f in range(12) for k in range(2)]
    got = ids(spark, rows)
    assert [got[10], got[11], got[110], got[111]] == [1, 2, 2, 1]


def plain_tracks(rows, max_age=15, min_hits=2, overlap=0.3):
    """One camera, one object for each track, all ways to assign: (id, track, hits, age). rows: frame, id, box."""
    q, r = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001]), np.diag([1, 1, 10, 10.0])
    f = np.eye(7)
    f[0, 4] = f[1, 5] = f[2, 6] = 1
    h, out, live, begun = np.eye(4, 7), [], [], 0
    z = lambda b: np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) * (b[3] - b[1]), (b[2] - b[0]) / (b[3] - b[1])])

    def over(a, b):
        w, t = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(t, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    for frame in range(max((r[0] for r in rows), default=-1) + 1):
        seen = sorted((i, b) for at, i, b in rows if at == frame)
        for t in live:
            if t["x"][2] + t["x"][6] <= 0:
                t["x"][6] = 0
            t["x"], t["p"], t["age"], t["missed"] = f @ t["x"], f @ t["p"] @ f.T + q, t["age"] + 1, t["missed"] + 1
            w = np.sqrt(t["x"][2] * t["x"][3])
            c = t["x"][:2]
            t["box"] = [c[0] - w / 2, c[1] - t["x"][2] / w / 2, c[0] + w / 2, c[1] + t["x"][2] / w / 2]
        gain = np.array([[over(b, t["box"]) for t in live] for _, b in seen]).reshape(len(seen), len(live))
        small = min(gain.shape)
        ways = [list(zip(a, b)) for a in itertools.combinations(range(len(seen)), small) for b in itertools.permutations(range(len(live)), small)]
        best = max(ways, key=lambda w: sum(gain[d, t] for d, t in w))
        new = dict(enumerate(seen))
        for d, k in best:
            if gain[d, k] >= overlap:
                t, (i, b) = live[k], new.pop(d)
                g = t["p"] @ h.T @ np.linalg.inv(h @ t["p"] @ h.T + r)
                t["x"], t["p"], t["hits"], t["missed"], t["id"] = t["x"] + g @ (z(b) - h @ t["x"]), t["p"] - g @ h @ t["p"], t["hits"] + 1, 0, i
        for i, b in new.values():
            begun += 1
            live.append({"n": begun, "x": np.r_[z(b), 0, 0, 0], "p": np.diag([10, 10, 10, 10, 1e4, 1e4, 1e4]), "hits": 1, "age": 0, "missed": 0, "id": i})
        out += [(t["id"], t["n"], t["hits"], t["age"]) for t in live if not t["missed"] and (t["hits"] >= min_hits or frame < min_hits)]
        live = [t for t in live if t["missed"] <= max_age]
    return sorted(out)


def test_tracks_equal_plain_ones_across_idle_gaps(spark):
    rng = np.random.default_rng(11)
    rows, people, frame = [], {}, 0
    for n in range(160):
        frame += int(rng.choice([1, 1, 1, 2, 9])) if n else 0
        people = {k: v for k, v in people.items() if rng.random() > 0.08}
        if len(people) < 3 and rng.random() < 0.5:
            people[n] = (rng.uniform(0, 500, 2), rng.normal(0, 4, 2), rng.uniform(30, 60, 2))
        for k, (c, v, s) in people.items():
            people[k] = (c + v, v, s)
            if rng.random() > 0.15:
                a = c + rng.normal(0, 1, 2)
                rows.append((frame, 1000 * frame + k, [*a, *(a + s)]))
    df = spark.createDataFrame([("s", "c", f, i, *map(float, b)) for f, i, b in rows] + [("t", None, f, i, *map(float, b)) for f, i, b in rows[:50]], DET)
    for age in (2, 5):
        got = tracking.track(df, max_age=age).collect()
        assert sorted((r.id, r.track_id, r.hits, r.age) for r in got if r.store_id == "s") == plain_tracks(rows, age)
        assert sorted((r.id, r.track_id, r.hits, r.age) for r in got if r.store_id == "t") == plain_tracks(rows[:50], age)
    cut = ordered.idle_segments(df, ["store_id", "camera_id"], "frame", 3, 16)
    starts = {f for f in {r[0] for r in rows} if not {f - 1, f - 2, f - 3} & {r[0] for r in rows}}
    assert {r._segment for r in cut.where("store_id = 's'").collect()} == starts and len(starts) > 5
    assert tracking.track(df.limit(0)).count() == 0


def test_track_does_not_depend_on_batches_or_cuts(spark):
    whole = sorted(map(tuple, catalog.track_boxes(spark, SF).collect()))
    unbroken = ordered.fold_in_order(catalog.shifts(spark, SF), ["store_id", "camera_id"], ["frame", "id"], lambda key: tracking.Tracker(key, overlap=0.1).step, tracking.TRACKS)
    assert sorted(map(tuple, unbroken.collect())) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, catalog.track_boxes(spark, SF).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, catalog.stream_tracks(spark, SF).collect())) == whole


def test_stretches_are_folded_together_and_each_as_if_alone(monkeypatch):
    """Forty stretches of crowded frames: as many steps as one of them has frames, and the same rows as one at a time."""
    rng, rows = np.random.default_rng(4), []
    for lane in range(40):
        for frame in range(100 * lane, 100 * lane + 12):
            a = rng.integers(0, 200, (int(rng.integers(1, 30)), 2)).astype(float)
            a[len(a) // 2 :] = a[: len(a) - len(a) // 2]  # equal boxes, too
            rows += [(lane, frame, len(rows) + k, *p, *(p + [30, 60])) for k, p in enumerate(a)]
    lane, frame, ids = (np.array([r[k] for r in rows]) for k in range(3))
    box, steps = np.array([r[3:] for r in rows]), []
    box[5, 2] = np.nan  # a box without a side overlaps nothing
    advance = tracking.Tracks._advance
    monkeypatch.setattr(tracking.Tracks, "_advance", lambda self, *a: steps.append(1) or advance(self, *a))
    monkeypatch.setattr(tracking, "PAIRS", 5000)
    out, _ = tracking.Tracks([tracking.FRESH] * 40, 15, 2, 0.1).fold(lane, frame, ids, box)
    assert len(steps) == 12
    for k in range(40):
        own, state = lane == k, tracking.FRESH
        cut = int(np.flatnonzero(own & (frame == 100 * k + 7))[0]), int(np.flatnonzero(own)[0])
        alone = []
        for part in (own & (np.arange(len(own)) < cut[0]), own & (np.arange(len(own)) >= cut[0])):
            got, state = tracking.Tracks([state], 15, 2, 0.1).fold(lane[part] * 0, frame[part], ids[part], box[part], 0)
            alone += got[1:].T.tolist()
        assert sorted(alone) == sorted(out[1:, out[0] == k].T.tolist()) and alone


def test_pairs_of_what_overlaps_are_the_best_of_all():
    rng = np.random.default_rng(2)
    for n, m in [(3, 9), (9, 3), (12, 12), (30, 60)]:
        for _ in range(30):
            g = np.where(rng.random((n, m)) < 0.3, rng.random((n, m)), 0)
            got = tracking.best_pairs([[(int(c), float(row[c])) for c in np.flatnonzero(row)] for row in g], m)
            assert sorted((r, c) for c, r in got) == [p for p in tracking.assign(g) if g[p] > 0]


def test_suppression_equals_a_loop(spark):
    rows = [r.asDict(True) for r in catalog._detections(spark, SF).withColumn("confidence", (F.col("id") * 37 % 101) / F.lit(100.0)).collect()]
    want, kept = set(), {}
    for r in sorted((r for r in rows if r["confidence"] >= 0.4), key=lambda r: (-r["confidence"], r["id"], *(r["box"][c] for c in ("x1", "y1", "x2", "y2")))):
        own = kept.setdefault((r["store_id"], r["camera_id"], r["frame"]), [])
        box = np.array([[r["box"][c] for c in ("x1", "y1", "x2", "y2")]])
        if all(tracking.overlaps(box, k)[0, 0] <= 0.2 for k in own):
            own.append(box)
            want.add(r["id"])
    assert {r.id for r in catalog.nms(spark, SF).collect()} == want


def test_resolver_decisions(spark):
    schema = "store_id string, camera_id string, track_id long, id long, role string, embedding array<double>, ts double"
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [
        ("s", "a", 1, 1, "employee", unit([1, 0.05, 0]), 0.0), ("s", "a", 2, 2, "employee", unit([0.8, 0.6, 0]), 0.0),
        ("s", "a", 3, 3, "employee", unit([0, 0, 1]), 0.0), ("s", "a", 4, 4, "customer", unit([0, 1, 0]), 0.0),
        ("s", "b", 1, 5, "customer", unit([0, 1, 0.02]), 0.4), ("s", "a", 1, 6, "employee", unit([0, 0, 1]), 0.5),
        ("s", "b", 9, 7, "customer", unit([0, 1, 0]), 50.0), ("s", "b", 10, 8, "customer", None, 51.0), ("t", "a", 1, 9, "customer", unit([0, 1, 0]), 0.0),
    ]
    out = {r.id: (r.global_id, r.needs_review) for r in resolver.resolve(spark.createDataFrame(rows, schema), {"emp-1": [[1.0, 0.0, 0.0]]}).collect()}
    assert out == {1: ("emp-1", False), 2: ("emp-1", True), 3: ("employee-unknown-0001", True), 4: ("person-0001", False), 5: ("person-0001", False), 6: ("emp-1", False), 7: ("person-0002", False), 9: ("person-0001", False)}


def plain_identities(rows, staff, match, review, ttl, reverify=30):
    """One store, told step by step: id -> (global id, employee, confidence, review)."""
    out, seen, vectors, bound, count = {}, {}, {}, {}, {"person": 0, "employee-unknown": 0}
    frames = {}
    for r in rows:
        frames.setdefault((r["ts"], r["camera_id"]), []).append(r)
    for (ts, camera), own in sorted(frames.items()):
        for gone in [g for g in seen if ts - seen[g][2] > ttl]:
            del seen[gone], vectors[gone]
            bound = {k: b for k, b in bound.items() if b[0] != gone}
        for r in sorted(own, key=lambda r: (r["track_id"], r["id"])):
            if r["embedding"] is None:
                continue
            v, key, is_staff = np.array(r["embedding"]), (camera, r["track_id"]), r["role"] == "employee"
            near = lambda g: max(float(np.dot(w, v)) for w in vectors[g])  # noqa: B023, E731

            def learn(g):
                if g not in vectors or near(g) >= review:
                    vectors[g] = [*vectors.get(g, []), v][-20:]

            held = bound.get(key)
            if held:
                held[1] += 1
                if held[1] % reverify:
                    seen[held[0]][2] = ts
                    learn(held[0])
                    out[r["id"]] = (held[0], seen[held[0]][1], 1.0, False)
                    continue
            found = None
            if is_staff:
                ranked = sorted(((float(np.dot(e, v)), n) for n, e in staff.items()), key=lambda x: (-x[0], x[1]))
                if ranked and ranked[0][0] >= review:
                    sure = ranked[0][0] >= match and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else -1) > 0.02
                    found = (ranked[0][1], ranked[0][1], ranked[0][0], not sure)
            if not found:
                top = sorted(((near(g), g) for g in vectors), key=lambda x: (-x[0], x[1]))[:5]
                fits = [x for x in top if seen[x[1]][0] == is_staff]
                if fits and fits[0][0] >= match:
                    found = (fits[0][1], None, fits[0][0], is_staff)
                else:
                    kind = "employee-unknown" if is_staff else "person"
                    count[kind] += 1
                    found = (f"{kind}-{count[kind]:04d}", None, 0.0, is_staff)
            if held and (found[3] or found[2] <= 0):
                seen[held[0]][2] = ts
                out[r["id"]] = (held[0], seen[held[0]][1], 1.0, False)
                continue
            seen.setdefault(found[0], [is_staff, found[1], ts])[2] = ts
            learn(found[0])
            bound[key] = [found[0], 1]
            out[r["id"]] = found
        shown = {r["track_id"] for r in own}
        bound = {k: b for k, b in bound.items() if k[0] != camera or k[1] in shown}
    return out


def test_identities_equal_a_plain_resolver(spark):
    rows = [r.asDict() for r in catalog.seen_people(spark, "/root/testdata/sf0.01").collect()]
    staff = {n: e[0] for n, e in catalog._staff(spark, "/root/testdata/sf0.01").items()}
    got = {r.id: (r.global_id, r.employee_id, round(r.confidence, 9), r.needs_review) for r in catalog.resolve_identities(spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for s in {r["store_id"] for r in rows}:
        own = plain_identities([r for r in rows if r["store_id"] == s], staff, 0.5, 0.3, 20.0)
        want |= {k: (g, e, round(c, 9), w) for k, (g, e, c, w) in own.items()}
    assert got == want and {g[0].rsplit("-", 1)[0] for g in got.values()} == {"emp", "person", "employee-unknown"}
    assert sum(c == 1.0 for _, _, c, _ in got.values()) > 50
    streamed = {r.id: (r.global_id, r.employee_id, round(r.confidence, 9), r.needs_review) for r in catalog.stream_identities(spark, "/root/testdata/sf0.01").collect()}
    assert streamed == want


def test_release_after_one_missed_frame(spark):
    """A bound track keeps its person whatever it looks like; missing from one frame of its camera, it is looked at anew."""
    schema = "store_id string, camera_id string, track_id long, id long, role string, embedding array<double>, ts double"
    a, b = [1.0, 0.0], [0.0, 1.0]

    def told(rows):
        return {r.id: r.global_id for r in resolver.resolve(spark.createDataFrame([("s", *r) for r in rows], schema), {}).collect()}

    person = lambda cam, track, i, v, ts: (cam, track, i, "customer", v, ts)
    assert told([person("x", 1, 1, a, 0.0), person("x", 1, 2, b, 1.0)]) == {1: "person-0001", 2: "person-0001"}
    # another track in the frame between, a frame without people, or the track shown but too close to the edge to be embedded
    assert told([person("x", 1, 1, a, 0.0), person("x", 2, 5, a, 1.0), person("x", 1, 2, b, 2.0)])[2] == "person-0002"
    assert told([person("x", 1, 1, a, 0.0), ("x", None, None, None, None, 1.0), person("x", 1, 2, b, 2.0)]) == {1: "person-0001", 2: "person-0002"}
    assert told([person("x", 1, 1, a, 0.0), person("x", 1, 3, None, 1.0), person("x", 1, 2, b, 2.0)]) == {1: "person-0001", 2: "person-0001"}
    # another camera's frames release nothing here
    assert told([person("x", 1, 1, a, 0.0), person("y", 9, 4, a, 1.0), person("x", 1, 2, b, 2.0)])[2] == "person-0001"
    # numbers go on after an idle gap
    assert told([person("x", 1, 1, a, 0.0), person("x", 1, 2, a, 100.0), person("x", 2, 3, b, 100.0)]) == {1: "person-0001", 2: "person-0002", 3: "person-0003"}


def zone_stream(spark, rows, folder, batches, delay="1 second", **kw):
    """rows: (person, event_id, ts, x) of one camera whose shelf is x in 0..10, in the given batches."""
    schema = "store_id string, camera_id string, global_id string, event_id long, ts double, role string, employee_id string, confidence double, needs_review boolean, x double, y double"
    zones = spark.createDataFrame([("s", "c", "z", "shelf", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "store_id string, camera_id string, zone string, kind string, polygon array<struct<x:double,y:double>>")
    timed = lambda df: df.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long") + 1_000_000_000))
    made = lambda part: spark.createDataFrame([("s", "c", p, i, float(t), "customer", None, 0.5, False, float(x), 5.0) for p, i, t, x in part], schema)
    for part in batches:
        made(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).withWatermark("event_time", delay)
    live_rows = jobs.run_available(live.zone_events(stream, zones, **kw), f"{folder}/out", f"{folder}/cp")
    batch = E.zone_events(made(rows), zones, **kw)
    plain = lambda df: sorted((r.event_type, r.global_id, r.ts, r.payload) for r in df.collect())
    return plain(live_rows), plain(batch)


def test_live_zones_with_timers_and_late_rows(spark, tmp_path):
    """A visit is closed by the first frame past the gap, whoever it shows; a frame without people does it too. Rows that come
    late, but within the delay, are worked on in order; a later one is dropped."""
    kw = {"gap": 3.0, "enter": 2, "leave": 2, "interact": 3, "min_dwell": 1.0}
    stay = [("p", i, i, 5) for i in range(5)]
    others = [("q", 10 + i, 5 + i, 50) for i in range(4)]
    far = [("end", 99, 1000, 50)]
    rows = stay + others
    got, want = zone_stream(spark, rows, str(tmp_path / "a"), [stay, others[:2], others[2:], far], **kw)
    assert got == want and [g[0] for g in got] == ["dwell", "product_interaction", "zone_entered", "zone_exited"]
    assert {g[2] for g in got if g[0] in ("dwell", "zone_exited")} == {8.0}
    shuffled = [rows[1::2], rows[::2], far]
    assert zone_stream(spark, rows, str(tmp_path / "b"), shuffled, delay="20 seconds", **kw)[0] == want
    clock = [*stay, (None, 50, 7.5, 0)]
    got, _ = zone_stream(spark, stay, str(tmp_path / "c"), [clock[:3], clock[3:], far], **kw)
    assert {g[2] for g in got if g[0] == "zone_exited"} == {7.5} and not any(g[1] is None for g in got)
    # without the far row nothing has passed the last frame: what waits is neither lost nor told
    open_yet, _ = zone_stream(spark, stay, str(tmp_path / "d"), [stay[:3], stay[3:]], **kw)
    assert [g[0] for g in open_yet] == ["product_interaction", "zone_entered"]
    dropped, _ = zone_stream(spark, rows, str(tmp_path / "e"), [stay, others, far, [("p", 77, 6, 5)]], **kw)
    assert dropped == want


def test_too_many_staff_fail(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MAX_STAFF", 2)
    with pytest.raises(ValueError):
        catalog.resolve_identities(spark, SF)


def test_zone_stream_equals_windows(spark):
    got = {(r.store_id, r.global_id, r.step, r.ts) for r in catalog.stream_zone_steps(spark, SF).collect()}
    obs = catalog.observations(spark, SF)
    want = set()
    for r in Z.visits(obs, ["store_id", "global_id"], ["ts", "event_id"]).collect():
        want |= {(r.store_id, r.global_id, k, t) for k, t in (("enter", r.enter_ts), ("exit", r.exit_ts), ("interaction", r.interaction_ts)) if t is not None}
    assert got == want and got


def test_streams_from_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"event_type": "zone_entered", "store_id": "s", "camera_id": "c", "timestamp": t, "global_id": "p", "role": "customer", "zone": None, "payload": {"zone_kind": "shelf"}} for t in (0.0, 4.0, 8.0, 9.0, 13.0)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    events = jobs.event_lines(spark, str(tmp_path / "in")).withColumn("event_id", (F.col("ts") * 10).cast("long"))
    kept = jobs.run_available(jobs.deduplicate(events, ["global_id", "event_type", "zone"], 5.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.ts for r in kept.collect()) == [0.0, 8.0, 13.0]
    with pytest.raises(ValueError):
        jobs.writer(events, "fax", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        jobs.writer(events, "jsonl", str(tmp_path / "x"))
    jobs.writer(jobs.windowed_summary(events), "memory", str(tmp_path / "cp2"), name="summed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("summed").agg(F.sum("events")).first()[0] == 5
    jobs.upsert_latest(events, ["camera_id"], "ts", str(tmp_path / "latest"), str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    assert [r.ts for r in spark.read.parquet(str(tmp_path / "latest/batch=0")).collect()] == [13.0]


def test_store_config(spark):
    cameras, zones = store_tables(spark, {"store_id": "s", "cameras": [{"camera_id": "c", "zones": [{"name": "z", "kind": "shelf", "polygon": [[0, 0], [1, 0], [1, 1]]}]}]})
    assert cameras.first().fps == 10.0 and zones.first().zone == "z"
    with pytest.raises(ValueError):
        store_tables(spark, {"store_id": "s", "cameras": [{"camera_id": "c", "zones": [{"name": "z", "polygon": [[0, 0]]}]}]})


def test_ingest_leaves_a_repeated_batch_as_it_was(spark, tmp_path):
    """Good events and those put aside, by micro-batch; run again without its checkpoint, every batch replaces its own part."""
    line = {"event_type": "zone_entered", "store_id": "s", "camera_id": "c", "timestamp": 1.0, "global_id": "p", "role": "customer", "zone": None, "confidence": 0.5, "payload": {}}
    for k, rows in enumerate(([line, line | {"confidence": 7.0}], [line | {"timestamp": 2.0}], [line | {"confidence": -1.0}])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, rows)))
    told = []
    for n in range(2):
        events = jobs.event_lines(spark, str(tmp_path / "in"), files_at_once=1)
        jobs.ingest(events, str(tmp_path / "good"), str(tmp_path / "aside"), str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination()
        good, aside = (spark.read.parquet(str(tmp_path / t)) for t in ("good", "aside"))
        told.append((sorted((r.batch, r.ts) for r in good.collect()), sorted((r.batch, r.fault) for r in aside.collect())))
    assert told[0] == told[1] and [len(x) for x in told[0]] == [2, 2] and {f for _, f in told[0][1]} == {"confidence is out of range"}


def test_live_deduplication_takes_late_rows_in_order(spark, tmp_path):
    """Times 0, 4, 8, 9, 13 with a window of 5 keep 0, 8, 13, in whatever order they come within the delay; null keys are values."""
    schema = "global_id string, zone string, event_id long, ts double"
    rows = [("p", None, i, t) for i, t in enumerate((0.0, 4.0, 8.0, 9.0, 13.0))] + [(None, "z", 9, 3.0), ("p", "z", 10, None)]
    for part in ([rows[2], rows[4], rows[6]], [rows[1], rows[0]], [rows[3], rows[5]], [("end", "z", 99, 500.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = stream.withColumn("event_time", F.timestamp_micros((F.coalesce("ts", F.lit(0.0)) * 1e6).cast("long") + 1_000_000_000)).withWatermark("event_time", "60 seconds")
    kept = jobs.run_available(live.deduplicate(timed, ["global_id", "zone"], 5.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.event_id for r in kept.collect()) == [0, 2, 4, 9]
    machine = live.Kept(("p",), 5.0)
    machine.resume((13.0, 1_013_000_000))
    assert machine.idle_from() == 1_018_000_000


def test_live_zone_steps_take_rows_in_order(spark, tmp_path):
    """Rows of one slice that come in two micro-batches, the later ones first: in by two, out by four, whatever the cuts; null keys
    are values."""
    schema = "store_id string, global_id string, event_id long, ts double, inside boolean"
    rows = [(None, "p", k, k / 4, k < 7) for k in range(12)] + [("s", "p", 20, 1.0, True), ("s", "p", 21, 2.0, None)]
    for part in (rows[6:], rows[:6], [("end", "z", 99, 500.0, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = stream.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long") + 1_000_000_000)).withWatermark("event_time", "60 seconds")
    got = jobs.run_available(live.zone_steps(timed, ["store_id", "global_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.store_id, r.step, r.ts, r.dwell_s) for r in got.collect()) == [(None, "enter", 0.25, None), (None, "exit", 2.5, 2.25), (None, "interaction", 1.25, None)]


def test_waiting_rows_are_worked_on_by_slices(spark, monkeypatch):
    """A step gets the rows of one slice, however many wait."""
    from aisleflow.streaming import ordered as waiting

    class Kept:  # a state store's map
        def __init__(self):
            self.rows = {}
            self.updateValue, self.removeKey = self.rows.__setitem__, self.rows.pop

        def keys(self):
            return list(self.rows)

        def getValue(self, key):
            return self.rows[key]

    sizes = []

    class Count:
        def step(self, part, last):
            sizes.append((part["at"].min(), len(part)))
            return part

        def held(self):
            return None

    class Value(Kept):
        exists, update = (lambda self: False), (lambda self, v: None)

    monkeypatch.setattr(waiting, "HELD", 7)
    p = waiting._Ordered(lambda key: Count(), ["at"])
    p.waiting, p.machine = Kept(), Value()
    p.handle = type("Handle", (), {"listTimers": lambda self: [], "registerTimer": lambda self, at: None})()
    at = np.random.default_rng(3).permutation(40)
    parts = [pd.DataFrame({"at": at[k : k + 5], "at_us": at[k : k + 5].astype("int64") * (waiting.SLICE // 10)}) for k in range(0, 40, 5)]
    seconds = waiting.SLICE // 10 // 1000
    out = [*p._release(("k",), 24 * seconds, iter(parts)), *p._release(("k",), 99 * seconds, iter(()))]
    assert sizes == [(0, 10), (10, 10), (20, 5), (25, 5), (30, 10)] and pd.concat(out)["at"].tolist() == list(range(40)) and not p.waiting.rows


class _Store:  # a state store's map, or a value of it
    def __init__(self):
        self.rows, self.calls = {}, 0
        self.removeKey, self.keys, self.getValue = self.rows.pop, lambda: list(self.rows), self.rows.__getitem__
        self.exists, self.get = (lambda: 0 in self.rows), (lambda: self.rows[0])
        self.update = lambda v: self.updateValue(0, v)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value


def _processor(make, order, **how):
    from aisleflow.streaming import ordered as waiting

    p = waiting._Ordered(make, order, **how)
    p.waiting, p.machine, p.passed = _Store(), _Store(), _Store()
    p.handle = type("Handle", (), {"listTimers": lambda self: [], "registerTimer": lambda self, at: None})()
    return p


class _Steps:
    def __init__(self):
        self.parts = []

    def step(self, part, last):
        self.parts.append(part["at"].tolist())
        return part

    def held(self):
        return None

    def resume(self, held):
        pass


def test_sparse_slices_are_one_piece_and_one_step(monkeypatch):
    """Camera reports: a thousand slices of four rows wait in few pieces and are worked on in few steps, in order."""
    from aisleflow.streaming import ordered as waiting

    monkeypatch.setattr(waiting, "HELD", 1600)
    steps = _Steps()
    p = _processor(lambda key: steps, ["at"])
    at = np.random.default_rng(5).permutation(4000)
    parts = [pd.DataFrame({"at": x, "at_us": x.astype("int64") * (waiting.SLICE // 4)}) for x in np.split(at, 40)]
    quarter = waiting.SLICE // 4 // 1000
    out = [*p._release(("k",), 2499 * quarter, iter(parts)), *p._release(("k",), 9999 * quarter, iter(()))]
    assert pd.concat(out)["at"].tolist() == [x for part in steps.parts for x in part] == list(range(4000)) and not p.waiting.rows
    assert p.waiting.calls < 100 and len(steps.parts) < 10 and max(map(len, steps.parts)) <= 2 * 1600


def test_packed_rows_come_in_order_and_late_ones_go():
    """Rows of null keys are packed, too; rows without a time are not; those that a key's state has passed are dropped."""
    import pickle

    import pyarrow as pa

    from aisleflow.streaming import ordered as waiting

    table = pa.table({"s": ["a", None, "a", "b", "a", None], "c": ["x", "x", None, "x", "x", "x"], "at": list(range(6)), "at_us": pa.array([5000, 1000, None, 7000, 3000, 2000], pa.int64())})
    packs = pa.Table.from_batches(list(waiting._packed(["s", "c"])(iter(table.to_batches(max_chunksize=2))))).to_pylist()
    assert {(r["s"], r["c"]): sorted(pickle.loads(r["packed"])["at"]) for r in packs} == {("a", "x"): [0, 4], (None, "x"): [1, 5], ("b", "x"): [3]}
    assert list(waiting._packed(["s", "c"])(iter(table.slice(2, 1).to_batches()))) == []
    steps = _Steps()
    p = _processor(lambda key: steps, ["at"], packed=True)
    for passed, rows in ((0, [5, 3]), (3, [2, 4]), (5, [1, 9, 5]), (9, [6, 4])):
        pack = pd.DataFrame({"packed": [pickle.dumps(pd.DataFrame({"at": [x], "at_us": [x * 1000]})) for x in rows]})
        list(p.handleInputRows(("k",), iter([pack]), type("Now", (), {"getCurrentWatermarkInMs": lambda self, at=passed: at})()))
    assert [x for part in steps.parts for x in part] == [2, 3, 4, 5, 5, 6, 9]


def test_a_stream_tracker_folds_stretches_together(monkeypatch):
    """Rows of many stretches take as many steps as the longest has frames, and are numbered as one at a time is; repeated ids
    of a frame, in any order, give the same."""
    rng, rows = np.random.default_rng(9), []
    for frame in [f for k in range(20) for f in range(60 * k, 60 * k + 10)]:
        a = rng.integers(0, 200, (8, 2)).astype(float)
        rows += [(frame, 1000 * frame + k // 2, *p, *(p + [40, 60])) for k, p in enumerate(a)]
    df = pd.DataFrame(rows, columns=["frame", "id", "x1", "y1", "x2", "y2"])
    slow, want = tracking.Tracker(("s", "c"), overlap=0.1), []
    for _, part in df.groupby("frame"):
        want.append(slow.step(part, True))
    steps, advance = [], tracking.Tracks._advance
    monkeypatch.setattr(tracking.Tracks, "_advance", lambda self, *a: steps.append(1) or advance(self, *a))
    mixed = df.sample(frac=1, random_state=1).sort_values(["frame", "id"], kind="stable")
    fast, cut = tracking.Tracker(("s", "c"), overlap=0.1), int((mixed["frame"] < 604).sum())
    got = [fast.step(mixed[:cut], True), fast.step(mixed[cut:], True)]
    sort = lambda parts: sorted(map(tuple, pd.concat(parts).to_numpy().tolist()))
    assert sort(got) == sort(want) and len(steps) < 50
    assert all(np.array_equal(a, b) for a, b in zip(slow.held(), fast.held(), strict=True))
