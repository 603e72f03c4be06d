"""Sources, sinks, hooks and edge cases of the event engine, against plain Python."""

import functools
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aisleflow.functions import hooks
from aisleflow.operators import analytics, events, identity, zones
from aisleflow.sources import datasets, stores
from aisleflow.sources.events import append_table, flatten, read_lines, write_lines

LINE = {"event_type": "zone_exited", "store_id": "s", "camera_id": "c", "timestamp": 1.5, "global_id": "g", "role": "customer", "zone": "z", "employee_id": None, "confidence": 0.5}


def test_truth_of_payload_values_is_pythons(spark):
    values = [True, False, None, 0, 1, -2, 0.0, 0.5, "", "0", "false", [], [0], {}, {"a": 1}]
    rows = [json.dumps({"needs_review": v, "dwell_seconds": k}) for k, v in enumerate(values)] + ["{}", None]
    raw = spark.createDataFrame([(*LINE.values(), p) for p in rows], "event_type string, store_id string, camera_id string, timestamp double, global_id string, role string, zone string, employee_id string, confidence double, payload string")
    got = {r.dwell_seconds: r.needs_review for r in flatten(raw).collect() if r.dwell_seconds is not None}
    assert got == {float(k): bool(v) for k, v in enumerate(values)}
    assert [r.needs_review for r in flatten(raw).where("dwell_seconds IS NULL").collect()] == [False, False]
    with pytest.raises(PySparkException):
        flatten(raw.withColumn("store_id", F.lit(None).cast("string"))).collect()


def test_lines_and_tables(spark, tmp_path):
    path = tmp_path / "in" / "a.jsonl"
    path.parent.mkdir()
    path.write_text(json.dumps(LINE | {"payload": {"zone_kind": "seat", "dwell_seconds": 2.5}}) + "\n\n" + json.dumps(LINE | {"global_id": "h"}) + "\n")
    got = read_lines(spark, str(path)).orderBy("global_id")
    assert [(r.global_id, r.zone_kind, r.dwell_seconds, r.needs_review) for r in got.collect()] == [("g", "seat", 2.5, False), ("h", None, None, False)]
    write_lines(got, str(tmp_path / "out"))
    write_lines(got, str(tmp_path / "out"), append=True)
    written = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(written) == 4 and all("employee_id" in x for x in written)
    assert append_table(got, str(tmp_path / "t")) == 2 and append_table(got, str(tmp_path / "t")) == 4
    path.write_text("{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_lines(spark, str(path)).collect()


def test_batches_and_limits(spark):
    good = flatten(spark.createDataFrame([(*LINE.values(), None)], "event_type string, store_id string, camera_id string, timestamp double, global_id string, role string, zone string, employee_id string, confidence double, payload string"))
    bad = good.withColumn("confidence", F.lit(1.5)).unionByName(good.withColumn("ts", F.lit(None).cast("double")))
    kept, aside = events.split_batch(good.unionByName(bad))
    assert kept.columns == good.columns and kept.count() == 1 and sorted(r.fault for r in aside.collect()) == ["confidence is out of range", "ts is missing"]
    for n in (0, 4):
        with pytest.raises(ValueError):
            events.split_batch(good.limit(0) if not n else good.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(n)))), most=3)
    for limit in (-1, 501):
        with pytest.raises(ValueError):
            analytics.journeys(good, limit)
    assert analytics.review_queue_size(good.withColumn("event_id", F.lit(1))).first().n == 0


def test_identity_edges(spark):
    near = [(k, k % 2, [1.0, 0.01 * k]) for k in range(4)]
    v = spark.createDataFrame(near, "vec_id long, label long, embedding array<double>")
    got = identity.leave_one_out(v).first()
    assert got.samples == 4 and got.rank5 == 1.0
    for labels in ("0", "vec_id"):
        with pytest.raises(PySparkException):
            identity.thresholds(v.withColumn("label", F.expr(labels).cast("long"))).collect()
    series = [("full", n, [1.0, 0.0] if n < 10 else [0.0, 2.0]) for n in range(20)] + [("short", n, [1.0, 0.0]) for n in range(9)] + [("zero", n, [0.0, 0.0]) for n in range(20)]
    d = identity.drift(spark.createDataFrame(series, "cam string, n long, embedding array<double>"), size=10, least=10)
    assert {r.cam: r.drift for r in d.collect()} == {"full": 1.0, "short": None, "zero": None}
    assert identity.identity_accuracy(spark.createDataFrame([], "name string, gid string, is_employee boolean, said_employee boolean, employee_id string")).first().matched_frames == 0


def test_similarities_by_blocks_equal_all_pairs(spark, monkeypatch):
    from aisleflow.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 3)).round(1)
    vectors[5] = vectors[6]
    labels = rng.integers(0, 6, 40)
    v = spark.createDataFrame([(k, int(labels[k]), vectors[k].tolist()) for k in range(40)], "vec_id long, label long, embedding array<double>")
    s = np.round(vectors @ vectors.T, 6)
    ranked = [[j for j in sorted(range(40), key=lambda j: (-s[i, j], j)) if j != i] for i in range(40)]
    got = {(r.q, r.rank): (r.g_label, r.sim) for r in identity.gallery_top(v, v, 3).collect()}
    for i in range(40):
        best = sorted({int(x): max(s[i, j] for j in range(40) if labels[j] == x and j != i) for x in {labels[j] for j in ranked[i]}}.items(), key=lambda x: (-x[1], x[0]))
        assert [got[i, k + 1] for k in range(3)] == [(a, b) for a, b in best[:3]]
    hits = [[labels[j] == labels[i] for j in ranked[i]] for i in range(40)]
    ap = [np.mean([sum(h[: k + 1]) / (k + 1) for k, x in enumerate(h) if x]) if any(h) else 0 for h in hits]
    r = identity.rank_metrics(v, v).first()
    assert np.allclose([r.rank1, r.rank5, r.map], [np.mean([h[0] for h in hits]), np.mean([any(h[:5]) for h in hits]), np.mean(ap)], atol=1e-4)
    other = [s[i, j] for i in range(40) for j in range(i) if labels[i] != labels[j]]
    same = [s[i, j] for i in range(40) for j in range(i) if labels[i] == labels[j]]
    t = identity.thresholds(v).first()
    assert np.allclose([t.match_threshold, t.review_threshold, t.impostor_mean, t.genuine_mean, t.genuine_accept], [np.quantile(other, 0.99), np.quantile(other, 0.95), np.mean(other), np.mean(same), np.mean(np.array(same) >= np.quantile(other, 0.99))], atol=1e-4)
    assert t.impostor_pairs == len(other) and t.genuine_pairs == len(same)


def test_zone_events_close_visits_at_a_flush(spark):
    """Two cameras; one person stays on a shelf and vanishes, another goes on; the frame that misses the first closes the visit."""
    zone = spark.createDataFrame([("s", c, z, k, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]) for c in ("a", "b") for z, k in (("shelf", "shelf"), ("seat", "seat"))], "store_id string, camera_id string, zone string, kind string, polygon array<struct<x:double,y:double>>")
    rows = [("a", "p", t, 3.0) for t in range(8)] + [("a", "q", t, 20.0) for t in range(14)] + [("b", "p", t, 3.0) for t in range(3)]
    obs = spark.createDataFrame([("s", c, g, k, float(t), "customer", None, 0.9, False, x, 9.0) for k, (c, g, t, x) in enumerate(rows)], "store_id string, camera_id string, global_id string, event_id long, ts double, role string, employee_id string, confidence double, needs_review boolean, x double, y double")
    got = sorted((r.camera_id, r.event_type, r.ts, json.loads(r.payload)) for r in events.zone_events(obs, zone, gap=3.0, min_dwell=9.5).collect() if r.zone == "shelf")
    assert got == [
        ("a", "dwell", 11.0, {"zone_kind": "shelf", "needs_review": False, "dwell_seconds": 10.0}),
        ("a", "product_interaction", 5.0, {"zone_kind": "shelf", "needs_review": False, "frames": 6}),
        ("a", "zone_entered", 1.0, {"zone_kind": "shelf", "needs_review": False}),
        ("a", "zone_exited", 11.0, {"zone_kind": "shelf", "needs_review": False, "dwell_seconds": 10.0}),
        ("b", "zone_entered", 1.0, {"zone_kind": "shelf", "needs_review": False}),
    ]
    seats = sorted((r.camera_id, r.event_type) for r in events.zone_events(obs, zone, gap=3.0, min_dwell=99).collect() if r.zone == "seat")
    assert seats == [("a", "seat_occupied"), ("a", "seat_released"), ("b", "seat_occupied")]


def test_deduplication_keeps_rows_whose_ids_repeat(spark):
    df = spark.createDataFrame([(1, "g", 0.0, "first"), (1, "g", 1.0, "too soon"), (1, "g", 6.0, "later"), (1, None, 0.0, "no key")], "event_id long, global_id string, ts double, note string")
    assert sorted(r.note for r in zones.deduplicate(df, ["global_id"], 5.0).collect()) == ["first", "later", "no key"]


def test_galleries_and_cameras(spark, tmp_path):
    g = spark.createDataFrame([("a", k, [float(k)]) for k in range(5)] + [("b", 0, [9.0])], "identity_id string, seq long, embedding array<double>")
    stores.save_gallery(g, str(tmp_path / "g"), most=4)
    assert sorted((r.identity_id, r.seq) for r in stores.load_gallery(spark, str(tmp_path / "g"), most=2).collect()) == [("a", 3), ("a", 4), ("b", 0)]
    cameras, _ = stores.store_tables(spark, {"store_id": "s", "cameras": [{"camera_id": "c", "fps": 5}]})
    assert stores.camera(cameras, "c").first().fps == 5.0
    with pytest.raises(KeyError):
        stores.camera(cameras, "d")
    e = spark.createDataFrame([("s", "c"), ("s", "x")], "store_id string, camera_id string")
    assert stores.with_camera(e.where("camera_id = 'c'"), cameras).count() == 1
    with pytest.raises(PySparkException):
        stores.with_camera(e, cameras).collect()


def test_photos_labels_and_reports(spark, tmp_path):
    for name, data in {"emp-1/a.jpg": b"11", "emp-1/b.PNG": b"2", "emp-1/notes.txt": b"x", "emp-2/c.gif": b"3"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = datasets.enrolment_photos(spark, str(tmp_path / "root"))
    assert sorted((r.employee_id, bytes(r.content)) for r in found.collect()) == [("emp-1", b"11"), ("emp-1", b"2")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "root"))
    assert {r.employee_id: r.photos for r in datasets.photo_counts(files).collect()} == {"emp-1": 2, "emp-2": 0}
    gallery = datasets.enrol(files.select("path", "content"), lambda x: x.map(lambda b: [float(len(b))] if len(b) > 1 else None))
    assert [(r.identity_id, r.embedding) for r in gallery.collect()] == [("emp-1", [2.0])]
    boxes = spark.createDataFrame([("img", 1, (0.0, 0.0, 32.0, 16.0))], "stem string, kind int, box struct<x1:double,y1:double,x2:double,y2:double>")
    lines = boxes.select("stem", datasets.label_line(F.col("kind"), F.col("box"), 64.0, 64.0).alias("line"))
    assert lines.first().line == "1 0.250000 0.125000 0.500000 0.250000"
    datasets.write_labels(lines, str(tmp_path / "labels"))
    back = stores.yolo_labels(spark, str(tmp_path / "labels" / "*")).collect()
    assert [(r["class"], r.cx, r.cy, r.w, r.h) for r in back] == [(1, 0.25, 0.125, 0.5, 0.25)]
    datasets.write_report({"n": lines.groupBy().count()}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": [{"count": 1}]}
    with pytest.raises(ValueError):
        datasets.write_report({"n": lines}, str(tmp_path / "r.json"), most=0)


def test_expansion(spark):
    boxes = spark.createDataFrame([(k, k, (10.0 * k, 5.0, 10.0 * k + 30, 40.0)) for k in range(10)], "image long, id long, box struct<x1:double,y1:double,x2:double,y2:double>")
    out = datasets.expand(boxes, 100.0, 50.0, 4).collect()
    assert len(out) == 40 and all(0 <= r.box.x1 and r.box.x2 <= 100 and 0 <= r.box.y1 and r.box.y2 <= 50 for r in out)
    for r in out:
        area = (r.box.x2 - r.box.x1) * (r.box.y2 - r.box.y1)
        assert r.kept == (area >= 64 and area >= 0.3 * 30 * 35)
    stats = datasets.expansion_stats(boxes, datasets.expand(boxes, 100.0, 50.0, 4), 4).first()
    assert (stats.source_images, stats.written_images, stats.dropped_boxes) == (10, 50, sum(not r.kept for r in out))


def test_hooks(spark):
    frames = spark.createDataFrame([("s", "c", k) for k in range(5)], "store_id string, camera_id string, frame long")

    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            side = batch["frame"].astype(float)
            return batch.assign(x1=0.0, y1=0.0, x2=side, y2=10.0, confidence=0.9 - 0.2 * (batch["frame"] == 4), **{"class": (batch["frame"] == 3).astype("int32")})

        return model

    assert [r.frame for r in hooks.detect_with(frames, load, least=0.8, min_side=1.0).orderBy("frame").collect()] == [1, 2]
    crops = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id long, crop binary")
    out = crops.select("id", hooks.embed_with(lambda s: s.map(lambda b: [float(len(b))]), F.col("crop")).alias("v"), hooks.classify_with(lambda s: pd.DataFrame({"role": ["customer"] * len(s), "confidence": [0.5] * len(s)}), F.col("crop")).alias("r"))
    assert {r.id: (r.v, r.r.role) for r in out.collect()} == {1: ([3.0], "customer"), 2: (None, "customer")}


def test_streamed_health_equals_batch(spark, tmp_path):
    from aisleflow.sources.events import camera_events
    from aisleflow.streaming import jobs

    e = camera_events(spark, "/root/testdata/sf0.001").withColumn("event_time", F.timestamp_seconds("ts"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_health(stream, "1 day", "0 seconds").writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.window.start, r.store_id, r.camera_id)
    got = {key(r): r for r in spark.table("health").collect()}
    want = e.groupBy(F.window("event_time", "1 day"), "store_id", "camera_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("needs_review").cast("int")).alias("r")).collect()
    assert len(got) == len(want)
    assert all(got[key(w)].decisions == w.n and abs(got[key(w)].mean_confidence - w.c) < 1e-5 and abs(got[key(w)].review_ratio - w.r) < 1e-5 for w in want)


def test_heartbeats_keep_the_newest(spark, tmp_path):
    from aisleflow.streaming import jobs

    schema = "store_id string, camera_id string, ts double, note string"
    for k in range(4):
        spark.createDataFrame([("s", "c", float(k), f"n{k}"), ("s", f"d{k}", 0.0, "once")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.upsert_latest(stream, ["store_id", "camera_id"], "ts", str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert kept == ["batch=2", "batch=3"]
    assert sorted((r.camera_id, r.note) for r in spark.read.parquet(str(tmp_path / "t" / "batch=3")).collect()) == [("c", "n3"), *((f"d{k}", "once") for k in range(4))]


def test_posted_batches(spark, tmp_path):
    from aisleflow.streaming import jobs

    spark.createDataFrame([(k, None) for k in range(7)], "id int, note string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = tmp_path / "posted"
    out.mkdir()

    def post(lines):
        import uuid

        (out / uuid.uuid4().hex).write_text("\n".join(lines))

    stream = spark.readStream.schema("id int, note string").parquet(str(tmp_path / "in"))
    jobs.post_batches(stream, post, str(tmp_path / "c"), rows=3).trigger(availableNow=True).start().awaitTermination()
    sent = [p.read_text().splitlines() for p in out.iterdir()]
    assert sorted(map(len, sent)) == [1, 3, 3] and sorted(json.loads(x)["id"] for b in sent for x in b) == list(range(7)) and all("note" in json.loads(x) for b in sent for x in b)
    jobs.writer(stream, "jsonl", str(tmp_path / "c2"), path=str(tmp_path / "lines")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "lines")).count() == 7


def test_similarity_reports_pass_over_unusable_vectors(spark):
    """Null, empty and non-finite vectors, and rows without a label, change no report; other lengths meet their like alone."""
    from aisleflow.operators import blocks, identity

    rng = np.random.default_rng(4)
    rows = [(k, k % 5, rng.normal(size=6).tolist()) for k in range(60)]
    odd = [(100, 1, None), (101, 1, []), (102, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, 2, [float("nan")] + [0.0] * 5), (104, 3, [float("inf")] + [0.0] * 5), (105, None, [1.0] * 6), (None, 1, [1.0] * 6)]
    schema = "vec_id long, label long, embedding array<double>"
    clean, mixed = spark.createDataFrame(rows, schema), spark.createDataFrame(odd[:3] + rows + odd[3:], schema)
    half = lambda df, k: df.where(f"vec_id % 2 = {k} OR vec_id IS NULL")
    reports = [
        lambda df: identity.gallery_top(half(df, 0), half(df, 1), 3), lambda df: identity.role_after_top(half(df, 0), half(df, 1), "g_label % 2 = 0"), lambda df: identity.bands(half(df, 0), half(df, 1), 0.4, 0.3),
        lambda df: identity.rank_metrics(half(df, 0), half(df, 1)), identity.leave_one_out, identity.thresholds,
    ]
    for report in reports:
        assert sorted(map(tuple, report(mixed).collect()), key=str) == sorted(map(tuple, report(clean).collect()), key=str) != []
    assert tuple(blocks.unusable(mixed).first()) == (67, 7) and tuple(blocks.unusable(clean.limit(0)).first()) == (0, 0)
    short = spark.createDataFrame([(k, 9, [1.0, 0.0]) for k in range(200, 204)], schema)
    top = identity.gallery_top(half(clean.unionByName(short), 0), half(clean.unionByName(short), 1), 1).collect()
    assert all((r.g_label == 9) == (r.q >= 200) for r in top) and {200, 202} < {r.q for r in top}
    none = identity.leave_one_out(clean.limit(0)).first()
    assert (none.rank1, none.rank5, none.samples) == (None, None, 0)


def test_boxes_that_overlap_are_found_once_and_few_others_looked_at(spark):
    from aisleflow.operators import spatial

    rng = np.random.default_rng(8)
    # a crowded frame, boxes of all sizes, of the size of the picture, on tiles' borders, of no area, null and non-finite
    rows = [(0, k, (*(c := rng.uniform(-50, 1900, 2).round(int(k % 2))).tolist(), *(c + rng.uniform(1, 60, 2)).tolist())) for k in range(3000)]
    rows += [(1, 5000 + k, (96.0 * k, 0.0, 96.0 * k + 96.0, 96.0)) for k in range(4)] + [(1, 5010, (0.0, 0.0, 2000.0, 1500.0)), (1, 5011, (5.0, 5.0, 5.0, 9.0)), (1, 5012, (9.0, 9.0, 5.0, 5.0)), (1, 5013, (float("nan"), 0.0, 5.0, 5.0)), (1, 5014, None), (2, 6000, (0.0, 0.0, 50.0, 50.0)), (None, 6001, (0.0, 0.0, 50.0, 50.0))]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    one = spark.createDataFrame(rows, f"frame long, a long, p {box}")
    two = one.toDF("frame", "b", "q")
    got = [(r.a, r.b) for r in spatial.overlapping(one, two, ["frame"], "p", "q").where("a < b").collect()]
    fine = [(f, k, x) for f, k, x in rows if f is not None and x and all(np.isfinite(x)) and x[2] > x[0] and x[3] > x[1]]
    x = np.array([b for _, _, b in fine])
    hit = (np.minimum(x[:, None, 2], x[None, :, 2]) > np.maximum(x[:, None, 0], x[None, :, 0])) & (np.minimum(x[:, None, 3], x[None, :, 3]) > np.maximum(x[:, None, 1], x[None, :, 1]))
    want = {(fine[i][1], fine[j][1]) for i, j in zip(*np.nonzero(hit)) if fine[i][1] < fine[j][1] and fine[i][0] == fine[j][0]}
    assert len(got) == len(set(got)) and set(got) == want and {(5000, 5010), (5003, 5010)} < want
    # four times the boxes over four times the place: four times the pairs looked at, not sixteen
    looked = lambda n: spatial.meeting(*(spark.range(n).select(F.lit(0).alias("frame"), F.col("id").alias(i), F.struct((x := F.rand(3) * 20 * n**0.5).alias("x1"), (y := F.rand(4) * 20 * n**0.5).alias("y1"), (x + 30).alias("x2"), (y + 30).alias("y2")).alias(c)) for i, c in (("a", "p"), ("b", "q"))), ["frame"], "p", "q").count()
    few, many = looked(2000), looked(8000)
    assert many < 6 * few and few < 2000 * 2000 / 10
    assert spatial.overlapping(one.limit(0), two, ["frame"], "p", "q").count() == 0


def test_boxes_of_a_calm_frame_meet_once(spark):
    """Boxes that touch many tiles are copied to these only in a crowded frame, and both ways find the same pairs."""
    from aisleflow.operators import spatial

    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    one = spark.createDataFrame([(f, 10 * f + k, (20.0 * k, 0.0, 20.0 * k + 300, 300.0)) for f in range(2) for k in range(3 + 3 * f)], f"frame long, a long, p {box}")
    two = one.toDF("frame", "b", "q")
    assert {r.frame: r["count"] for r in spatial.meeting(one, two, ["frame"], "p", "q", crowd=6).where("frame = 0").groupBy("frame").count().collect()} == {0: 9}
    found = [sorted(map(tuple, spatial.overlapping(one, two, ["frame"], "p", "q", crowd=n).select("a", "b").collect())) for n in (0, 6, 100)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 9 + 36


def test_a_box_that_nothing_hides_is_kept(spark, tmp_path):
    """One box alone, and one behind another that lies elsewhere, are hidden by nothing; one behind a box in front of it goes."""
    from aisleflow.plans import catalog

    lines = [(8, 1, 10, 20.0), (80, 1, 500, 5.0), (80, 2, 100, 5.0), (160, 1, 30, 1.0), (161, 1, 28, 40.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.hidden for r in catalog.occlusion(spark, str(tmp_path)).collect()}
    assert got == {65: 0.0, 641: 0.0, 642: 0.0, 1289: 0.0}


def test_blocks_keep_their_number_as_tables_grow(spark, monkeypatch):
    """A vector travels up to SIDE times whatever the tables' size; hits are ranked in one task or travel, with the same result."""
    from aisleflow.operators import blocks

    assert [blocks._blocks(n) for n in (0, 1024, 1025, 100_000, 2_000_000, 4_000_000)] == [1, 1, 2, 16, 16, 31]
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 4)).round(1) * rng.choice([1.0, 1e4], 90)[:, None]
    v = spark.createDataFrame([(k, k % 7, vectors[k].tolist()) for k in range(90)], "vec_id long, label long, embedding array<double>")
    monkeypatch.setattr(blocks, "BLOCK", 9)
    one = [tuple(identity.rank_metrics(v, v).first()), tuple(identity.leave_one_out(v).first()), tuple(identity.thresholds(v).first())]
    for name, n in (("SIDE", 2), ("TILE", 50), ("WHOLE", 10), ("COUNTED", 1000)):
        monkeypatch.setattr(blocks, name, n)
    assert [tuple(identity.rank_metrics(v, v).first()), tuple(identity.leave_one_out(v).first()), tuple(identity.thresholds(v).first())] == one


def test_a_query_brings_no_list_of_hits_along(spark, monkeypatch):
    from aisleflow.operators import blocks

    monkeypatch.setattr(identity, "travelling_hits", None)
    v = spark.createDataFrame([(k, k % 2, [1.0, 0.01 * k]) for k in range(20)], "vec_id long, label long, embedding array<double>")
    assert identity.rank_metrics(v, v).first().rank1 is not None and blocks.WHOLE > 20


def test_flushes_look_no_frame_up_by_a_window_to_the_end(spark, capsys):
    """A frame at the due time doesn't end a session, the next one does; windows run from the first row, which costs a row each once."""
    rows = [("s", "c", "p", 0, 0.0), ("s", "c", "q", 1, 3.0), ("s", "c", "q", 2, 3.5), ("s", "c", "r", 3, 90_000.0)]
    out = events.flushed(spark.createDataFrame(rows, "store_id string, camera_id string, global_id string, event_id long, ts double"), 3.0)
    assert {r.event_id: r.flush_ts for r in out.collect()} == {0: 3.5, 1: None, 2: 90_000.0, 3: None}
    out.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_presence_does_not_hang_on_the_rows_order(spark):
    """Sums that end in half a tenth are rounded up, in whatever order their parts come."""
    ways = list(itertools.permutations([0.1, 0.2, 0.3, 0.35]))
    assert len({functools.reduce(float.__add__, w) for w in ways}) > 1
    rows = [("s", f"e{k:02}", "c", "z", "seat", 0.0, x, x) for k, way in enumerate(ways) for x in way]
    df = spark.createDataFrame(rows, "store_id string, employee_id string, camera_id string, zone string, zone_kind string, ts double, dwell_seconds double, confidence double").coalesce(1)
    assert {r.seated_s for r in analytics.employee_presence(df).collect()} == {1.0}
    odd = analytics.employee_presence(df.limit(1).withColumn("dwell_seconds", F.lit(float("nan"))).withColumn("confidence", F.lit(None).cast("double"))).first()
    assert odd.seated_s != odd.seated_s and odd.avg_confidence is None


def test_presence_adds_event_after_event(spark):
    """Sums of doubles that end in half a tenth are rounded as those of a scan in the events' order, whichever that is."""
    ways = list(itertools.permutations([0.1, 0.2, 0.3, 0.35, 0.7, 1.1]))
    want = {f"e{k:03}": math.floor(functools.reduce(float.__add__, way) * 10 + 0.5) / 10 for k, way in enumerate(ways)}
    assert len(set(want.values())) == 2
    rows = [("s", f"e{k:03}", "c", "z", "seat", 10 * k + n, 0.0, x, x) for k, way in enumerate(ways) for n, x in enumerate(way)]
    df = spark.createDataFrame(rows[::-1], "store_id string, employee_id string, camera_id string, zone string, zone_kind string, event_id long, ts double, dwell_seconds double, confidence double")
    assert {r.employee_id: r.seated_s for r in analytics.employee_presence(df.repartition(7)).collect()} == want


def test_expansion_keeps_a_box_of_just_the_least_share(spark):
    """The least share is of a box's whole area: boxes of which just three tenths stay in the frame, by a rounding."""
    rows = [(4407, 4407511791, (391.0, 7.0, 434.0, 93.0)), (4407, 4407118488, (488.0, 7.0, 531.0, 93.0)), (66407, 66407718010, (10.0, 7.0, 53.0, 93.0)), (136031, 136031109109, (109.0, 31.0, 152.0, 117.0))]
    df = spark.createDataFrame(rows, "image long, id long, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = {(r.id, r.copy): r.kept for r in datasets.expand(df, 640.0, 480.0, 3).collect()}
    assert {k: got[k] for k in [(4407511791, 3), (4407118488, 3), (66407718010, 2), (136031109109, 1)]} == {(4407511791, 3): True, (4407118488, 3): True, (66407718010, 2): True, (136031109109, 1): True}


def test_carried_samples_by_stretches(spark, monkeypatch):
    """Chunks of any length give the same; a row without a frame is in no stretch, as in the SQL."""
    rows = [("s", "c", 1, f, f % 4 != 0, 100 + f, "customer") for f in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 20, 21)] + [("s", None, 1, 5, True, 5, "customer"), ("s", "c", 1, None, True, 7, "employee")]
    df = spark.createDataFrame(rows, "store_id string, camera_id string, track_id long, frame long, embeddable boolean, sample long, role string")
    told = []
    for chunk in (4096, 3, 1):
        monkeypatch.setattr(events, "CHUNK", chunk)
        told.append(sorted(map(str, events.carried(df).collect())))
    assert told[0] == told[1] == told[2] and len(told[0]) == 13 and not any("frame=None" in r for r in told[0])
    assert {r.frame: (r.carried, r.samples_before) for r in events.carried(df).where("camera_id = 'c'").collect()}[9] == (109, 3)
