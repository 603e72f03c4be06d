"""Queries of the event engine, camera health, identity evaluation and data sets, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import from_measure, letterbox, round_half_away, stride, to_measure, unletterbox
from ..functions.hooks import keep_detections
from ..operators import analytics as A
from ..operators import events as E
from ..operators import health as H
from ..operators import identity as I
from ..sources import datasets as D
from ..sources.events import DUCK_ADAPTER, camera_events, flatten
from ..sources.stores import newest_vectors, store_tables, with_camera

DAY = 86_400.0
GAP = 3 * DAY
ZONES = (("shelf-a", "shelf", 0, 60), ("seat-1", "seat", 40, 100), ("area-1", "area", 20, 80))


def R(x: str, n: int) -> str:
    return f"round(({x}) * {10**n}.0::DOUBLE, 0) / {10**n}.0::DOUBLE"


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Cameras and zones of three stores of four cameras, whose zones are bands of the frame that overlap."""
    polygon = lambda lo, hi: [(lo, 0), (hi, 0), (hi, 100), (lo, 100)]
    parts = [
        store_tables(spark, {"store_id": f"store-{s}", "cameras": [{"camera_id": f"cam-{c}", "width": 640 + 64 * c, "fps": 5 + c, "zones": [{"name": z, "kind": k, "polygon": polygon(lo, hi)} for z, k, lo, hi in ZONES]} for c in range(4)]})
        for s in range(3)
    ]
    cameras, zones = parts[0]
    for c, z in parts[1:]:
        cameras, zones = cameras.unionByName(c), zones.unionByName(z)
    return cameras, zones


def zone_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_events(spark, sf_dir).select("store_id", "camera_id", "global_id", "event_id", "ts", "role", "employee_id", "confidence", "needs_review", F.col("k").cast("double").alias("x"), (F.col("confidence") * 100).alias("y"))


def zones(spark: SparkSession) -> DataFrame:
    return tables(spark)[1].select("store_id", "camera_id", "zone", "kind", "polygon")


def as_lines(events: DataFrame) -> DataFrame:
    """Events with their payloads, read again as a sink's lines are."""
    frames = F.get_json_object("payload", "$.frames").cast("int")
    return flatten(events.withColumnRenamed("ts", "timestamp")).withColumn("frames", frames).drop("payload")


def zone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(E.zone_events(zone_observations(spark, sf_dir), zones(spark), GAP, min_dwell=DAY))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detections: an order is a frame of one of six cameras, which hold 1,000 orders in a row."""
    x1, y1 = (F.col("l_partkey") % 600).cast("double"), (F.col("l_orderkey") % 400).cast("double")
    q, block = F.col("l_quantity"), F.floor(F.col("l_orderkey") / 1000)
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 10 + q).alias("x2"), (y1 + 20 + 2 * q).alias("y2"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("store-"), block % 3).alias("store_id"), F.concat(F.lit("cam-"), block % 2).alias("camera_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("id"), box.alias("box"), (F.col("l_partkey") % 101 / 100).alias("confidence"), (F.col("l_suppkey") % 7 == 0).alias("needs_review"), F.col("l_quantity").alias("q"), block.alias("chunk"),
    )


LINES = "(SELECT concat('store-', CAST(floor(l_orderkey / 1000) AS BIGINT) % 3) AS store_id, concat('cam-', CAST(floor(l_orderkey / 1000) AS BIGINT) % 2) AS camera_id, l_orderkey AS frame, l_linenumber AS track_id, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_orderkey % 400 AS DOUBLE) AS y1, CAST(l_partkey % 600 AS DOUBLE) + 10 + l_quantity AS x2, CAST(l_orderkey % 400 AS DOUBLE) + 20 + 2 * l_quantity AS y2, CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence, l_suppkey % 7 = 0 AS needs_review, l_quantity AS q FROM lineitem)"


def camera_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir)
    frames = d.groupBy("store_id", "camera_id", "frame", "chunk").agg((F.sum("q") / 1000).alias("latency"))
    return H.camera_health(frames, d)


SAMPLES = 30


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples of six cameras, in the order of their ids."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.concat(F.lit("store-"), F.col("vec_id") % 3).alias("store_id"), F.concat(F.lit("cam-"), F.col("vec_id") % 2).alias("camera_id"), F.col("vec_id").alias("n"), "embedding")


def camera_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras' health with their events and drift, a camera's first 30 samples being its measure."""
    return H.camera_report(camera_health(spark, sf_dir), camera_events(spark, sf_dir), samples(spark, sf_dir), SAMPLES)


def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, events and samples of camera_report as one table of rows with times, as streams bring them: a frame, a sample
    and an event for each second."""
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda c: F.timestamp_seconds(c + 1_000_000)
    d = _lines(spark, sf_dir).select("store_id", "camera_id", F.lit("detection").alias("kind"), "frame", "id", (F.col("q") / 1000).alias("latency"), "confidence", "needs_review", none("array<float>").alias("embedding"), at(F.col("frame")).alias("event_time"))
    e = camera_events(spark, sf_dir).select("store_id", "camera_id", F.lit("event").alias("kind"), none("long").alias("frame"), F.col("event_id").alias("id"), none("double").alias("latency"), none("double").alias("confidence"), none("boolean").alias("needs_review"), none("array<float>").alias("embedding"), at(F.col("event_id")).alias("event_time"))
    v = samples(spark, sf_dir).select("store_id", "camera_id", F.lit("sample").alias("kind"), none("long").alias("frame"), F.col("n").alias("id"), none("double").alias("latency"), none("double").alias("confidence"), none("boolean").alias("needs_review"), "embedding", at(F.col("n")).alias("event_time"))
    return d.unionByName(e).unionByName(v).withColumn("digest", F.xxhash64("kind", "id"))


def person_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).withColumn("ts", F.col("frame") / 10)
    own = d.select("*", F.concat(F.lit("person-"), F.col("track_id")).alias("global_id"), F.lit("customer").alias("role"), F.lit(None).cast("string").alias("employee_id"))
    out = E.person_seen(own)
    at = lambda n: F.get_json_object("payload", f"$.bbox[{n}]").cast("double")
    return out.select("event_type", "store_id", "camera_id", "ts", "global_id", "confidence", F.get_json_object("payload", "$.needs_review").alias("needs_review"), *[at(n).alias(c) for n, c in enumerate(("x1", "y1", "x2", "y2"))])


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frame of a track, its line of the smallest id."""
    d = _lines(spark, sf_dir).groupBy("store_id", "camera_id", "track_id", "frame").agg(F.min("id").alias("sample"))
    role = F.when(F.col("sample") % 3 == 0, "employee").otherwise("customer")
    return E.carried(d.select("*", (F.col("sample") % 5 != 0).alias("embeddable"), role.alias("role")))


def identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as matched frames: each 20th is given its zone as id, each 9th the wrong role, each 11th of the staff no name."""
    staff, e = F.col("role") == "employee", F.col("event_id")
    return camera_events(spark, sf_dir).select(
        F.col("global_id").alias("name"), F.when(e % 20 == 0, F.coalesce("zone", F.lit("none"))).otherwise(F.col("global_id")).alias("gid"),
        staff.alias("is_employee"), F.when(e % 9 == 0, ~staff).otherwise(staff).alias("said_employee"), F.when(e % 11 == 0, None).when(e % 13 == 0, "emp-x").otherwise(F.col("employee_id")).alias("employee_id"),
    )


PAIRS = "p AS (SELECT global_id AS name, CASE WHEN event_id % 20 = 0 THEN coalesce(zone, 'none') ELSE global_id END AS gid, role = 'employee' AS is_employee, CASE WHEN event_id % 9 = 0 THEN role <> 'employee' ELSE role = 'employee' END AS said, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'emp-x' ELSE employee_id END AS employee_id FROM ev)"


def spoilt(events: DataFrame) -> DataFrame:
    """Events that were spoilt in known ways."""
    out = events.withColumn("store_id", F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("store_id"))).withColumn("ts", F.when(F.col("event_id") % 19 == 0, None).otherwise(F.col("ts")))
    return out.withColumn("confidence", F.when(F.col("event_id") % 23 == 0, F.col("confidence") + 1.5).otherwise(F.col("confidence")))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the spoilt events have each fault."""
    return E.checked(spoilt(camera_events(spark, sf_dir))).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def camera_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_camera(camera_events(spark, sf_dir), tables(spark)[0])
    return found.groupBy("store_id", "camera_id", "width", "fps").agg(F.count("*").alias("events"))


def frame_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that a source of 25 frames a second gives at 10, with their times."""
    step = stride(None, 10.0)
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("frame")).where(F.col("frame") % step == 0)
    return frames.select("frame", (F.col("frame") / 25).alias("ts"))


def boxes_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in the letterbox, and back from it and from their measures."""
    d = _lines(spark, sf_dir).select("id", "box", letterbox(F.col("box"), 640, 480, 320).alias("l"), from_measure(to_measure(F.col("box"))).alias("m"))
    back = d.withColumn("u", unletterbox(F.col("l"), 640, 480, 320))
    r = lambda c: round_half_away(F.col(c), 4)
    return back.select("id", r("l.cx").alias("cx"), r("l.cy").alias("cy"), r("l.w").alias("w"), r("l.h").alias("h"), r("u.x2").alias("x2"), r("u.y2").alias("y2"), r("m.x1").alias("x1"), r("m.y1").alias("y1"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir)
    return d.select("id", D.label_line(F.col("track_id"), F.col("box"), 1024.0, 1024.0).alias("line"))


def dataset_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).select(F.col("frame").alias("image"), "id", "box")
    return D.expansion_stats(d, D.expand(d, 640.0, 480.0, 3), 3)


def _photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    end = F.when(F.col("vec_id") % 5 == 0, ".txt").when(F.col("vec_id") % 3 == 0, ".PNG").otherwise(".jpg")
    return v.select(F.concat(F.lit("enrol/emp-"), "label", F.lit("/"), "vec_id", end).alias("path"), "vec_id")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _photo_files(spark, sf_dir)
    labels = files.where("vec_id % 2 = 0").select(F.regexp_replace("path", r"\.[^.]*$", ".txt").alias("path"))
    return D.pair_labels(files, labels).select("image", "labels")


def detections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).select("store_id", "camera_id", "frame", "id", "box.*", "confidence", (F.col("track_id") % 2).alias("class"))
    return keep_detections(d, 0.4, 0, 4.0, 900.0).select("store_id", "camera_id", "frame", "id", "confidence")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("identity_id", F.concat(F.lit("id-"), "label"))
    held = newest_vectors(v, "identity_id", "vec_id", 20).groupBy("identity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("embeddings"))
    return D.flat_gallery(held).select("identity_id", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


_on_events = lambda f: lambda spark, sf_dir: f(camera_events(spark, sf_dir))

QUERIES = {
    "zone_events": zone_events,
    "camera_health": camera_health,
    "camera_report": camera_report,
    "camera_gauges": lambda s, d: H.gauges(camera_report(s, d)),
    "person_seen": person_seen,
    "embedding_carry": carried,
    "identity_accuracy": lambda s, d: I.identity_accuracy(identity_pairs(s, d)),
    "ids_per_person": lambda s, d: I.ids_per_person(identity_pairs(s, d)),
    "ingest_quarantine": quarantine,
    "review_queue_size": _on_events(A.review_queue_size),
    "camera_lookup": camera_lookup,
    "frame_clock": frame_clock,
    "box_letterbox": boxes_there_and_back,
    "label_lines": label_lines,
    "dataset_expansion": dataset_expansion,
    "photo_counts": lambda s, d: D.photo_counts(_photo_files(s, d)),
    "label_pairs": label_pairs,
    "detections_kept": detections_kept,
    "gallery_flat": _flat,
}


def _ev(sql: str) -> str:
    return f"WITH ev AS ({DUCK_ADAPTER}), {sql}"


_HEALTH = f"""d AS (SELECT * FROM {LINES}), f AS (SELECT store_id, camera_id, frame, sum(q) / 1000 AS latency, count(*) AS people FROM d GROUP BY ALL),
 l AS (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY frame DESC) AS r FROM f), c AS (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY frame DESC, id DESC) AS r FROM d),
 a AS (SELECT store_id, camera_id, count(*) AS frames, {R('quantile_cont(latency, 0.5) FILTER (WHERE r <= 300)', 6)} AS latency_p50, {R('quantile_cont(latency, 0.95) FILTER (WHERE r <= 300)', 6)} AS latency_p95, {R('avg(people) FILTER (WHERE r <= 300)', 6)} AS mean_people FROM l GROUP BY ALL),
 b AS (SELECT store_id, camera_id, {R('avg(confidence) FILTER (WHERE r <= 300)', 6)} AS mean_confidence, count(*) AS decisions, {R('count(*) FILTER (WHERE needs_review) / count(*)', 6)} AS review_ratio FROM c GROUP BY ALL), h AS (SELECT * FROM a JOIN b USING (store_id, camera_id))"""
_SAMPLED = f"""vs AS (SELECT concat('store-', vec_id % 3) AS store_id, concat('cam-', vec_id % 2) AS camera_id, embedding, row_number() OVER w AS n, row_number() OVER (PARTITION BY vec_id % 6 ORDER BY vec_id DESC) AS back, count(*) OVER (PARTITION BY vec_id % 6) AS held FROM embeddings WINDOW w AS (PARTITION BY vec_id % 6 ORDER BY vec_id)),
 us AS (SELECT store_id, camera_id, held, n <= {SAMPLES} AS early, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM vs WHERE n <= {SAMPLES} OR back <= {SAMPLES}),
 ms AS (SELECT store_id, camera_id, held, pos, avg(x) FILTER (WHERE early) AS a, avg(x) FILTER (WHERE NOT early) AS b FROM us GROUP BY ALL),
 far AS (SELECT store_id, camera_id, CASE WHEN held >= {SAMPLES} + 10 THEN {R('1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))', 4)} END AS drift FROM ms GROUP BY store_id, camera_id, held)"""
_REPORT = f"""{_HEALTH}, {_SAMPLED}, ev AS ({DUCK_ADAPTER}), t AS (SELECT store_id, camera_id, count(*) AS events FROM ev GROUP BY ALL),
 rep AS (SELECT h.*, coalesce(events, 0) AS events, drift FROM h LEFT JOIN t USING (store_id, camera_id) LEFT JOIN far USING (store_id, camera_id))"""
_FILES = "f AS (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN '.txt' WHEN vec_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS e FROM embeddings)"
_ZONE_ROWS = ", ".join(f"('{z}', '{k}', {lo}, {hi})" for z, k, lo, hi in ZONES)
#: A step machine, one observation after another; sessions and flushes from the frames' times themselves.
_ZONE_EVENTS = "WITH RECURSIVE ev AS (" + DUCK_ADAPTER + f"""),
f AS (SELECT DISTINCT store_id, camera_id, ts FROM ev), z(zone, kind, lo, hi) AS (VALUES {_ZONE_ROWS}),
g AS (SELECT *, lead(ts) OVER (PARTITION BY store_id, camera_id, global_id ORDER BY ts, event_id) AS nxt FROM ev),
u AS (SELECT g.*, (SELECT min(f.ts) FROM f WHERE f.store_id = g.store_id AND f.camera_id = g.camera_id AND f.ts > g.ts + {GAP}) AS flush FROM g),
s AS (SELECT *, CASE WHEN nxt IS NULL OR flush < nxt THEN flush END AS gone FROM u),
t AS (SELECT *, coalesce(sum(CASE WHEN gone IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY store_id, camera_id, global_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM s),
o AS (SELECT t.*, z.zone AS zn, z.kind, t.k BETWEEN z.lo AND z.hi AS inside, row_number() OVER (PARTITION BY t.store_id, t.camera_id, t.global_id, t.session, z.zone ORDER BY t.ts, t.event_id) AS n, count(*) OVER (PARTITION BY t.store_id, t.camera_id, t.global_id, t.session, z.zone) AS total FROM t CROSS JOIN z),
m AS (SELECT DISTINCT store_id, camera_id, global_id, session, zn, kind, 0::BIGINT AS n, false AS is_in, 0 AS i, 0 AS x, NULL::DOUBLE AS since, false AS fired, false AS came, false AS act, false AS went, NULL::DOUBLE AS began, NULL::BIGINT AS event_id, NULL::DOUBLE AS ts FROM o
UNION ALL SELECT o.store_id, o.camera_id, o.global_id, o.session, o.zn, o.kind, o.n,
  CASE WHEN o.inside THEN m.is_in OR m.i + 1 >= 2 ELSE m.is_in AND m.x + 1 < 4 END, CASE WHEN o.inside THEN m.i + 1 ELSE 0 END, CASE WHEN o.inside THEN 0 ELSE m.x + 1 END,
  CASE WHEN o.inside AND NOT m.is_in AND m.i + 1 >= 2 THEN o.ts ELSE m.since END,
  CASE WHEN o.inside AND NOT m.is_in AND m.i + 1 >= 2 THEN false ELSE m.fired END OR (o.kind = 'shelf' AND o.inside AND (m.is_in OR m.i + 1 >= 2) AND m.i + 1 >= 6),
  o.inside AND NOT m.is_in AND m.i + 1 >= 2, o.kind = 'shelf' AND o.inside AND (m.is_in OR m.i + 1 >= 2) AND m.i + 1 >= 6 AND NOT (m.fired AND m.is_in), NOT o.inside AND m.is_in AND m.x + 1 >= 4, m.since, o.event_id, o.ts
  FROM m JOIN o ON o.store_id = m.store_id AND o.camera_id = m.camera_id AND o.global_id = m.global_id AND o.session = m.session AND o.zn = m.zn AND o.n = m.n + 1),
w AS (SELECT m.*, o.role, o.employee_id, o.confidence, o.needs_review, o.gone, o.n = o.total AS final FROM m JOIN o USING (event_id, zn)),
x AS (SELECT *, ts AS t, CASE WHEN kind = 'seat' THEN 'seat_occupied' ELSE 'zone_entered' END AS event_type, NULL::DOUBLE AS dw, NULL::INTEGER AS frames FROM w WHERE came
 UNION ALL SELECT *, ts, 'product_interaction', NULL, i FROM w WHERE act
 UNION ALL SELECT *, ts, CASE WHEN kind = 'seat' THEN 'seat_released' ELSE 'zone_exited' END, ts - began, NULL FROM w WHERE went
 UNION ALL SELECT *, ts, 'dwell', ts - began, NULL FROM w WHERE went AND ts - began >= {DAY}
 UNION ALL SELECT *, gone, CASE WHEN kind = 'seat' THEN 'seat_released' ELSE 'zone_exited' END, gone - since, NULL FROM w WHERE final AND is_in AND gone IS NOT NULL
 UNION ALL SELECT *, gone, 'dwell', gone - since, NULL FROM w WHERE final AND is_in AND gone IS NOT NULL AND gone - since >= {DAY})
SELECT event_type, store_id, camera_id, t AS ts, global_id, role, zn AS zone, kind AS zone_kind, employee_id, confidence, needs_review, round(dw, 3) AS dwell_seconds, frames FROM x"""

SQL = {
    "zone_events": _ZONE_EVENTS,
    "camera_health": f"WITH {_HEALTH} SELECT * FROM h",
    "camera_report": f"WITH {_REPORT} SELECT * FROM rep",
    # the gauges from the rows themselves: sorted lists in place of quantiles, and means of slices
    "camera_gauges": f"""WITH {_SAMPLED}, d AS (SELECT * FROM {LINES}), f AS (SELECT store_id, camera_id, frame, sum(q) / 1000 AS latency, count(*) AS people FROM d GROUP BY ALL),
 n AS (SELECT store_id, camera_id, list(latency ORDER BY frame DESC)[:300] AS l, list(people ORDER BY frame DESC)[:300] AS p FROM f GROUP BY ALL),
 s AS (SELECT store_id, camera_id, list_sort(l) AS l, p, len(l) AS k FROM n), r AS (SELECT store_id, camera_id, avg(CASE WHEN needs_review THEN 1.0::DOUBLE ELSE 0 END) AS review FROM d GROUP BY ALL)
 SELECT store_id, camera_id, 'latency_p50' AS metric, {R('(l[(k + 1) // 2] + l[k // 2 + 1]) / 2', 6)} AS value FROM s UNION ALL SELECT store_id, camera_id, 'mean_people', {R('list_sum(p)::DOUBLE / len(p)', 6)} FROM s
 UNION ALL SELECT store_id, camera_id, 'review_ratio', {R('review', 6)} FROM r UNION ALL SELECT store_id, camera_id, 'drift', drift FROM far JOIN s USING (store_id, camera_id) WHERE drift IS NOT NULL""",
    "person_seen": f"SELECT 'person_seen' AS event_type, store_id, camera_id, frame / 10 AS ts, concat('person-', track_id) AS global_id, confidence, needs_review::VARCHAR AS needs_review, round(x1, 1) AS x1, round(y1, 1) AS y1, round(x2, 1) AS x2, round(y2, 1) AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id, track_id ORDER BY frame, id) AS r FROM {LINES}) WHERE r = 1",
    "embedding_carry": f"WITH d AS (SELECT store_id, camera_id, track_id, frame, min(id) AS sample FROM {LINES} GROUP BY ALL), "
    "b AS (SELECT *, sample % 5 <> 0 AS ok, CASE WHEN sample % 3 = 0 THEN 'employee' ELSE 'customer' END AS role, frame - row_number() OVER (PARTITION BY store_id, camera_id, track_id ORDER BY frame) AS island FROM d), "
    "f AS (SELECT *, min(CASE WHEN ok THEN frame END) OVER (PARTITION BY store_id, camera_id, track_id, island) AS first_ok FROM b), "
    "s AS (SELECT * FROM f WHERE ok AND (frame % 3 = 0 OR frame = first_ok)), "
    "p AS (SELECT f.store_id, f.camera_id, f.track_id, f.frame, s.sample, s.role, s.frame AS taken_at, row_number() OVER (PARTITION BY f.store_id, f.camera_id, f.track_id, f.frame ORDER BY s.frame DESC) AS back, count(*) OVER (PARTITION BY f.store_id, f.camera_id, f.track_id, f.frame) AS held FROM f JOIN s ON s.store_id = f.store_id AND s.camera_id = f.camera_id AND s.track_id = f.track_id AND s.island = f.island AND s.frame <= f.frame), "
    "v AS (SELECT store_id, camera_id, track_id, frame, role, count(*) AS votes, min(taken_at) AS early FROM p WHERE back <= 5 GROUP BY ALL), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id, track_id, frame ORDER BY votes DESC, early) AS r FROM v) "
    "SELECT p.store_id, p.camera_id, p.track_id, p.frame, p.sample AS carried, w.role AS vote, (p.held - 1)::INTEGER AS samples_before FROM p JOIN w USING (store_id, camera_id, track_id, frame) WHERE p.back = 1 AND w.r = 1",
    "identity_accuracy": _ev(f"{PAIRS}, c AS (SELECT name, gid, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT name, sum(n) AS t FROM c GROUP BY name), fr AS (SELECT name, count(*) FILTER (WHERE n >= 0.02 * t) AS ids FROM c JOIN t USING (name) GROUP BY name) SELECT count(*) AS matched_frames, {R('(SELECT sum(top) FROM (SELECT max(n) AS top FROM c GROUP BY gid)) / count(*)', 3)} AS purity, {R('(SELECT avg(ids) FROM fr)', 3)} AS mean_fragmentation, {R('avg((is_employee = said)::INTEGER)', 3)} AS role_accuracy, {R('count(*) FILTER (WHERE is_employee AND employee_id = name) / count(*) FILTER (WHERE is_employee)', 3)} AS employee_id_accuracy, {R('count(*) FILTER (WHERE is_employee AND employee_id IS NULL) / count(*) FILTER (WHERE is_employee)', 3)} AS employee_unknown_ratio FROM p"),
    "ids_per_person": _ev(f"{PAIRS} SELECT name, string_agg(gid, ',' ORDER BY n DESC, gid) AS ids FROM (SELECT name, gid, count(*) AS n FROM p GROUP BY ALL) GROUP BY name"),
    "ingest_quarantine": _ev("q AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'store_id is missing' WHEN event_id % 19 = 0 THEN 'ts is missing' WHEN event_id % 23 = 0 THEN 'confidence is out of range' ELSE 'none' END AS fault FROM ev) SELECT fault, count(*) AS n FROM q GROUP BY fault"),
    "review_queue_size": _ev("q AS (SELECT 1 FROM ev WHERE needs_review AND event_type = 'person_seen') SELECT least(count(*), 1000) AS n FROM q"),
    "camera_lookup": _ev("c AS (SELECT *, (right(camera_id, 1))::INTEGER AS no FROM ev) SELECT store_id, camera_id, (640 + 64 * no)::DOUBLE AS width, (5 + no)::DOUBLE AS fps, count(*) AS events FROM c GROUP BY store_id, camera_id, no"),
    "frame_clock": "SELECT o_orderkey AS frame, o_orderkey / 25 AS ts FROM orders WHERE o_orderkey % 2 = 0",
    "box_letterbox": f"SELECT id, {R('(x1 + x2) / 2 * 0.5', 4)} AS cx, {R('(y1 + y2) / 2 * 0.5', 4)} AS cy, {R('(x2 - x1) * 0.5', 4)} AS w, {R('(y2 - y1) * 0.5', 4)} AS h, {R('least(640, x2)', 4)} AS x2, {R('least(480, y2)', 4)} AS y2, {R('x1', 4)} AS x1, {R('y1', 4)} AS y1 FROM {LINES}",
    "label_lines": f"SELECT id, printf('%d %.6f %.6f %.6f %.6f', track_id, (x1 + x2) / 2048, (y1 + y2) / 2048, (x2 - x1) / 1024, (y2 - y1) / 1024) AS line FROM {LINES}",
    "dataset_expansion": f"""WITH b AS (SELECT frame, x1, y1, x2, y2, unnest([1, 2, 3]) AS copy FROM {LINES}),
m AS (SELECT *, (('0x' || substr(md5(concat(frame, ':', copy, ':1')), 1, 7))::BIGINT % 41 - 20) / 100.0::DOUBLE * 640 AS dx, (('0x' || substr(md5(concat(frame, ':', copy, ':2')), 1, 7))::BIGINT % 41 - 20) / 100.0::DOUBLE * 480 AS dy FROM b),
p AS (SELECT *, CASE WHEN copy % 2 = 1 THEN 640 - x2 ELSE x1 END + dx AS nx, y1 + dy AS ny, x2 - x1 AS w, y2 - y1 AS h FROM m),
a AS (SELECT (least(640, greatest(0, nx + w)) - least(640, greatest(0, nx))) * (least(480, greatest(0, ny + h)) - least(480, greatest(0, ny))) AS area, w * h AS whole FROM p)
SELECT (SELECT count(DISTINCT frame) FROM {LINES}) AS source_images, (SELECT count(DISTINCT frame) FROM {LINES}) * 4 AS written_images, count(*) FILTER (WHERE NOT (area >= 64 AND area >= 0.3::DOUBLE * w0)) AS dropped_boxes FROM (SELECT area, whole AS w0 FROM a)""",
    "photo_counts": f"WITH {_FILES} SELECT concat('emp-', label) AS employee_id, count(*) FILTER (WHERE e <> '.txt') AS photos FROM f GROUP BY label",
    "label_pairs": f"WITH {_FILES} SELECT concat('enrol/emp-', label, '/', vec_id, e) AS image, CASE WHEN vec_id % 2 = 0 THEN concat('enrol/emp-', label, '/', vec_id, '.txt') END AS labels FROM f WHERE e <> '.txt'",
    "detections_kept": f"SELECT store_id, camera_id, frame, id, confidence FROM {LINES} WHERE confidence >= 0.4 AND track_id % 2 = 0 AND x2 - x1 >= 4 AND y2 - y1 >= 4 AND (x2 - x1) * (y2 - y1) >= 900",
    "gallery_flat": "SELECT concat('id-', label) AS identity_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 20",
}
