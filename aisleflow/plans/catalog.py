"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import area, clip_box, foot_point, intersection, l2_normalise, quality_ok, role_by_colour, round_half_away, to_measure
from ..operators import analytics as A
from ..operators import events as E
from ..operators import identity as I
from ..operators import resolver as R_
from ..operators import spatial as S
from ..operators import tracking as T
from ..operators import zones as Z
from ..sources.events import DUCK_ADAPTER, camera_events, shared_dir
from ..sources.stores import newest_vectors
from ..streaming import jobs as J
from ..streaming import live as L
from . import engine

DAY = 86_400.0


def _on_events(f, *args, **kwargs):
    return lambda spark, sf_dir: f(camera_events(spark, sf_dir), *args, **kwargs)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _on_split(f, *args, **kwargs):
    """Even vectors are the queries, odd ones the gallery."""

    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir)
        return f(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), *args, **kwargs)

    return run


def _on_vectors(f, *args, **kwargs):
    return lambda spark, sf_dir: f(_vectors(spark, sf_dir), *args, **kwargs)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_events(spark, sf_dir).select("store_id", "camera_id", "global_id", "event_id", "ts", (F.col("k") < 50).alias("inside"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order line, in a frame for each supplier and day of order key."""
    x1, y1 = (F.col("l_partkey") % 600).cast("double"), (F.col("l_orderkey") % 400).cast("double")
    w, h = (10 + F.col("l_quantity")).cast("double"), (20 + 2 * F.col("l_quantity")).cast("double")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_orderkey") / 8).alias("frame"), box.alias("box"))


BOXES = "(SELECT l_orderkey * 8 + l_linenumber AS id, CAST(floor(l_orderkey / 8) AS BIGINT) AS frame, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_orderkey % 400 AS DOUBLE) AS y1, CAST(l_partkey % 600 AS DOUBLE) + 10 + l_quantity AS x2, CAST(l_orderkey % 400 AS DOUBLE) + 20 + 2 * l_quantity AS y2 FROM lineitem)"
INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
IOU = f"({INTER} / ({AREA.format('a')} + {AREA.format('b')} - {INTER}))"


def _two(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The boxes, with other names for id and box."""
    return boxes(spark, sf_dir).select("frame", F.col("id").alias(names[0]), F.col("box").alias(names[1]))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.overlapping(_two(spark, sf_dir, "a", "ab"), _two(spark, sf_dir, "b", "bb"), ["frame"], "ab", "bb").where("a < b")
    # the boxes have an area, and their pairs share one. What rounds to 0 goes before it is rounded: Spark puts the last filter
    # into the join, where it is computed for all pairs of a frame, and rounding is dear
    a, b, both = F.col("ab"), F.col("bb"), intersection(F.col("ab"), F.col("bb"))
    size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    over = both / (size(a) + size(b) - both)
    return pairs.where(over * 1e6 >= 0.5).select("frame", "a", "b", round_half_away(over, 6).alias("iou"))


def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest share of a box that boxes nearer to the camera hide; boxes hidden beyond 0.7 go."""
    own, other = _two(spark, sf_dir, "id", "box"), _two(spark, sf_dir, "o", "ob")
    pairs = S.overlapping(own, other, ["frame"], "box", "ob").where((F.col("id") != F.col("o")) & (F.col("ob.y2") > F.col("box.y2")))
    share = pairs.select("id", (intersection(F.col("box"), F.col("ob")) / area(F.col("box"))).alias("part"))
    # a box that nothing overlaps is hidden by nothing
    every = share.unionByName(own.select("id", F.lit(0.0).alias("part")))
    return every.groupBy("id").agg(round_half_away(F.max("part"), 6).alias("hidden")).where("hidden <= 0.7")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("id", quality_ok(F.col("box"), 640.0, 480.0).alias("ok"))


def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spark.createDataFrame(
        [("store-0", "cam-0", "entrance", [(0.0, 0.0), (120.0, 0.0), (120.0, 480.0), (0.0, 480.0)]), ("store-0", "cam-0", "shelf", [(200.0, 40.0), (320.0, 40.0), (260.0, 140.0)]), ("store-0", "cam-1", "seat", [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (200.0, 200.0), (100.0, 300.0)])],
        "store_id string, camera_id string, zone string, polygon array<struct<x:double,y:double>>",
    )
    b = boxes(spark, sf_dir)
    points = b.select("id", F.lit("store-0").alias("store_id"), F.concat(F.lit("cam-"), F.col("id") % 2).alias("camera_id"), foot_point(F.col("box")).alias("p")).select("id", "store_id", "camera_id", "p.x", "p.y")
    return Z.in_zones(points, zones).where("inside").select("id", "camera_id", "zone")


IN_ZONE = """
WITH z(camera_id, zone, i, ax, ay, bx, byy) AS (VALUES
 ('cam-0','entrance',1,0.0,0.0,120.0,0.0),('cam-0','entrance',2,120.0,0.0,120.0,480.0),('cam-0','entrance',3,120.0,480.0,0.0,480.0),('cam-0','entrance',4,0.0,480.0,0.0,0.0),
 ('cam-0','shelf',1,200.0,40.0,320.0,40.0),('cam-0','shelf',2,320.0,40.0,260.0,140.0),('cam-0','shelf',3,260.0,140.0,200.0,40.0),
 ('cam-1','seat',1,100.0,100.0,300.0,100.0),('cam-1','seat',2,300.0,100.0,300.0,300.0),('cam-1','seat',3,300.0,300.0,200.0,200.0),('cam-1','seat',4,200.0,200.0,100.0,300.0),('cam-1','seat',5,100.0,300.0,100.0,100.0)),
e AS (SELECT camera_id, zone, ax::DOUBLE ax, ay::DOUBLE ay, bx::DOUBLE bx, byy::DOUBLE byy FROM z),
p AS (SELECT id, row_number() OVER () AS r, concat('cam-', id % 2) AS camera_id, (x1 + x2) / 2 AS x, y2 AS y FROM """ + BOXES + """),
t AS (SELECT p.id, p.r, p.camera_id, e.zone,
  bool_or((bx-ax)*(y-ay) - (byy-ay)*(x-ax) = 0 AND x BETWEEN least(ax,bx) AND greatest(ax,bx) AND y BETWEEN least(ay,byy) AND greatest(ay,byy)) AS edge,
  sum(CASE WHEN (ay > y) <> (byy > y) AND x < (bx-ax)*(y-ay)/(byy-ay)+ax THEN 1 ELSE 0 END) AS n
 FROM p JOIN e USING (camera_id) GROUP BY p.id, p.r, p.camera_id, e.zone, x, y)
SELECT id, camera_id, zone FROM t WHERE edge OR n % 2 = 1
"""


def identity_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = camera_events(spark, sf_dir).select(F.col("global_id").alias("name"), F.when(F.col("event_id") % 20 == 0, F.concat("zone", F.lit("-x"))).otherwise(F.col("global_id")).alias("gid"))
    return I.identity_report(pairs.where("gid IS NOT NULL"))


def truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return I.best_overlaps(b.where("id % 2 = 0").select("frame", F.col("id").alias("pred"), "box"), b.where("id % 2 = 1").select("frame", F.col("id").alias("gt"), F.col("box").alias("gt_box")), 0.05)


MAX_STAFF = 1000
VISIT_KEYS = ["store_id", "global_id"]
DEDUP_KEYS = ["global_id", "event_type", "zone"]

def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detections of a few cameras for each store: 8 orders make a frame, lines are its boxes."""
    b = boxes(spark, sf_dir)
    return b.select(F.concat(F.lit("store-"), F.col("frame") % 3).alias("store_id"), F.concat(F.lit("cam-"), F.col("frame") % 4).alias("camera_id"), F.floor(F.col("frame") / 12).alias("frame"), "id", "box")


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("confidence", (F.col("id") * 37 % 101) / F.lit(100.0))
    return T.suppress(d, ["store_id", "camera_id", "frame"], 0.4, 0.2).select("store_id", "camera_id", "frame", "id", "confidence")


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of cameras that rest for 40 frames after each 50."""
    d = _detections(spark, sf_dir).select("store_id", "camera_id", "frame", "id", "box.*")
    return d.withColumn("frame", F.col("frame") + 40 * F.floor(F.col("frame") / 50))


def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.track(shifts(spark, sf_dir), overlap=0.1)


def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks from a stream in several micro-batches, with late rows."""
    timed = shifts(spark, sf_dir).withColumn("event_time", F.timestamp_seconds(F.col("frame") + 1_000_000))
    return _streamed(L.tracks(_replayed(timed, "id"), overlap=0.1), "tracks")


def _staff(spark: SparkSession, sf_dir: str) -> dict[str, list]:
    """The first vector of each even label, as the enrolled staff."""
    v = _vectors(spark, sf_dir)
    staff = v.where("label % 2 = 0").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).limit(MAX_STAFF + 1).collect()  # labels are the staff: a bounded list
    if len(staff) > MAX_STAFF:
        raise ValueError(f"more than {MAX_STAFF} enrolled staff")
    return {f"emp-{r['label']}": [r["e"]] for r in staff}


def seen_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as what three stores' cameras see: 120 are ten frames of half a second, of up to six tracks on each of two
    cameras; each seventh vector is a track that has no embedding, each eleventh isn't seen. A store is seen again after ten
    seconds, but six turns in seven pass before a longer rest."""
    n = F.col("vec_id")
    block, at = F.floor(n / 120), n % 120
    ts = block * 5 + 40 * F.floor(block / 7) + F.floor(at / 12) / 2
    role, unit = F.when(F.col("label") % 2 == 0, "employee").otherwise("customer"), l2_normalise(F.col("embedding"))
    return _vectors(spark, sf_dir).where(n % 11 != 0).select(
        F.concat(F.lit("store-"), block % 3).alias("store_id"), F.concat(F.lit("cam-"), n % 2).alias("camera_id"), (F.floor(n / 2) % 6).alias("track_id"), n.alias("id"), role.alias("role"), F.when(n % 7 != 0, unit).alias("embedding"), ts.cast("double").alias("ts"),
    )


def resolve_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.resolve(seen_people(spark, sf_dir), _staff(spark, sf_dir), 0.5, 0.3)


def stream_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same identities from a stream in several micro-batches, with late rows."""
    timed = seen_people(spark, sf_dir).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long") + 1_000_000_000))
    return _streamed(L.identities(_replayed(timed, "id"), _staff(spark, sf_dir), 0.5, 0.3), "identities")


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplication as a stream of several micro-batches, with late rows."""
    kept = L.deduplicate(_replayed(_timed(camera_events(spark, sf_dir)), "event_id"), DEDUP_KEYS, 2 * DAY)
    return _streamed(kept, "dedup").select("event_id", "global_id", "event_type", "zone")


def stream_zone_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone entries, interactions and exits as a stream of several micro-batches, in order."""
    obs = _timed(camera_events(spark, sf_dir)).select("store_id", "global_id", "event_id", "ts", (F.col("k") < 50).alias("inside"), "event_time")
    in_order = J.replay(obs, f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}", "event_id", late=0)
    return _streamed(L.zone_steps(in_order, ["store_id", "global_id"]), "zones")


def stream_shelf_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelf engagement by day, from a stream of several micro-batches with late rows."""
    out = _streamed(J.shelf_engagement(_replayed(_timed(camera_events(spark, sf_dir)), "event_id"), "1 day"), "shelves")
    return out.withColumn("window_start", F.unix_timestamp("window_start").cast("double"))


def stream_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys that end after a day away, from a stream of several micro-batches with late rows."""
    return _streamed(J.journeys(_replayed(_timed(camera_events(spark, sf_dir)), "event_id"), "1 day"), "journeys")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoilt events as a stream into the table of good ones and that of those put aside: how many have each fault."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = _timed(camera_events(spark, sf_dir)).withColumn("event_time", F.coalesce("event_time", F.timestamp_seconds(F.lit(0))))
    landed = J.replay(rows, f"{root}/landed", "event_id", late=0).where("event_id IS NOT NULL")
    J.ingest(engine.spoilt(landed), f"{root}/good", f"{root}/aside", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    tables = [spark.read.parquet(f"{root}/{t}") for t in ("good", "aside")]
    return tables[0].select(F.lit("none").alias("fault")).unionByName(tables[1].select("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def stream_camera_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot of each camera's health, events and drift, from a stream of several micro-batches with late rows."""
    snapshots = _streamed(L.camera_reports(_replayed(engine.health_rows(spark, sf_dir), "digest"), size=engine.SAMPLES), "health")
    newest = snapshots.groupBy("store_id", "camera_id").agg(F.max_by(F.struct(*snapshots.columns), "us").alias("s")).select("s.*")
    return newest.where("frames > 0").drop("us")


def _replayed(rows: DataFrame, tie: str) -> DataFrame:
    return J.replay(rows, f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex}", tie)


def stream_zone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone events from a stream in several micro-batches, with late rows; the same events as the windows' of zone_events."""
    return engine.as_lines(_streamed(L.zone_events(_replayed(_timed(engine.zone_observations(spark, sf_dir)), "event_id"), engine.zones(spark), engine.GAP, min_dwell=DAY), "zone-events"))


def _streamed(stream: DataFrame, name: str) -> DataFrame:
    root = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return J.run_available(stream, f"{root}/out", f"{root}/state")


QUERIES = {
    "summary": _on_events(A.summary),
    "summary_store": _on_events(A.summary, "store-1"),
    "summary_by_store": _on_events(A.summary_by_store),
    "store_visits": _on_events(A.store_visits),
    "zone_dwell": _on_events(A.zone_dwell),
    "shelf_engagement": _on_events(A.shelf_engagement),
    "employee_presence": _on_events(A.employee_presence),
    "journeys": _on_events(A.journeys, 500),
    "review_queue": _on_events(A.review_queue, 50),
    "events_by_type": _on_events(A.events_by_type),
    "recent_feed": _on_events(A.recent_feed),
    "heartbeat_latest": _on_events(A.heartbeat_latest),
    "active_identities": _on_events(A.active_identities, 2 * DAY),
    "dashboard_kpis": _on_events(A.dashboard, DAY),
    "camera_snapshot": _on_events(A.camera_snapshot),
    "first_seen": _on_events(A.first_seen),
    "majority_vote": _on_events(A.majority_vote),
    "unmatched_anti": _on_events(A.unmatched),
    "flatten_payload": _on_events(lambda e: e.select("event_id", "event_type", "store_id", "camera_id", "global_id", "role", "zone", "zone_kind", "employee_id", "confidence", "needs_review", F.get_json_object("payload", "$.k").cast("int").alias("payload_k"))),
    "zone_visits": lambda s, d: Z.visits(observations(s, d), VISIT_KEYS, ["ts", "event_id"]),
    "session_flush": lambda s, d: E.flushed(observations(s, d), DAY).select("event_id", (F.col("session") + 1).cast("int").alias("session")),
    "dedup_window": _on_events(lambda e: Z.deduplicate(e, DEDUP_KEYS, 2 * DAY).select("event_id", "global_id", "event_type", "zone")),
    "point_in_zone": point_in_zone,
    "iou_pairs": iou_pairs,
    "occlusion": occlusion,
    "quality_gate": gate,
    "truth_match": truth_match,
    "nms": nms,
    "track_boxes": track_boxes,
    "resolve_identities": resolve_identities,
    "stream_dedup": stream_dedup,
    "stream_zone_steps": stream_zone_steps,
    "stream_zone_events": stream_zone_events,
    "stream_shelf_engagement": stream_shelf_engagement,
    "stream_journeys": stream_journeys,
    "stream_ingest": stream_ingest,
    "stream_camera_report": stream_camera_report,
    "stream_tracks": stream_tracks,
    "stream_identities": stream_identities,
    "box_measure": lambda s, d: boxes(s, d).select("id", to_measure(F.col("box")).alias("m"), clip_box(F.col("box"), 640.0, 480.0).alias("c")).select("id", "m.cx", "m.cy", "m.s", "m.r", F.col("c.x2").alias("clip_x2"), F.col("c.y2").alias("clip_y2")),
    "role_by_colour": lambda s, d: boxes(s, d).select("id", role_by_colour(F.array(F.col("id") % 256, F.col("id") % 90, F.col("frame") % 80), [40, 40, 40], 60).alias("r")).select("id", "r.role", round_half_away(F.col("r.confidence"), 6).alias("confidence")),
    "gallery_cap": _on_vectors(lambda v: newest_vectors(v, "label", "vec_id", 20).select("label", "vec_id")),
    "gallery_topk": _on_split(I.gallery_top, 3),
    "gallery_role_postfilter": _on_split(I.role_after_top, "g_label % 2 = 0"),
    "similarity_bands": _on_split(I.bands, 0.4, 0.3),
    "reid_rank_map": _on_split(I.rank_metrics),
    "loo_reid": _on_vectors(I.leave_one_out),
    "thresholds": _on_vectors(I.thresholds),
    "drift": _on_vectors(lambda v: I.drift(v.select((F.col("vec_id") % 2).alias("cam"), F.col("vec_id").alias("n"), "embedding"))),
    "identity_eval": identity_eval,
    "l2_normalize": _on_vectors(lambda v: v.select("vec_id", F.transform(l2_normalise(F.col("embedding")), lambda x: F.round(x, 5)).alias("e")).select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))),
}


def _ev(sql: str) -> str:
    return f"WITH ev AS ({DUCK_ADAPTER}) {sql}"


def R(x: str, n: int) -> str:
    return f"round(({x}) * {10**n}.0::DOUBLE, 0) / {10**n}.0::DOUBLE"


_SUM = "count(*) AS events, count(DISTINCT global_id) AS unique_people, count(DISTINCT global_id) FILTER (WHERE role = 'customer') AS unique_customers, count(DISTINCT employee_id) AS employees_seen, count(*) FILTER (WHERE event_type = 'product_interaction') AS product_interactions, count(*) FILTER (WHERE needs_review) AS needs_review, min(ts) AS first_ts, max(ts) AS last_ts"
_SHELF = f"SELECT store_id, zone, visitors, coalesce(n, 0) AS interacting, {R('coalesce(n, 0) * 100.0::DOUBLE / visitors', 1)} AS interaction_rate_pct FROM (SELECT store_id, zone, count(DISTINCT global_id) AS visitors FROM ev WHERE event_type = 'zone_entered' AND zone_kind = 'shelf' AND role = 'customer' GROUP BY ALL) LEFT JOIN (SELECT store_id, zone, count(DISTINCT global_id) AS n FROM ev WHERE event_type = 'product_interaction' AND role = 'customer' GROUP BY ALL) USING (store_id, zone)"
_SIM = "s AS (SELECT q.vec_id AS q, q.label AS q_label, g.vec_id AS g, g.label AS g_label, round(list_inner_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id {where})"
_SPLIT = "WITH " + _SIM.format(where="WHERE q.vec_id % 2 = 0 AND g.vec_id % 2 = 1")
_ALL = "WITH " + _SIM.format(where="")
_TOP = ", t AS (SELECT q, g_label, max(sim) AS sim FROM s GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, g_label)::INTEGER AS rank FROM t)"
_OBS = "obs AS (SELECT store_id, camera_id, global_id, event_id, ts, k < 50 AS inside FROM ev)"

SQL = {
    "summary": _ev(f"SELECT {_SUM} FROM ev"),
    "summary_store": _ev(f"SELECT {_SUM} FROM ev WHERE store_id = 'store-1'"),
    "summary_by_store": _ev(f"SELECT store_id, {_SUM} FROM ev GROUP BY store_id"),
    "store_visits": _ev("SELECT store_id, count(DISTINCT global_id) AS visitors FROM ev WHERE event_type = 'zone_entered' AND zone_kind = 'entrance' AND role = 'customer' GROUP BY store_id"),
    "zone_dwell": _ev(f"SELECT store_id, zone, zone_kind, role, count(*) AS visits, {R('avg(dwell_seconds)', 2)} AS avg_dwell_s, {R('max(dwell_seconds)', 2)} AS max_dwell_s FROM ev WHERE event_type IN ('zone_exited', 'seat_released') GROUP BY ALL"),
    "shelf_engagement": _ev(_SHELF),
    "employee_presence": _ev(f"SELECT store_id, employee_id, {R('max(ts) - min(ts)', 1)} AS presence_s, count(DISTINCT camera_id) AS cameras, count(DISTINCT zone) AS zones, {R('sum(CASE WHEN zone_kind = $$seat$$ THEN dwell_seconds END)', 1)} AS seated_s, {R('avg(confidence)', 3)} AS avg_confidence FROM ev WHERE employee_id IS NOT NULL GROUP BY ALL").replace("$$", "'"),
    "journeys": _ev(f"SELECT * FROM (SELECT store_id, global_id, role, count(DISTINCT camera_id) AS cameras, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS camera_list, {R('max(ts) - min(ts)', 1)} AS journey_s FROM ev GROUP BY store_id, global_id, role) WHERE cameras > 1 ORDER BY journey_s DESC, store_id, global_id, role LIMIT 500"),
    "review_queue": _ev("SELECT ts, store_id, camera_id, global_id, role, employee_id, confidence, payload FROM ev WHERE needs_review AND event_type = 'person_seen' ORDER BY confidence, ts, event_id LIMIT 50"),
    "events_by_type": _ev("SELECT event_type, count(*) AS n FROM ev GROUP BY event_type"),
    "recent_feed": _ev("SELECT store_id, camera_id, pos, event_type, coalesce(employee_id, global_id) AS label, ts FROM (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY ts DESC, event_id DESC)::INTEGER AS pos FROM ev) WHERE pos <= 4"),
    "heartbeat_latest": _ev("SELECT store_id, camera_id, ts, event_type, confidence, events FROM (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY ts DESC, event_id DESC) AS pos, count(*) OVER (PARTITION BY store_id, camera_id) AS events FROM ev) WHERE pos = 1"),
    "active_identities": _ev(f"SELECT p.store_id, global_id, role, employee_id, last_seen, cameras FROM (SELECT store_id, global_id, arg_max(role, ts) AS role, max(employee_id) AS employee_id, max(ts) AS last_seen, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS cameras FROM ev GROUP BY ALL) p JOIN (SELECT store_id, max(ts) AS t FROM ev GROUP BY ALL) n ON p.store_id = n.store_id WHERE t - last_seen <= {2 * DAY}"),
    "dashboard_kpis": _ev(f"SELECT (SELECT arg_min(v, store_id) FROM (SELECT store_id, count(DISTINCT global_id) AS v FROM ev WHERE event_type = 'zone_entered' AND zone_kind = 'entrance' AND role = 'customer' GROUP BY store_id)) AS visitors, (SELECT count(*) FROM (SELECT store_id, global_id, max(ts) AS t FROM ev GROUP BY ALL) JOIN (SELECT store_id, max(ts) AS n FROM ev GROUP BY ALL) USING (store_id) WHERE n - t < {DAY}) AS on_floor, (SELECT {R('sum(round(interaction_rate_pct * 10)::BIGINT)::DOUBLE / count(*) / 10', 3)} FROM ({_SHELF})) AS interaction_rate, count(*) AS events, count(DISTINCT employee_id) AS employees, {R('avg(CASE WHEN needs_review THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 4)} AS review_ratio FROM ev"),
    "camera_snapshot": _ev(f"SELECT store_id, camera_id, count(*) AS events, {R('count(*) FILTER (WHERE needs_review) / greatest(count(*), 1)', 6)} AS review_ratio, {R('quantile_cont(confidence, 0.5) FILTER (WHERE r <= 300)', 6)} AS p50, {R('quantile_cont(confidence, 0.95) FILTER (WHERE r <= 300)', 6)} AS p95, {R('avg(confidence) FILTER (WHERE r <= 300)', 6)} AS mean_confidence FROM (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) GROUP BY store_id, camera_id"),
    "first_seen": _ev("SELECT camera_id, global_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, global_id ORDER BY ts, event_id) AS r FROM ev) WHERE r = 1"),
    "majority_vote": _ev(", o AS (SELECT global_id, event_id, zone_kind, row_number() OVER (PARTITION BY global_id ORDER BY ts, event_id) AS n FROM ev WHERE zone_kind IS NOT NULL), c AS (SELECT a.global_id, a.event_id, b.zone_kind, count(*) AS votes, min(b.n) AS early FROM o a JOIN o b ON a.global_id = b.global_id AND b.n BETWEEN a.n - 4 AND a.n GROUP BY ALL) SELECT global_id, event_id, zone_kind AS vote FROM (SELECT *, row_number() OVER (PARTITION BY global_id, event_id ORDER BY votes DESC, early) AS r FROM c) WHERE r = 1"),
    "unmatched_anti": _ev("SELECT DISTINCT store_id, global_id, zone FROM ev e WHERE event_type = 'zone_entered' AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type IN ('zone_exited', 'seat_released') AND x.store_id = e.store_id AND x.global_id = e.global_id AND x.zone = e.zone)"),
    "flatten_payload": _ev("SELECT event_id, event_type, store_id, camera_id, global_id, role, zone, zone_kind, employee_id, confidence, needs_review, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS payload_k FROM ev"),
    # an independent step machine, one observation after another, as a recursive query
    "zone_visits": "WITH RECURSIVE " + _ev("")[5:] + f", {_OBS}" + """, o AS (SELECT store_id, global_id, ts, inside, row_number() OVER (PARTITION BY store_id, global_id ORDER BY ts, event_id) AS n FROM obs),
m AS (SELECT store_id, global_id, 0::BIGINT AS n, false AS is_in, 0 AS i, 0 AS u, 0 AS visit, NULL::DOUBLE AS enter_ts, false AS fired, NULL::VARCHAR AS e, NULL::DOUBLE AS moment, 0 AS run FROM (SELECT DISTINCT store_id, global_id FROM o)
UNION ALL SELECT m.store_id, m.global_id, o.n,
  CASE WHEN o.inside THEN m.is_in OR m.i + 1 >= 2 ELSE m.is_in AND m.u + 1 < 4 END,
  CASE WHEN o.inside THEN m.i + 1 ELSE 0 END, CASE WHEN o.inside THEN 0 ELSE m.u + 1 END,
  m.visit + CASE WHEN o.inside AND NOT m.is_in AND m.i + 1 >= 2 THEN 1 ELSE 0 END,
  CASE WHEN o.inside AND NOT m.is_in AND m.i + 1 >= 2 THEN o.ts ELSE m.enter_ts END,
  CASE WHEN o.inside AND NOT m.is_in AND m.i + 1 >= 2 THEN false WHEN o.inside AND m.is_in AND m.i + 1 >= 6 THEN true ELSE m.fired END,
  CASE WHEN NOT o.inside AND m.is_in AND m.u + 1 >= 4 THEN 'exit' WHEN o.inside AND m.is_in AND NOT m.fired AND m.i + 1 >= 6 THEN 'act' END, o.ts, m.i + 1
  FROM m JOIN o ON o.store_id = m.store_id AND o.global_id = m.global_id AND o.n = m.n + 1)
SELECT store_id, global_id, visit, max(enter_ts) AS enter_ts, max(CASE WHEN e = 'exit' THEN moment END) AS exit_ts, """ + R("max(CASE WHEN e = 'exit' THEN moment END) - max(enter_ts)", 3) + """ AS dwell_s, min(CASE WHEN e = 'act' THEN moment END) AS interaction_ts, min(CASE WHEN e = 'act' THEN run END) AS run_frames FROM m WHERE visit > 0 GROUP BY store_id, global_id, visit""",
    "session_flush": _ev(f", {_OBS}, f AS (SELECT *, lag(ts) OVER (PARTITION BY store_id, camera_id ORDER BY ts) AS before FROM (SELECT DISTINCT store_id, camera_id, ts FROM obs)), p AS (SELECT o.*, f.before, lag(o.ts) OVER (PARTITION BY store_id, camera_id, global_id ORDER BY o.ts, event_id) AS seen FROM obs o JOIN f USING (store_id, camera_id, ts)) SELECT event_id, (1 + sum(CASE WHEN before - seen > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY store_id, camera_id, global_id ORDER BY ts, event_id))::INTEGER AS session FROM p"),
    "dedup_window": "WITH RECURSIVE " + _ev("")[5:] + f", o AS (SELECT *, row_number() OVER (PARTITION BY global_id, event_type, zone ORDER BY ts, event_id) AS n FROM ev), m AS (SELECT global_id, event_type, zone, event_id, ts AS last, n, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.global_id, o.event_type, o.zone, o.event_id, CASE WHEN o.ts - m.last >= {2 * DAY} THEN o.ts ELSE m.last END, o.n, o.ts - m.last >= {2 * DAY} FROM m JOIN o ON o.global_id = m.global_id AND o.event_type = m.event_type AND o.zone IS NOT DISTINCT FROM m.zone AND o.n = m.n + 1) SELECT event_id, global_id, event_type, zone FROM m WHERE kept",
    "point_in_zone": IN_ZONE,
    "iou_pairs": f"SELECT * FROM (SELECT a.frame, a.id AS a, b.id AS b, {R(IOU, 6)} AS iou FROM {BOXES} a JOIN {BOXES} b ON a.frame = b.frame AND a.id < b.id) WHERE iou > 0",
    # (least and greatest pass over nulls, so a box without others must not be measured against none)
    "occlusion": f"SELECT * FROM (SELECT a.id, {R('coalesce(max(CASE WHEN b.id IS NOT NULL THEN ' + INTER + ' / ' + AREA.format('a') + ' END), 0)', 6)} AS hidden FROM {BOXES} a LEFT JOIN {BOXES} b ON a.frame = b.frame AND a.id <> b.id AND b.y2 > a.y2 GROUP BY a.id) WHERE hidden <= 0.7",
    "quality_gate": f"SELECT id, (y2 - y1 >= 32 AND x1 > 2 AND y1 > 2 AND x2 < 638 AND y2 < 478 AND (x2 - x1) / greatest(y2 - y1, 1e-6) <= 1.2) AS ok FROM {BOXES}",
    "truth_match": f"SELECT frame, pred, gt, {R('iou', 6)} AS iou FROM (SELECT a.frame, a.id AS pred, b.id AS gt, round({IOU}, 9) AS iou, row_number() OVER (PARTITION BY a.frame, a.id ORDER BY round({IOU}, 9) DESC, b.id) AS r FROM {BOXES} a JOIN {BOXES} b ON a.frame = b.frame AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE round({IOU}, 9) > 0.05) WHERE r = 1",
    "gallery_topk": _SPLIT + _TOP + " SELECT * FROM top WHERE rank <= 3",
    "gallery_role_postfilter": _SPLIT + _TOP + ", f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS r FROM top WHERE rank <= 5 AND g_label % 2 = 0) SELECT q, g_label, sim, rank FROM f WHERE r = 1",
    "similarity_bands": _SPLIT + _TOP + ", b AS (SELECT q, max(CASE WHEN rank = 1 THEN sim END) AS best, coalesce(max(CASE WHEN rank = 2 THEN sim END), -1) AS second FROM top GROUP BY q) SELECT q, best, round(best - second, 6) AS margin, CASE WHEN best >= 0.4 AND best - second > 0.02 THEN 'match' WHEN best >= 0.3 THEN 'review' ELSE 'unknown' END AS band FROM b",
    "reid_rank_map": _SPLIT + f", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, g) AS rank, (q_label = g_label)::INTEGER AS hit FROM s), p AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) / rank AS precision FROM r), e AS (SELECT q, max(CASE WHEN rank <= 1 THEN hit ELSE 0 END) AS r1, max(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS r5, coalesce(avg(CASE WHEN hit = 1 THEN precision END), 0) AS ap FROM p GROUP BY q) SELECT {R('avg(r1)', 4)} AS rank1, {R('avg(r5)', 4)} AS rank5, {R('avg(ap)', 4)} AS map FROM e",
    "loo_reid": _ALL + f", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, g) AS rank FROM s), e AS (SELECT q, q_label, max(CASE WHEN rank = 1 THEN (q_label = g_label)::INTEGER END) AS r1, max((q_label = g_label)::INTEGER) AS r5 FROM r WHERE rank <= 5 GROUP BY ALL) SELECT {R('avg(r1)', 4)} AS rank1, {R('avg(r5)', 4)} AS rank5, count(*) AS samples, count(DISTINCT q_label) AS identities FROM e",
    "thresholds": _ALL + f", p AS (SELECT *, q_label = g_label AS same FROM s WHERE q < g), c AS (SELECT quantile_cont(sim, 0.99) AS m, quantile_cont(sim, 0.95) AS r, count(*) AS n, avg(sim) AS a FROM p WHERE NOT same) SELECT {R('m', 4)} AS match_threshold, {R('r', 4)} AS review_threshold, n AS impostor_pairs, {R('a', 4)} AS impostor_mean, count(*) AS genuine_pairs, {R('avg(sim)', 4)} AS genuine_mean, {R('avg(CASE WHEN sim >= m THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS genuine_accept FROM p, c WHERE same GROUP BY m, r, n, a",
    "drift": f"WITH v AS (SELECT *, vec_id % 2 AS cam, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id DESC) AS back FROM embeddings), u AS (SELECT cam, CASE WHEN n <= 200 THEN 'a' WHEN back <= 200 THEN 'b' END AS part, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM v), w AS (SELECT cam, pos, avg(x) FILTER (WHERE part = 'a') AS a, avg(x) FILTER (WHERE part = 'b') AS b FROM u GROUP BY ALL) SELECT cam, {R('1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))', 4)} AS drift FROM w GROUP BY cam",
    "identity_eval": _ev(f", p AS (SELECT global_id AS name, CASE WHEN event_id % 20 = 0 THEN CASE WHEN zone IS NULL THEN NULL ELSE concat(zone, '-x') END ELSE global_id END AS gid FROM ev), c AS (SELECT name, gid, count(*) AS n FROM p WHERE gid IS NOT NULL GROUP BY ALL), g AS (SELECT max(n) AS top, sum(n) AS al FROM c GROUP BY gid), t AS (SELECT name, sum(n) AS t FROM c GROUP BY name), f AS (SELECT name, count(*) AS ids FROM c JOIN t USING (name) WHERE n >= 0.02 * t GROUP BY name) SELECT {R('(SELECT sum(top) / sum(al) FROM g)', 4)} AS purity, {R('avg(ids)', 4)} AS fragmentation, count(*) AS people FROM f"),
    "l2_normalize": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9), 5))), 3) AS total FROM embeddings",
}

SQL |= {
    "stream_dedup": SQL["dedup_window"],
    "box_measure": f"SELECT id, x1 + (x2 - x1) / 2 AS cx, y1 + (y2 - y1) / 2 AS cy, (x2 - x1) * (y2 - y1) AS s, (x2 - x1) / (y2 - y1) AS r, CASE WHEN least(x2, 640) > x1 AND least(y2, 480) > y1 THEN trunc(least(x2, 640))::INTEGER END AS clip_x2, CASE WHEN least(x2, 640) > x1 AND least(y2, 480) > y1 THEN trunc(least(y2, 480))::INTEGER END AS clip_y2 FROM {BOXES}",
    "role_by_colour": f"SELECT id, CASE WHEN d <= 60 THEN 'employee' ELSE 'customer' END AS role, {R('CASE WHEN d <= 60 THEN 1 - d / 765.0::DOUBLE ELSE least(1.0::DOUBLE, d / 765.0::DOUBLE + 0.5::DOUBLE) END', 6)} AS confidence FROM (SELECT id, (abs(id % 256 - 40) + abs(id % 90 - 40) + abs(frame % 80 - 40))::DOUBLE AS d FROM {BOXES})",
    "gallery_cap": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings) WHERE n <= 20",
}

QUERIES |= engine.QUERIES
SQL |= engine.SQL
SQL |= {f"stream_{to}": SQL[of] for to, of in (("zone_events", "zone_events"), ("ingest", "ingest_quarantine"), ("camera_report", "camera_report"))}

SQL |= {
    "stream_shelf_engagement": _ev(f", v AS (SELECT floor(ts / {DAY}) * {DAY} AS window_start, store_id, zone, count(DISTINCT global_id) AS visitors FROM ev WHERE event_type = 'zone_entered' AND zone_kind = 'shelf' AND role = 'customer' GROUP BY ALL), i AS (SELECT floor(ts / {DAY}) * {DAY} AS window_start, store_id, zone, count(DISTINCT global_id) AS n FROM ev WHERE event_type = 'product_interaction' AND role = 'customer' GROUP BY ALL) SELECT window_start, store_id, zone, visitors, coalesce(n, 0) AS interacting, {R('coalesce(n, 0) * 100.0::DOUBLE / visitors', 1)} AS interaction_rate_pct FROM v LEFT JOIN i USING (window_start, store_id, zone)"),
    "stream_journeys": _ev(f", b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= {DAY} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY store_id, global_id, role ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY store_id, global_id, role ORDER BY ts, event_id) AS visit FROM b) SELECT store_id, global_id, role, count(DISTINCT camera_id) AS cameras, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS camera_list, min(ts) AS first_ts, {R('max(ts) - min(ts)', 1)} AS journey_s FROM s GROUP BY store_id, global_id, role, visit HAVING count(DISTINCT camera_id) > 1"),
}

_OVER = "greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))"
SQL |= {
    "stream_zone_steps": SQL["zone_visits"].replace("SELECT store_id, global_id, visit, max(enter_ts)", "SELECT * FROM (SELECT store_id, global_id, unnest(['enter', 'interaction', 'exit']) AS step, unnest([enter_ts, interaction_ts, exit_ts]) AS ts, unnest([NULL, NULL, dwell_s]) AS dwell_s FROM (SELECT store_id, global_id, visit, max(enter_ts)") + ")) WHERE ts IS NOT NULL",
    # one detection after another, in the order of confidence, against those that were kept
    "nms": f"""WITH RECURSIVE d AS (SELECT concat('store-', frame % 3) AS store_id, concat('cam-', frame % 4) AS camera_id, CAST(floor(frame / 12) AS BIGINT) AS frame, id, (id * 37 % 101) / 100.0::DOUBLE AS confidence, x1, y1, x2, y2 FROM {BOXES}),
o AS (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id, frame ORDER BY confidence DESC, id, x1, y1, x2, y2) AS n FROM d WHERE confidence >= 0.4),
m AS (SELECT store_id, camera_id, frame, 1::BIGINT AS n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS stays, id, confidence FROM o WHERE n = 1
UNION ALL SELECT o.store_id, o.camera_id, o.frame, o.n, CASE WHEN hidden THEN kept ELSE list_append(kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END, NOT hidden, o.id, o.confidence FROM (SELECT m.kept, o.*, len(list_filter(m.kept, lambda k: {_OVER} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {_OVER}) > 0.2)) > 0 AS hidden FROM m JOIN o ON o.store_id = m.store_id AND o.camera_id = m.camera_id AND o.frame = m.frame AND o.n = m.n + 1) o)
SELECT store_id, camera_id, frame, id, confidence FROM m WHERE stays""",
}
