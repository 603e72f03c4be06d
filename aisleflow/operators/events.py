"""Events from observations: zone entries, interactions, exits and dwells with their names and payloads, first sightings,
samples that are carried along a track, and the check of incoming batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import idle_segments
from .zones import in_zones, mark_visits

CAMERA = ["store_id", "camera_id"]
#: Frames that are looked at together when a track's missed frames are searched.
CHUNK = 4096
IDENTITY = ["role", "employee_id", "confidence", "needs_review"]
EVENT = ["event_type", "store_id", "camera_id", "ts", "global_id", "role", "zone", "employee_id", "confidence", "payload"]


def entered(kind: Column) -> Column:
    return F.when(kind == "seat", "seat_occupied").otherwise("zone_entered")


def left(kind: Column) -> Column:
    return F.when(kind == "seat", "seat_released").otherwise("zone_exited")


def payload(**parts: Column) -> Column:
    """The parts as JSON; those that are null are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def flushed(obs: DataFrame, gap: float) -> DataFrame:
    """obs with ``session`` and ``flush_ts``. A person's session on a camera ends when a frame of that camera comes more
    than ``gap`` after they were last seen; flush_ts is that frame's time, null where none came.

    Only rows after which the person is away for longer than the gap can end a session, so these alone look for a frame:
    among the camera's frames of the day when they are due, then among the first ones of later days. No task holds a camera's
    whole clock, and the other rows go by. Null stores and cameras are values.
    """
    day = lambda c: F.floor(c / 86_400)
    w = W.partitionBy(*CAMERA, "global_id").orderBy("ts", "event_id")
    rows = obs.withColumn("_next", F.lead("ts").over(w)).withColumn("_due", F.col("ts") + gap)
    away = F.coalesce(F.col("_next") > F.col("_due"), F.col("_next").isNull() & F.col("_due").isNotNull())
    here = rows.where(~away).withColumn("flush_ts", F.lit(None).cast("double"))
    # frames and due times of a camera's day from the last to the first, so that what is ahead is a running minimum (a window that
    # reaches to the end is worked out anew for each row); a frame at the due time itself isn't past the gap, so it comes after
    asked = rows.where(away).select("*", day(F.col("_due")).alias("_day"), F.col("_due").alias("_t"), F.lit(None).cast("double").alias("_frame"))
    seen = obs.where("ts IS NOT NULL")
    frames = seen.select(*CAMERA, day(F.col("ts")).alias("_day"), F.col("ts").alias("_t"), F.col("ts").alias("_frame"))
    ahead = W.partitionBy(*CAMERA, "_day").orderBy(F.desc("_t"), F.col("_frame").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    both = asked.unionByName(frames, allowMissingColumns=True).withColumn("_after", F.min("_frame").over(ahead)).where("_frame IS NULL")
    # the first frame of a later day, for each day that has frames or is asked about
    days = frames.groupBy(*CAMERA, "_day").agg(F.min("_t").alias("first"))
    days = days.unionByName(asked.groupBy(*CAMERA, "_day").agg(F.lit(None).cast("double").alias("first")))
    days = days.groupBy(*CAMERA, "_day").agg(F.min("first").alias("first"))
    later = F.min("first").over(W.partitionBy(*CAMERA).orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1))
    days = days.select(*[F.col(c).alias(f"_of_{c}") for c in (*CAMERA, "_day")], later.alias("_later"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*CAMERA, "_day")]
    found = both.join(days, same, "left").withColumn("flush_ts", F.coalesce("_after", "_later"))
    # a frame in which the person is seen again doesn't end the session
    found = found.withColumn("flush_ts", F.when(F.col("_next").isNull() | (F.col("flush_ts") < F.col("_next")), F.col("flush_ts")))
    out = here.select(*obs.columns, "flush_ts").unionByName(found.select(*obs.columns, "flush_ts"))
    return out.withColumn("session", F.count("flush_ts").over(w.rowsBetween(W.unboundedPreceding, -1)))


def zone_events(obs: DataFrame, zones: DataFrame, gap: float, enter: int = 2, leave: int = 4, interact: int = 6, min_dwell: float = 1.0) -> DataFrame:
    """Events of zones. obs: store, camera, person, event_id (order within a time), ts, identity, and the foot point x, y;
    zones: store, camera, zone, kind, polygon.

    A person enters a zone at their ``enter``-th observation inside in a row and leaves at the ``leave``-th outside in a
    row, or when the camera goes on without them for more than ``gap`` seconds, in which case the exit has the time of the
    frame that showed it. On shelves the ``interact``-th observation inside in a row is an interaction, once a visit.
    Visits of ``min_dwell`` seconds or more give a dwell event besides their exit. A visit that is open when the data end
    gives no exit.
    """
    placed = in_zones(flushed(obs, gap), zones)
    keys = [*CAMERA, "global_id", "session", "zone", "kind"]
    steps = mark_visits(placed, keys, ["ts", "event_id"], enter, leave, interact)
    at = F.struct("at", "ts", *IDENTITY, "rl")
    seen = steps.groupBy(*keys, "visit").agg(
        F.min(F.when(F.col("step") == "enter", at)).alias("came"),
        F.min(F.when(F.col("step") == "exit", at)).alias("went"),
        F.min(F.when(F.col("acted") & (F.col("kind") == "shelf"), at)).alias("act"),
        F.max(at).alias("last"),
        F.max("flush_ts").alias("flush_ts"),
        F.max("visit_last").alias("visit_last"),
    ).where("visit > 0")
    out = F.when(F.col("went").isNotNull(), F.col("went")).when(F.col("visit") == F.col("visit_last"), F.col("last").withField("ts", F.col("flush_ts")))
    seen = seen.withColumn("out", F.when(out["ts"].isNotNull(), out))
    dwell = F.round(F.col("out.ts") - F.col("came.ts"), 3)

    def event(name: Column, who: Column, when: Column, **extra: Column) -> Column:
        body = payload(zone_kind=F.col("kind"), needs_review=who["needs_review"], **extra)
        return F.when(when, F.struct(name.alias("event_type"), who["ts"].alias("ts"), *[who[c].alias(c) for c in IDENTITY], body.alias("payload")))

    each = F.array(
        event(entered(F.col("kind")), F.col("came"), F.col("came").isNotNull()),
        event(F.lit("product_interaction"), F.col("act"), F.col("act").isNotNull(), frames=F.col("act.rl")),
        event(left(F.col("kind")), F.col("out"), F.col("out").isNotNull(), dwell_seconds=dwell),
        event(F.lit("dwell"), F.col("out"), F.col("out").isNotNull() & (F.col("out.ts") - F.col("came.ts") >= min_dwell), dwell_seconds=dwell),
    )
    return seen.select(*CAMERA, "global_id", "zone", F.explode(F.array_compact(each)).alias("e")).select(*CAMERA, "global_id", "zone", "e.*").select(*EVENT)


def person_seen(tracks: DataFrame) -> DataFrame:
    """The first sighting of each track: an event whose payload holds the box to a tenth of a pixel."""
    w = W.partitionBy(*CAMERA, "track_id").orderBy("ts", "id")
    first = tracks.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    box = F.array(*[F.round(F.col(f"box.{c}"), 1) for c in ("x1", "y1", "x2", "y2")])
    out = first.withColumn("event_type", F.lit("person_seen")).withColumn("zone", F.lit(None).cast("string")).withColumn("payload", payload(needs_review=F.col("needs_review"), bbox=box))
    return out.select(*EVENT)


def carried(tracks: DataFrame, every: int = 3, votes: int = 5) -> DataFrame:
    """What a track's rows know of it: tracks (store, camera, track_id, frame, embeddable, sample, role) with ``carried``, the
    last sample, and ``vote``, the commonest role of the last ``votes`` samples (ties: the earliest of these).

    A sample is taken of an embeddable row when none is held or the frame's number is divisible by ``every``. One missed
    frame ends what is held. Rows before the first sample of an unbroken stretch go, and those without a frame. No task sorts a
    track's whole history, but stretches.
    """
    key = [*CAMERA, "track_id"]
    rows = idle_segments(tracks.where("frame IS NOT NULL"), key, "frame", 1, CHUNK).withColumnRenamed("_segment", "stretch")
    own = W.partitionBy(*key, "stretch").orderBy("frame")
    fit = F.count_if("embeddable").over(own)
    rows = rows.withColumn("taken", F.col("embeddable") & ((F.col("frame") % every == 0) | (fit == 1)))
    rows = rows.withColumn("n", F.count_if("taken").over(own)).where("n > 0")
    lately = F.collect_list(F.struct("n", "role")).over(W.partitionBy(*key, "stretch", "taken").orderBy("frame").rowsBetween(-(votes - 1), 0))
    rows = rows.withColumn("lately", F.when(F.col("taken"), F.transform(lately, lambda x: x["role"])))
    counted = F.transform("lately", lambda x: F.struct(F.size(F.filter("lately", lambda y: y == x)).alias("n"), (-F.array_position("lately", x)).alias("early"), x.alias("role")))
    rows = rows.withColumn("won", F.array_max(counted)["role"])
    return rows.select(*key, "frame", F.last(F.when(F.col("taken"), F.col("sample")), ignorenulls=True).over(own).alias("carried"), F.last("won", ignorenulls=True).over(own).alias("vote"), (F.col("n") - 1).cast("int").alias("samples_before"))


REQUIRED = ["event_type", "store_id", "camera_id", "ts", "global_id"]


def checked(events: DataFrame) -> DataFrame:
    """events with ``fault``: the first thing that is wrong with a row, null for a good one."""
    fault = F.lit(None).cast("string")
    for name in reversed(REQUIRED):
        fault = F.when(F.col(name).isNull(), f"{name} is missing").otherwise(fault)
    return events.withColumn("fault", F.coalesce(fault, F.when(~F.col("confidence").between(0, 1), "confidence is out of range")))


def split_batch(events: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows to be put aside with their fault) of one delivery, which holds 1 to ``most`` rows."""
    n = events.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a batch holds 1 to {most} events")
    rows = checked(events)
    return rows.where("fault IS NULL").drop("fault"), rows.where("fault IS NOT NULL")
