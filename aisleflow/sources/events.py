"""Event sources: JSON lines with nested payloads, and the adapter from the driver's click events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "event_type string, store_id string, camera_id string, timestamp double, global_id string, role string, zone string, employee_id string, confidence double, payload string"

#: The projection of the driver's events to camera events, the same text on both engines but for the parts named here.
ADAPTER = """
SELECT CASE e.event_type WHEN 'view' THEN 'zone_entered' WHEN 'click' THEN 'product_interaction' WHEN 'purchase' THEN 'zone_exited' WHEN 'signup' THEN 'person_seen' ELSE 'seat_released' END AS event_type,
  concat('store-', e.user_id % 3) AS store_id,
  concat('cam-', CASE WHEN e.user_id % 2 = 0 THEN e.user_id % 4 ELSE e.event_id % 4 END) AS camera_id,
  {epoch} AS ts,
  CASE WHEN e.user_id % 10 = 0 THEN concat('emp-', e.user_id) ELSE concat('person-', e.user_id) END AS global_id,
  CASE WHEN e.user_id % 10 = 0 THEN 'employee' ELSE 'customer' END AS role,
  CASE WHEN e.event_type = 'signup' THEN NULL ELSE concat('zone-', e.k % 48) END AS zone,
  CASE WHEN e.event_type = 'signup' THEN NULL WHEN e.k % 6 = 0 THEN 'entrance' WHEN e.k % 6 IN (1, 2) THEN 'shelf' WHEN e.k % 6 = 3 THEN 'seat' ELSE 'area' END AS zone_kind,
  CASE WHEN e.user_id % 10 = 0 THEN concat('emp-', e.user_id) ELSE NULL END AS employee_id,
  CAST(e.event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  e.event_id % 7 = 0 AS needs_review,
  CASE WHEN e.event_type IN ('purchase', 'error') THEN e.value ELSE NULL END AS dwell_seconds,
  e.props AS payload, e.event_id AS event_id, e.user_id AS user_id, e.k AS k
FROM (SELECT *, CAST({k} AS INT) AS k FROM {source}) e
"""
SPARK_ADAPTER = ADAPTER.format(epoch="CAST(unix_micros(CAST(e.ts AS TIMESTAMP)) AS DOUBLE) / 1e6D", k="get_json_object(props, '$.k')", source="{raw}")
DUCK_ADAPTER = ADAPTER.format(epoch="CAST(epoch_us(e.ts) AS DOUBLE) / 1e6", k="json_extract_string(props, '$.k')", source="events")


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark.read.parquet(f"{sf_dir}/events.parquet"))


def adapt(raw: DataFrame) -> DataFrame:
    return raw.sparkSession.sql(SPARK_ADAPTER, raw=raw)


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one of our own where it names none (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named and not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-state-"))
    return named.rstrip("/") if named else _own_dir[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read more than once is made once, and lost executors don't undo it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event lines as the flat table; a malformed line raises, blank lines are skipped."""
    return flatten(spark.read.schema(LINES).option("mode", "FAILFAST").json(path))


def flatten(raw: DataFrame) -> DataFrame:
    """The flat event table: three keys of the payload become columns."""
    required = ["event_type", "store_id", "camera_id", "timestamp", "global_id"]
    raw = raw.where(F.assert_true(F.forall(F.array(*[F.col(c).isNotNull() for c in required]), lambda x: x), F.lit("an event lacks a required key")).isNull())
    at = lambda key: F.get_json_object("payload", f"$.{key}")
    return raw.select(
        "event_type", "store_id", "camera_id", F.col("timestamp").alias("ts"), "global_id", "role", "zone",
        at("zone_kind").alias("zone_kind"), "employee_id", "confidence",
        truth(F.col("payload"), "needs_review").alias("needs_review"),
        at("dwell_seconds").cast("double").alias("dwell_seconds"), "payload",
    )


def truth(payload: Column, key: str) -> Column:
    """Whether a JSON value counts as true: not where it is missing, null, false, zero, or an empty text, list or object."""
    value = F.variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    kind, text = F.schema_of_variant(value), F.get_json_object(payload, f"$.{key}")
    empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(kind.rlike("^(ARRAY|OBJECT)"), text.isin("[]", "{}")).otherwise(text.try_cast("double") == 0)
    return F.when(value.isNull() | (kind == "VOID") | text.isNull(), False).otherwise(~F.coalesce(empty, F.lit(False)))


def append_table(events: DataFrame, path: str) -> int:
    """Appends flat events to a stored table, a folder for each store; gives the number of rows that it holds then."""
    events.write.mode("append").partitionBy("store_id").parquet(path)
    return events.sparkSession.read.parquet(path).count()


def write_lines(events: DataFrame, path: str, append: bool = False) -> None:
    events.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)
