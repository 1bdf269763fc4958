"""The events model made of the given test tables: what they lack (overrides, members, pages, places) follows from their numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timeutil import millis
from eventloom.sources.model import resolve_persons

PROJECT = "p1"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name where driver and executors share one: in spark.checkpoint.dir, in local mode else in a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="eventloom-")
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _properties():
    """The table's property k, and more of several JSON kinds by the event's number."""
    more = {
        1: ', "plan": "free", "ok": true}',
        2: ', "plan": "pro", "ok": false}',
        3: ', "plan": "", "ok": null}',
        4: ', "plan": "12.5", "seen": "2024-01-15"}',
    }
    tail = F.lit("}")
    for k, text in more.items():
        tail = F.when(F.col("event_id") % 5 == k, F.lit(text)).otherwise(tail)
    return F.concat(F.expr("substring(props, 1, length(props) - 1)"), tail)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the columns of the model; person_id is the one that came with the event."""
    user, third = F.col("user_id").cast("string"), F.col("user_id") % 3
    pick = lambda a, b, c: F.when(third == 0, a).when(third == 1, b).otherwise(c)
    return read(spark, sf_dir, "events").select(
        F.lit(PROJECT).alias("project_id"),
        "event_id",
        F.col("event_type").alias("event_name"),
        user.alias("distinct_id"),
        user.alias("person_id"),
        "ts",
        millis(F.col("ts")).alias("ms"),
        "value",
        _properties().alias("properties"),
        F.format_string('{"segment": "s%d"}', F.col("user_id") % 5).alias("user_properties"),
        F.concat(user, F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("page_path"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("ref"), (F.col("event_id") % 4).cast("string"))).alias("referrer"),
        pick("desktop", "mobile", "tablet").alias("device_type"),
        pick("chrome", "firefox", "safari").alias("browser"),
        pick("linux", "windows", "macos").alias("os"),
        "user_id",
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, distinct_id, person_id, version: every tenth user was merged, twice."""
    users = read(spark, sf_dir, "events").where("user_id % 10 = 0").select("user_id").distinct()
    rows = users.select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return rows.select(
        F.lit(PROJECT).alias("project_id"),
        F.col("user_id").cast("string").alias("distinct_id"),
        (F.col("user_id") + 3 - F.col("version")).cast("string").alias("person_id"),
        F.col("version").cast("long").alias("version"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that all insights read: resolved persons, one project."""
    return resolve_persons(raw_events(spark, sf_dir), overrides(spark, sf_dir))


def with_geography(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Adds country and region of the user's nation."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("nation_key"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return rows.join(places, F.col("user_id") % 25 == F.col("nation_key"), "left").drop("nation_key")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, properties (JSON), created_at, updated_at of every person seen."""
    rows = events(spark, sf_dir)
    return rows.groupBy("project_id", "person_id").agg(F.max_by("user_properties", F.struct("ts", "event_id")).alias("properties"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("project_id", "person_id", "distinct_id").distinct()


def static_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort_id, person_id: an uploaded cohort, every fourth user."""
    return read(spark, sf_dir, "events").where("user_id % 4 = 0").select(F.lit("c_static").alias("cohort_id"), F.col("user_id").cast("string").alias("person_id")).distinct()


def materialized_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort_id, person_id, version: a computed cohort."""
    return read(spark, sf_dir, "events").where("user_id % 7 < 3").select(F.lit("c_dynamic").alias("cohort_id"), F.col("user_id").cast("string").alias("person_id"), F.lit(1).cast("long").alias("version")).distinct()
