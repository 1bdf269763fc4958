"""The events model: its tables as files, and identity and deduplication on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timeutil import millis

#: Columns of the tables beside the events: persons that distinct ids were moved to, and members of cohorts.
OVERRIDES = "project_id string, distinct_id string, person_id string, version long"
MEMBERS = "cohort_id string, person_id string, version long"


def stored_events(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> DataFrame:
    """The model that insights read, of events as ``files.write_events`` writes them: ``ms`` added, persons resolved."""
    rows = spark.read.parquet(path)
    rows = rows if "ms" in rows.columns else rows.withColumn("ms", millis(F.col("ts")))
    return rows.withColumn("raw_person_id", F.col("person_id")) if overrides is None else resolve_persons(rows, overrides)


def stored_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERRIDES).parquet(path)


def stored_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMBERS).parquet(path)


def latest_overrides(rows: DataFrame) -> DataFrame:
    """One row a distinct id: that of the last version; of equal versions the larger person."""
    return rows.groupBy("project_id", "distinct_id").agg(F.max(F.struct("version", "person_id"))["person_id"].alias("person_id"))


def resolve_persons(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events with the person that their distinct id belongs to now; ``raw_person_id`` keeps the event's own.

    A left join without a hint: Spark broadcasts the overrides if they are below its threshold, else both sides are dealt."""
    now = latest_overrides(rows).withColumnRenamed("person_id", "now_id")
    joined = events.withColumnRenamed("person_id", "raw_person_id").join(now, ["project_id", "distinct_id"], "left")
    return joined.withColumn("person_id", F.coalesce("now_id", "raw_person_id")).drop("now_id")


def dedup_latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key: the one with the largest version, of equal ones the largest row."""
    rest = [c for c in rows.columns if c not in (*key, version)]
    best = rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("best"))
    return best.select(*key, "best.*").select(*rows.columns)
