"""Tables that the ingest job keeps beside the events: snapshots that are swapped in whole, and the log of what it did.

A snapshot is a folder ``version=<step>``; readers take the newest complete one before their own step, so a batch that is written again starts from
the same state and replaces what it wrote. Steps rise: batch n is step ``n * STEPS``, and replays after it take the steps that follow."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Replays between two batches.
STEPS = 1000
#: Versions of a snapshot that are kept.
KEPT = 3
LOG = "kind string, batch long, at_ms long, what string"


def place(spark: SparkSession, path: str):
    """A path and its filesystem, wherever Spark can write."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, or all that a pattern with stars names."""
    at, files = place(spark, path)
    for status in files.globStatus(at) or []:
        files.delete(status.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = place(spark, path)
    return files.exists(at)


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix>=<number>`` that were written to their end."""
    at, files = place(spark, path)
    if not files.exists(at):
        return []
    found = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith(f"{prefix}=")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix(f"{prefix}=")) for p in done)


def snapshot(spark: SparkSession, path: str, schema: str, step: int) -> DataFrame:
    """The newest version before a step; an empty table at first."""
    known = [n for n in numbers(spark, path, "version") if n < step]
    return spark.read.schema(schema).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)


def newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return snapshot(spark, path, schema, 1 << 62)


def swap_in(rows: DataFrame, path: str, step: int) -> DataFrame:
    """Write a version whole and forget the oldest ones; a version isn't seen before it is complete."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/version={step}")
    for old in [n for n in numbers(spark, path, "version") if n < step][: -(KEPT - 1)]:
        remove(spark, f"{path}/version={old}")
    return spark.read.schema(rows.schema).parquet(f"{path}/version={step}")


def note(spark: SparkSession, out: str, kind: str, batch: int, what: str = "", at_ms: int | None = None) -> None:
    """A line of the log: attempt, written, dead, replayed, replay_failed."""
    row = [(kind, batch, int(time.time() * 1000) if at_ms is None else at_ms, what[:500])]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").json(f"{out}/log")


def log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{out}/log") if exists(spark, f"{out}/log") else spark.createDataFrame([], LOG)


def next_step(spark: SparkSession, out: str, folder: str = "seen/filter") -> int:
    """A step after all that have been taken so far, for a replay."""
    return max(numbers(spark, f"{out}/{folder}", "version"), default=-1) + 1


def open_until(spark: SparkSession, out: str, failures: int, rest_ms: int) -> int:
    """Until when replays rest: ``rest_ms`` after the last of ``failures`` failed replays in a row; 0 if they needn't.

    A rest that is over starts the count anew."""
    rows = log(spark, out).where(F.col("kind").isin("replayed", "replay_failed")).orderBy(F.desc("at_ms"), "kind").limit(failures).collect()
    row = 0
    for r in rows:
        if r["kind"] != "replay_failed":
            break
        row += 1
    return rows[0]["at_ms"] + rest_ms if row >= failures else 0
