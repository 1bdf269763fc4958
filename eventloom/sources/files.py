"""Readers and writers: JSON batches and imports, member lists, the events table by month, exports, deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timeutil import month

#: An event as clients send it.
EVENT_SCHEMA = (
    "project_id string, event_id string, event string, distinct_id string, anonymous_id string, user_id string, properties string, user_properties string, timestamp string, sent_at string, ip string, user_agent string, "
    "session_id string, url string, referrer string, page_title string, page_path string, device_type string, browser string, browser_version string, os string, os_version string, screen_width string, screen_height string, "
    "language string, timezone string, sdk_name string, sdk_version string, batch_id string"
)
ID_HEADERS = {"distinct_id": "distinct_id", "id": "person_id", "person_id": "person_id", "user_id": "distinct_id", "email": "email", "e-mail": "email"}


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; broken lines are kept in _corrupt for the warnings."""
    return spark.read.schema(EVENT_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an import: one broken line, or one without a timestamp, fails all of it, whichever columns are read."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.where(F.when(F.trim("timestamp") != "", F.lit(True)).otherwise(F.raise_error(F.lit("an imported event has no timestamp"))))


class ImportRejected(ValueError):
    """An import with bad lines; nothing of it was kept."""

    def __init__(self, bad: int, lines: int):
        super().__init__(f"{bad} of {lines} lines are broken or have no timestamp")
        self.bad, self.lines = bad, lines


def import_events(spark: SparkSession, path: str, target: str, name: str) -> int:
    """Add JSON lines to the imports under ``target`` as ``import=<name>``, all or nothing; the number of events.

    Lines are checked while they are written to a folder of their own, which becomes the import in one step if none is bad, and is deleted otherwise.
    An import of the same name is replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    stage, final = place(f"{target}/.stage-{uuid.uuid4().hex}"), place(f"{target}/import={name}")
    store = stage.getFileSystem(spark._jsc.hadoopConfiguration())
    bad = F.col("_corrupt").isNotNull() | (F.coalesce(F.trim("timestamp"), F.lit("")) == "")
    seen = Observation()
    rows = read_batch(spark, path).observe(seen, F.count_if(bad).alias("bad"), F.count("*").alias("lines"))
    try:
        rows.drop("_corrupt").write.parquet(stage.toString())
        found = seen.get
        if found["bad"]:
            raise ImportRejected(found["bad"], found["lines"])
        store.delete(final, True)
        store.rename(stage, final)
        return found["lines"]
    finally:
        store.delete(stage, True)


def read_member_csv(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """id column of a member list and what kind of id it is, by the header."""
    rows = spark.read.csv(path, header=True)
    kind = ID_HEADERS.get(rows.columns[0].strip().lower()) if rows.columns else None
    if kind is None:
        raise ValueError(f"the first column's header is one of {', '.join(ID_HEADERS)}")
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("id")), kind


def write_events(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by month, sorted for scans by event name and time. Rows are dealt by ranges of these, so a month, or a name that
    most events have, is spread over as many tasks and files as it needs."""
    order = ["event_month", "event_name", "ts"]
    rows = rows.withColumn("event_month", month(F.col("ts"))).repartitionByRange(*order)
    rows.sortWithinPartitions("event_month", "project_id", "event_name", "ts").write.mode(mode).partitionBy("event_month").parquet(path)


def drop_expired(rows: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    return rows.where(F.col("ts") >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))


def delete_where(spark: SparkSession, path: str, target: str, condition: Column) -> None:
    """Rewrite a table without the rows that meet the condition; a null result keeps the row."""
    spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))).write.parquet(target)


def delete_in_place(spark: SparkSession, path: str, condition: Column, partition: str = "event_month") -> list:
    """Delete rows of a partitioned table; only partitions that hold a match are rewritten (and those left empty taken away), and their values returned.

    The new files of all of them are swapped in when the last is written. A null result of the condition keeps the row."""
    match = F.coalesce(condition, F.lit(False))
    table = spark.read.parquet(path)
    #: A row a partition.
    hit = [r[0] for r in table.where(match).select(F.col(partition).alias("p")).distinct().orderBy("p").collect()]
    if not hit:
        return []
    mine = F.col(partition).isin([v for v in hit if v is not None]) | (F.col(partition).isNull() if None in hit else F.lit(False))
    rest = table.where(mine & ~match)
    left = {r[0] for r in rest.select(partition).distinct().collect()}
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(place):
        name = folder.getPath().getName()
        if name.startswith(f"{partition}=") and any(name == f"{partition}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in hit if v not in left):
            store.delete(folder.getPath(), True)
    spark.catalog.refreshByPath(path)
    return hit


def after(rows: DataFrame, cursor: tuple | None, keys: tuple[str, str], limit: int) -> DataFrame:
    """A page of rows after a cursor, in order of two keys; the first key's filter reaches the scan."""
    a, b = (F.col(k) for k in keys)
    if cursor is not None:
        rows = rows.where((a >= cursor[0]) & ((a > cursor[0]) | (b > cursor[1])))
    return rows.orderBy(*keys).limit(limit)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def markdown_header(rows: DataFrame) -> str:
    """The two first lines of a Markdown table."""
    names = [c.replace("|", "\\|") for c in rows.columns]
    return f"| {' | '.join(names)} |\n|{' --- |' * len(names)}\n"


def export_markdown(rows: DataFrame, path: str) -> None:
    """A Markdown table: its header in the first file by name, its lines in the files after it."""
    names = rows.sparkSession.createDataFrame([(markdown_header(rows).rstrip("\n"),)], "value string")
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", " ") for c in rows.columns]
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    place = rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    names.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.header")
    files = place(path).getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(place(f"{path.rstrip('/')}.header")) if f.getPath().getName().startswith("part-"))
    files.rename(part, place(f"{path.rstrip('/')}/header-00000.txt"))
    files.delete(place(f"{path.rstrip('/')}.header"), True)
