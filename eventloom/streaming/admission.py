"""What a project may send: a rate over a sliding minute and a monthly quota, held as counters from batch to batch.

Time is cut into buckets of ten seconds. In each, a project is let in as far as the bucket and the five before it have less than the rate's limit
of events that were let in, and, of these, as far as its month has less than the plan's. What the rate refuses is answered ``rate_limited`` and may
come again; what the quota refuses is answered ``quota_limited``. Neither counts. Inside a bucket, events are taken by time and id.

Only counts by project and bucket are gone through one after another; the events themselves are ranked inside their bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.sources.package import ship

RATE, BUCKET_MS, WINDOW_BUCKETS = 100_000, 10_000, 6
#: Counters: of a bucket (at: its number), or of a month (at: its number since 1970).
COUNTERS = "project_id string, kind string, at long, n long"
PLANS = "project_id string, events_limit long"


def month_number(ms):
    at = F.timestamp_millis(ms)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return (F.year(utc) * 12 + F.month(utc)).cast("long")


def _rooms(counts: DataFrame, rate: int) -> DataFrame:
    """project_id, bucket, rate_room, room: how many events a bucket's rate lets in, and how many of these the quota; counters at the end.

    ``counts``: project_id, bucket, month, n, events_limit, and rows of earlier counters (kind not null)."""
    schema = "project_id string, bucket long, month long, rate_room long, room long, n long"
    arrow = pa.schema([("project_id", pa.string()), *[(c, pa.int64()) for c in ("bucket", "month", "rate_room", "room", "n")]])
    rows = counts.select("project_id", "at", "kind", "month", "n", "events_limit").repartition("project_id").sortWithinPartitions("project_id", F.desc("kind"), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, recent, months = None, {}, {}
        for batch in batches:
            out = []
            for key, at, kind, month, n, limit in zip(*(c.to_pylist() for c in batch.columns)):
                if key != project:
                    project, recent, months = key, {}, {}
                if kind == "old_bucket":
                    recent[at] = n
                elif kind == "old_month":
                    months[at] = n
                else:
                    recent = {b: m for b, m in recent.items() if at - WINDOW_BUCKETS < b <= at}
                    rate_room = min(n, max(0, rate - sum(recent.values())))
                    room = rate_room if limit is None else min(rate_room, max(0, limit - months.get(month, 0)))
                    recent[at] = recent.get(at, 0) + room
                    months[month] = months.get(month, 0) + room
                    out.append((key, at, month, rate_room, room, n))
            yield pa.record_batch([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(6)], schema=arrow)

    ship(counts.sparkSession)
    return rows.mapInArrow(run, schema)


def admit(rows: DataFrame, counters: DataFrame, plans: DataFrame, rate: int = RATE, at: str = "ms") -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``answer`` (null: let in), and the counters after them. ``at``: the column of arrival times in milliseconds.

    ``plans``: project_id, events_limit a month (null, or no row: none)."""
    marked = rows.withColumn("__bucket", F.floor(F.col(at) / BUCKET_MS))
    counts = marked.groupBy("project_id", "__bucket").agg(F.count("*").alias("n"), F.min(month_number(F.col(at))).alias("month"))
    counts = counts.join(plans.select("project_id", "events_limit"), "project_id", "left").select("project_id", F.col("__bucket").alias("at"), F.lit("new").alias("kind"), "month", "n", "events_limit")
    old = counters.select("project_id", "at", F.concat(F.lit("old_"), "kind").alias("kind"), F.lit(None).cast("long").alias("month"), "n", F.lit(None).cast("long").alias("events_limit"))
    rooms = _rooms(counts.unionByName(old), rate)
    rank = F.row_number().over(Window.partitionBy("project_id", "__bucket").orderBy(at, "event_id"))
    some = rooms.where("room < n").select(F.col("project_id").alias("__p"), F.col("bucket").alias("__b"), "rate_room", "room")
    judged = marked.withColumn("__rank", rank).join(some, F.col("project_id").eqNullSafe(F.col("__p")) & (F.col("__bucket") == F.col("__b")), "left")
    answer = F.when(F.col("__rank") > F.col("rate_room"), "rate_limited").when(F.col("__rank") > F.col("room"), "quota_limited")
    judged = judged.withColumn("answer", answer).select(*rows.columns, "answer")
    new = rooms.select("project_id", F.explode(F.array(F.struct(F.lit("bucket").alias("kind"), F.col("bucket").alias("at"), F.col("room").alias("n")), F.struct(F.lit("month").alias("kind"), F.col("month").alias("at"), F.col("room").alias("n")))).alias("x"))
    after = counters.unionByName(new.select("project_id", "x.*")).groupBy("project_id", "kind", "at").agg(F.sum("n").alias("n"))
    #: Buckets that no later one looks at are forgotten, and all months but a project's last two.
    last = Window.partitionBy("project_id", "kind")
    keep = F.when(F.col("kind") == "bucket", F.col("at") > F.max("at").over(last) - WINDOW_BUCKETS).otherwise(F.col("at") > F.max("at").over(last) - 2)
    return judged, after.withColumn("keep", keep).where("keep").drop("keep")
