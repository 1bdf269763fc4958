"""Retention, lifecycle and stickiness: who comes back, by calendar periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, matches
from eventloom.functions.values import half_up, percent


@dataclass(frozen=True)
class ActivitySpec:
    names: tuple[str, ...]
    date_from: str
    date_to: str
    unit: str = "day"
    tz: str = "UTC"
    filters: tuple[Filter, ...] = ()
    #: Retention only.
    kind: str = "recurring"
    periods: int = 11
    return_names: tuple[str, ...] = ()

    def validate(self) -> None:
        if self.unit not in ("day", "week", "month"):
            raise ValueError("unit is day, week or month")
        if not 1 <= self.periods <= 30 or self.kind not in ("recurring", "first_time"):
            raise ValueError("1 to 30 periods, recurring or first_time")


def _active(events: DataFrame, spec: ActivitySpec, date_from: str, date_to: str, names=None, filters=None) -> DataFrame:
    """person_id, bucket: a row for each period in which a person is active."""
    rows = events.where(matches(names or spec.names, spec.filters if filters is None else filters) & T.in_range(date_from, date_to, spec.tz))
    return rows.select("person_id", T.bucket(F.col("ts"), spec.unit, spec.tz).alias("bucket")).distinct()


def retention_pairs(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """person_id, cohort, offset; offset -1 stands for being in the cohort.

    Both ends of the range are moved to the starts of their periods; the last one's first day counts whole."""
    spec.validate()
    begin, last = (T.truncate(date.fromisoformat(d[:10]), spec.unit) for d in (spec.date_from, spec.date_to))
    if spec.kind == "recurring":
        cohort = _active(events, spec, begin.isoformat(), last.isoformat())
    else:  # first ever; filters don't count, the range is one of the first time
        first = events.where(matches(spec.names)).groupBy("person_id").agg(F.min("ts").alias("ts"))
        cohort = first.where(T.in_range(begin.isoformat(), last.isoformat(), spec.tz)).select("person_id", T.bucket(F.col("ts"), spec.unit, spec.tz).alias("bucket"))
    cohort = cohort.withColumnRenamed("bucket", "cohort")
    end = T.shift(last, spec.unit, spec.periods)
    back = _active(events, spec, begin.isoformat(), end.isoformat(), spec.return_names or spec.names)
    pairs = cohort.join(back, "person_id").withColumn("offset", T.periods_between(F.col("cohort"), F.col("bucket"), spec.unit))
    pairs = pairs.where((F.col("offset") >= 0) & (F.col("offset") <= spec.periods)).select("person_id", "cohort", "offset")
    return pairs.unionByName(cohort.select("person_id", "cohort", F.lit(-1).alias("offset")))


def retention(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """cohort, cohort_size, offset, n_persons, rate; a cohort without a returner has a row with offset null."""
    counts = retention_pairs(events, spec).groupBy("cohort", "offset").agg(F.count_distinct("person_id").alias("n_persons"))
    size = F.max(F.when(F.col("offset") == -1, F.col("n_persons"))).over(Window.partitionBy("cohort"))
    more = F.max("offset").over(Window.partitionBy("cohort"))
    rows = counts.withColumn("cohort_size", size).withColumn("more", more)
    rows = rows.where((F.col("offset") >= 0) | (F.col("more") == -1))
    offset = F.when(F.col("offset") >= 0, F.col("offset"))
    n = F.when(F.col("offset") >= 0, F.col("n_persons")).otherwise(0)
    return rows.select(T.label(F.col("cohort"), spec.unit).alias("cohort"), "cohort_size", offset.alias("offset"), n.alias("n_persons"), percent(n, F.col("cohort_size")).alias("rate"))


def retention_average(events: DataFrame, spec: ActivitySpec, as_of: str) -> DataFrame:
    """offset, average rate over the cohorts whose period at that offset is over by ``as_of`` (a date), weighted by size."""
    pairs = retention_pairs(events, spec)
    sizes = pairs.where("offset = -1").groupBy("cohort").agg(F.count_distinct("person_id").alias("size"))
    full = sizes.select("cohort", "size", F.explode(F.sequence(F.lit(0), F.lit(spec.periods))).alias("offset"))
    step = F.col("offset") + 1
    over = F.add_months("cohort", step) if spec.unit == "month" else F.date_add("cohort", step * (7 if spec.unit == "week" else 1))
    full = full.where(over <= F.lit(as_of).cast("date"))
    counts = pairs.where("offset >= 0").groupBy("cohort", "offset").agg(F.count_distinct("person_id").alias("n"))
    rows = full.join(counts, ["cohort", "offset"], "left").groupBy("offset").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum("size").alias("size"))
    return rows.select("offset", percent(F.col("n"), F.col("size")).alias("rate"))


def lifecycle_rows(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """person_id, bucket, status: new, returning, resurrecting or dormant."""
    spec.validate()
    first = T.truncate(date.fromisoformat(spec.date_from[:10]), spec.unit)
    start = T.shift(first, spec.unit, -1).isoformat()
    rows = _active(events, spec, start, spec.date_to)
    known = events.where(matches(spec.names)).where(F.col("ts") < T.literal(T.moment(start, False, spec.tz))).select("person_id").distinct().withColumn("known", F.lit(True))
    by = Window.partitionBy("person_id").orderBy("bucket")
    rows = rows.withColumn("before", F.lag("bucket").over(by)).withColumn("after", F.lead("bucket").over(by))
    rows = rows.join(known, "person_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    status = F.when(F.col("before").isNull() & ~F.col("known"), "new").when(F.col("before") == T.next_bucket(F.col("bucket"), spec.unit, -1), "returning").otherwise("resurrecting")
    low, high = F.lit(spec.date_from[:10]).cast("date"), F.lit(spec.date_to[:10]).cast("date")
    active = rows.where(F.col("bucket") >= low).select("person_id", "bucket", status.alias("status"))
    gone = T.next_bucket(F.col("bucket"), spec.unit)
    quiet = rows.where(F.col("after").isNull() | (F.col("after") != gone)).select("person_id", gone.alias("bucket"), F.lit("dormant").alias("status"))
    return active.unionByName(quiet.where((F.col("bucket") >= low) & (F.col("bucket") <= high)))


def lifecycle(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """bucket, status, n_persons; dormant ones are negative."""
    counts = lifecycle_rows(events, spec).groupBy(T.label(F.col("bucket"), spec.unit).alias("bucket"), "status").agg(F.count_distinct("person_id").alias("n"))
    return counts.select("bucket", "status", F.when(F.col("status") == "dormant", -F.col("n")).otherwise(F.col("n")).alias("n_persons"))


def lifecycle_totals(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    return lifecycle(events, spec).groupBy("status").agg(F.sum("n_persons").alias("n_persons"))


def stickiness_rows(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """person_id, n_active: in how many periods a person is active."""
    spec.validate()
    return _active(events, spec, spec.date_from, spec.date_to).groupBy("person_id").agg(F.count("*").alias("n_active"))


def stickiness(events: DataFrame, spec: ActivitySpec) -> DataFrame:
    """n_active, n_persons, share (percent of all active persons), total_periods."""
    counts = stickiness_rows(events, spec).groupBy("n_active").agg(F.count("*").alias("n_persons"))
    #: A row for each number of periods at most.
    whole = F.sum("n_persons").over(Window.partitionBy(F.lit(1)))
    total = F.lit(T.n_periods(spec.date_from, spec.date_to, spec.unit)).cast("long")
    return counts.select("n_active", "n_persons", half_up(F.col("n_persons") * 100.0 / whole, 1).alias("share"), total.alias("total_periods"))
