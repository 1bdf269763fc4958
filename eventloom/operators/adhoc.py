"""Ad-hoc comparisons: segments, causes of a change, gaps of a funnel, time between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, all_of, condition, matches
from eventloom.functions.selection import exact_percentiles
from eventloom.functions.values import Property, half_up, ratio

METRICS = ("total_events", "unique_users", "events_per_user")


def _measure(metric: str, inside: Column) -> Column:
    users = F.count_distinct(F.when(inside, F.col("person_id")))
    if metric == "unique_users":
        return users.cast("double")
    n = F.count_if(inside)
    return n.cast("double") if metric == "total_events" else ratio(n, users)


def change_percent(before: Column, after: Column) -> Column:
    """Relative change; from 0 it is 0 or 100."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(half_up((after - before) * 100.0 / before, 2))


def segment_compare(events: DataFrame, name: str, metric: str, a: tuple[Filter, ...], b: tuple[Filter, ...], date_from: str, date_to: str) -> DataFrame:
    """value_a, value_b, diff_percent of two filter sets, in one pass."""
    rows = events.where(matches((name,)) & T.in_range(date_from, date_to))
    sums = rows.agg(_measure(metric, all_of(map(condition, a))).alias("value_a"), _measure(metric, all_of(map(condition, b))).alias("value_b"))
    return sums.withColumn("diff_percent", change_percent(F.col("value_a"), F.col("value_b")))


def metric_change(events: DataFrame, name: str, metric: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """value_before, value_after, change_percent of two ranges, in one pass."""
    a, b = T.in_range(*first), T.in_range(*second)
    sums = events.where(matches((name,)) & (a | b)).agg(_measure(metric, a).alias("value_before"), _measure(metric, b).alias("value_after"))
    return sums.withColumn("change_percent", change_percent(F.col("value_before"), F.col("value_after")))


def metric_change_by(events: DataFrame, name: str, metric: str, dimension: str, first: tuple[str, str], second: tuple[str, str], top: int = 20) -> DataFrame:
    """segment, value_before, value_after, contribution (its part of the whole change) of the segments that changed most."""
    a, b = T.in_range(*first), T.in_range(*second)
    rows = events.where(matches((name,)) & (a | b)).withColumn("segment", Property(dimension).text)
    both = rows.groupBy("segment").agg(_measure(metric, a).alias("value_before"), _measure(metric, b).alias("value_after")).na.fill(0.0, ["value_before", "value_after"])
    total = both.agg((F.sum("value_after") - F.sum("value_before")).alias("whole"))
    #: One row on the right.
    out = both.crossJoin(total).withColumn("change", F.col("value_after") - F.col("value_before")).orderBy(F.desc(F.abs("change")), "segment").limit(top)
    return out.select("segment", "value_before", "value_after", F.when(F.col("whole") == 0, 0.0).otherwise(half_up(F.try_divide(F.col("change") * 100.0, "whole"), 2)).alias("contribution"))


def first_event(events: DataFrame, name: str, date_from: str, date_to: str) -> DataFrame:
    """person_id, start: each person's first event of the name in the range."""
    return events.where(matches((name,)) & T.in_range(date_from, date_to)).groupBy("person_id").agg(F.min("ts").alias("start"))


def funnel_gaps(events: DataFrame, start: str, end: str, date_from: str, date_to: str, least: int = 30, top: int = 10) -> DataFrame:
    """Events after a person's first ``start`` that go with reaching ``end``: counts, rates (percent) with and without, lift.

    Both groups have ``least`` persons. The ``top`` by difference of rates are kept."""
    entrants = first_event(events, start, date_from, date_to)
    later = events.where(T.in_range(date_from, date_to) & (F.col("event_name") != start)).join(entrants, "person_id").where("ts > start")
    seen = later.groupBy("person_id", "event_name").agg(F.lit(1).alias("one"))
    done = seen.where(F.col("event_name") == end).select("person_id", F.lit(True).alias("done"))
    people = entrants.select("person_id").join(done, "person_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    by = seen.where(F.col("event_name") != end).select("person_id", "event_name").join(people, "person_id")
    by = by.groupBy("event_name").agg(F.count("*").alias("n_with"), F.count_if("done").alias("done_with"))
    whole = people.agg(F.count("*").alias("n_all"), F.count_if("done").alias("done_all"))
    #: One row on the right.
    both = by.crossJoin(whole).withColumn("n_without", F.col("n_all") - F.col("n_with")).where((F.col("n_with") >= least) & (F.col("n_without") >= least))
    a, b = F.col("done_with") / F.col("n_with"), (F.col("done_all") - F.col("done_with")) / F.col("n_without")
    both = both.withColumn("gap", F.abs(a - b)).orderBy(F.desc("gap"), "event_name").limit(top)
    return both.select("event_name", "n_with", "n_without", half_up(a * 100, 2).alias("rate_with"), half_up(b * 100, 2).alias("rate_without"), F.when(b > 0, half_up((a - b) * 100 / b, 2)).otherwise(0.0).alias("lift_percent"))


def time_between(events: DataFrame, a: str, b: str, max_days: int, date_from: str, date_to: str) -> DataFrame:
    """person_id, seconds from the first ``a`` to the first ``b`` after it, within so many days."""
    starts = events.where(matches((a,)) & T.in_range(date_from, date_to)).groupBy("person_id").agg(F.min("ms").alias("start"))
    later = events.where(matches((b,))).select("person_id", "ms").join(starts, "person_id")
    later = later.where((F.col("ms") > F.col("start")) & (F.col("ms") <= F.col("start") + max_days * 86_400_000))
    return later.groupBy("person_id", "start").agg(F.min("ms").alias("stop")).select("person_id", F.floor((F.col("stop") - F.col("start")) / 1000).alias("seconds"))


def time_percentiles(times: DataFrame) -> DataFrame:
    """n, avg_seconds and nearest-rank percentiles."""
    exact = [F.expr(f"percentile_disc({p}) within group (order by seconds)").alias(n) for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))]
    return times.agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds"), *exact)


def selected_time_percentiles(times: DataFrame) -> DataFrame:
    """As ``time_percentiles``, narrowed down by passes, so that no buffer holds all persons' times."""
    names = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    found = exact_percentiles(times, F.col("seconds"), list(names.values()), discrete=True)
    out = times.agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds"))
    return out.select("*", *[F.lit(v).cast("double").alias(name) for name, v in zip(names, found)])


def equal_bins(times: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n of equal width between the least and the largest; one bin if all are equal."""
    ends = times.agg(F.min("seconds").alias("low"), F.max("seconds").alias("high"))
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor(F.try_divide((F.col("seconds") - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(bins - 1)))
    #: One row on the right.
    return times.crossJoin(ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def query_persons(events: DataFrame, filters: tuple[Filter, ...] = (), order: str = "event_count", limit: int = 25) -> DataFrame:
    """person_id, event_count, first_seen, last_seen (milliseconds)."""
    rows = events.where(all_of(map(condition, filters))).groupBy("person_id")
    rows = rows.agg(F.count("*").alias("event_count"), F.min("ms").alias("first_seen"), F.max("ms").alias("last_seen"))
    return rows.orderBy(F.desc(order), "person_id").limit(limit)


def cohort_sample(events: DataFrame, members: DataFrame, bag: str = "user_properties", limit: int = 25) -> DataFrame:
    """Latest properties of a cohort's first persons by id."""
    rows = events.join(members.select("person_id"), "person_id", "left_semi").groupBy("person_id")
    return rows.agg(F.max_by(bag, F.struct("ts", "event_id")).alias(bag)).orderBy("person_id").limit(limit)
