"""Web analytics over client-given sessions: KPIs, time series, pages, sources, devices, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.values import Property, half_up, percent

#: A session with one page view and less than this is a bounce.
BOUNCE_SECONDS, TOP, PAGE_VIEW = 10, 20, "view"
#: Dimensions of page views by name: columns, and properties of campaigns.
DIMENSIONS = {c: c for c in ("referrer", "country", "region", "city", "device_type", "browser", "os")} | {c: f"properties.{c}" for c in ("utm_source", "utm_medium", "utm_campaign")}


def sessions(events: DataFrame, date_from: str, date_to: str, tz: str = "UTC", page_view: str = PAGE_VIEW) -> DataFrame:
    """A row a session with a page view: pageviews, start, seconds, bounced, person, entry and exit page, and its first attributes."""
    rows = events.where(T.in_range(date_from, date_to, tz) & (F.col("session_id") != ""))
    seen = F.col("event_name") == page_view
    at = F.struct("ts", "event_id")
    page = lambda f: f(F.when(seen, F.col("page_path")), F.when(seen, at))
    more = [F.min_by(c, at).alias(c) for c in ("referrer", "device_type", "browser", "os", "country", "region") if c in events.columns]
    out = rows.groupBy("session_id").agg(F.count_if(seen).alias("pageviews"), F.min("ts").alias("start"), F.min("ms").alias("a"), F.max("ms").alias("b"), F.min("person_id").alias("person_id"), page(F.min_by).alias("entry_page"), page(F.max_by).alias("exit_page"), *more)
    out = out.where("pageviews > 0").withColumn("seconds", F.floor((F.col("b") - F.col("a")) / 1000))
    return out.withColumn("bounced", (F.col("pageviews") == 1) & (F.col("seconds") < BOUNCE_SECONDS)).drop("a", "b")


def metrics() -> list[Column]:
    return [
        F.count_distinct("person_id").alias("visitors"),
        F.coalesce(F.sum("pageviews"), F.lit(0)).alias("pageviews"),
        F.count("*").alias("n_sessions"),
        F.coalesce(half_up(F.avg("seconds"), 2), F.lit(0.0)).alias("avg_seconds"),
        percent(F.count_if("bounced"), F.count("*")).alias("bounce_rate"),
    ]


def kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(*metrics())


def timeseries(rows: DataFrame, unit: str = "day", tz: str = "UTC") -> DataFrame:
    return rows.groupBy(T.label(T.bucket(F.col("start"), unit, tz), unit).alias("bucket")).agg(*metrics())


def top_by(rows: DataFrame, column: str, order: str = "visitors") -> DataFrame:
    """value, visitors, pageviews of the largest values of a session's attribute; empty ones are left out."""
    counts = rows.where((F.col(column) != "") & F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    counts = counts.agg(F.count_distinct("person_id").alias("visitors"), F.sum("pageviews").alias("pageviews"))
    return counts.orderBy(F.desc(order), "value").limit(TOP)


def top_pages(events: DataFrame, date_from: str, date_to: str, tz: str = "UTC", page_view: str = PAGE_VIEW) -> DataFrame:
    rows = events.where(T.in_range(date_from, date_to, tz) & (F.col("event_name") == page_view) & (F.col("page_path") != ""))
    counts = rows.groupBy(F.col("page_path").alias("value")).agg(F.count_distinct("person_id").alias("visitors"), F.count("*").alias("pageviews"))
    return counts.orderBy(F.desc("pageviews"), "value").limit(TOP)


def top_dimension(events: DataFrame, dimension: str, date_from: str, date_to: str, tz: str = "UTC", page_view: str = PAGE_VIEW) -> DataFrame:
    """value, visitors, pageviews of the largest values that page views have in a dimension; empty ones are left out."""
    rows = events.where(T.in_range(date_from, date_to, tz) & (F.col("event_name") == page_view)).select("person_id", Property(DIMENSIONS[dimension]).text.alias("value"))
    counts = rows.where("value <> ''").groupBy("value").agg(F.count_distinct("person_id").alias("visitors"), F.count("*").alias("pageviews"))
    return counts.orderBy(F.desc("visitors"), "value").limit(TOP)
