"""User paths: ordered names of a person's events, as transitions and as whole paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import all_of
from eventloom.functions.values import history

TOP_PATHS = 20


@dataclass(frozen=True)
class PathSpec:
    date_from: str
    date_to: str
    step_limit: int = 5
    start_event: str = ""
    end_event: str = ""
    exclusions: tuple[str, ...] = ()
    min_persons: int = 1
    tz: str = "UTC"
    #: (name, patterns with * and ?) and (name, regular expression); the first that matches renames an event.
    groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rules: tuple[tuple[str, str], ...] = ()

    def validate(self) -> None:
        if not 3 <= self.step_limit <= 1000:
            raise ValueError("3 to 1000 steps")


def cleaned(spec: PathSpec) -> Column:
    name, out = F.col("event_name"), None
    wild = lambda p: "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"
    for to, pattern in [*((g, wild(p)) for g, some in spec.groups for p in some), *spec.rules]:
        out = F.when(name.rlike(pattern), F.lit(to)) if out is None else out.when(name.rlike(pattern), F.lit(to))
    return name if out is None else out.otherwise(name)


def person_paths(events: DataFrame, spec: PathSpec) -> DataFrame:
    """person_id, path: at least two names. Repeats in a row are one, then the path is cut to its limit, then to
    what begins with the start event and ends before the end event; without those there is no path."""
    spec.validate()
    inside = T.in_range(spec.date_from, spec.date_to, spec.tz)
    rows = events.where(all_of([inside, *([~F.col("event_name").isin(*spec.exclusions)] if spec.exclusions else [])]))
    if spec.start_event:
        began = events.where(inside & (F.col("event_name") == spec.start_event)).select("person_id").distinct()
        rows = rows.join(began, "person_id", "left_semi")
    by = Window.partitionBy("person_id").orderBy("ms", "event_id")
    rows = rows.select("person_id", "ms", "event_id", cleaned(spec).alias("name")).withColumn("before", F.lag("name").over(by))
    #: Only the first steps of a person are ever held together, however many events there are; the windows spill.
    rows = rows.where(~F.col("name").eqNullSafe(F.col("before"))).withColumn("place", F.row_number().over(by)).where(F.col("place") <= spec.step_limit)
    rows = rows.groupBy("person_id").agg(history("place", "name").alias("h"))
    rows = rows.select("person_id", F.transform("h", lambda e: e["name"]).alias("path")).where(F.size("path") >= 2)
    if spec.start_event:
        at = F.array_position("path", spec.start_event)
        rows = rows.where(at > 0).withColumn("path", F.slice("path", F.greatest(at, F.lit(1)).cast("int"), F.size("path"))).where(F.size("path") >= 2)
    if spec.end_event:
        at = F.array_position("path", spec.end_event)
        rows = rows.where(at > 0).withColumn("path", F.slice("path", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    return rows.where(F.size("path") >= 2)


def transitions(events: DataFrame, spec: PathSpec) -> DataFrame:
    """step (from 1), source, target, n_persons."""
    rows = person_paths(events, spec)
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("step"), F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))
    rows = rows.select("person_id", F.explode(steps).alias("x")).select("person_id", "x.*")
    return rows.groupBy("step", "source", "target").agg(F.count_distinct("person_id").alias("n_persons")).where(F.col("n_persons") >= spec.min_persons)


def top_paths(events: DataFrame, spec: PathSpec) -> DataFrame:
    """path (names joined by ' > '), n_persons of the most frequent whole paths."""
    rows = person_paths(events, spec).select("person_id", F.array_join("path", " > ").alias("path"))
    counts = rows.groupBy("path").agg(F.count_distinct("person_id").alias("n_persons"))
    return counts.orderBy(F.desc("n_persons"), "path").limit(TOP_PATHS)
