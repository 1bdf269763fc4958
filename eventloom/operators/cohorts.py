"""Cohorts: a tree of conditions becomes a set of persons; membership tables, order of computation, upkeep."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, condition, matches
from eventloom.functions.values import Property, history
from eventloom.operators import chunks
from eventloom.streaming.tables import numbers, remove

MOST_LEAVES, MOST_DEPTH, MOST_IN_GROUP, MOST_COHORTS, MOST_DAYS = 50, 4, 20, 20, 365
PERCENTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@dataclass
class Bounds:
    """``as_of`` stands for now (a time in UTC); with ``date_from`` the absence conditions look at that range."""

    as_of: datetime
    date_from: str | None = None

    def ago(self, days: int) -> Column:
        return T.literal(self.as_of - timedelta(days=days))

    @property
    def now(self) -> Column:
        return T.literal(self.as_of)

    def since(self, days: int) -> Column:
        return T.literal(T.moment(self.date_from)) if self.date_from else self.ago(days)


@dataclass
class Context:
    """What conditions are computed on. ``members``: cohort_id, person_id of materialised and static cohorts."""

    events: DataFrame
    bounds: Bounds
    members: DataFrame | None = None
    most_events: int = chunks.MOST_EVENTS
    whole_bytes: int = chunks.WHOLE_BYTES


def _filters(rows) -> tuple[Filter, ...]:
    return tuple(Filter(f["property"], f["operator"], f.get("value", ""), tuple(f.get("values", ()))) for f in rows or ())


def _compare(x: Column, operator: str, n) -> Column:
    return {"gte": x >= n, "lte": x <= n, "eq": x == n}[operator]


def _window(c: Context, days: int) -> DataFrame:
    return c.events.where((F.col("ts") >= c.bounds.ago(days)) & (F.col("ts") <= c.bounds.now))


def _in_spans(c: Context, x: dict, marks: list[Column]) -> DataFrame:
    """person_id, in0, in1, ...: whether a person has the event in each span between two marks; the last one includes its end. One pass."""
    rows = c.events.where(matches((x["event_name"],), _filters(x.get("event_filters"))) & (F.col("ts") >= marks[0]) & (F.col("ts") <= marks[-1]))
    last = len(marks) - 2
    spans = [F.bool_or((F.col("ts") >= marks[k]) & ((F.col("ts") < marks[k + 1]) | F.lit(k == last))).alias(f"in{k}") for k in range(last + 1)]
    return rows.groupBy("person_id").agg(*spans)


def person_property(c: Context, x: dict) -> DataFrame:
    """The person's latest value passes the operator."""
    bag, _, _ = x["property"].partition(".")
    latest = c.events.groupBy("person_id").agg(F.max_by(bag, F.struct("ts", "event_id")).alias(bag))
    return latest.where(condition(Filter(x["property"], x["operator"], x.get("value", ""), tuple(x.get("values", ()))))).select("person_id")


def _at_share(rows: DataFrame, number: Column, share: float) -> DataFrame:
    """person_id, v: the person's number at a share of all, between neighbours low * (1 - part) + high * part.

    The sum is rounded once (``fma``), as the SQL's engine does it; ``percentile`` also rounds the first product, and comes out on the other side of a limit
    now and then. Windows spill, so no buffer holds a person's numbers."""
    own = Window.partitionBy("person_id")
    rows = rows.select("person_id", number.alias("v")).where("v is not null")
    rows = rows.withColumn("place", (F.count("*").over(own) - 1) * F.lit(share)).withColumn("i", F.row_number().over(own.orderBy("v")) - 1)
    ends = rows.where((F.col("i") == F.floor("place")) | (F.col("i") == F.ceil("place"))).groupBy("person_id")
    ends = ends.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.first(F.col("place") - F.floor("place")).alias("part"))
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - F.col("part"), F.col("high") * F.col("part")).cast("double")
    return ends.select("person_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("v"))


def event(c: Context, x: dict) -> DataFrame:
    """A count or an aggregate of a number over the last days; exactly 0 means active persons without the event."""
    kind, own = x.get("aggregation_type", "count"), matches((x["event_name"],), _filters(x.get("event_filters")))
    if kind == "count" and x["count_operator"] == "eq" and x["count"] == 0:
        rows = c.events.where((F.col("ts") >= c.bounds.since(x["time_window_days"])) & (F.col("ts") <= c.bounds.now))
        return rows.groupBy("person_id").agg(F.count_if(own).alias("n")).where("n = 0").select("person_id")
    rows = _window(c, x["time_window_days"]).where(own)
    number = Property(x.get("aggregation_property", "value")).number
    if kind in PERCENTILES:
        found = _at_share(rows, number, PERCENTILES[kind])
    else:
        value = F.count("*") if kind == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](number)
        found = rows.groupBy("person_id").agg(value.alias("v"))
    return found.where(_compare(F.col("v"), x["count_operator"], x["count"])).select("person_id")


def cohort_ref(c: Context, x: dict) -> DataFrame:
    """Members of another cohort, or active persons that aren't."""
    own = c.members.where(F.col("cohort_id") == x["cohort_id"]).select("person_id").distinct()
    if not x.get("negated"):
        return own
    return c.events.where(F.col("ts") <= c.bounds.now).select("person_id").distinct().join(own, "person_id", "left_anti")


def first_time_event(c: Context, x: dict) -> DataFrame:
    rows = c.events.where(matches((x["event_name"],), _filters(x.get("event_filters"))) & (F.col("ts") <= c.bounds.now))
    return rows.groupBy("person_id").agg(F.min("ts").alias("first")).where(F.col("first") >= c.bounds.ago(x["time_window_days"])).select("person_id")


def not_performed_event(c: Context, x: dict) -> DataFrame:
    return event(c, {**x, "count_operator": "eq", "count": 0, "aggregation_type": "count"})


def completers(c: Context, x: dict, start: Column) -> DataFrame:
    """person_id, done of persons with a step's event: whether the steps come in order, each within the window of the one before.

    An event stands for the first step that it fits."""
    steps = [matches((s["event_name"],), _filters(s.get("event_filters"))) for s in x["steps"]]
    index = reduce(lambda a, k: F.when(steps[k], F.lit(k + 1)).otherwise(a), range(len(steps) - 1, -1, -1), F.lit(0))
    rows = c.events.where((F.col("ts") >= start) & (F.col("ts") <= c.bounds.now)).withColumn("step", index).where("step > 0")
    gap = x["window_days"] * 86_400_000
    rows, hot = chunks.split(rows.select("person_id", "ms", "event_id", "step"), c.most_events, c.whole_bytes)
    rows = rows.groupBy("person_id").agg(history("ms", "event_id", "step").alias("h"))
    begin = F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("at"))
    move = lambda s, e: F.when((e["step"] == s["next"]) & ((s["next"] == 1) | (e["ms"] - s["at"] <= gap)), F.struct((s["next"] + 1).alias("next"), e["ms"].alias("at"))).otherwise(s)
    rows = rows.select("person_id", (F.aggregate("h", begin, move)["next"] > len(steps)).alias("done"))
    return rows if hot is None else rows.unionByName(chunks.sequences(hot, len(steps), gap).withColumnRenamed("out", "done"))


def event_sequence(c: Context, x: dict) -> DataFrame:
    return completers(c, x, c.bounds.ago(x["time_window_days"])).where("done").select("person_id")


def not_performed_event_sequence(c: Context, x: dict) -> DataFrame:
    """With a range: active persons that didn't complete it. Without: those with some step's event that didn't."""
    start = c.bounds.since(x["time_window_days"])
    found = completers(c, x, start)
    if c.bounds.date_from is None:
        return found.where("not done").select("person_id")
    active = c.events.where((F.col("ts") >= start) & (F.col("ts") <= c.bounds.now)).select("person_id").distinct()
    return active.join(found.where("done"), "person_id", "left_anti")


def performed_regularly(c: Context, x: dict) -> DataFrame:
    """In at least so many periods of UTC."""
    rows = _window(c, x["time_window_days"]).where(matches((x["event_name"],), _filters(x.get("event_filters"))))
    n = F.count_distinct(T.bucket(F.col("ts"), x["period_type"]))
    return rows.groupBy("person_id").agg(n.alias("n")).where(F.col("n") >= x["min_periods"]).select("person_id")


def stopped_performing(c: Context, x: dict) -> DataFrame:
    recent, past, b = x["recent_window_days"], x["historical_window_days"], c.bounds
    if recent >= past:
        raise ValueError("the recent window is shorter than the historical one")
    return _in_spans(c, x, [b.ago(past), b.ago(recent), b.now]).where("in0 and not in1").select("person_id")


def restarted_performing(c: Context, x: dict) -> DataFrame:
    recent, gap, past, b = x["recent_window_days"], x["gap_window_days"], x["historical_window_days"], c.bounds
    if past <= recent + gap:
        raise ValueError("the historical window is longer than the recent one and the gap")
    return _in_spans(c, x, [b.ago(past), b.ago(recent + gap), b.ago(recent), b.now]).where("in0 and not in1 and in2").select("person_id")


CONDITIONS = {
    f.__name__: f
    for f in (person_property, event, first_time_event, not_performed_event, event_sequence, not_performed_event_sequence, performed_regularly, stopped_performing, restarted_performing)
} | {"cohort": cohort_ref}


def validate(node: dict, depth: int = 1) -> int:
    """Number of leaves; an error if there are too many, or levels, or in a group, or a window isn't of 1 to 365 days."""
    if depth > MOST_DEPTH + 1:
        raise ValueError(f"conditions are nested in at most {MOST_DEPTH} levels")
    if node["type"] not in ("AND", "OR"):
        if node["type"] not in CONDITIONS:
            raise ValueError(f"unknown condition {node['type']}")
        if any(not 1 <= days <= MOST_DAYS for key, days in node.items() if key.endswith("window_days")):
            raise ValueError(f"windows are of 1 to {MOST_DAYS} days")
        return 1
    if len(node["values"]) > MOST_IN_GROUP:
        raise ValueError(f"at most {MOST_IN_GROUP} conditions in a group")
    n = sum(validate(x, depth + 1) for x in node["values"])
    if n > MOST_LEAVES:
        raise ValueError(f"at most {MOST_LEAVES} conditions")
    return n


def persons(c: Context, node: dict) -> DataFrame:
    """person_id, each once, of a condition tree; groups are evaluated as the tree says. An empty group has nobody."""
    validate(node)
    return _persons(c, node)


def _persons(c: Context, node: dict) -> DataFrame:
    if node["type"] not in ("AND", "OR"):
        return CONDITIONS[node["type"]](c, node)
    parts = [_persons(c, x) for x in node["values"]]
    if not parts:
        return c.events.select("person_id").limit(0)
    if node["type"] == "AND":
        return reduce(lambda a, b: a.join(b, "person_id", "left_semi"), parts)
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def restrict(rows: DataFrame, c: Context, nodes: list[dict]) -> DataFrame:
    """Rows of persons that are in all the cohorts, at most MOST_COHORTS."""
    if len(nodes) > MOST_COHORTS:
        raise ValueError(f"at most {MOST_COHORTS} cohorts")
    return reduce(lambda a, n: a.join(persons(c, n), "person_id", "left_semi"), nodes, rows)


def references(node: dict) -> set[str]:
    if node["type"] in ("AND", "OR"):
        return set().union(*map(references, node["values"]))
    return {node["cohort_id"]} if node["type"] == "cohort" else set()


def levels(definitions: dict[str, dict]) -> tuple[list[list[str]], list[str]]:
    """Cohorts in levels, each after those that it refers to; and those in circles. References to unknown ones don't count."""
    waiting = {k: references(d) & definitions.keys() for k, d in definitions.items()}
    out: list[list[str]] = []
    while ready := sorted(k for k, deps in waiting.items() if not deps):
        out.append(ready)
        waiting = {k: deps - set(ready) for k, deps in waiting.items() if k not in ready}
    return out, sorted(waiting)


def materialize(c: Context, definitions: dict[str, dict], version: int) -> DataFrame:
    """cohort_id, person_id, version of all cohorts but those in circles, level by level."""
    members = c.members
    for level in levels(definitions)[0]:
        now = replace(c, members=members)
        parts = [persons(now, definitions[k]).select(F.lit(k).alias("cohort_id"), "person_id", F.lit(version).cast("long").alias("version")) for k in level]
        new = reduce(lambda a, b: a.unionByName(b), parts)
        old = members.where(~F.col("cohort_id").isin(*level)) if members is not None else None
        members = new if old is None else old.unionByName(new)
    return members


def refresh(c: Context, definitions: dict[str, dict], folder: str, version: int, due: set[str] | None = None, kept: int = 2) -> dict[str, int]:
    """Compute cohorts into tables under ``folder``, a level after the other; the version of each cohort's newest table.

    Only cohorts in ``due`` (None: all) and those that refer to them, directly or not, are computed; each level reads the tables of those before it, so a
    plan is as large as its own conditions, however deep the references are. A table counts once it is written to its end, and a cohort's older ones but
    ``kept`` go. ``c.members`` holds other cohorts' members, static ones for example."""
    spark, at = c.events.sparkSession, lambda k: f"{folder}/cohort={k}"
    order, _ = levels(definitions)
    found = {k: n for k in definitions if (n := numbers(spark, at(k), "version"))}
    again = set(definitions) if due is None else set(due) | (set(definitions) - set(found))
    for level in order:
        again |= {k for k in level if references(definitions[k]) & again}
    for level in order:
        known = [f"{at(k)}/version={n[-1]}" for k, n in found.items()]
        tables = spark.read.schema("cohort_id string, person_id string").parquet(*known) if known else None
        others = [m.select("cohort_id", "person_id") for m in (c.members, tables) if m is not None]
        now = replace(c, members=reduce(lambda a, b: a.unionByName(b), others) if others else None)
        for k in (k for k in level if k in again):
            persons(now, definitions[k]).select(F.lit(k).alias("cohort_id"), "person_id").write.mode("overwrite").parquet(f"{at(k)}/version={version}")
        for k in (k for k in level if k in again):
            found[k] = numbers(spark, at(k), "version")
            for old in found[k][:-kept]:
                remove(spark, f"{at(k)}/version={old}")
    return {k: n[-1] for k, n in found.items()}


def refreshed(spark: SparkSession, folder: str, versions: dict[str, int]) -> DataFrame:
    """cohort_id, person_id, version of the tables that ``refresh`` names."""
    paths = [f"{folder}/cohort={k}/version={v}" for k, v in versions.items()]
    if not paths:
        return spark.createDataFrame([], "cohort_id string, person_id string, version long")
    numbers_ = F.create_map(*[F.lit(x) for k, v in versions.items() for x in (k, v)])
    return spark.read.schema("cohort_id string, person_id string").parquet(*paths).withColumn("version", F.element_at(numbers_, F.col("cohort_id")).cast("long"))


def latest_members(rows: DataFrame) -> DataFrame:
    """Rows of each cohort's last version."""
    last = rows.groupBy("cohort_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["cohort_id", "version"], "left_semi")


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cohort_id").agg(F.count_distinct("person_id").alias("n_persons"))


def size_history(rows: DataFrame, since: str) -> DataFrame:
    """cohort_id, date, count: the last record of each day (cohort_id, date, count, recorded_at)."""
    return rows.where(F.col("date") >= F.lit(since).cast("date")).groupBy("cohort_id", "date").agg(F.max_by("count", "recorded_at").alias("count"))


def stale(cohorts: DataFrame, as_of: str, minutes: int = 15, most_errors: int = 20) -> DataFrame:
    """Cohorts to compute: not static, not failed too often, old enough, and past their wait after an error (30 minutes, doubled by each)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = lambda c: F.expr(f"timestampdiff(SECOND, {c}, timestamp_ntz'{as_of}') / 60.0")
    wait = F.lit(30.0) * F.pow(F.lit(2.0), F.least(F.col("errors_calculating"), F.lit(10)))
    due = F.col("computed_at").isNull() | (age("computed_at") >= minutes)
    rested = (F.col("errors_calculating") == 0) | F.col("last_error_at").isNull() | (age("last_error_at") >= wait)
    return cohorts.where(~F.col("is_static") & (F.col("errors_calculating") < most_errors) & due & rested & now.isNotNull())


def drop_orphans(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members of cohorts that still exist. If none is known, nothing goes: the list may be late, not empty."""
    known = known.select("cohort_id").distinct()
    #: One row on the right.
    none = known.agg((F.count("*") == 0).alias("__none"))
    rows = members.crossJoin(none).join(known.withColumn("__known", F.lit(True)), "cohort_id", "left")
    return rows.where(F.col("__none") | F.col("__known")).select(*members.columns)


def add_members(members: DataFrame, cohort_id: str, person_ids: DataFrame) -> DataFrame:
    """Static members after adding persons (person_id) to a cohort; those in it already stay once."""
    new = person_ids.select(F.lit(cohort_id).alias("cohort_id"), "person_id")
    return members.select("cohort_id", "person_id").unionByName(new).distinct()


def remove_members(members: DataFrame, cohort_id: str, person_ids: DataFrame) -> DataFrame:
    gone = person_ids.select(F.lit(cohort_id).alias("cohort_id"), "person_id").distinct()
    return members.join(gone, ["cohort_id", "person_id"], "left_anti")


def duplicate_as_static(source: DataFrame, cohort_id: str, new_id: str) -> DataFrame:
    """Static members of a copy, from the members of the cohort (static ones, or the last computed ones)."""
    return source.where(F.col("cohort_id") == cohort_id).select(F.lit(new_id).alias("cohort_id"), "person_id").distinct()


def stamped(node: dict, static: set[str]) -> dict:
    """A condition tree whose references to cohorts say whether they are static."""
    if node["type"] in ("AND", "OR"):
        return {**node, "values": [stamped(x, static) for x in node["values"]]}
    return {**node, "is_static": node["cohort_id"] in static} if node["type"] == "cohort" else node


def members_of(c: Context, cohort: dict, static: DataFrame, computed: DataFrame) -> DataFrame:
    """person_id of a cohort (cohort_id, definition, is_static, materialized): static members, the last computed ones, or the
    persons that its conditions give now."""
    if cohort.get("is_static"):
        return static.where(F.col("cohort_id") == cohort["cohort_id"]).select("person_id").distinct()
    if cohort.get("materialized"):
        own = computed.where(F.col("cohort_id") == cohort["cohort_id"])
        return latest_members(own).select("person_id").distinct()
    return persons(c, cohort["definition"])


def import_members(ids: DataFrame, kind: str, cohort_id: str, distinct_ids: DataFrame, people: DataFrame) -> DataFrame:
    """cohort_id, person_id for uploaded ids of a kind: distinct_id, person_id or email (in lower case)."""
    ids = ids.select(F.trim("id").alias("id")).where("id <> ''").distinct()
    if kind == "email":
        known = people.select("person_id", F.lower(Property("properties.email").text).alias("id")).where("id <> ''")
        found = known.join(ids.select(F.lower("id").alias("id")).distinct(), "id", "left_semi")
    else:
        found = distinct_ids.withColumn("id", F.col("distinct_id" if kind == "distinct_id" else "person_id")).join(ids, "id", "left_semi")
    return found.select(F.lit(cohort_id).alias("cohort_id"), "person_id").distinct()
