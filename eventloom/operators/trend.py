"""Trends: series over time, breakdowns, comparison, formulas, maps and heat maps."""

from __future__ import annotations

import ast
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, matches
from eventloom.functions.values import Property, ratio

TOP_VALUES, MAP_ROWS, MOST_HOURS_DAYS, NONE = 25, 200, 7, "(none)"


@dataclass(frozen=True)
class Series:
    names: tuple[str, ...]
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class TrendSpec:
    series: tuple[Series, ...]
    date_from: str
    date_to: str
    unit: str = "day"
    metric: str = "total_events"
    property: str = ""
    tz: str = "UTC"
    breakdown: str = ""
    #: Values to which a breakdown is held; None takes the most frequent.
    values: tuple[str, ...] | None = None

    def validate(self) -> None:
        if not 1 <= len(self.series) <= 10:
            raise ValueError("a trend has 1 to 10 series")
        if self.unit not in T.UNITS:
            raise ValueError(f"unit is one of {T.UNITS}")
        if self.unit == "hour" and T.n_periods(self.date_from, self.date_to, "day") > MOST_HOURS_DAYS:
            raise ValueError(f"hours are for ranges of at most {MOST_HOURS_DAYS} days")
        if self.metric.startswith("property_") and not self.property:
            raise ValueError("a property metric names its property")


def _value(spec: TrendSpec) -> Column:
    """The series' value from a group of events; missing and unreadable numbers count as 0."""
    kind = spec.metric.removeprefix("property_")
    if kind in ("sum", "avg", "min", "max"):
        return getattr(F, kind)("number")
    if spec.metric == "unique_users":
        return F.count_distinct("person_id").cast("double")
    if spec.metric == "events_per_user":
        return ratio(F.count("*"), F.count_distinct("person_id"))
    return F.count("*").cast("double")


def marked(events: DataFrame, spec: TrendSpec) -> DataFrame:
    """Events of the range with the number of each series that they are in: one scan for all series."""
    own = [F.when(matches(s.names, s.filters), F.lit(k)) for k, s in enumerate(spec.series)]
    names = sorted({n for s in spec.series for n in s.names})
    rows = events.where(T.in_range(spec.date_from, spec.date_to, spec.tz))
    if all(s.names for s in spec.series):
        rows = rows.where(F.col("event_name").isin(*names))
    rows = rows.withColumn("number", Property(spec.property).number if spec.property else F.lit(0.0))
    rows = rows.withColumn("breakdown", Property(spec.breakdown).text if spec.breakdown else F.lit(""))
    return rows.withColumn("series", F.explode(F.array_compact(F.array(*own))))


def top_values(rows: DataFrame, spec: TrendSpec) -> DataFrame:
    """breakdown: the most frequent values over all series; ties by value."""
    if spec.values is not None:
        return rows.sparkSession.createDataFrame([(v,) for v in spec.values], "breakdown string")
    return rows.groupBy("breakdown").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "breakdown").limit(TOP_VALUES).select("breakdown")


def first_events(events: DataFrame, spec: TrendSpec, keep_filters: bool) -> DataFrame:
    """person_id, ts, breakdown, series of persons whose first matching event is in the range and who have none before it.

    The look into the past leaves the series' filters out unless ``keep_filters`` says otherwise."""
    value = Property(spec.breakdown).text if spec.breakdown else F.lit("")
    start, end = (T.literal(T.moment(x, e, spec.tz)) for x, e in ((spec.date_from, False), (spec.date_to, True)))
    rows, names = events.where(F.col("ts") <= end), sorted({n for s in spec.series for n in s.names})
    if all(s.names for s in spec.series):
        rows = rows.where(F.col("event_name").isin(*names))
    seen = []
    for k, s in enumerate(spec.series):
        inside = matches(s.names, s.filters) & (F.col("ts") >= start)
        past = matches(s.names, s.filters if keep_filters else ()) & (F.col("ts") < start)
        seen += [F.min(F.when(inside, F.struct("ts", "event_id", value.alias("breakdown")))).alias(f"first{k}"), F.max(past).alias(f"past{k}")]
    #: One scan and one row a person for all series.
    rows = rows.groupBy("person_id").agg(*seen)
    own = [F.when(~F.col(f"past{k}") & F.col(f"first{k}").isNotNull(), F.struct(F.lit(k).alias("series"), F.col(f"first{k}").alias("first"))) for k in range(len(spec.series))]
    rows = rows.select("person_id", F.explode(F.array_compact(F.array(*own))).alias("x"))
    return rows.select("person_id", F.col("x.first.ts").alias("ts"), F.col("x.first.breakdown").alias("breakdown"), F.col("x.series").alias("series"), F.lit(0).alias("event_id"), F.lit(0.0).alias("number"))


def trend(events: DataFrame, spec: TrendSpec) -> DataFrame:
    """series, bucket (text), breakdown, n_events, n_users, value."""
    spec.validate()
    first = {"first_time_users": False, "first_matching_event": True}
    rows = first_events(events, spec, first[spec.metric]) if spec.metric in first else marked(events, spec)
    if spec.breakdown:
        rows = rows.join(top_values(rows, spec), "breakdown", "left_semi")
    bucket = T.label(T.bucket(F.col("ts"), spec.unit, spec.tz), spec.unit)
    out = rows.groupBy("series", bucket.alias("bucket"), "breakdown").agg(F.count("*").alias("n_events"), F.count_distinct("person_id").alias("n_users"), _value(spec).alias("value"))
    shown = F.when(F.col("breakdown") == "", NONE).otherwise(F.col("breakdown")) if spec.breakdown else F.lit("")
    return out.withColumn("breakdown", shown)


def trend_by_cohort(events: DataFrame, spec: TrendSpec, members: DataFrame) -> DataFrame:
    """As ``trend``, with cohort_id from ``members`` (cohort_id, person_id) as the breakdown; one scan for all cohorts."""
    if spec.metric.startswith("first_"):
        raise ValueError("first events can't be broken down by cohort")
    spec.validate()
    rows = marked(events, spec).join(members.select("cohort_id", "person_id").distinct(), "person_id")
    bucket = T.label(T.bucket(F.col("ts"), spec.unit, spec.tz), spec.unit)
    return rows.groupBy("series", bucket.alias("bucket"), F.col("cohort_id").alias("breakdown")).agg(F.count("*").alias("n_events"), F.count_distinct("person_id").alias("n_users"), _value(spec).alias("value"))


def compare(events: DataFrame, spec: TrendSpec) -> DataFrame:
    """series, position, breakdown, value, previous: periods of both ranges by their place, empty ones as 0."""
    a, b = T.previous_period(spec.date_from, spec.date_to)
    now = trend(events, spec)
    if spec.breakdown:
        kept = tuple("" if r[0] == NONE else r[0] for r in now.select("breakdown").distinct().collect())  # at most TOP_VALUES
        spec = replace(spec, values=kept)
    before = trend(events, replace(spec, date_from=a, date_to=b))

    def placed(rows: DataFrame, start: str, name: str) -> DataFrame:
        origin = T.truncate(T.date.fromisoformat(start[:10]), spec.unit).isoformat()
        place = T.periods_between(F.lit(origin).cast("date"), F.col("bucket").cast("date"), spec.unit)
        return rows.select("series", place.alias("position"), "breakdown", F.col("value").alias(name))

    both = placed(now, spec.date_from, "value").join(placed(before, a, "previous"), ["series", "position", "breakdown"], "full")
    return both.na.fill(0.0, ["value", "previous"])


def gap_filled(rows: DataFrame, spec: TrendSpec) -> DataFrame:
    """Adds the range's periods that a series lacks, with 0."""
    spark = rows.sparkSession
    axis = T.axis(spark, spec.date_from, spec.date_to, spec.unit).select(T.label(F.col("bucket"), spec.unit).alias("bucket"))
    lines = rows.select("series", "breakdown").distinct()
    #: Lines are series times breakdown values, the axis is the range's periods: both a few hundred rows at most.
    full = lines.crossJoin(axis).join(rows, ["series", "breakdown", "bucket"], "left")
    return full.na.fill(0, ["n_events", "n_users"]).na.fill(0.0, ["value"])


def cumulative(rows: DataFrame) -> DataFrame:
    """Running sums of the value by series and breakdown."""
    upto = Window.partitionBy("series", "breakdown").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.sum("value").over(upto))


def totals(rows: DataFrame, most: int = 5) -> DataFrame:
    """label, value: sums over time, those after the largest ``most`` together as Other."""
    sums = rows.groupBy("series", "breakdown").agg(F.sum("value").alias("value"))
    #: One row a line of the chart.
    place = F.row_number().over(Window.orderBy(F.desc("value"), "series", "breakdown"))
    name = F.when(place <= most, F.concat_ws(" ", F.col("series").cast("string"), "breakdown")).otherwise("Other")
    return sums.select(name.alias("label"), "value").groupBy("label").agg(F.sum("value").alias("value"))


def formula(rows: DataFrame, text: str, n_series: int) -> DataFrame:
    """bucket, breakdown, value of an arithmetic formula over series A, B, ...; missing points are 0, so is division by 0."""
    letters = [chr(65 + k) for k in range(n_series)]
    wide = rows.groupBy("bucket", "breakdown").agg(*[F.coalesce(F.max(F.when(F.col("series") == k, F.col("value"))), F.lit(0.0)).alias(c) for k, c in enumerate(letters)])

    def column(node: ast.AST) -> Column:
        if isinstance(node, ast.Name) and node.id in letters:
            return F.col(node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -column(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = column(node.left), column(node.right)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))
        raise ValueError(f"a formula has series letters, numbers, + - * / and brackets: {text}")

    return wide.select("bucket", "breakdown", column(ast.parse(text, mode="eval").body).alias("value"))


def world_map(events: DataFrame, spec: TrendSpec) -> DataFrame:
    """country, n_events of the first series; the largest MAP_ROWS."""
    rows = marked(events, replace(spec, series=spec.series[:1]))
    return rows.groupBy("country").agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "country").limit(MAP_ROWS)


def calendar_heatmap(events: DataFrame, spec: TrendSpec) -> DataFrame:
    """weekday (1 is Monday), hour, n_events of the first series in local time."""
    rows = marked(events, replace(spec, series=spec.series[:1]))
    at = T.local(F.col("ts"), spec.tz)
    return rows.groupBy((F.weekday(at) + 1).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n_events"))


