"""The persons behind a number, listings of persons and events, and catalogs of names."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, all_of, any_of, condition, matches
from eventloom.functions.values import Property
from eventloom.operators import funnel, retention
from eventloom.operators.ingest import NOISY
from eventloom.operators.trend import TrendSpec

VALUES, EVENTS = 50, 50


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def at_funnel_step(events: DataFrame, spec: funnel.FunnelSpec, step: int) -> DataFrame:
    """Persons that reached the step (from 1); exclusions don't count here."""
    return funnel.per_person(events, spec, exclude=False).where(F.col("max_step") >= step).select("person_id")


def at_trend_bucket(events: DataFrame, spec: TrendSpec, series: int, bucket: str) -> DataFrame:
    s = spec.series[series]
    rows = events.where(matches(s.names, s.filters) & T.in_range(spec.date_from, spec.date_to, spec.tz))
    return rows.where(T.label(T.bucket(F.col("ts"), spec.unit, spec.tz), spec.unit) == bucket).select("person_id").distinct()


def at_stickiness_bar(events: DataFrame, spec: retention.ActivitySpec, n: int) -> DataFrame:
    return retention.stickiness_rows(events, spec).where(F.col("n_active") == n).select("person_id")


def at_retention_cell(events: DataFrame, spec: retention.ActivitySpec, cohort: str, offset: int) -> DataFrame:
    rows = retention.retention_pairs(events, spec).where((F.col("cohort") == F.lit(cohort).cast("date")) & (F.col("offset") == offset))
    return rows.select("person_id").distinct()


def at_lifecycle_bucket(events: DataFrame, spec: retention.ActivitySpec, bucket: str, status: str) -> DataFrame:
    rows = retention.lifecycle_rows(events, spec).where((F.col("bucket") == F.lit(bucket).cast("date")) & (F.col("status") == status))
    return rows.select("person_id").distinct()


def person_list(people: DataFrame, distinct_ids: DataFrame, filters: tuple[Filter, ...] = (), search: str = "") -> DataFrame:
    """Persons that pass the filters, with their sorted distinct ids; ``search`` is part of a distinct id in any case."""
    rows = people.where(all_of(map(condition, filters)))
    if search:
        found = distinct_ids.where(F.contains(F.lower("distinct_id"), F.lit(search.lower()))).select("person_id")
        rows = rows.join(found, "person_id", "left_semi")
    ids = distinct_ids.groupBy("person_id").agg(F.array_sort(F.collect_set("distinct_id")).alias("distinct_ids"))
    return rows.join(ids, "person_id", "left")


def person_by_id(people: DataFrame, distinct_ids: DataFrame, person_id: str) -> DataFrame:
    """The person, with its sorted distinct ids (none give an empty list)."""
    return persons_by_ids(people, distinct_ids, [person_id]).drop("place")


def persons_by_ids(people: DataFrame, distinct_ids: DataFrame, person_ids: list[str]) -> DataFrame:
    """Persons of the given ids in their order (``place``), each once, with their distinct ids; unknown ids are left out."""
    order = {p: k for k, p in reversed(list(enumerate(person_ids)))}
    own = F.col("person_id").isin(*order)
    ids = distinct_ids.where(own).groupBy("person_id").agg(F.array_sort(F.collect_set("distinct_id")).alias("distinct_ids"))
    rows = people.where(own).join(ids, "person_id", "left").withColumn("distinct_ids", F.coalesce("distinct_ids", F.array().cast("array<string>")))
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("person_id")] if order else F.lit(0)
    return rows.withColumn("place", place).orderBy("place")


def person_page(people: DataFrame, distinct_ids: DataFrame, filters: tuple[Filter, ...] = (), search: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the persons that fit, the last updated first, with the number of all that fit (``total``)."""
    rows = person_list(people, distinct_ids, filters, search)
    #: One row on the right.
    return page(rows, [F.desc("updated_at"), "person_id"], limit, offset).crossJoin(rows.agg(F.count("*").alias("total")))


def person_events(raw: DataFrame, overrides: DataFrame, person_id: str, limit: int | None = None, offset: int = 0, most_ids: int = 1000) -> DataFrame:
    """The events of a person by their own id or by the one that their distinct id belongs to now, with both; with a limit the newest ones.

    The distinct ids that belong to the person are looked up first; both conditions reach the scan of the events. Those of a person with more than
    ``most_ids`` of them are joined instead.
    ``overrides``: project_id, distinct_id, person_id, one row a distinct id."""
    own = overrides.where(F.col("person_id") == person_id).select("distinct_id").distinct()
    ids = sorted(r[0] for r in own.limit(most_ids + 1).collect())
    if len(ids) > most_ids:
        rows = raw.where(F.col("person_id") == person_id).unionByName(raw.where(~F.col("person_id").eqNullSafe(person_id)).join(own, "distinct_id", "left_semi").select(raw.columns))
    else:
        rows = raw.where((F.col("person_id") == person_id) | F.col("distinct_id").isin(*ids) if ids else F.col("person_id") == person_id)
    now = overrides.select("project_id", "distinct_id", F.col("person_id").alias("now_id"))
    rows = rows.withColumnRenamed("person_id", "raw_person_id").join(now, ["project_id", "distinct_id"], "left")
    rows = rows.withColumn("person_id", F.coalesce("now_id", "raw_person_id")).drop("now_id")
    rows = rows.where((F.col("person_id") == person_id) | (F.col("raw_person_id") == person_id))
    return rows if limit is None else page(rows, [F.desc("ts"), F.desc("event_id")], limit, offset)


def person_cohorts(person_id: str, *memberships: DataFrame) -> DataFrame:
    out = None
    for m in memberships:
        own = m.where(F.col("person_id") == person_id).select("cohort_id")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def property_names(rows: DataFrame, bag: str, limit: int = 500) -> DataFrame:
    names = rows.select(F.explode(F.json_object_keys(bag)).alias("property_name")).groupBy("property_name").agg(F.count("*").alias("n"))
    return names.orderBy(F.desc("n"), "property_name").limit(limit)


def property_values(rows: DataFrame, path: str, limit: int = VALUES) -> DataFrame:
    """value, n of the most frequent values that aren't empty."""
    counts = rows.select(Property(path).text.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def event_list(events: DataFrame, filters: tuple[Filter, ...], date_from: str, date_to: str, limit: int = EVENTS, offset: int = 0) -> DataFrame:
    """Newest events first."""
    rows = events.where(all_of([T.in_range(date_from, date_to), *map(condition, filters)]))
    return page(rows, [F.desc("ts"), F.desc("event_id")], limit, offset)


def event_detail(events: DataFrame, event_id: int, at: str) -> DataFrame:
    """The event, looked for five minutes around a time."""
    around = lambda sign: F.expr(f"timestamp_ntz'{at}' {sign} interval 5 minutes")
    return events.where((F.col("event_id") == event_id) & (F.col("ts") >= around("-")) & (F.col("ts") <= around("+")))


def event_definitions(events: DataFrame) -> DataFrame:
    """event_name, n_events, last_seen (floored to the hour, as text)."""
    rows = events.groupBy("event_name").agg(F.count("*").alias("n_events"), F.max("ts").alias("t"))
    return rows.select("event_name", "n_events", T.bucket(F.col("t"), "hour").cast("string").alias("last_seen"))


def property_definitions(events: DataFrame, bag: str = "properties", most_length: int = 200, as_of: datetime | None = None) -> DataFrame:
    """event_name, property_name, value_type (of the earliest value that has one), last_seen. A row's JSON is parsed once."""
    values = F.explode(F.try_variant_get(F.try_parse_json(F.col(bag)), "$", "map<string,variant>"))
    pairs = events.select("event_name", "ts", "event_id", values.alias("property_name", "value")).where(F.length("property_name") <= most_length)
    kind = value_type(F.col("property_name"), F.try_variant_get("value", "$", "string"), F.schema_of_variant("value"), as_of)
    pairs = pairs.select("event_name", "ts", "event_id", "property_name", kind.alias("value_type"))
    order = F.when(F.col("value_type").isNotNull(), F.struct("ts", "event_id"))
    rows = pairs.groupBy("event_name", "property_name").agg(F.min_by("value_type", order).alias("value_type"), F.max("ts").alias("t"))
    return rows.select("event_name", "property_name", "value_type", T.bucket(F.col("t"), "hour").cast("string").alias("last_seen"))


def person_property_definitions(events: DataFrame, most_length: int = 200, as_of: datetime | None = None) -> DataFrame:
    """As ``property_definitions``, of what events say of their persons: keys of user_properties, and those in its $set and $set_once."""
    bag = F.try_parse_json("user_properties")
    top = F.map_filter(F.try_variant_get(bag, "$", "map<string,variant>"), lambda k, _: ~k.isin("$set", "$set_once", "$unset"))
    maps = [top, *[F.try_variant_get(bag, f"$['{k}']", "map<string,variant>") for k in ("$set", "$set_once")]]
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:variant>>")) for m in maps]))
    pairs = events.select("ts", "event_id", F.explode(entries).alias("x")).select("ts", "event_id", F.col("x.key").alias("property_name"), "x.value")
    pairs = pairs.where((F.length("property_name") <= most_length) & ~F.col("property_name").isin(*NOISY))
    kind = value_type(F.col("property_name"), F.try_variant_get("value", "$", "string"), F.schema_of_variant("value"), as_of)
    pairs = pairs.select("ts", "event_id", "property_name", kind.alias("value_type"))
    order = F.when(F.col("value_type").isNotNull(), F.struct("ts", "event_id"))
    rows = pairs.groupBy("property_name").agg(F.min_by("value_type", order).alias("value_type"), F.max("ts").alias("t"))
    return rows.select("property_name", "value_type", T.bucket(F.col("t"), "hour").cast("string").alias("last_seen"))


#: Fixed parts of names by which a property may be a time, and beginnings (and one name) of those that are texts whatever they hold.
TIME_WORDS = ("time", "timestamp", "date", "_at", "-at", "createdat", "updatedat")
TEXT_BEGINNINGS, TEXT_NAME = ("utm_", "$initial_utm_", "$feature/", "$survey_response"), "$feature_flag_response"
#: Fixed patterns of texts that look like a date, and of those that are a number.
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}[T\s]|^\s*(\d{4}[/-][0-2]\d[/-][0-3]\d|[0-2]\d[/-][0-3]\d[/-]\d{4})([ T][0-2]\d:[0-6]\d:[0-6]\d.*)?\s*$"
NUMBER_TEXT = r"^\s*([+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)\s*$"
#: How far a number of seconds may lie before and after now to be taken for a time.
PAST_SECONDS, FUTURE_SECONDS = 15_768_000, 10 * 365 * 86_400


def value_type(name: Column, text: Column, kind: Column, as_of: datetime | None = None) -> Column:
    """String, Numeric, Boolean, DateTime or null, from a property's name, its value's text and its JSON kind.

    Names of campaigns, features and surveys are texts. A name that speaks of time makes a DateTime of a number only if it is
    seconds near ``as_of`` (now, if none is given). Objects, lists and null have no type."""
    lower, is_text = F.lower(name), kind == "STRING"
    is_number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
    dated, number = is_text & text.rlike(DATE_TEXT), text.try_cast("double")
    now = F.lit(as_of.replace(tzinfo=UTC).timestamp()) if as_of else F.unix_timestamp().cast("double")
    near = is_number & (number >= F.floor(now) - PAST_SECONDS) & (number <= F.floor(now) + FUTURE_SECONDS)
    fixed = any_of([*[F.startswith(lower, F.lit(x)) for x in TEXT_BEGINNINGS], lower == TEXT_NAME])
    timely = any_of([F.contains(lower, F.lit(x)) for x in TIME_WORDS])
    return (
        F.when(fixed, "String")
        .when(text.isNull() | kind.rlike("^(OBJECT|ARRAY|VOID)"), F.lit(None).cast("string"))
        .when(timely & (dated | near), "DateTime")
        .when(kind == "BOOLEAN", "Boolean")
        .when(is_number, "Numeric")
        .when(F.trim(text).isin("true", "false", "TRUE", "FALSE"), "Boolean")
        .when(dated, "DateTime")
        .when(text.rlike(NUMBER_TEXT), "Numeric")
        .otherwise("String")
    )


#: Columns that a user sets on a definition.
EDITABLE = ("description", "tags", "verified", "value_type", "is_numerical")


def definition_list(rows: DataFrame, search: str = "", filters: dict | None = None, order: str = "last_seen", descending: bool = True, limit: int = 100, offset: int = 0, name: str = "event_name") -> DataFrame:
    """A page of definitions and ``total``, the number of all that fit; ``search`` is part of the name in any case."""
    fits = [F.contains(F.lower(name), F.lit(search.lower()))] if search else []
    rows = rows.where(all_of([*fits, *[F.col(c).eqNullSafe(F.lit(v)) for c, v in (filters or {}).items()]]))
    total = rows.agg(F.count("*").alias("total"))
    shown = page(rows, [F.desc(order) if descending else F.asc(order), name], limit, offset)
    #: One row on the right.
    return shown.crossJoin(total)


def upsert_definitions(known: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions after changes: a null in a change keeps what is known; keys that aren't known come in as new rows."""
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys])
    both = known.join(new, keys, "full")
    own = lambda c: F.coalesce(f"new_{c}", c) if c in changes.columns else F.col(c)
    out = both.select(*[F.col(c) if c in keys else own(c).alias(c) for c in known.columns])
    return out.withColumn("verified", F.coalesce("verified", F.lit(False))) if "verified" in out.columns else out


def delete_definitions(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (definitions, or properties of events) whose keys aren't among those that were deleted."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged_catalog(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog after a batch of definitions seen: a type once known stays, the later last_seen holds, other columns are the known ones'."""
    new = seen.select(*keys, *[F.col(c).alias(f"new_{c}") for c in seen.columns if c not in keys])
    both = known.join(new, keys, "full")

    def column(c: str) -> Column:
        if c in keys or f"new_{c}" not in both.columns:
            return F.col(c)
        return (F.greatest(c, f"new_{c}") if c == "last_seen" else F.coalesce(c, f"new_{c}")).alias(c)

    return both.select(*map(column, known.columns))
