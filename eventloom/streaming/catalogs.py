"""Catalogs of events and their properties, kept by the ingest job: each batch's definitions go into a snapshot that is swapped in whole.

A row is an event's name (kind ``event``), a property of events or persons (``property``), or a property that an event has had (``event_property``).
A property's type is the first one that a value showed, by batch and then by time, and stays. Events of more than ``MOST_PROPERTIES`` properties, or with
a longer name than ``MOST_NAME``, leave no trace; longer names of properties are left out, and so are those that carry a person's."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.drilldown import value_type

MOST_PROPERTIES, MOST_NAME = 10_000, 200
#: Fixed names of properties that aren't an event's own.
SERVICE = ("$set", "$set_once", "$unset", "$group_0", "$group_1", "$group_2", "$group_3", "$group_4", "$groups")
KEYS = ["kind", "project_id", "event_name", "property_name", "property_type"]
CATALOG = "kind string, project_id string, event_name string, property_name string, property_type string, value_type string, last_seen_ms long"


def definitions_seen(rows: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """A batch's definitions (CATALOG). ``rows``: project_id, event_name, event_id, ms, properties, user_properties. A row's JSON is parsed once."""
    bag = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    rows = rows.where(F.length("event_name") <= MOST_NAME).select("project_id", "event_name", F.col("event_id").cast("string").alias("event_id"), "ms", bag("properties").alias("p"), bag("user_properties").alias("u"))
    size = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    rows = rows.where(size("p") + size("u") <= MOST_PROPERTIES)
    inner = lambda m, key: F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "map<string,variant>")
    none = F.array().cast("array<struct<key:string,value:variant>>")
    entries = lambda m, prefix, kind: F.transform(F.coalesce(F.map_entries(m), none), lambda e: F.struct(F.lit(prefix).alias("prefix"), e["key"].alias("name"), e["value"].alias("value"), F.lit(kind).alias("kind")))
    own = F.map_filter("p", lambda k, _: ~k.isin(*SERVICE))
    persons = [*[inner(c, k) for c in "pu" for k in ("$set", "$set_once")], F.map_filter("u", lambda k, _: ~k.isin("$set", "$set_once", "$unset"))]
    every = F.concat(entries(own, "properties.", "event"), *[entries(m, "user_properties.", "person") for m in persons])
    #: An entry without a name stands for the event itself.
    itself = F.array(F.struct(F.lit("").alias("prefix"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("value"), F.lit("").alias("kind")))
    pairs = rows.select("project_id", "event_name", "event_id", "ms", F.explode(F.concat(itself, every)).alias("x"))
    pairs = pairs.where(F.col("x.name").isNull() | (F.length("x.name") <= MOST_NAME))
    kind = value_type(F.col("x.name"), F.try_variant_get("x.value", "$", "string"), F.schema_of_variant("x.value"), as_of)
    pairs = pairs.select("project_id", "event_name", "event_id", "ms", F.concat("x.prefix", "x.name").alias("property_name"), F.col("x.kind").alias("property_type"), kind.alias("value_type"))
    #: First by type, so that few rows carry the order.
    pairs = pairs.groupBy("project_id", "event_name", "property_name", "property_type", "value_type").agg(F.min(F.struct("ms", "event_id")).alias("at"), F.max("ms").alias("ms"))
    pairs = pairs.groupBy("project_id", "event_name", "property_name", "property_type").agg(
        F.min_by(F.struct("value_type", "at"), F.when(F.col("value_type").isNotNull(), F.col("at"))).alias("first"), F.max("ms").alias("ms"))
    is_event = F.col("property_name").isNull()
    as_property = F.struct(F.lit("property").alias("kind"), F.lit("").alias("event_name"), F.col("first.value_type").alias("value_type"), F.col("first.at").alias("at"))
    as_pair = F.struct(F.when(is_event, "event").otherwise("event_property").alias("kind"), F.col("event_name").alias("event_name"), F.lit(None).cast("string").alias("value_type"), F.col("first.at").alias("at"))
    rows = pairs.select("project_id", F.coalesce("property_name", F.lit("")).alias("property_name"), "property_type", "ms", F.explode(F.when(is_event, F.array(as_pair)).otherwise(F.array(as_property, as_pair))).alias("d"))
    rows = rows.select("d.kind", "project_id", "d.event_name", "property_name", "property_type", "d.value_type", "d.at", "ms")
    out = rows.groupBy(*KEYS).agg(F.min_by("value_type", F.when(F.col("value_type").isNotNull(), F.col("at"))).alias("value_type"), F.max("ms").alias("last_seen_ms"))
    return out.select(*KEYS, "value_type", "last_seen_ms")


def merged(known: DataFrame, seen: DataFrame) -> DataFrame:
    """The catalog after a batch: a known type stays, the later time holds."""
    both = known.withColumn("old", F.lit(True)).unionByName(seen.withColumn("old", F.lit(False)))
    out = both.groupBy(*KEYS).agg(F.max(F.when(F.col("old"), F.col("value_type"))).alias("known"), F.max(F.when(~F.col("old"), F.col("value_type"))).alias("new"), F.max("last_seen_ms").alias("last_seen_ms"))
    return out.select(*KEYS, F.coalesce("known", "new").alias("value_type"), "last_seen_ms")
