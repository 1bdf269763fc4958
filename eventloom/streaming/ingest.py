"""Structured Streaming ingest: files of JSON lines become validated, identified, enriched events, with dead letters.

Delivery is at least once; the checkpoint remembers what was read, and each micro-batch is written under its own batch
number, so that a repeated batch replaces itself. Repeated events are dropped by (project_id, event_id), however late they come, by the
index of ``streaming.seen``. Events without an id get one of their own, and rows with a problem are never compared.

Identity is resolved in order: an event belongs to the person that its distinct id has at its time, after the identify events of earlier batches and
those of its own batch at or before it (``operators.merges``). Across batches the order is that of arrival. What was stored before is moved by the overrides when it is asked for.

A batch that can't be written is tried ``ATTEMPTS`` times and then put aside whole among the dead letters, and the stream goes on. ``replay`` writes dead letters again,
compared with everything that was written meanwhile; after ``FAILURES`` failed replays in a row it rests. What happened stands in the log, so all of
this survives a restart. Snapshots (identity, persons, catalogs, counters) are swapped in whole (``streaming.tables``)."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators import ingest, merges
from eventloom.sources.files import EVENT_SCHEMA
from eventloom.streaming import admission, catalogs, tables
from eventloom.streaming.seen import CAPACITY, KEYS, SeenKeys

FILES_PER_TRIGGER = 100
ATTEMPTS, FAILURES, REST_MS = 3, 5, 5 * 60_000
#: Distinct ids that took part in an identify event: their first person and the one they belong to.
IDENTITY = "project_id string, distinct_id string, base_id string, person_id string"
PERSONS = "person_id string, name string, value string"


@dataclass(frozen=True)
class Job:
    """What a job keeps. ``rate``: events a project and minute (None: no limit); ``plans``: a table of monthly limits; ``keys``: how many keys the index is made for."""

    persons: bool = True
    catalogs: bool = True
    rate: int | None = None
    plans: str | None = None
    keys: int = CAPACITY
    attempts: int = ATTEMPTS


def source(spark: SparkSession, path: str, files: int = FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).json(path)


def prepared(rows: DataFrame, imported: bool = False) -> DataFrame:
    """Columns of the model from raw events; rows with a problem keep it.

    Without sent_at the server's time holds, but an import's own times are taken as they are."""
    ms = lambda c: F.unix_millis(F.col(c).try_cast("timestamp"))
    server = F.unix_millis(F.current_timestamp())
    rows = rows.withColumnRenamed("event", "event_name")
    rows = rows.withColumn("event_id", F.when(F.trim("event_id") != "", F.col("event_id")).otherwise(F.uuid()))
    at = F.coalesce(ms("timestamp"), server) if imported else ingest.corrected_ms(server, ms("sent_at"), ms("timestamp"))
    rows = rows.withColumn("ms", at).withColumn("time", F.timestamp_millis("ms")).withColumn("problem", ingest.problem(tuple(c for c in ingest.CONTEXT_LENGTHS if c in rows.columns), tuple(rows.columns)))
    rows = ingest.with_device(rows.withColumn("event_type", ingest.event_type(F.col("event_name"))))
    return ingest.mapped_fields(rows, F.current_timestamp().cast("string"), "ms", "time", "problem", "ip", "browser", "os", "device_type")


def moved(stage: DataFrame) -> DataFrame:
    """anonymous, user (their persons before the batch), ms, event_id of the identify events, and the ids: project_id, anonymous_id, distinct_id."""
    own = stage.where((F.col("event_name") == "$identify") & (F.coalesce(F.col("anonymous_id"), F.lit("")) != "") & (F.col("anonymous_id") != F.col("distinct_id")))
    return own.select("project_id", "anonymous_id", "distinct_id", "ms", "event_id")


def _located(rows: DataFrame, identity: DataFrame, distinct: str, person: str) -> DataFrame:
    """``rows`` with the person that a distinct id has by the identity snapshot, else its own."""
    known = identity.select(F.col("project_id").alias("__p"), F.col("distinct_id").alias("__d"), F.col("person_id").alias("__known"))
    rows = rows.join(known, (F.col("project_id") == F.col("__p")) & (F.col(distinct) == F.col("__d")), "left")
    return rows.withColumn(person, F.coalesce("__known", ingest.person_id(F.col("project_id"), F.col(distinct)))).drop("__p", "__d", "__known")


def _identified(stage: DataFrame, out: str, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The batch's events with their persons, the persons that were merged (``merges.WAYS``), and the identity after the batch."""
    identity = tables.snapshot(stage.sparkSession, f"{out}/identity", IDENTITY, step)
    told = moved(stage)
    placed = _located(_located(told, identity, "anonymous_id", "anonymous"), identity, "distinct_id", "user")
    ways = merges.merge_ways(placed)
    events = merges.persons_at(_located(stage, identity, "distinct_id", "person_id"), ways)
    if told.isEmpty():
        return events, ways, identity
    ids = told.select("project_id", F.explode(F.array("anonymous_id", "distinct_id")).alias("distinct_id")).distinct()
    new = ids.join(identity, ["project_id", "distinct_id"], "left_anti").withColumn("base_id", ingest.person_id(F.col("project_id"), F.col("distinct_id")))
    every = identity.unionByName(new.withColumn("person_id", F.col("base_id")))
    return events, ways, merges.persons_now(every, ways).select("project_id", "distinct_id", "base_id", "person_id")


def folded(people: DataFrame, changes: DataFrame) -> DataFrame:
    """person_id, name, value after a batch's changes: the last set or unset counts, else what is known, else the first set_once."""
    at = F.struct("ms", "event_id")
    last = F.col("kind").isin("set", "unset")
    known = people.select("person_id", "name", "value", F.lit("known").alias("kind"), F.lit(None).cast("long").alias("ms"), F.lit(None).cast("string").alias("event_id"))
    rows = known.unionByName(changes.select("person_id", "name", "value", "kind", "ms", F.col("event_id").cast("string").alias("event_id"))).groupBy("person_id", "name").agg(
        F.max_by(F.struct("kind", "value"), F.when(last, at)).alias("last"),
        F.max(F.when(F.col("kind") == "known", F.col("value"))).alias("known"),
        F.min_by("value", F.when(F.col("kind") == "set_once", at)).alias("once"),
    )
    value = F.when(F.col("last").isNull(), F.coalesce("known", "once")).when(F.col("last.kind") == "set", F.col("last.value"))
    return rows.select("person_id", "name", value.alias("value")).where("value is not null")


def write_batch(batch: DataFrame, out: str, number: int, step: int | None = None, job: Job = Job()) -> None:
    """A batch's rows as files under its number: events with their persons, overrides and property changes that they ask for,
    warnings, and what was refused; and the snapshots after it. Writing it again replaces it. The keys are stored last, so that a batch that fails can come again."""
    spark, step = batch.sparkSession, number * tables.STEPS if step is None else step
    put = lambda rows, kind: rows.write.mode("overwrite").parquet(f"{out}/{kind}/batch={number}")
    seen = SeenKeys(spark, f"{out}/seen", job.keys)
    good = seen.fresh(batch.where("problem is null").drop("problem"), step)
    stage = f"{out}/stage/step={step}"
    if job.rate or job.plans:
        plans = spark.read.schema(admission.PLANS).parquet(job.plans) if job.plans else spark.createDataFrame([], admission.PLANS)
        counters = tables.snapshot(spark, f"{out}/counters", admission.COUNTERS, step)
        judged, counters = admission.admit(good, counters, plans, job.rate or 1 << 62)
        judged.write.mode("overwrite").parquet(f"{stage}/judged")
        judged = spark.read.schema(judged.schema).parquet(f"{stage}/judged")
        tables.swap_in(counters, f"{out}/counters", step)
        put(judged.where("answer is not null"), "refused")
        good = judged.where("answer is null").drop("answer")
    #: Ids that are drawn, and times that are taken, stay as they are from here on.
    good.write.mode("overwrite").parquet(f"{stage}/good")
    events, ways, identity = _identified(spark.read.schema(good.schema).parquet(f"{stage}/good"), out, step)
    ways.write.mode("overwrite").parquet(f"{stage}/ways")
    ways = spark.read.schema(ways.schema).parquet(f"{stage}/ways")
    put(events, "events")
    stored = spark.read.schema(events.schema).parquet(f"{out}/events/batch={number}")

    def moves() -> None:
        before = tables.snapshot(spark, f"{out}/identity", IDENTITY, step).select("project_id", "distinct_id", F.col("person_id").alias("was"))
        changed = identity.join(before, ["project_id", "distinct_id"], "left").where(F.col("person_id") != F.coalesce("was", "base_id"))
        put(changed.select("project_id", "distinct_id", "person_id", F.lit(step).cast("long").alias("version")), "overrides")
        tables.swap_in(identity, f"{out}/identity", step)

    def persons() -> None:
        changes = ingest.property_changes(stored, "project_id", "person_id", "ms", "event_id")
        put(changes, "changes")
        if job.persons:
            people = folded(tables.snapshot(spark, f"{out}/persons", PERSONS, step), spark.read.schema(changes.schema).parquet(f"{out}/changes/batch={number}"))
            tables.swap_in(merges.merged_people(people, ways), f"{out}/persons", step)

    def catalog() -> None:
        if job.catalogs:
            known = tables.snapshot(spark, f"{out}/catalog", catalogs.CATALOG, step)
            tables.swap_in(catalogs.merged(known, catalogs.definitions_seen(stored)), f"{out}/catalog", step)

    def warnings() -> None:
        put(batch.where("problem is not null").select("project_id", F.col("problem").alias("type"), "event_name", "distinct_id", "ms"), "warnings")

    #: None of these reads what another writes.
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(f) for f in (moves, persons, catalog, warnings)]:
            done.result()
    seen.add(stored.select(*KEYS), step)
    tables.remove(spark, stage)


def start(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True, files: int = FILES_PER_TRIGGER, imported: bool = False, job: Job = Job()) -> StreamingQuery:
    """Events go to ``out``/events, overrides of persons to ``out``/overrides, changes of their properties to ``out``/changes, rejected
    rows to ``out``/warnings, refused ones to ``out``/refused, a batch that couldn't be written to ``out``/dead, and the stream goes on with the next."""
    rows = prepared(source(spark, path, files), imported)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for attempt in range(1, job.attempts + 1):
                try:
                    write_batch(batch, out, number, job=job)
                    tables.note(spark, out, "written", number)
                    return
                except Exception as error:
                    tables.note(spark, out, "attempt", number, f"{attempt}: {type(error).__name__}: {error}")
            put_aside(batch, out, number)
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": "5 seconds"}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def put_aside(batch: DataFrame, out: str, number: int) -> None:
    """A batch that couldn't be written becomes dead letters, and nothing of it stays elsewhere. If that fails too, the stream stops and the batch comes again."""
    spark, step = batch.sparkSession, number * tables.STEPS
    batch.write.mode("overwrite").parquet(f"{out}/dead/batch={number}")
    SeenKeys(spark, f"{out}/seen").forget(step)
    for kind in ("events", "overrides", "changes", "warnings", "refused"):
        tables.remove(spark, f"{out}/{kind}/batch={number}")
    for kind in ("identity", "persons", "catalog", "counters", "seen/filter"):
        tables.remove(spark, f"{out}/{kind}/version={step}")
    tables.remove(spark, f"{out}/stage/step={step}")
    tables.note(spark, out, "dead", number)


def dead_batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches among the dead letters."""
    return tables.numbers(spark, f"{out}/dead", "batch")


def replay(spark: SparkSession, out: str, failures: int = FAILURES, rest_ms: int = REST_MS, now_ms: int | None = None, job: Job = Job()) -> list[int]:
    """Write the dead letters' batches again, the oldest first, and take each away once it is written; their numbers.

    They are compared with all batches written so far, later ones too. After ``failures`` replays in a row that failed, in this run or in earlier ones,
    nothing is tried for ``rest_ms``; what is left stays for another time. Not to be run while the stream writes."""
    done: list[int] = []
    clock = lambda: int(time.time() * 1000) if now_ms is None else now_ms
    for number in dead_batches(spark, out):
        if tables.open_until(spark, out, failures, rest_ms) > clock():
            break
        step = max(tables.next_step(spark, out), tables.next_step(spark, out, "identity"))
        try:
            write_batch(spark.read.parquet(f"{out}/dead/batch={number}"), out, number, step, job)
        except Exception as error:  # it stays among the dead letters
            SeenKeys(spark, f"{out}/seen").forget(step)
            tables.note(spark, out, "replay_failed", number, f"{type(error).__name__}: {error}", clock())
            continue
        tables.remove(spark, f"{out}/dead/batch={number}")
        tables.note(spark, out, "replayed", number, at_ms=clock())
        done.append(number)
    return done


def current_persons(spark: SparkSession, out: str) -> DataFrame:
    """person_id, name, value of all persons as they are now."""
    return tables.newest(spark, f"{out}/persons", PERSONS)


def current_catalog(spark: SparkSession, out: str) -> DataFrame:
    return tables.newest(spark, f"{out}/catalog", catalogs.CATALOG)


def stored_warnings(spark: SparkSession, out: str, limit: int = 100) -> DataFrame:
    """The newest warnings first."""
    return spark.read.parquet(f"{out}/warnings").orderBy(F.desc("ms"), "project_id", "type", "distinct_id").limit(limit)


def minute_counts(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events by project and minute, late ones up to ``delay``."""
    return rows.withWatermark("time", delay).groupBy("project_id", F.window("time", "1 minute")).agg(F.count("*").alias("n"))
