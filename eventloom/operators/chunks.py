"""Folds over a person's events that can be cut into chunks and joined again.

Most persons' events are one array. Those of persons with more than a limit are dealt by ranges of (person, time), so that many tasks
share a person, and a range is cut further where the limit is below its size; events of one person and one millisecond stay together. There are as many
tasks as the events take, however many chunks these make. A chunk is folded without knowledge of what came before it:

* ordered steps: for each step the newest way that began inside, and for each pair of steps (j, k) the first time at which somebody who had
  reached j before the chunk reaches k in it. A way from before is as good as its start's window lasts.
* strict steps: what the chunk does to somebody without a step, and its first events, one a step, which decide about all others.
* steps in any order, and spoiled ways: what a chunk needs of its neighbours (the next time of each step after it; the last beginnings and excluded
  events before it) are minima and maxima of other chunks, so these are taken first and the chunk's sweep starts with them.
* sequences: for each awaited step, its first time in the chunk and where that leads.

Chunks of a person are then joined in order; there are as many as the person's events take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.values import history
from eventloom.plans.fixtures import scratch

#: Events of a person above which they are cut (a task's range has about as many), and bytes of input up to which nobody looks for such persons.
MOST_EVENTS, WHOLE_BYTES = 100_000, 256 << 20
#: A chunk's number is that of its range times this, and its place in the range.
IN_RANGE = 1 << 32


def input_bytes(rows: DataFrame) -> int:
    """Bytes of all tables that a plan reads, as Spark estimates them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def split(rows: DataFrame, most: int = MOST_EVENTS, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Rows of persons with up to ``most`` of them, and the others' rows with their ``chunk``, written; None if there are none.

    An input of up to ``whole_bytes`` isn't looked at, since any person of it fits into a task."""
    if input_bytes(rows) <= whole_bytes:
        return rows, None
    spark = rows.sparkSession
    folder = scratch(spark, "hot")
    rows.groupBy("person_id").agg(F.count("*").alias("n")).where(F.col("n") > most).write.parquet(f"{folder}/persons")
    persons = spark.read.schema(f"person_id {rows.schema['person_id'].dataType.simpleString()}, n long").parquet(f"{folder}/persons")
    total = persons.agg(F.sum("n")).first()[0]
    if total is None:
        return rows, None
    ids, size = persons.select("person_id"), max(most, MOST_EVENTS)
    cut = rows.join(ids, "person_id", "left_semi").repartitionByRange(-(-total // size) + 1, "person_id", "ms")
    cut = cut.withColumn("chunk", F.spark_partition_id().cast("long") * IN_RANGE)
    if most < size:
        place = F.rank().over(Window.partitionBy("person_id", "chunk").orderBy("ms")) - 1
        cut = cut.withColumn("place", place).withColumn("chunk", F.col("chunk") + F.floor(F.col("place") / most)).drop("place")
    cut.write.parquet(f"{folder}/rows")
    return rows.join(ids, "person_id", "left_anti"), spark.read.parquet(f"{folder}/rows")


def dealt(hot: DataFrame) -> DataFrame:
    """A task for about each range's events, since a task holds the arrays of all chunks that it collects."""
    n = (hot.agg(F.max("chunk")).first()[0] or 0) // IN_RANGE + 1
    return hot.repartition(n, "person_id", "chunk")


def histories(hot: DataFrame, *more: str) -> DataFrame:
    """person_id, chunk, h: a row a chunk, its events in order."""
    return dealt(hot.select("person_id", "chunk", "ms", "event_id", *more)).groupBy("person_id", "chunk").agg(history("ms", "event_id", *more).alias("h"))


def joined(tables: DataFrame, start: Column, step, finish) -> DataFrame:
    """person_id, out: a person's chunk tables (column ``table``) folded in order."""
    rows = tables.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "table"))).alias("tables"))
    return rows.select("person_id", F.aggregate("tables", start, lambda s, x: step(s, x["table"]), finish).alias("out"))


# ---- steps in order

def ordered_table(n: int, window: int, move) -> Column:
    """Struct c (newest start inside that reached each step) and e (first time of k for who had j before, at j * n + k). ``move``: the fold of c."""
    empty = lambda size: F.array_repeat(F.lit(None).cast("long"), size)
    start = F.struct(empty(n).alias("c"), empty(n * n).alias("e"))

    def on(acc: Column, event: Column) -> Column:
        def first(v: Column, i: Column) -> Column:
            j, k = F.floor(i / n).cast("int"), (i % n).cast("int")
            able = (k > j) & F.get(event["m"], k) & ((k == j + 1) | F.get(acc["e"], i - 1).isNotNull())
            return F.when(v.isNull() & able, event["ms"]).otherwise(v)

        return F.struct(move(acc["c"], event).alias("c"), F.transform(acc["e"], first).alias("e"))

    return F.aggregate("h", start, on)


def ordered_steps(hot: DataFrame, n: int, window: int, move) -> DataFrame:
    """person_id, out: the number of steps that a way of the person reaches."""
    tables = histories(hot, "m").select("person_id", "chunk", ordered_table(n, window, move).alias("table"))

    def step(v: Column, table: Column) -> Column:
        reach = lambda j, k: F.when(F.get(table["e"], F.lit(j * n + k)) <= F.get(v, F.lit(j)) + window, F.get(v, F.lit(j)))
        return F.array(*[F.array_max(F.array(F.get(table["c"], F.lit(k)), F.get(v, F.lit(k)), *[reach(j, k) for j in range(k)])) for k in range(n)])

    return joined(tables, F.array_repeat(F.lit(None).cast("long"), n), step, lambda v: F.size(F.filter(v, lambda x: x.isNotNull())))


# ---- strict steps

def strict_steps(hot: DataFrame, n: int, start: Column, move) -> DataFrame:
    """person_id, out: level reached. ``start`` and ``move``: the fold of strict funnels."""
    table = F.struct(F.slice("h", 1, n).alias("head"), F.aggregate("h", start, move).alias("fresh"))
    tables = histories(hot, "m").select("person_id", "chunk", table.alias("table"))

    def step(s: Column, t: Column) -> Column:
        after = F.aggregate(t["head"], s, move)
        #: Who starts again at the first event, which is later than any start before, goes on as one without a step does.
        again = (s["level"] == 0) | ((s["level"] == 1) & (F.aggregate(F.slice(t["head"], 1, 1), s, move)["start"] != s["start"]))
        return F.when(again, t["fresh"]).otherwise(after)

    return joined(tables, start, step, lambda s: s["level"])


# ---- steps in any order, spoiled ways

def _chunk_order():
    return Window.partitionBy("person_id").orderBy("chunk")


def covered_steps(hot: DataFrame, n: int, cover) -> DataFrame:
    """person_id, best, most as the sweep of unordered funnels gives them. ``cover``: the sweep, given the next times after the chunk."""
    firsts = hot.groupBy("person_id", "chunk").agg(*[F.min(F.when(F.get("m", F.lit(k)), F.col("ms"))).alias(f"f{k}") for k in range(n)])
    later = _chunk_order().rowsBetween(1, Window.unboundedFollowing)
    seeds = firsts.select("person_id", "chunk", F.array(*[F.min(f"f{k}").over(later) for k in range(n)]).alias("seed"))
    swept = histories(hot, "m").join(seeds, ["person_id", "chunk"]).select("person_id", cover(F.col("seed")).alias("c"))
    return swept.groupBy("person_id").agg(F.array(*[F.max(F.get("c.best", F.lit(k))) for k in range(n)]).alias("best"), F.max("c.most").alias("most"))


def spoiled_persons(hot: DataFrame, k: int, begins: Column, spoiled) -> DataFrame:
    """person_id of those with a spoiled way between exclusion k's steps and no clean one. ``begins``: whether an event begins one."""
    mark = F.get("x", F.lit(k))
    at = lambda when: F.max(F.when(when, F.col("ms")))
    last = hot.groupBy("person_id", "chunk").agg(at(begins).alias("f"), at(mark["e"]).alias("e"))
    inside = hot.join(last.select("person_id", "chunk", F.col("e").alias("last_e")), ["person_id", "chunk"]).where(begins & (F.col("ms") < F.col("last_e")))
    last = last.join(inside.groupBy("person_id", "chunk").agg(F.max("ms").alias("fe")), ["person_id", "chunk"], "left")
    before = _chunk_order().rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("f_in", F.max("f").over(before))
    #: The last beginning before a chunk's last excluded event is inside it, or else the last one of the chunks before.
    last = last.withColumn("fe", F.when(F.col("e").isNotNull(), F.coalesce("fe", "f_in")))
    seen = F.max(F.when(F.col("e").isNotNull(), F.struct("chunk", "e", "fe"))).over(before)
    seeds = last.select("person_id", "chunk", "f_in", seen.alias("seen"))
    seeds = seeds.select("person_id", "chunk", F.struct(F.col("f_in").alias("f"), F.col("seen.e").alias("e"), F.col("seen.fe").alias("fe")).alias("seed"))
    more = [c for c in ("anchor",) if c in hot.columns]
    rows = dealt(hot).groupBy("person_id", "chunk").agg(history("ms", "event_id", "m", "x").alias("h"), *[F.first(c).alias(c) for c in more])
    found = rows.join(seeds, ["person_id", "chunk"]).select("person_id", spoiled(F.col("seed")).alias("s"))
    return found.groupBy("person_id").agg(F.bool_or("s.dirty").alias("dirty"), F.bool_or("s.clean").alias("clean")).where("dirty and not clean").select("person_id")


# ---- sequences

def sequences(hot: DataFrame, n: int, gap: int) -> DataFrame:
    """person_id, out: whether the steps (column ``step`` of an event, from 1) come in order, each within ``gap`` of the one before."""
    null = F.lit(None).cast("long")
    start = F.array(*[F.struct(F.lit(k).alias("next"), null.alias("at"), null.alias("first")) for k in range(1, n + 1)])

    def on(acc: Column, e: Column) -> Column:
        hit = lambda s: (e["step"] == s["next"]) & (s["at"].isNull() | (e["ms"] - s["at"] <= gap))
        return F.transform(acc, lambda s: F.when(hit(s), F.struct((s["next"] + 1).alias("next"), e["ms"].alias("at"), F.coalesce(s["first"], e["ms"]).alias("first"))).otherwise(s))

    tables = histories(hot, "step").select("person_id", "chunk", F.aggregate("h", start, on).alias("table"))

    def step(s: Column, table: Column) -> Column:
        own = F.get(table, s["next"] - 1)
        able = own["first"].isNotNull() & ((s["next"] == 1) | (own["first"] - s["at"] <= gap))
        return F.when(able, F.struct(own["next"].alias("next"), own["at"].alias("at"))).otherwise(s)

    begin = F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("at"))
    return joined(tables, begin, step, lambda s: s["next"] > n)
