"""Index of the keys of all events ever written, so that a batch reads only what may hold its keys.

Keys are stored in ``BUCKETS`` folders by hash. Beside them stands a filter of fixed size: a slot of 32,768 bits for every thousand keys that it is made
for, and eight bits a key in the key's slot. A batch looks its keys up in the filter (one row a slot), and only the keys that it may have
(all repeats, and about one new key in 100,000 while the filter isn't over-full) are compared with the stored keys of their buckets. What a batch costs is so its own size, the filter's,
and the buckets of its repeats, however many batches came before. When more keys are stored than the filter is made for, it is made
anew with twice the slots, from the stored keys.

A repeat is found however late it comes. A batch that is written again doesn't see its own keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.streaming import tables

BUCKETS, CAPACITY, SLOT_BITS, PROBES, SLOT_KEYS = 64, 8_000_000, 32_768, 8, 1_000
FILTER = "slot int, bits binary, slots int, keys long"
KEYS = ["project_id", "event_id"]


def _hash() -> Column:
    return F.xxhash64(*KEYS)


def _positions() -> list[Column]:
    return [F.pmod(F.xxhash64(*KEYS, F.lit(k)), F.lit(SLOT_BITS)) for k in range(PROBES)]


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *KEYS), F.lit(BUCKETS)).cast("int")


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2 == 1


def _bits(keys: DataFrame, slots: int) -> DataFrame:
    """slot, bits of keys."""
    rows = keys.select(F.pmod(_hash(), F.lit(slots)).cast("int").alias("slot"), F.explode(F.array(*_positions())).alias("position"))
    return rows.groupBy("slot").agg(F.bitmap_construct_agg("position").alias("bits"))


class SeenKeys:
    """The index under a folder. ``capacity``: keys that the first filter is made for."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity = spark, path, capacity

    def _filter(self, step: int) -> tuple[DataFrame, int, int]:
        """The filter before a step, its slots, and how many keys it holds."""
        rows = tables.snapshot(self.spark, f"{self.path}/filter", FILTER, step)
        head = rows.where("slot = -1").first()
        return rows.where("slot >= 0"), *((head["slots"], head["keys"]) if head else (max(1, self.capacity // SLOT_KEYS), 0))

    def stored(self, buckets: list[int], step: int) -> DataFrame:
        """Keys of some buckets that steps before this one have stored."""
        paths = [p for b in buckets if tables.exists(self.spark, p := f"{self.path}/keys/bucket={b}")]
        schema = "project_id string, event_id string, step long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/keys").parquet(*paths).where(F.col("step") < step)

    def repeats(self, rows: DataFrame, step: int) -> DataFrame:
        """project_id, event_id of the rows' keys that have been stored before a step."""
        bits, slots, _ = self._filter(step)
        rows = rows.select(*KEYS).withColumn("slot", F.pmod(_hash(), F.lit(slots)).cast("int"))
        hit = None
        for position in _positions():
            hit = _is_set(F.col("bits"), position) if hit is None else hit & _is_set(F.col("bits"), position)
        maybe = rows.join(bits.select("slot", "bits"), "slot").where(hit).select(*KEYS, _bucket().alias("bucket")).persist()
        #: At most BUCKETS numbers.
        buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        return maybe.select(*KEYS).join(self.stored(buckets, step).select(*KEYS).distinct(), KEYS, "left_semi").distinct()

    def fresh(self, rows: DataFrame, step: int) -> DataFrame:
        """One row a key, of those whose key hasn't been stored before a step."""
        return rows.dropDuplicates(KEYS).join(self.repeats(rows, step), KEYS, "left_anti")

    def add(self, keys: DataFrame, step: int) -> None:
        """Store the keys of a batch; the filter is swapped in after them."""
        keys = keys.select(*KEYS)
        self.forget(step)
        rows = keys.withColumn("step", F.lit(step).cast("long")).withColumn("bucket", _bucket())
        rows.repartition("bucket").write.mode("append").partitionBy("bucket", "step").parquet(f"{self.path}/keys")
        bits, slots, n = self._filter(step)
        n += keys.count()
        if n > slots * SLOT_KEYS:
            while n > slots * SLOT_KEYS:
                slots *= 2
            every = self.spark.read.schema("project_id string, event_id string, step long").parquet(f"{self.path}/keys").where(F.col("step") <= step)
            bits = _bits(every, slots)
        else:
            bits = bits.select("slot", "bits").unionByName(_bits(keys, slots)).groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits"))
        head = self.spark.createDataFrame([(-1, None, slots, n)], FILTER)
        whole = bits.select("slot", "bits", F.lit(slots).alias("slots"), F.lit(0).cast("long").alias("keys"))
        tables.swap_in(whole.unionByName(head), f"{self.path}/filter", step)

    def forget(self, step: int) -> None:
        """Take away what a step has stored, should it have failed half way."""
        tables.remove(self.spark, f"{self.path}/keys/bucket=*/step={step}")
