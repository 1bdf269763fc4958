"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

A fingerprint has one bit for each of the 64 bits of XXH64 (seed 42) of the word shingles: set if it is set in over
half of them. Fingerprints at most three bits apart are linked. With two segments of 32 bits, two such fingerprints
differ by at most one bit in one of the segments, so each fingerprint looks up the Hamming ball of radius one (33
values) of both its segments in a table of all segments, and complete distances are verified: no link is lost.

Exact copies meet as one fingerprint before anything is paired. A bucket never emits all its pairs: it is read in
sorted order by one task, which walks its links breadth first and gives a spanning forest of its links, one row fewer than members. A crowded bucket is first
cut by a second level of segments (16 bits of the other half, ball of radius one again), where a table side holds at
most 65,536 fingerprints whatever the input.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows keep a row each. An empty table
gives an empty result. Rows without a doc_id are classed as the others, and don't name a class unless they are alone in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventloom.llm.common import checkpoint
from eventloom.llm.components import component_roots

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Members from which a bucket of the first level goes on to the second.
CROWDED = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text in UTF-8, as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(g, SEED) for g in grams], np.uint64)
    #: How often each value of each byte occurs, then how often each bit is set.
    places = hashes.view(np.uint8).reshape(-1, 8) + _PLACES
    ones = (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACES = np.arange(0, 2048, 256)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _balls(value, bits: int, shift: int):
    """Column: the bits of ``value`` from ``shift`` on, and each value that differs from them in one bit."""
    own = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return F.transform(F.array(*[F.lit(m) for m in (0, *(1 << k for k in range(bits)))]), lambda m: own.bitwiseXOR(m.cast("long")))


def _probes(fps: DataFrame) -> DataFrame:
    """fp, half, key, own: the ball of each half; own marks the half itself, which is the table's side."""
    halves = F.array(*[F.struct(F.lit(h).alias("half"), _balls(F.col("fp"), 32, 32 * h).alias("ball")) for h in (0, 1)])
    return (
        fps.select("fp", F.explode(halves).alias("h"))
        .select("fp", "h.half", F.posexplode("h.ball").alias("nth", "key"))
        .select("fp", "half", "key", (F.col("nth") == 0).alias("own"))
    )


def _forest(members: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the links of each bucket. A bucket's rows are read in sorted order, own ones first."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width + 2)]
            if left:
                columns = [np.concatenate(x) for x in zip(left, columns, strict=True)]
            same = np.ones(len(columns[0]), bool)
            for k in range(width):
                same &= columns[k] == columns[k][-1]
            cut = len(same) - int(same.sum())  # the last bucket may go on in the next batch
            left = [x[cut:] for x in columns]
            if cut:
                yield _edges(*_link([x[:cut] for x in columns], width, radius))
        if left:
            yield _edges(*_link(left, width, radius))

    order = [*keys, F.col("own").desc(), "fp"]
    dealt = members.select(*keys, "own", "fp").repartition(*keys).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _link(columns: list[np.ndarray], width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    own, fp = columns[width].astype(bool), columns[width + 1].astype(np.int64)
    change = np.zeros(len(fp), bool)
    change[0] = True
    for k in range(width):
        change[1:] |= columns[k][1:] != columns[k][:-1]
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], len(fp))
    owned = np.add.reduceat(own.astype(np.int64), starts)
    a, b = [], []
    for start, stop, n in zip(starts, stops, owned, strict=True):
        if n and stop - start > 1:
            x, y = _bucket(fp[start : start + n], fp[start:stop], radius)
            a.append(x)
            b.append(y)
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket(table: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between table and members (the table comes first among them).

    Breadth first from each table entry that isn't reached yet; what has been reached isn't compared again."""
    n_own, bits = len(table), members.view(np.uint64)  # of a negative number, numpy counts the bits of its absolute value
    open_ = np.ones(len(members), bool)
    a, b = [], []
    for seed in range(n_own):
        front = [seed] if open_[seed] else []
        open_[seed] = False
        while front:
            x = front.pop()
            rest = np.flatnonzero(open_ if x < n_own else open_[:n_own])
            near = rest[np.bitwise_count(bits[rest] ^ bits[x]) <= radius]
            if len(near):
                open_[near] = False
                a.append(np.full(len(near), members[x]))
                b.append(members[near])
                front += near.tolist()
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_links(fps: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are within ``radius`` (at most 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    #: A row becomes 66, so the rows are dealt over all tasks before, however small they are.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = _probes(fps.repartition(parts, F.xxhash64("fp")))
    #: Buckets where a table entry meets another fingerprint; most probes of unrelated fingerprints end here.
    sizes = probes.groupBy("half", "key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("n_own"))
    sizes = sizes.where((F.col("n") > 1) & (F.col("n_own") > 0))
    #: Merged by hint: Spark's estimates take no account of explode, so it would broadcast 66 rows a fingerprint by the size of one.
    met = checkpoint(probes.join(sizes.hint("merge"), ["half", "key"]))
    plain = _forest(met.where(F.col("n") <= crowded), ["half", "key"], radius)
    #: Second level: a pair differs by at most one bit in one of the two 16-bit parts of the other half.
    other = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), _balls(other, 16, 16 * p).alias("ball")) for p in (0, 1)])
    fine = (
        met.where(F.col("n") > crowded)
        .select("fp", "half", "key", F.col("own").alias("o"), F.explode(parts).alias("p"))
        .select("fp", "half", "key", "o", "p.part", F.posexplode("p.ball").alias("nth", "sub"))
        .select("fp", "half", "key", "part", "sub", (F.col("o") & (F.col("nth") == 0)).alias("own"))
    )
    return plain.unionByName(_forest(fine, ["half", "key", "part", "sub"], radius))


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, first_id (smallest doc_id with it), component_id (smallest doc_id reachable), class_fp (smallest fingerprint reachable) of
    every fingerprint in ``prints`` (doc_id, fp). All of these tables grow with the input, so their joins are merged by hint."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = component_roots(near_links(classes.select("fp"), radius))
    linked = checkpoint(classes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp"))
    #: Written, as below: a class of very many fingerprints can be split.
    least = checkpoint(linked.groupBy("root").agg(F.min("first_id").alias("least_id")))
    named = linked.join(least.hint("merge"), "root").select("fp", "root", "least_id")
    #: Written, so that a join with rows has nothing but its two exchanges and the rows of a hot fingerprint can be split.
    return checkpoint(classes.join(named.hint("merge"), "fp", "left").select("fp", "first_id", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("class_fp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable), class_fp (smallest fingerprint reachable) of every row of ``docs``."""
    prints = checkpoint(fingerprints(docs, shingle))
    return prints.join(fingerprint_classes(prints, radius).hint("merge"), "fp").select("doc_id", "fp", "component_id", "class_fp")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row (all columns of ``docs``, whatever their names) and fp."""
    schema = StructType([StructField("row", docs.schema, False), StructField("fp", LongType(), False)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in row.field(at)]
            yield pa.RecordBatch.from_arrays([row, pa.array(prints, pa.int64())], ["row", "fp"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the class's smallest doc_id.

    Of several rows of the class with that doc_id one stays, the one with the smallest text. A class without any doc_id keeps
    one row, too. A doc_id that stands on texts of several classes may stay in each of them. Columns may have any names."""
    prints = checkpoint(fingerprints(docs, shingle))
    classes = fingerprint_classes(prints, radius)
    #: Of each class the fingerprints that stand on its smallest doc_id: another row can't be the one that stays.
    first = classes.where(F.col("first_id").eqNullSafe(F.col("component_id"))).select("fp", F.col("component_id").alias("id"), "class_fp")
    copies = prints.groupBy(F.col("fp").alias("f"), F.col("doc_id").alias("d")).agg(F.count("*").alias("n"))
    first = first.join(copies, (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("d"))).select("fp", "id", "class_fp", "n")
    rows_of = first.groupBy("class_fp").agg((F.sum("n") == 1).alias("sole"))
    first = checkpoint(first.join(rows_of, "class_fp").select(F.col("fp").alias("f"), F.col("id").alias("d"), "class_fp", "sole"))
    rows = with_fingerprints(docs, shingle).select("row", "fp", F.col("row.doc_id").cast("long").alias("id"))
    #: Whole rows are dealt once, for this join; only those of classes where several could stay are dealt again.
    met = rows.join(first, (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("d"))).select("row", "class_fp", "sole")
    order = [F.col("row.text"), *(F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text"))]
    turn = F.row_number().over(Window.partitionBy("class_fp").orderBy(*order))
    several = met.where("not sole").withColumn("turn", turn).where("turn = 1")
    return met.where("sole").select("row.*").unionByName(several.select("row.*"))
