"""Mixing sources to target weights over training time.

Each source has a weight and a schedule: over training time t in [0, 1] its weight goes linearly from ``(1 - tilt)`` to
``(1 + tilt)`` times the given one, so its integral over all of training is the weight itself. A source's documents stand
in the order of a hash of doc_id and text. The words before a document are a demand; the position where the integrated
schedule first reaches that demand is the inverse of the cumulative demand, a root of a quadratic. Sorting by position
gives the training order.

Targets: the sources share ``share`` times all words by weight; a target stops at ``most`` times its source's words, and
what is over goes to the others by weight until no target is above its bound. This has a closed form: sources ordered by
bound to weight; the level is the first that the next source's bound isn't below.

Words before a document are summed in two levels, first by buckets of the order's hash and then inside them, so that a hot source
is spread over thousands of tasks, and so are many documents with one doc_id or none. Nothing but the table of sources (a row
each) is ever in one task.

A null text has no words: it takes none and has no position. A null source is a source of its own, last in order. Rows
with the same doc_id are mixed as documents of their own; rows with equal doc_id and text may swap their results. Empty tables
give no rows. Columns of the documents stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import checkpoint

WEIGHTS, TILTS, SHARE, MOST = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order's hash that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, tilt, target from rows (source, size); a row a source."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    #: One row a source from here on; windows without a key see no more than those.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.pmod("rank", F.lit(len(values))).cast("int") + 1)
    table = table.withColumn("rank", rank).withColumn("weight", turn(weights)).withColumn("tilt", turn(tilts))
    table = table.withColumn("bound", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy(F.lit(1))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    below = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (total - below) / rest)
    #: The level of the first source whose bound it doesn't pass; if it passes all, all stand at their bounds.
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank"))).over(everything)
    target = F.least("bound", F.coalesce(level * F.col("weight"), F.col("bound")))
    return table.withColumn("target", target).select("source", "source_size", "weight", "tilt", "target")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, h (what a source's documents are ordered by), bucket, and more columns."""
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("h"), *more)
    return rows.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))


def _before(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds ``before``: the words of the source's documents that stand before this one. ``buckets``: source, bucket, words."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(upto, F.lit(0)).alias("upto"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = rows.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("before", F.col("upto") + F.col("inside")).drop("s", "b", "upto", "inside", "h", "bucket")


def _position(demand: Column, target: Column, tilt: Column) -> Column:
    """Inverse of target * (p + tilt * (p * p - p))."""
    y = demand / target
    root = (tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)) / (2 * tilt)
    return F.when(tilt == 0, y).otherwise(root)


def _placed(rows: DataFrame, totals: DataFrame, weights, tilts, share: float, most: float, whole: bool) -> DataFrame:
    """Adds source_size, target, taken and positions to the rows of ``_sized``. ``totals``: source, bucket, words."""
    sizes = totals.select("source", F.col("words").alias("size"))
    targets = source_targets(sizes, weights, tilts, share, most).withColumnRenamed("source", "s")
    rows = _before(rows, totals).join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes, taken = [], F.lit(0).cast("long")
    for k in range(math.ceil(most)):
        start = F.col("before") + k * F.col("source_size")
        room = F.floor(F.col("target") + 0.5) - start
        words = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("size"), room))
        words = words.cast("long")
        passes.append(F.when(words > 0, F.least(F.lit(1.0), _position(start.cast("double"), F.col("target"), F.col("tilt")))))
        taken = taken + words
    return rows.withColumn("taken", taken).withColumn("positions", F.filter(F.array(*passes), lambda p: p.isNotNull()))


def _totals(rows: DataFrame) -> DataFrame:
    return checkpoint(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions (one a pass over the source, ceil(most) at most) of every row.

    taken counts the words that the mix takes. The document in which a source meets its target is cut there, so that the
    source's words come to its target; with ``whole`` it is taken whole if at least half of it is needed, else left out.
    Texts are read once: doc_id, source, size and order are written and the rest works on these."""
    rows = checkpoint(_sized(docs.select("doc_id", "source", "text")))
    placed = _placed(rows, _totals(rows), weights, tilts, share, most, whole)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def training_order(docs: DataFrame, partitions: int | None = None, position: str | None = "position", weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs``' columns and the position: a row for each time that the mix takes a document, whole, range-sorted by position.

    The position's column has the given name, with underscores added while ``docs`` has such a column; None leaves it out.
    Texts are read twice, for their sizes and for the result, dealt once by buckets and once by position."""
    if position is not None:
        while position.lower() in map(str.lower, docs.columns):
            position += "_"
    totals = _totals(_sized(docs.select("doc_id", "source", "text")))
    rows = _placed(_sized(docs, F.struct("*").alias("row")), totals, weights, tilts, share, most, whole=True)
    rows = rows.select("row", F.explode("positions").alias("at"))
    order = ["at", "row.source", "row.doc_id"]
    dealt = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    return dealt.select("row.*", *([F.col("at").alias(position)] if position is not None else []))
