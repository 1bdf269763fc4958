"""Divergence of sources: how far the term distributions of a language's sources lie apart, and which terms set one off.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that stand in
at least ``least_docs`` of its documents. A group is a (lang, source); its share of a kept term is the integer
``1 + floor(scale * (count + smooth) / (N + smooth * V))``, N being the group's count of all V kept terms; the language's own share
is made the same way from the counts of all its groups. Two groups are as far apart as the sum of their shares' differences over all
kept terms; a group's terms are those with the largest surplus over the language's share.

Terms are counted by tasks over blocks of texts and added up by Spark. Each language's terms are dealt into blocks by hash and its
groups into blocks by rank; a task holds one dense int64 matrix of groups by terms, ``CELLS`` cells at most, whatever
the number of documents, terms or sources is, takes the differences of all pairs of its rows by broadcasting, and adds them to a matrix of
pairs. Partial matrices and heaps of the best terms leave the task once for each pair of group blocks; Spark adds and ranks them.
Only the result itself (every pair of a language's sources) grows with the square of a language's sources.

Integers throughout: shares are divided out in steps that stay below 2**63 as long as a language has fewer than 9e15 terms.

A null text, lang or source is the empty string. Every row counts as a document of its own, repeated ones too. Very long texts are
blocks of their own. Groups without a term count: all their shares are those of a count of zero. Ties rank by the item's
UTF-8 bytes. An empty table gives no rows. Columns other than text, lang and source aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, checkpoint, written

LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Everything that isn't part of a term.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Cells of a task's matrix, and sources in a block of groups.
CELLS, GROUP_BLOCK = 1 << 20, 256
#: Rows of (group, term) that a task gathers before it hands them on.
GATHERED = 400_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TILES = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _added(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names)


def _block_counts(part: pa.RecordBatch) -> pa.Table:
    """Occurrences of terms, and documents with them, of a batch (lang, source, text); each group once with the empty term and zeros."""
    lang, source = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
    n_sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    pieces = pc.split_pattern_regex(pc.ascii_lower(part.column(2)), GAP)
    document, terms = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
    real = pc.greater(pc.binary_length(terms), 0)
    document, terms = document[real.to_numpy(zero_copy_only=False)].astype(np.int64), terms.filter(real).dictionary_encode()
    width = max(1, len(terms.dictionary))
    in_document, times = np.unique(document * width + terms.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(group[in_document // width] * width + in_document % width, return_inverse=True)
    n, docs = np.zeros(len(keys), np.int64), np.bincount(place, minlength=len(keys)).astype(np.int64)
    np.add.at(n, place, times)
    seen = np.unique(group)
    groups = np.concatenate([keys // width, seen])
    named = pa.concat_arrays([terms.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array([""] * len(seen), pa.string())])
    zeros = np.zeros(len(seen), np.int64)
    columns = [lang.dictionary.take(pa.array(groups // n_sources)), source.dictionary.take(pa.array(groups % n_sources)), named]
    return pa.table([*columns, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros]))], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for part in blocks(batches, 2):
        held.append(_block_counts(part))
        if sum(t.num_rows for t in held) > GATHERED:
            held = [_added(held)]
            if held[0].num_rows > GATHERED // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _added(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); every group also once with the empty term and zeros."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, first: the counts of kept terms, the language's, and whether this is the term's first group.

    The rows of the empty term, one a group, stay."""
    term = Window.partitionBy("lang", "term")
    rows = counts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
    rows = rows.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return rows.where((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", "first")


def group_table(kept: DataFrame, cells: int = CELLS, group_block: int = GROUP_BLOCK) -> DataFrame:
    """A row a group: its rank g in the language, its block, size N, the language's size, V, and the numbers of term and group blocks."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(((F.col("term") != "") & F.col("first")).cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = groups.withColumn("g", F.row_number().over(lang.orderBy("source")) - 1).withColumn("n_groups", F.count("*").over(lang))
    groups = groups.withColumn("lang_size", F.sum("size").over(lang)).withColumn("v", F.sum("firsts").over(lang)).drop("firsts")
    rows = F.least(F.col("n_groups"), F.lit(2 * group_block))
    groups = groups.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * rows / cells)).cast("int"))
    return groups.withColumn("group_blocks", F.ceil(F.col("n_groups") / group_block).cast("int")).withColumn("gb", F.floor(F.col("g") / group_block).cast("int"))


def share(count: np.ndarray, total: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * count / total) for 0 <= count <= total, by long division to base 1,000."""
    if np.any(total >= (1 << 63) // 1000):
        raise OverflowError("a language has more than 9e15 terms")
    quotient, rest, left = np.zeros_like(count + total), count + np.zeros_like(total), scale
    while left > 1:
        step = min(1000, left)
        quotient, rest, left = quotient * step + rest * step // total, rest * step % total, left // step
    return quotient + 1


def pair_sums(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Sums over the columns of |a_i - b_j| for all i and j, at most about ``cells`` differences at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    width = max(1, min(a.shape[1], cells // max(1, len(b))))
    for at in range(0, a.shape[1], width):
        right = b[:, at : at + width]
        rows = max(1, cells // max(1, right.size))
        for i in range(0, len(a), rows):
            out[i : i + rows] += np.abs(a[i : i + rows, None, at : at + width] - right[None]).sum(2)
    return out


class _Tiles:
    """Works through the rows of tiles in order (lang, bi, bj, block): first a tile's groups, then its counts."""

    def __init__(self, smooth: int, top: int):
        self.smooth, self.top = smooth, top
        self.pair, self.sums, self.names, self.heaps = None, None, ([], []), {}

    def tile(self, key, table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, bi, bj = key[:3]
        if key[:3] != self.pair:
            yield from self.pairs_out()
        col = lambda name: table.column(name)
        is_group = pc.is_null(col("term"))
        groups, counts = table.filter(is_group).sort_by("g"), table.filter(pc.invert(is_group))
        g = groups["g"].to_numpy()
        v, lang_size = int(groups["v"][0].as_py()), int(groups["lang_size"][0].as_py())
        extra = self.smooth * v
        terms = counts["term"].combine_chunks()
        terms = (terms if isinstance(terms, pa.Array) else pa.array(terms)).dictionary_encode()
        at = (np.searchsorted(g, counts["g"].to_numpy()), terms.indices.to_numpy())
        dense = np.zeros((len(g), len(terms.dictionary)), np.int64)
        dense[at] = counts["n"].to_numpy()
        p = share(dense + self.smooth, groups["size"].to_numpy()[:, None] + extra) if dense.shape[1] else dense
        left, right = groups["gb"].to_numpy() == bi, groups["gb"].to_numpy() == bj
        if self.pair is None:
            names = np.array(groups["source"].to_pylist(), object)
            self.pair, self.names, self.sums = key[:3], (names[left], names[right]), np.zeros((left.sum(), right.sum()), np.int64)
        self.sums += pair_sums(p[left], p[right])
        #: Terms of the block that none of the tile's groups has.
        absent = int(groups["n"][0].as_py()) - dense.shape[1]
        if absent:
            none = share(np.full(len(g), self.smooth), groups["size"].to_numpy() + extra)
            self.sums += absent * np.abs(none[left][:, None] - none[right][None])
        if bi == bj and dense.shape[1]:
            q_counts = np.zeros(dense.shape[1], np.int64)
            q_counts[at[1]] = counts["lang_n"].to_numpy()
            surplus = p - share(q_counts + self.smooth, np.int64(lang_size + extra))
            names = terms.dictionary.to_pylist()
            order = np.argsort(np.argsort(np.array([x.encode() for x in names], object)))
            for i, source in enumerate(groups["source"].to_pylist()):
                found = np.flatnonzero((dense[i] > 0) & (surplus[i] > 0))
                best = found[np.lexsort((order[found], -surplus[i][found]))][: self.top]
                mine = [(-int(surplus[i][k]), names[k].encode()) for k in best]
                self.heaps[lang, source] = heapq.nsmallest(self.top, [*self.heaps.get((lang, source), []), *mine])
            if len(self.heaps) > 10_000:
                yield from self.heaps_out()

    def pairs_out(self) -> Iterator[pa.RecordBatch]:
        if self.pair is None:
            return
        (lang, bi, bj), (a, b) = self.pair, self.names
        for i in range(len(a)):
            others = range(i + 1 if bi == bj else 0, len(b))
            if len(others):
                n = len(others)
                yield pa.record_batch([["pair"] * n, [lang] * n, [a[i]] * n, [b[j] for j in others], self.sums[i, others.start :]], schema=_TILES)
        self.pair = None

    def heaps_out(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), heap in self.heaps.items():
            n = len(heap)
            yield pa.record_batch([["term"] * n, [lang] * n, [source] * n, [x.decode() for _, x in heap], [-v for v, _ in heap]], schema=_TILES)
        self.heaps = {}


def _tile_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of every tile: its groups (term null, n the number of kept terms in the block), then the counts of the block's terms."""
    counts = kept.where(F.col("term") != "").select("lang", "source", "term", "n", "lang_n", "first")
    counts = counts.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    sizes = counts.groupBy("lang", "block").agg(F.sum(F.col("first").cast("long")).alias("n"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).join(sizes, ["lang", "block"], "left")
    heads = heads.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("term", F.lit(None).cast("string")).withColumn("lang_n", F.lit(None).cast("long"))
    counts = counts.drop("first")
    rows = counts.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    rows = rows.withColumn("bi", F.least("gb", "other")).withColumn("bj", F.greatest("gb", "other"))
    columns = ["lang", "bi", "bj", "block", "source", "g", "gb", "size", "lang_size", "v", "term", "n", "lang_n"]
    key = ["lang", "bi", "bj", "block"]
    return rows.select(*columns).repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first())


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, top: int = TOP, cells: int = CELLS, group_block: int = GROUP_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by distance (part ``pair``), and the group's ``top`` terms (part ``term``)."""
    kept = written(kept_terms(term_counts(docs), least_docs), "terms")
    groups = checkpoint(group_table(kept, cells, group_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, key, held = _Tiles(smooth, top), None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if key is not None and keys[start] != key:
                    yield from work.tile(key, pa.Table.from_batches(held))
                    held = []
                key = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
        if held:
            yield from work.tile(key, pa.Table.from_batches(held))
        yield from work.pairs_out()
        yield from work.heaps_out()

    partial = _tile_rows(kept, groups).mapInArrow(run, "part string, lang string, source string, item string, value long")
    summed = partial.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    #: Each pair stands once so far; both of its sources get it.
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = F.when(F.col("part") == "pair", ends).otherwise(F.slice(ends, 1, 1))
    rows = summed.select("part", "lang", "value", F.explode(both).alias("end")).select("lang", "end.source", "part", "end.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
