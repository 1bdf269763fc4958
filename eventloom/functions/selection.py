"""Exact percentiles over any number of values, without a buffer of them: the place of a rank is narrowed down by histograms.

A pass counts values in a few thousand equal parts of the span in question, and the next one looks only at the part that holds the rank; parts get
thousands of times narrower by each pass. When a part holds few different values, these are counted one by one. Tasks hold a histogram, the driver
its counts; a handful of passes does it for doubles of any spread. Several ranks are narrowed down in the same passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, FEW = 4096, 20_000


def _at_ranks(values: DataFrame, ranks: list[int], parts: int, few: int) -> dict[int, float]:
    """The value at each rank (from 0) in order. ``values``: one column v of doubles, not null."""
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    #: Spans in question: low, high, how many values are below, how many inside.
    spans = {rank: (ends["low"], ends["high"], 0, ends["n"]) for rank in set(ranks)}
    found: dict[int, float] = {}
    while spans:
        for rank, (low, high, _, _) in list(spans.items()):
            if low == high:
                found[rank] = low
                del spans[rank]
        open_ = sorted(set(spans.values()))
        if not open_:
            break
        inside = lambda s: (F.col("v") >= F.lit(s[0])) & (F.col("v") <= F.lit(s[1]))
        small = [s for s in open_ if s[3] <= few or s[0] / 2 == s[1] / 2]
        if small:
            which = F.array(*[F.when(inside(s), F.lit(i)) for i, s in enumerate(small)])
            rows = values.select("v", F.explode(F.array_compact(which)).alias("span")).groupBy("span", "v").agg(F.count("*").alias("n")).collect()
            for i, span in enumerate(small):
                below = span[2]
                for v, n in sorted((r["v"], r["n"]) for r in rows if r["span"] == i):
                    for rank in [k for k, s in spans.items() if s == span and below <= k < below + n]:
                        found[rank] = v
                    below += n
                spans = {k: s for k, s in spans.items() if s != span}
        wide = [s for s in open_ if s not in small]
        if wide:
            def part(s) -> Column:
                #: Halves, so that a span of all doubles doesn't overflow.
                place = (F.col("v") / 2 - F.lit(s[0] / 2)) / F.lit(s[1] / 2 - s[0] / 2) * parts
                return F.when(inside(s), F.least(F.floor(place), F.lit(parts - 1)).cast("int"))

            which = F.filter(F.array(*[F.struct(F.lit(i).alias("span"), part(s).alias("part")) for i, s in enumerate(wide)]), lambda x: x["part"].isNotNull())
            counts = values.select("v", F.explode(which).alias("x")).groupBy("x.span", "x.part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for i, span in enumerate(wide):
                below = span[2]
                for r in sorted((r for r in counts if r["span"] == i), key=lambda r: r["part"]):
                    for rank in [k for k, s in spans.items() if s == span and below <= k < below + r["n"]]:
                        spans[rank] = (r["low"], r["high"], below, r["n"])
                    below += r["n"]
    return found


def exact_percentiles(rows: DataFrame, value: Column, shares: list[float], discrete: bool = False, parts: int = PARTS, few: int = FEW) -> list[float | None]:
    """The values at given shares of all values that aren't null: between neighbours (as ``percentile``), or the first one that reaches the share (as ``percentile_disc``)."""
    values = rows.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [max(0, math.ceil(round(s * n, 9)) - 1) if discrete else s * (n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    at = _at_ranks(values, ranks, parts, few)

    def between(p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        return at[low] if low == high or at[low] == at[high] else (high - p) * at[low] + (p - low) * at[high]

    return [between(p) for p in places]
