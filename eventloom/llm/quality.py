"""Quality rules: text statistics and decision lists learned from labelled rows.

Learning is sequential covering. A rule is a conjunction of thresholds on statistics. It is grown on two thirds of the
labelled rows, a threshold at a time by the information that it gains, pruned from its end on the other third, and kept if
it is precise enough there; the rows that it covers go and the next rule is learned from the rest. The rules come out as
one Spark conditional expression in their order, so they can be read and run without Python.

Learning takes at most ``SAMPLE`` labelled rows, those with the smallest hashes of doc_id; statistics are taken of all
rows. Null texts have no words. Without labelled rows of both kinds there are no rules and all rows but those that fail the
base are kept. A very long text is read whole; an empty table gives no rows. Repeated rows keep a row each; a doc_id with several labels is learned from with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, PRECISION = 20_000, 8, 20, 30, 0.9
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]
#: What rules may test; each is a Spark expression over the statistics.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
#: White space that separates words, symbols that are counted, capitals.
SPACE, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of STATS for one text in UTF-8."""
    words = text.split()
    n_chars = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    word_chars = n_chars - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated(words), capitals, len(lines)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += hashes[k : k + n] * _POWERS[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    #: Equal hashes are only a reason to compare the words themselves.
    seen: dict[tuple[bytes, ...], int] = {}
    cover = np.zeros(len(words) + 1, np.int64)
    for at in np.flatnonzero(twice).tolist():
        first = seen.setdefault(tuple(words[at : at + window]), at)
        if first != at:
            for x in (first, at):
                cover[x] += 1
                cover[x + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or b"") for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, sign, cut in rule:
        value = x[:, names.index(name)]
        hit &= value >= cut if sign == ">=" else value < cut
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 4) -> Rule:
    rule: Rule = []
    hit = np.ones(len(x), bool)
    while len(rule) < most and bad[hit].sum() and not bad[hit].all():
        p, n = bad[hit].sum(), hit.sum()
        best: tuple[float, Rule] = (0.0, [])
        for k, name in enumerate(names):
            value = x[hit, k]
            cuts = np.unique(np.quantile(value, np.linspace(0, 1, 129)))
            cuts = np.unique((cuts[1:] + cuts[:-1]) / 2)
            order = np.argsort(value, kind="stable")
            upto = np.concatenate([[0], np.cumsum(bad[hit][order])])
            below = np.searchsorted(value[order], cuts, "left")
            for sign, p1, n1 in (("<", upto[below], below), (">=", p - upto[below], n - below)):
                gain = np.where(p1 > 0, p1 * (np.log2((p1 + 1e-9) / np.maximum(n1, 1)) - np.log2(p / n)), 0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), [(name, sign, float(cuts[int(gain.argmax())]))])
        if not best[1]:
            break
        rule += best[1]
        hit = _covers(rule, x, names)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION, most: int = 12, seed: int = 1) -> list[Rule]:
    """Ordered rules for rejecting a row; none if nothing precise is found."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(seed)
    for _ in range(most):
        at = np.flatnonzero(left)
        if bad[at].sum() < 3:
            break
        fold = rng.permutation(len(at)) % 3
        grow, prune = at[fold > 0], at[fold == 0]
        rule = _grow(x[grow], bad[grow], names)

        def worth(r: Rule, at: np.ndarray = prune) -> float:
            hit = _covers(r, x[at], names)
            return (bad[at][hit].sum() - (~bad[at][hit]).sum()) / max(1, hit.sum()) if r else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x[at], names)
        if not rule or not hit.any() or bad[at][hit].mean() < precision:
            break
        rules.append(rule)
        left[at[hit]] = False
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: false where a rule applies, else true."""
    out = None
    for rule in rules:
        test = None
        for name, sign, cut in rule:
            value = F.expr(FEATURES[name]).cast("double")
            one = value >= F.lit(cut) if sign == ">=" else value < F.lit(cut)
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_verdict(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from statistics and labels (doc_id, quality 0 or 1; other values and nulls are left out)."""
    labels = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("d"), "quality")
    rows = stats.where(~base_failed()).join(labels, F.col("doc_id") == F.col("d")).orderBy(F.xxhash64("doc_id"), *STATS, "quality").limit(sample)
    table = rows.select(*[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()], "quality").toArrow()
    names = list(FEATURES)
    x = np.stack([table[n].to_numpy() for n in names], 1) if table.num_rows else np.empty((0, len(names)))
    return learn_rules(x, table["quality"].to_numpy() == 0, names)
