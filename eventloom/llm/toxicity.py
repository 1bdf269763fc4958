"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models. Each later model also gets the earlier categories' log-odds.
It is trained with out-of-fold ones: a row's are those of a model that hasn't seen the row, as a new document's will be. Such a
model hasn't seen the row's near copies either, for folds are dealt by classes of near duplicates, and its features are chosen
without them. The models of a category, one a fold and the one of all rows, are fitted by a task each.

Features are 64-bit hashes of what a text has at all: words, beginnings of words (three to eight letters), symbols, each once, twice or four times. A
category's model uses the ``TOP`` features that say most about it (chi-squared over the sample), so a long document isn't condemned
for its length. Features that stand in nearly the same rows count as one: else the many words of one document with many copies
would leave no room for others. A category's threshold is the one with the best F1 on out-of-fold probabilities.

The labels table has two judgements, toxic and quality; the chain predicts low quality first and then toxic. Learning takes at
most ``SAMPLE`` labelled rows, those with the smallest hashes of doc_id; rows with a null judgement are left out. Null texts
have no features. Without labels of both kinds a category has probability 0 everywhere and nothing is in it. Repeated rows
keep a row each. A very long text is a block of its own and is read whole. An empty table gives no rows, and empty labels a chain that finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import simhash
from eventloom.llm.common import blocks, checkpoint, code_points, filter_rows, letter_table, mix64

SAMPLE, TOP, FOLDS, RIDGE, ROUNDS, LEAST_ROWS = 8000, 256, 5, 1e-5, 600, 3
#: Candidates for each feature used, and the share of common rows from which two features are one.
CANDIDATES, SAME_ROWS = 8, 0.8
#: In the chain's order: name and condition on the labels' columns.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
BEGINNINGS, LEVELS = (3, 4, 5, 6, 7, 8), (1, 2, 4)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts and the text of each; a feature may come more than once."""
    points, owner = code_points([t.lower() for t in texts])
    letters = letter_table()[points]
    symbols = ~letters & (points > 32) & ~((points >= 48) & (points <= 57))
    out, who = [mix64(points[symbols].astype(np.uint64) + np.uint64(1 << 40))], [owner[symbols]]
    begins = letters.copy()
    begins[1:] &= ~letters[:-1]
    at = np.flatnonzero(letters)
    if len(at):
        first = np.flatnonzero(begins[at])
        sizes = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        with np.errstate(over="ignore"):
            value = mix64(points[at].astype(np.uint64)) * _POWERS[np.minimum(place, 63)]
            out.append(mix64(np.add.reduceat(value, first)))
            who.append(owner[at[first]])
            for size in BEGINNINGS:
                some = first[sizes >= size]
                total = np.zeros(len(some), np.uint64)
                for k in range(size):
                    total += value[some + k]
                out.append(mix64(total + np.uint64(size << 48)))
                who.append(owner[at[some]])
    return np.concatenate(out), np.concatenate(who)


def hits(texts: list[str], tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted table of feature hashes: whether each text has each feature once, twice, four times (text x 3 features)."""
    keys, owner = features(texts)
    every = np.unique(np.concatenate(tables)) if tables else np.empty(0, np.uint64)
    counts = np.zeros((len(texts), len(every)), np.int64)
    if len(every):
        place = np.minimum(np.searchsorted(every, keys), len(every) - 1)
        same = every[place] == keys
        counts = np.bincount(owner[same] * len(every) + place[same], minlength=counts.size).reshape(counts.shape)
    out = []
    for table in tables:
        own = counts[:, np.searchsorted(every, table)]
        out.append(np.hstack([own >= n for n in LEVELS]))
    return out


@dataclass
class Link:
    """A category's model: weights of its features, then of the earlier categories' log-odds, then the constant."""

    name: str
    table: np.ndarray
    weights: np.ndarray
    threshold: float


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        top = x.T @ (x @ (top / np.linalg.norm(top))) / len(x)
    step = np.float32(3.6 / max(float(np.linalg.norm(top)), 1e-6))
    w = np.zeros(x.shape[1], np.float32)
    v, t = w.copy(), 1.0
    penalty = np.full(len(w), ridge, np.float32)
    penalty[-1] = 0
    for _ in range(rounds):
        #: All in single precision: a double among the factors would copy x in double precision in every round.
        slope = (_sigmoid(x @ v) - y) @ x / np.float32(len(y)) + penalty * v
        new = v - step * slope
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t_next) * (new - w), new, t_next
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Probability of the cut with the best F1, in the middle of the gap of log-odds that it lies in."""
    order = np.argsort(-odds, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(odds) + 1) + y.sum())
    k = int(f1.argmax())
    after = odds[order[k + 1]] if k + 1 < len(odds) else odds[order[k]] - 2
    return float(_sigmoid((odds[order[k]].astype(np.float64) + after) / 2))


@dataclass
class Labelled:
    """The labelled sample: which rows have each candidate feature once, twice, four times (level x candidate x row, packed),
    judgements (row x category), the fold of each row, and features by category and fold left out (the last: none): candidates in
    order of what they say, or, once they are ``selected``, those that the models use."""

    bits: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    order: list[list[np.ndarray]]

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        flat = self.bits[:, columns].reshape(-1, self.bits.shape[2])
        return np.unpackbits(flat, axis=1, count=len(self.y)).T.astype(np.float32)


def selected(data: Labelled, top: int) -> tuple[Labelled, np.ndarray]:
    """The sample with the features that models use, and no others' bits: this is what goes to the tasks. And which these are."""
    chosen = [[distinct_features(data.bits[0], order, top, np.packbits(data.fold != f)) for f, order in enumerate(some)] for some in data.order]
    every = np.unique(np.concatenate([x for some in chosen for x in some]))
    return Labelled(data.bits[:, every], data.y, data.fold, [[np.searchsorted(every, x) for x in some] for some in chosen]), every


def fit_without(data: Labelled, k: int, fold: int, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A category's model from all rows that aren't in the fold: its features, its weights (none if there is nothing to
    learn) and the log-odds of all rows."""
    train, y = data.fold != fold, data.y[:, k]
    columns = data.order[k][fold]
    if train.sum() < 2 * FOLDS or y[train].min() == y[train].max():
        return columns, np.empty(0, np.float32), np.zeros(len(y), np.float32)
    x = np.hstack([data.matrix(columns), earlier])
    w = _fit(x[train], y[train].astype(np.float32))
    return columns, w, (x @ w[:-1] + w[-1]).astype(np.float32)


def train_chain(data: Labelled, features_: np.ndarray, names: list[str], run) -> list[Link]:
    """A model for each category; ``run``, given a category's number and the earlier log-odds, fits without each fold and without none."""
    chain, earlier = [], np.empty((len(data.y), 0), np.float32)
    for k, name in enumerate(names):
        results = run(k, earlier)
        columns, weights, _ = results[-1]
        odds = np.zeros(len(data.y), np.float32)
        for fold, result in enumerate(results[:-1]):
            odds[data.fold == fold] = result[2][data.fold == fold]
        if len(weights):
            chain.append(Link(name, features_[columns], weights, _threshold(odds, data.y[:, k])))
        else:
            chain.append(Link(name, features_[columns], np.zeros(len(LEVELS) * len(columns) + k + 1, np.float32), 2.0))
        earlier = np.hstack([earlier, np.clip(odds, -30, 30)[:, None]])
    return chain


def _in_tasks(spark: SparkSession, data: Labelled):
    """A ``run`` for train_chain by Spark tasks; the sample goes to them once, its size bounded by that of the sample."""
    sent = spark.sparkContext.broadcast(data)

    def run(k: int, earlier: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fold in batch.column(0).to_pylist():
                    found = fit_without(sent.value, k, fold, earlier)
                    yield pa.RecordBatch.from_arrays([pa.array([fold]), *(pa.array([x.tobytes()], pa.binary()) for x in found)], ["fold", "columns", "weights", "odds"])

        rows = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "fold long, columns binary, weights binary, odds binary").collect()
        return [(np.frombuffer(r["columns"], np.int64), np.frombuffer(r["weights"], np.float32), np.frombuffer(r["odds"], np.float32)) for r in sorted(rows, key=lambda r: r["fold"])]

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and a 0/1 column y0, y1, ... a category, of at most ``sample`` labelled rows.

    The bound holds for labels and, as a labelled doc_id may stand on many documents, for the rows themselves; those of the least hashes are taken."""
    marks = [F.expr(condition).cast("int").alias(f"y{k}") for k, (_, condition) in enumerate(categories)]
    rows = labels.select(F.col("doc_id").cast("long").alias("d"), *marks)
    for k in range(len(categories)):
        rows = rows.where(F.col(f"y{k}").isNotNull())
    rows = rows.orderBy(F.xxhash64("d"), *[f"y{k}" for k in range(len(categories))]).limit(sample)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), F.col("doc_id") == F.col("d"))
    #: A labelled doc_id may stand on any number of documents.
    return found.orderBy(F.xxhash64("d"), F.xxhash64("text"), "text", *[f"y{k}" for k in range(len(categories))]).limit(sample).drop("d")


def with_folds(rows: DataFrame) -> DataFrame:
    """``rows`` and ``fold``, by which near duplicates stand together."""
    prints = checkpoint(simhash.with_fingerprints(rows))
    classes = simhash.fingerprint_classes(prints.select(F.col("row.doc_id").cast("long").alias("doc_id"), "fp"))
    fold = F.pmod(F.xxhash64("class_fp"), F.lit(FOLDS)).cast("int").alias("fold")
    return prints.join(classes.select("fp", fold), "fp").select("row.*", "fold")


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, top: int = TOP) -> list[Link]:
    names, spark = [name for name, _ in categories], docs.sparkSession
    ys = [f"y{k}" for k in range(len(names))]
    rows = checkpoint(with_folds(labelled_sample(docs, labels, categories, sample)))
    sums = [f"{c}_{f}" for f in range(FOLDS) for c in ("n", *ys)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 1):
            keys, owner = features([x or "" for x in part.column(1).to_pylist()])
            marks = np.stack([np.ones(part.num_rows, np.int64), *(part.column(3 + k).to_numpy() for k in range(len(names)))], 1)
            own = np.zeros((part.num_rows, FOLDS, 1 + len(names)), np.int64)
            own[np.arange(part.num_rows), part.column(2).to_numpy()] = marks
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner = keys[new], owner[new]
            found, start = np.unique(keys, return_index=True)
            if not len(found):
                continue
            total = np.add.reduceat(own.reshape(part.num_rows, -1)[owner], start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(total[:, k]) for k in range(len(sums)))], ["feature", *sums])

    counts = rows.select("doc_id", "text", "fold", *ys).mapInArrow(count, "feature long, " + ", ".join(f"{c} long" for c in sums))
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums]).where(sum(F.col(f"n_{f}") for f in range(FOLDS)) >= LEAST_ROWS)
    counts = checkpoint(counts)
    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()}
    ranks: list[list[np.ndarray]] = []
    for y in ys:
        ranks.append([])
        for left_out in range(FOLDS + 1):
            seen = [f for f in range(FOLDS) if f != left_out]
            t, p = (float(sum(totals[f][c] for f in seen if f in totals)) for c in ("n", y))
            n, hit = (sum(F.col(f"{c}_{f}") for f in seen) for c in ("n", y))
            # chi-squared of the two by two table of having the feature and being in the category
            gap = hit * F.lit(t) - n * F.lit(p)
            chi = gap * gap / (n * (F.lit(t) - n + 1e-9) * F.lit(max(p * (t - p), 1e-9)))
            best = counts.where(n >= LEAST_ROWS).orderBy(chi.desc(), "feature").limit(CANDIDATES * top)
            ranks[-1].append(best.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    table = np.unique(np.concatenate([x for some in ranks for x in some]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 1):
            (found,) = hits([x or "" for x in part.column(1).to_pylist()], [table])
            packed = [row.tobytes() for row in np.packbits(found, axis=1)]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(packed, pa.binary())], ["fold", *ys, "x"])

    kinds = "fold int, " + "".join(f"{y} int, " for y in ys) + "x binary"
    seen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", *ys).select("doc_id", "text", "fold", *ys).mapInArrow(look, kinds).toArrow()
    judged = np.stack([seen[y].to_numpy() for y in ys], 1) if seen.num_rows else np.zeros((0, len(names)), np.int64)
    data = Labelled(_by_feature(seen["x"].to_pylist(), len(table)), judged, seen["fold"].to_numpy(), [[np.searchsorted(table, x) for x in some] for some in ranks])
    data, used = selected(data, top)
    return train_chain(data, table[used], names, _in_tasks(spark, data))


def _by_feature(rows: list[bytes], n_features: int) -> np.ndarray:
    """Packed bits of rows (row x level and feature) as packed bits of features (level x feature x row), a stretch at a time."""
    width = len(LEVELS) * n_features
    packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, -(-width // 8)), np.uint8)
    parts = [np.packbits(np.unpackbits(packed[:, a : a + 64], axis=1), axis=0).T for a in range(0, packed.shape[1], 64)]
    flat = np.concatenate(parts)[:width] if parts else np.zeros((0, -(-len(rows) // 8)), np.uint8)
    return np.ascontiguousarray(flat).reshape(len(LEVELS), n_features, flat.shape[1])


def distinct_features(bits: np.ndarray, order: np.ndarray, top: int, rows: np.ndarray) -> np.ndarray:
    """Up to ``top`` features, sorted, taken in the given order unless they share most of their rows with one that is taken already.

    ``bits`` says which rows have a feature and ``rows`` which count, both packed."""
    kept: list[int] = []
    wide = lambda x: np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, -x.shape[-1] % 8)]).view(np.uint64)
    present = wide(bits[order] & rows)
    own, n = np.empty((top, present.shape[1]), np.uint64), np.empty(top, np.int64)
    for c, mine in zip(order.tolist(), present, strict=True):
        if len(kept) == top:
            break
        size, k = int(np.bitwise_count(mine).sum()), len(kept)
        shared = np.bitwise_count(own[:k] & mine).sum(1, dtype=np.int64)
        if not (shared > SAME_ROWS * (size + n[:k] - shared)).any():
            own[k], n[k] = mine, size
            kept.append(c)
    return np.array(sorted(kept), np.int64)


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """doc_id, p_<category> and is_<category> for every category, of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"{kind}_{link.name}" for link in chain for kind in ("p", "is")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            columns = probabilities([x or "" for x in part.column(1).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in columns)], ["doc_id", *names])

    kinds = "doc_id long" + "".join(f", p_{link.name} double, is_{link.name} boolean" for link in chain)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def probabilities(texts: list[str], chain: list[Link]) -> list[np.ndarray]:
    """Probability and verdict of each category in turn."""
    out, earlier = [], np.empty((len(texts), 0))
    found = hits(texts, [link.table for link in chain])
    for link, x in zip(chain, found, strict=True):
        if link.threshold > 1:  # never learned
            odds, p = np.zeros(len(texts)), np.zeros(len(texts))
        else:
            odds = np.hstack([x, earlier]) @ link.weights[:-1].astype(np.float64) + float(link.weights[-1])
            p = _sigmoid(odds)
        out += [p, p >= link.threshold]
        earlier = np.hstack([earlier, np.clip(odds, -30, 30)[:, None]])
    return out


def keep_clean(docs: DataFrame, chain: list[Link], category: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't in the category."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    verdict = [link.name for link in chain].index(category) * 2 + 1
    return filter_rows(docs, lambda texts: ~probabilities(texts, sent.value)[verdict])
