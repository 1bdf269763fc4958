"""Language identification by multilingual mixture inference.

Each language has a distribution over letter trigrams (hashed, with word ends), counted over all labelled documents. A
word's likelihood in a language is the product of its trigrams'. A document is a mixture: expectation-maximisation
estimates the share of each language among its words. The set of languages starts with all and gives up the one with the
smallest share as long as the likelihood less a penalty for each language (``penalty`` times half the logarithm of the
number of words) doesn't fall. The prediction is the language with the largest share, ties by the learned order of names;
its share is the score. Texts that are null or have no letter are ``und`` with score 0, and so is everything if there is
nothing to learn from. Repeated rows give a row each, an empty table gives none; a doc_id may be missing. A very long text is a block
of its own, and is read whole.

The counts go to the driver as one table of at most ``2 ** BITS`` rows a language, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, code_points, filter_rows, letter_table

BITS, SMOOTHING, PENALTY, ROUNDS = 16, 0.5, 4.0, 8
#: Logarithm of a trigram's likelihood where all are alike.
BACKGROUND = -BITS * float(np.log(2))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram around each letter, the text of each, and whether a word begins with it."""
    points, text = code_points([t.lower() for t in texts])
    letters = letter_table()[points]
    points = np.where(letters, points, 0).astype(np.uint32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # of what is between words, the first place stays
    points, text = np.append(np.uint32(0), points[keep]), np.append(0, text[keep])
    at = np.flatnonzero(points)
    before, here, after = points[at - 1], points[at], points[at + 1]
    mixed = (before * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA6B) + (after * np.uint32(0xC2B2AE35)) * np.uint32(31))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64), text[at], before == 0


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (text, lang) that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in blocks(batches, 0):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            grams, text, _ = _trigrams(texts)
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)[text]
            counts = np.bincount((code << BITS) + grams, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, row in zip(names, counts, strict=True):
                totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "gram", "n"])

    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return labelled.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Names of the languages in order, and the logarithm of each trigram's likelihood (trigram x language)."""
    table = count_trigrams(docs).toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    names = sorted(set(langs))
    counts = np.full((1 << BITS, len(names)), smoothing)
    if names:
        counts[table["gram"].to_numpy(), np.searchsorted(np.array(names, object), langs)] += table["n"].to_numpy()
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after expectation-maximisation, and the logarithm of the likelihood, by document."""
    for _ in range(rounds):
        joint = like * share[doc]
        total = joint.sum(1)
        new = np.add.reduceat(joint / total[:, None], starts) / n[:, None]
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < 2e-3:
            break
    return share, np.add.reduceat(np.log((like * share[doc]).sum(1).astype(np.float64)), starts)


def mixtures(texts: list[str], table: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Share of each language in each text; rows of zeros for texts without a letter."""
    return fitted(texts, table, penalty, rounds)[0]


def fitted(texts: list[str], table: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The mixtures, and the logarithm of each text's likelihood under its own, a trigram; minus infinity without a letter."""
    size = table.shape[1]
    shares, likelihood = np.zeros((len(texts), size)), np.full(len(texts), -np.inf)
    grams, text, begins = _trigrams(texts)
    if not len(grams) or not size:
        return shares, likelihood
    word_at = np.flatnonzero(begins)
    score = np.add.reduceat(table[grams], word_at)
    #: Likelihoods of a word relative to its best language, bounded below so that no language is ever impossible.
    like = np.exp(np.maximum(score - score.max(1, keepdims=True), -60)).astype(np.float32)
    owner = text[word_at]
    found, starts, n = np.unique(owner, return_index=True, return_counts=True)
    doc = np.repeat(np.arange(len(found)), n)
    price = penalty * 0.5 * np.log(n + 1.0)
    share, fit = _em(like, doc, starts, n, np.full((len(found), size), 1 / size, np.float32), rounds)
    best = share.astype(np.float64)
    #: Documents that may still give up a language, by their place in ``found``.
    open_, words = np.arange(len(found)), np.arange(len(doc))
    for _ in range(size - 1):
        live = share > 0
        least = np.where(live, share, np.inf).argmin(1)
        fewer = share.copy()
        fewer[np.arange(len(fewer)), least] = 0
        some = live.sum(1) > 1
        fewer, some = fewer[some], np.flatnonzero(some)
        if not len(some):
            break
        mask = np.zeros(len(open_), bool)
        mask[some] = True
        n_open = n[open_]
        inside = np.repeat(mask, n_open)
        words = words[inside]
        open_, n_open, fit = open_[mask], n[open_[mask]], fit[mask]
        own = np.repeat(np.arange(len(open_)), n_open)
        first = np.concatenate([[0], np.cumsum(n_open)[:-1]])
        fewer, fit_fewer = _em(like[words], own, first, n_open, (fewer / np.maximum(fewer.sum(1, keepdims=True), 1e-9)).astype(np.float32), rounds)
        better = fit_fewer + price[open_] >= fit
        best[open_[better]] = fewer[better]
        words = words[np.repeat(better, n_open)]
        open_, share, fit = open_[better], fewer[better], fit_fewer[better]
        if not len(open_):
            break
    shares[found] = best
    total = np.log(np.maximum((like * best[doc]).sum(1, dtype=np.float64), 1e-300)) + score.max(1)
    likelihood[found] = np.add.reduceat(total, starts) / np.bincount(text, minlength=len(texts))[found]
    return shares, likelihood


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, n_langs of every row of ``docs``."""
    names, table = model
    sent = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for part in blocks(batches):
            share = mixtures([x or "" for x in part.column(1).to_pylist()], table, penalty)
            if names:
                top, known = share.argmax(1), share.any(1)
                pred = np.where(known, np.array(names, object)[top], "und")
                score = np.where(known, np.clip(share.max(1), 0, 1), 0.0)
            else:
                pred, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array((share > 0).sum(1), pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are a mixture of any number of known languages.

    A document is one if its mixture explains its trigrams better than a background in which all of them are as likely: text in languages (or scripts) that
    weren't learned, letters at random, and ``und`` go."""
    sent = docs.sparkSession.sparkContext.broadcast(model[1])

    def verdict(texts: list[str]) -> np.ndarray:
        return fitted(texts, sent.value, penalty)[1] > BACKGROUND

    return filter_rows(docs, verdict)


def held_out(doc_id) -> F.Column:
    """Whether a document is left out of learning; one without a doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
