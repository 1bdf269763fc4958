"""Document fingerprints by a randomised edit embedding.

A random walk reads a text's characters: at step j it writes out the character under its pointer and moves on by one if
the shared random bit for (j, that character) is set. Texts a few edits apart write the same string but for a few places,
because after an edit two walks soon stand at the same character again; so edit distance becomes Hamming distance. A text
of n characters is walked for 2n steps at most; what lies after its end is written as end marks.

A fingerprint has SLOTS bytes. Each samples one place of the written string, the same for all texts of about equal length
(the last of a shared series of places below twice the length, as the least of random keys would choose), and hashes
the GRAM characters read from there. The likeness of two fingerprints is the share of equal bytes. For finding pairs, bands of
sampled bits meet in buckets and candidates are verified by their likeness: a band samples all bits of BAND_BYTES slots,
which are drawn at random without replacement, so no pair that is alike enough is missed.

Null texts are empty; fingerprints of empty texts are equal. Texts are read whole. Equal texts have equal fingerprints.
Repeated rows give a row each, an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, checkpoint, mix64
from eventloom.llm.components import component_roots

SLOTS, GRAM, SEED, PERIOD = 64, 4, 2024, 1 << 12
#: Below so many texts still walking, each is walked by itself.
FEW = 48
BANDS, BAND_BYTES, LIKENESS, CROWDED = 16, 4, 0.8, 4096

_rng = np.random.default_rng(SEED)
#: Slots in the order in which bands take them.
_DRAWN = np.random.default_rng(SEED + 1).permutation(SLOTS).tolist()
#: Shared random bits of the walk for (step, character class); the steps repeat after PERIOD.
_STEPS = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_STEP_ROWS = None


def _sample_places(limit: int = 1 << 40) -> list[np.ndarray]:
    """For each slot, the increasing places that are records of its random keys."""
    out = []
    for _ in range(SLOTS):
        at, places = 0, [0]
        while at < limit:
            at = int(at / (1 - _rng.random())) + 1
            places.append(at)
        out.append(np.array(places))
    return out


_PLACES = _sample_places()


def places_for(lengths: np.ndarray) -> np.ndarray:
    """The place that each slot samples in the walks of texts of so many characters (text x slot)."""
    steps = np.maximum(1, 2 * lengths)
    return np.stack([p[np.searchsorted(p, steps) - 1] for p in _PLACES], 1)


_CLASS_OF: np.ndarray | None = None


def _classes(points: np.ndarray) -> np.ndarray:
    """A byte for each character, by which the walk's random bits are drawn."""
    global _CLASS_OF
    if _CLASS_OF is None:
        _CLASS_OF = (mix64(np.arange(0x110000)) >> np.uint64(56)).astype(np.uint8)
    return _CLASS_OF[points]


def _grams(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A byte for the GRAM characters from each given place on; past the end stand end marks."""
    wide = np.concatenate([points[at.min(initial=0) :], np.zeros(GRAM, points.dtype)])
    at = at - at.min(initial=0)
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            key = key * np.uint64(0x100000001B3) + wide[np.minimum(at + k, len(wide) - 1)] + np.uint64(1)
    return (mix64(key) >> np.uint64(56)).astype(np.uint8)


def walk(texts: list[np.ndarray], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """Pointer of each text (code points) at each of its wanted steps."""
    global _STEP_ROWS
    if _STEP_ROWS is None:
        _STEP_ROWS = [row.tobytes() for row in _STEPS]
    out = [np.full(len(w), len(t), np.int64) for t, w in zip(texts, wanted, strict=True)]
    order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
    if not order:
        return out
    lengths = np.array([len(texts[i]) for i in order])
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([_classes(texts[i]) for i in order])
    #: Places where some text has a wanted step, in order of the step.
    owner = np.concatenate([np.full(len(wanted[i]), k) for k, i in enumerate(order)])
    which = np.concatenate([np.arange(len(wanted[i])) for i in order])
    step = np.concatenate([wanted[i] for i in order])
    sort = np.argsort(step, kind="stable")
    owner, which, step = owner[sort], which[sort], step[sort]
    live, at, j, seen = np.arange(len(order)), base.copy(), 0, 0
    ends = base + lengths
    position = base.copy()
    while len(live) >= FEW:
        for _ in range(64):
            if seen < len(step) and step[seen] == j:
                position[live] = np.minimum(at, ends[live])
                while seen < len(step) and step[seen] == j:
                    out[order[owner[seen]]][which[seen]] = position[owner[seen]] - base[owner[seen]]
                    seen += 1
            at += _STEPS[j % PERIOD][flat[np.minimum(at, ends[live] - 1)]]
            j += 1
        position[live] = np.minimum(at, ends[live])
        going = at < ends[live]
        live, at = live[going], at[going]
    for k, pointer in zip(live.tolist(), (at - base[live]).tolist(), strict=True):
        _walk_one(flat[base[k] : ends[k]].tobytes(), j, pointer, wanted[order[k]], out[order[k]])
    return out


def _walk_one(classes: bytes, j: int, i: int, wanted: np.ndarray, out: np.ndarray) -> None:
    rows, n = _STEP_ROWS, len(classes)
    for k in np.argsort(wanted, kind="stable").tolist():
        stop = int(wanted[k])
        if stop < j:
            continue
        while j < stop and i < n:
            i += rows[j % PERIOD][classes[i]]
            j += 1
        j = max(j, stop) if i >= n else j
        out[k] = i


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    if not points:
        return np.empty((0, SLOTS), np.uint8)
    found = walk(points, list(places_for(np.array([len(p) for p in points], np.int64))))
    return np.stack([_grams(p, w) for p, w in zip(points, found, strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=8 << 20):
            prints = fingerprint_texts([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def near_links(prints: DataFrame, at_least: float = LIKENESS, bands: int = BANDS, band_bytes: int = BAND_BYTES, crowded: int = CROWDED) -> DataFrame:
    """a, b, likeness: links between distinct fingerprints that are alike enough, enough to connect all that are.

    ``prints`` needs a column fingerprint (binary); equal ones are one class and aren't linked. Fingerprints that are alike differ
    in so few bytes that they share some bands at least (four, as a rule). Buckets are counted by hashes alone, and only
    fingerprints that meet another are looked up. A bucket of one band is read by one task; one with over ``crowded`` members
    is cut by every later band first, and again, up to as many bands as a pair is sure to share. A bucket gives a spanning
    forest of its links, never all its pairs."""
    shared = bands - int((1 - at_least) * SLOTS + 1e-9)
    if shared < 2 or bands * band_bytes > SLOTS:
        raise ValueError(f"fingerprints with a likeness of {at_least} may share fewer than two of {bands} bands")
    classes = prints.select("fingerprint").where("fingerprint is not null").distinct()
    classes = checkpoint(classes.withColumn("id", F.xxhash64("fingerprint")))
    drawn = [_DRAWN[band_bytes * k : band_bytes * (k + 1)] for k in range(bands)]
    band = lambda k: F.xxhash64(F.lit(k), *[F.substring("fingerprint", slot + 1, 1) for slot in drawn[k]])
    keyed = classes.select("id", F.posexplode(F.array(*[band(k) for k in range(bands)])).alias("band", "key"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = checkpoint(_crowds(keyed, parts).join(classes, "id").select("band", "key", "n", "fingerprint"))
    out = _forest(met.where(F.col("n") <= crowded), at_least)
    for _ in range(1, shared):
        met = met.where(F.col("n") > crowded)
        if met.isEmpty():
            return out
        later = F.filter(F.array(*[F.struct(F.lit(k).alias("band"), band(k).alias("key")) for k in range(bands)]), lambda x: x["band"] > F.col("band"))
        cut = met.select("fingerprint", F.col("key").alias("above"), F.explode(later).alias("x"))
        cut = cut.select("fingerprint", "x.band", F.xxhash64("above", "x.key").alias("key"))
        met = checkpoint(_crowds(cut, parts))
        out = out.unionByName(_forest(met.where(F.col("n") <= crowded), at_least))
    return out.unionByName(_forest(met.where(F.col("n") > crowded), at_least))


def _crowds(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows whose key others have, too, and the number of them, ``n``. One exchange serves the counting and the join."""
    dealt = keyed.repartition(parts, "key")
    return dealt.join(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _forest(members: DataFrame, at_least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(starts, starts[1:], strict=False):
                if keys[a] != last and held:
                    yield from _links(b"".join(held), at_least)
                    held = []
                last = keys[a]
                held.append(b"".join(batch.column(1).slice(a, b - a).to_pylist()))
        if held:
            yield from _links(b"".join(held), at_least)

    dealt = members.select("key", "fingerprint").repartition("key").sortWithinPartitions("key", "fingerprint")
    return dealt.mapInArrow(run, "a binary, b binary, likeness double")


def _links(bucket: bytes, at_least: float) -> Iterator[pa.RecordBatch]:
    """Breadth first; a fingerprint that has been reached isn't compared again."""
    prints = np.frombuffer(bucket, np.uint8).reshape(-1, SLOTS)
    open_, rows = np.ones(len(prints), bool), []
    for seed in range(len(prints)):
        front = [seed] if open_[seed] else []
        open_[seed] = False
        while front:
            x = front.pop()
            rest = np.flatnonzero(open_)
            alike = likeness(prints[rest], prints[x])
            for y, value in zip(rest[alike >= at_least].tolist(), alike[alike >= at_least].tolist(), strict=True):
                rows.append((*sorted((prints[x].tobytes(), prints[y].tobytes())), value))
                open_[y] = False
                front.append(y)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["a", "b", "likeness"])


def with_classes(rows: DataFrame, at_least: float = LIKENESS) -> DataFrame:
    """``rows`` (doc_id, fingerprint in hexadecimal) and ``class_id``: the smallest doc_id of all rows that links of fingerprints
    at least so alike lead to, the row's own where there are none. Rows should be a written table: they are read twice."""
    prints = rows.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    classes = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = component_roots(near_links(classes, at_least).select("a", "b")).withColumnRenamed("node", "fingerprint")
    linked = checkpoint(classes.join(roots, "fingerprint"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = linked.join(least, "root").select("fingerprint", "class_id")
    #: Only classes of more than one row are joined with the rows; of these, all the links that there are.
    more = classes.where("n > 1").select("fingerprint", "first_id").join(named, "fingerprint", "full").select("fingerprint", F.coalesce("class_id", "first_id").alias("class_id"))
    more = checkpoint(more).select(F.lower(F.hex("fingerprint")).alias("__print"), F.col("class_id").alias("__class"))
    joined = rows.join(more, F.col("fingerprint") == F.col("__print"), "left")
    return joined.select(*rows.columns, F.coalesce("__class", "doc_id").alias("class_id"))


def _next_parts(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, packed, part, ghost: rows dealt into ranges of descending doc_id, each range also with the first rows of the next.

    The ranges' bounds are approximate quantiles of doc_id, their first doc_ids are looked up exactly; both are a value a range."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # null comes last
    rows = _compressed(docs)
    cuts = docs.select(F.percentile_approx(key, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    above = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < key))
    firsts = {r["part"]: r["first"] for r in docs.select(above.alias("part"), key.alias("k")).groupBy("part").agg(F.max("k").alias("first")).collect()}
    order = sorted(firsts)
    #: The first doc_id of each range goes to the range before as well, that of the first range to the last one.
    to = {firsts[p]: order[k - 1] for k, p in enumerate(order)}
    before = F.try_element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), key) if to else F.lit(None).cast("int")
    copies = F.array_compact(F.array(F.struct(above.alias("part"), F.lit(False).alias("ghost")), F.when(before.isNotNull(), F.struct(before.alias("part"), F.lit(True).alias("ghost")))))
    return rows.select("doc_id", "packed", F.explode(copies).alias("x")).select("doc_id", "packed", F.col("x.part").cast("int").alias("part"), "x.ghost")


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id and ``packed``, the text compressed: what a shuffle of whole texts costs most is their size on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([press(x.as_py() or b"") for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, packed binary")


def edited_fingerprints(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text's last floor(n_chars / 3) characters are replaced by as many of the first of the next document in
    descending order of doc_id (null last), or all of them; after the last comes the first. Rows with the same doc_id
    are in order of their compressed texts, so equal ones stand together. Texts are shuffled once, compressed, into ranges of
    doc_id; each range also gets the next one's first row.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                doc_id, packed, part, ghost = row
                if last == (part, True):  # one row from beyond the range is enough
                    continue
                text = unpress(packed.as_py()).decode("utf-8")
                held.append((doc_id, text, part, ghost))
                size += len(text)
                last = (part, ghost)
                if size >= batch_bytes:
                    yield _compare(held)
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield _compare(held)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = _next_parts(docs, parts).repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "packed").mapInArrow(run, kinds)


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Results for all rows that are followed by the next document of their range."""
    texts = [r[1] for r in rows]
    pairs = [k for k in range(len(rows) - 1) if not rows[k][3]]
    edited = []
    for k in pairs:
        text, cut = texts[k], len(texts[k]) // 3
        edited.append(text[: len(text) - cut] + texts[k + 1][:cut])
    prints = fingerprint_texts(texts + edited)
    own, other, following = prints[pairs], prints[len(texts) :], prints[[k + 1 for k in pairs]]
    columns = [
        pa.array([rows[k][0] for k in pairs], pa.int64()),
        pa.array([len(texts[k]) for k in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([p.tobytes().hex() for p in own], pa.string()),
        pa.array([p.tobytes().hex() for p in other], pa.string()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, following), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
