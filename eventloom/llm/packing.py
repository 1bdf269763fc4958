"""Best-fit packing of token sequences, improved by swap-based local search.

Documents longer than a sequence are cut into whole sequences from their end on, so that only the first piece may be
shorter; other documents are one piece. Pieces are dealt at random into shards of about ``shard_pieces`` pieces, however many
of them one document or one doc_id has, and each shard is packed by itself: largest first, each into the bin with the least
room that is enough. A local search then works on the bins that aren't full: it takes them from the least filled on and moves
their pieces elsewhere; where a piece fits nowhere, it swaps it for one or two pieces that together are smaller, from a bin
that is fuller for it. Every move and exchange makes the sum of squared fills larger, so the search ends; a bin that comes out
empty is gone. The search goes on until no exchange is left or the number of bins is a lower bound of the shard. A shard costs
at most a part of one sequence more than all pieces together would, beside what the search leaves.

Token ids are those of the vocabulary file for the tokenizers library without special tokens added; a special token's string
in a text is that token, as the library reads it. They are computed from the same vocabulary's rank file with tiktoken,
several times faster; tests hold both equal. A null text is an empty one: its only token is the end mark. Repeated rows are
packed as documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import checkpoint

CAPACITY, END, VOCABULARY, SHARD_PIECES = 2048, 0, "byte_bpe_50k.tiktoken", 20_000
#: Special tokens of the vocabulary file, which the rank file leaves out.
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """Byte-level BPE over a rank file of the public tokenizers, built once in each worker: a function from text to ids."""
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        _ENCODERS[vocabulary] = lambda text: own.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else own.encode_ordinary(text)
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of pieces of whole sizes, found by the room that they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.rooms = 0  # bit r is set if a bin has room r
        #: For one piece and for two, by room: the sums that its bins hold as bits, and the bins of each sum. Kept after ``index``.
        self.sums: list[dict[int, int]] = []
        self.holders: list[dict[tuple[int, int], set[int]]] = []

    def index(self) -> None:
        self.sums, self.holders = [defaultdict(int), defaultdict(int)], [defaultdict(set), defaultdict(set)]
        for bin_, items in enumerate(self.items):
            if items:
                self._note(bin_)

    def _note(self, bin_: int) -> None:
        room = self.room[bin_]
        for sums, holders, own in zip(self.sums, self.holders, _sums(self.items[bin_].values()), strict=True):
            for size in own:
                sums[room] |= 1 << size
                holders[room, size].add(bin_)

    def _forget(self, bin_: int) -> None:
        room = self.room[bin_]
        for sums, holders, own in zip(self.sums, self.holders, _sums(self.items[bin_].values()), strict=True):
            for size in own:
                some = holders[room, size]
                some.discard(bin_)
                if not some:
                    sums[room] &= ~(1 << size)

    def fill(self, bin_: int) -> int:
        return self.capacity - self.room[bin_]

    def _place(self, bin_: int) -> None:
        room = self.room[bin_]
        self.by_room[room].add(bin_)
        self.rooms |= 1 << room
        if self.sums:
            self._note(bin_)

    def _lift(self, bin_: int) -> None:
        room = self.room[bin_]
        self.by_room[room].discard(bin_)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        if self.sums:
            self._forget(bin_)

    def tightest(self, size: int) -> int:
        """Bin with the least room that is enough, or -1."""
        rooms = self.rooms >> size
        return next(iter(self.by_room[size + (rooms & -rooms).bit_length() - 1])) if rooms else -1

    def put(self, item: int, size: int, bin_: int) -> None:
        if bin_ < 0:
            bin_ = len(self.items)
            self.items.append({})
            self.room.append(self.capacity)
        elif self.items[bin_]:
            self._lift(bin_)
        self.items[bin_][item] = size
        self.room[bin_] -= size
        self._place(bin_)

    def take(self, item: int, bin_: int) -> int:
        self._lift(bin_)
        size = self.items[bin_].pop(item)
        self.room[bin_] += size
        if self.items[bin_]:
            self._place(bin_)
        return size


def _sums(sizes) -> tuple[set[int], set[int]]:
    """Sizes of one piece, and of two together."""
    ones: set[int] = set()
    twos: set[int] = set()
    for size in sizes:
        twos.update([size + other for other in ones])
        ones.add(size)
    sizes = list(sizes)
    twos.update(2 * size for size in ones if sizes.count(size) > 1)
    return ones, twos


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can do without: by volume, and by pieces that can't stand together.

    For every size up to half a bin: larger pieces than what it leaves of a bin, and those above half, have a bin each; what
    is at least of that size and finds no room beside the latter needs bins of its own."""
    counts = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    n, volume = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * np.arange(capacity + 1)))
    least = np.arange(1, capacity // 2 + 1)
    half = capacity // 2 + 1  # the first size above half a bin
    alone, beside = n[-1] - n[capacity - least + 1], n[capacity - least + 1] - n[half]
    room = beside * capacity - (volume[capacity - least + 1] - volume[half])
    rest = volume[half] - volume[least]
    more = np.maximum(0, -((room - rest) // capacity))
    return max(-(-int(sizes.sum()) // capacity), int((alone + beside + more).max(initial=0)))


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Equal inputs give equal results."""
    bins = Bins(capacity)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        bins.put(item, size, bins.tightest(size))
    improve(bins, lower_bound(sizes, capacity))
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = [b for b in bins.items if b]
    for n, items in enumerate(filled):
        at = 0
        for item, size in items.items():
            where[item], offset[item] = n, at
            at += size
    return where, offset


def improve(bins: Bins, least: int = 0) -> None:
    """Local search: pass over the bins that aren't full, the least filled first, until a pass changes nothing or ``least`` bins are left."""
    left, changed = sum(map(bool, bins.items)), True
    if left > least:
        bins.index()
    while changed and left > least:
        changed = False
        order = sorted((b for b, items in enumerate(bins.items) if items and bins.room[b]), key=lambda b: (bins.fill(b), b))
        for source in order:
            if bins.items[source] and bins.room[source]:
                changed |= _drain(bins, source)
                left -= not bins.items[source]
                if left <= least:
                    return


def _drain(bins: Bins, source: int) -> bool:
    """Move or swap the pieces of a bin into fuller ones as long as that can be done; whether anything was."""
    bins._lift(source)  # while it is drained, it isn't among the bins that are looked through
    own, changed, progress = bins.items[source], False, True
    while own and progress:
        progress = False
        for item, size in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            to = bins.tightest(size)
            if to >= 0 and bins.fill(to) + size > bins.fill(source):
                del own[item]
                bins.room[source] += size
                bins.put(item, size, to)
                progress = True
            elif _exchange(bins, source, item, size):
                progress = True
                break
        changed |= progress
    if own:
        bins._place(source)
    return changed


def _exchange(bins: Bins, source: int, item: int, size: int) -> bool:
    """Swap a piece of ``source`` for one or two that are smaller by what raises the squared fill most, from any bin that is fuller for it."""
    fill = bins.fill(source)
    best = (0, 0, 0, 0)  # gain in squared fill (halved), room, what goes out, pieces that it is in
    rooms = bins.rooms & ~1
    while rooms:
        low = (rooms & -rooms).bit_length() - 1
        rooms &= rooms - 1
        full = bins.capacity - low
        if full + min(low, size - 1) <= fill:  # this bin and the emptier ones can't become fuller than the source is
            break
        for pieces, mask in enumerate((bins.sums[0][low], bins.sums[1][low]), 1):
            #: The smallest that is enough: it leaves the bin fullest.
            mask >>= max(1, size - low)
            if mask:
                out = max(1, size - low) + (mask & -mask).bit_length() - 1
                more = size - out
                gain = more * (full - fill + more)
                if more > 0 and gain > best[0]:
                    best = (gain, low, out, pieces)
    if not best[0]:
        return False
    _, room, out, pieces = best
    bin_ = next(iter(bins.holders[pieces - 1][room, out]))
    moved = {a: bins.take(a, bin_) for a in _chosen(bins.items[bin_], out, pieces)}
    bins.put(item, size, bin_)
    del bins.items[source][item]
    bins.items[source].update(moved)
    bins.room[source] += size - out
    return True


def _chosen(items: dict[int, int], out: int, pieces: int) -> tuple[int, ...]:
    """The pieces of a bin, one or two, that sum to ``out``."""
    at: dict[int, int] = {}
    for item, size in items.items():
        if pieces == 1 and size == out:
            return (item,)
        if pieces == 2 and out - size in at:
            return at[out - size], item
        at[size] = item
    raise LookupError("the bin holds no such pieces")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The pieces (without their ids) are written once, so that they can be counted and dealt by their places in what was written."""
    cut = checkpoint(pieces(docs, capacity, vocabulary, end))
    shards = max(1, round(cut.count() / shard_pieces))

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = pack(shard["length"].to_numpy(), capacity)
        base = shard["shard"][0].as_py() << 32
        return shard.drop_columns(["shard"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(run, kinds)
