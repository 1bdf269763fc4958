"""Repair of conversation structure: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2, the only one for blank and duplicate rows); Insert puts an empty
turn anywhere (5). A truncated row that stays adds 5. A role counts by its initial; s, u and a stand for system, user, assistant.
The audit is the string of the edits' initials in order; of equally cheap ones the least in ASCII order.

Rank-compressed dynamic programming: a row's macro edit is a run of inserts and then its own edit, written ``I..IX``. The codes of
macros are prefix-free (each ends with its only letter that isn't I) and their order as strings is known beforehand, so audits of the same
number of rows compare like sequences of codes. A layer (a row) keeps for each state of the automaton (start, after s, u, a) the least
cost, and in place of the audit so far its rank among the layer's audits; the next layer compares (cost, rank, code). A byte holds the
parent state and the code; audits are read back from these at the end. Runs of three and more inserts come to the state of a run two
shorter, so runs stop at two.

Conversations needn't fit into a task. Equal rows of a conversation are counted first and the rest is dealt by ranges of
(conv_id, turn, role, text), so a long conversation is cut into segments over several tasks. A segment is solved for every state that
it may be entered with; entries and exits of a conversation's segments (some numbers each) are then chosen in order by the same comparison, and
each segment reads its edits back on its own. Repaired rows come by segments; only a digest of a whole conversation has
to pass one task in order, row by row, with nothing held.

Rows are taken by turn (null first), then role and text. Null roles and texts are one space here; an empty role has no initial and
can't be kept. Repeated rows are duplicates like
any other. Very long texts are dealt and read as any other; sorting compares them whole. An empty table gives no rows. Only conv_id, turn, role and text are read, other columns
may have any name; conv_id may be null, which is a conversation of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INK, END_MARK = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: States: nothing yet, after s, after u, after a. The next user or assistant turn from each, and where the end may be.
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
MOST_INSERTS = 2
#: Macro edits in the order of their codes.
MACROS = sorted(("I" * k + edit for k in range(MOST_INSERTS + 1) for edit in "DKR"))
NO_WAY = 1 << 60
LEGAL = ("su", "ua", "au")
#: Characters of the text by which ranges are cut; rows inside a range are sorted by the whole text.
RANGE_CHARS = 64


# ---- the automaton of one row

def initial_class(role: Column) -> Column:
    """1 for s, 2 for u, 3 for a, else 0."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)


@lru_cache(maxsize=None)
def _moves(kind: int, fault: int) -> list[tuple[int, int, int, int]]:
    """(state before, macro, state after, cost) of a row: ``kind`` its initial's class; fault 0, 1 (truncated) or 2 (has to go)."""
    found = []
    for start in range(4):
        for m, macro in enumerate(MACROS):
            state, edit = start, macro[-1]
            for _ in macro[:-1]:
                state = TURN[state]
            cost = INSERT * (len(macro) - 1)
            if edit == "D":
                found.append((start, m, state, cost + DELETE))
            elif fault < 2:
                stays = TRUNCATED if fault == 1 else 0
                if edit == "R":
                    found.append((start, m, TURN[state], cost + REROLE + stays))
                elif (kind == SYSTEM and state == START) or (kind > 1 and kind == TURN[state]):
                    found.append((start, m, kind, cost + KEEP + stays))
    return found


#: Lanes of a segment: (entry state, state now), sixteen of them.
_FIRST = (tuple(0 if e == q else NO_WAY for e in range(4) for q in range(4)), (0,) * 16)


@lru_cache(maxsize=1 << 16)
def _layer(costs: tuple, ranks: tuple, kind: int, fault: int) -> tuple[int, tuple, tuple, bytes]:
    """A row's layer: what all costs rise by, the lanes' costs above that, their ranks, their parents (a byte a lane)."""
    best: list[tuple | None] = [None] * 16
    for entry in range(0, 16, 4):
        for before, macro, after, cost in _moves(kind, fault):
            if costs[entry + before] >= NO_WAY:
                continue
            way = (costs[entry + before] + cost, ranks[entry + before], macro, before)
            if best[entry + after] is None or way < best[entry + after]:
                best[entry + after] = way
    low = min(w[0] for w in best if w)
    order = {key: i for i, key in enumerate(sorted({w[1:3] for w in best if w}))}
    return (
        low,
        tuple(w[0] - low if w else NO_WAY for w in best),
        tuple(order[w[1:3]] if w else 0 for w in best),
        bytes(w[3] * len(MACROS) + w[2] if w else 255 for w in best),
    )


class Segment:
    """Consecutive rows of a conversation, solved for every state of entry."""

    def __init__(self):
        self.low, (self.costs, self.ranks), self.parents = 0, _FIRST, bytearray()

    def add(self, kind: int, fault: int, times: int = 1) -> None:
        for _ in range(times):
            rise, self.costs, self.ranks, parents = _layer(self.costs, self.ranks, kind, fault)
            self.low += rise
            self.parents += parents

    def totals(self) -> list[int]:
        return [NO_WAY if c >= NO_WAY else c + self.low for c in self.costs]


def read_back(parents: bytes, entry: int, leave: int) -> bytes:
    """The macros of a segment's rows, a byte each, between two states."""
    found, lane = bytearray(), leave
    for at in range(len(parents) - 16, -1, -16):
        lane, macro = divmod(parents[at + entry * 4 + lane], len(MACROS))
        found.append(macro)
    found.reverse()
    return bytes(found)


def joined_path(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Cost, (entry, exit) of each segment, and the inserts behind the last, from (costs, ranks) of a conversation's segments."""
    now, links = {START: (0, 0)}, []
    for costs, ranks in segments:
        best: dict[int, tuple] = {}
        for before, (cost, rank) in now.items():
            for after in range(4):
                lane = before * 4 + after
                if costs[lane] < NO_WAY:
                    way = (cost + costs[lane], rank, ranks[lane], before)
                    if after not in best or way < best[after]:
                        best[after] = way
        order = {key: i for i, key in enumerate(sorted({w[1:3] for w in best.values()}))}
        now = {q: (w[0], order[w[1:3]]) for q, w in best.items()}
        links.append({q: w[3] for q, w in best.items()})
    ends = []
    for state, (cost, rank) in now.items():
        at = state
        for run in range(MOST_INSERTS + 1):
            if at in FINAL:
                ends.append((cost + INSERT * run, rank, run, state))
            at = TURN[at]
    cost, _, run, state = min(ends)
    path = []
    for link in reversed(links):
        path.append((link[state], state))
        state = link[state]
    return cost, path[::-1], run


# ---- the job

def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space each, but for conv_id and turn themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text, copies) in order, written, with ``part``, the task that holds them, and ``pos``, which rises in
    a conversation; and without texts, what the edits depend on.

    kind: class of the role's initial; fault: 0 none, 1 truncated, 2 blank, 3 duplicate, that of the first copy (the others are duplicates, or blank)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    rows = rows.repartitionByRange(*order, F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order, "text")
    rows = written(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "turns")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    brief = rows.select("conv_id", "turn", "part", "pos", "role", "copies", digest.alias("digest"), F.rlike("text", F.lit(INK)).alias("ink"), F.rlike("text", F.lit(END_MARK)).alias("ended"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("pos")) > 1
    fault = F.when(~F.col("ink"), 2).when(again, 3).when(~F.col("ended"), 1).otherwise(0)
    return rows, brief.select("part", "pos", "conv_id", "turn", "copies", F.substring("role", 1, 1).alias("initial"), initial_class(F.col("role")).alias("kind"), fault.alias("fault"))


_NUMBERS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"


def _segments(brief: DataFrame) -> DataFrame:
    """A row a segment: its first pos, lanes, parents and numbers."""
    kind = brief.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, pos long, costs array<long>, ranks array<long>, parents binary, {_NUMBERS}"
    rows = brief.repartition("part").sortWithinPartitions("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        key, seg, row = None, None, None

        def close():
            out.append({**row, "costs": seg.totals(), "ranks": list(seg.ranks), "parents": bytes(seg.parents)})

        def batch_out():
            arrow = pa.schema([("conv_id", conv_type), ("pos", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("parents", pa.binary())]
                              + [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NUMBERS.split(", ")])
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        held = 0
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for part, pos, conv, turn, copies, initial, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (part, conv):
                    if seg is not None:
                        close()
                        held += len(seg.parents)
                        if len(out) >= 2000 or held > 1 << 24:
                            yield batch_out()
                            out.clear()
                            held = 0
                    key, seg = (part, conv), Segment()
                    row = dict(conv_id=conv, pos=pos, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, first_turn=None, last_turn=None, first_initial=initial, last_initial=None)
                if row["last_initial"] is not None:
                    row["illegal"] += row["last_initial"] + initial not in LEGAL
                row["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
                row["last_initial"] = initial
                if turn is not None:
                    row["turns"] += turn != row["last_turn"]
                    row["last_turn"] = turn
                    row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
                if fault:
                    row[("truncated", "blank", "duplicate")[fault - 1]] += 1
                row["blank" if fault == 2 else "duplicate"] += copies - 1
                seg.add(kind, min(fault, 2))
                seg.add(kind, 2, copies - 1)
        if seg is not None:
            close()
            yield batch_out()

    return rows.mapInArrow(run, schema)


def _paths(segments: DataFrame) -> DataFrame:
    """Entry, exit and closing inserts of each segment, and on a conversation's first segment its numbers."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, pos long, entry int, leave int, run int, numbers struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"
    rows = segments.drop("parents").repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def solved(rows: list[dict]) -> list[dict]:
        cost, path, run = joined_path([(r["costs"], r["ranks"]) for r in rows])
        numbers = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
        numbers["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(rows, rows[1:]))
        timed = [r for r in rows if r["turns"]]
        distinct = sum(r["turns"] for r in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
        numbers |= {"gaps": min(gaps, (1 << 63) - 1), "cost": cost}
        last = len(rows) - 1
        return [{"conv_id": r["conv_id"], "pos": r["pos"], "entry": p[0], "leave": p[1], "run": run if i == last else 0, "numbers": None if i else numbers} for i, (r, p) in enumerate(zip(rows, path))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        for batch in batches:
            arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("pos", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("run", pa.int32()),
                               ("numbers", pa.struct([(c, pa.int64()) for c in counts]))])
            out = []
            for r in batch.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    out += solved(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(solved(held), schema=arrow)

    return rows.mapInArrow(run, schema)


def _edits(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, pos, entry, macros (binary), audit, numbers of each segment."""
    rows = segments.select("pos", "parents").join(paths, "pos").select("conv_id", "pos", "entry", "leave", "run", "parents", "numbers")
    kind = segments.schema["conv_id"].dataType.simpleString()
    numbers = paths.schema["numbers"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("entry", "leave", "run", "parents")}
            macros = [read_back(p, e, q) for p, e, q in zip(col["parents"], col["entry"], col["leave"])]
            audits = ["".join(map(MACROS.__getitem__, m)) + "I" * r for m, r in zip(macros, col["run"])]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(macros, pa.binary()), pa.array(audits, pa.string()), batch.column(6)],
                                  names=["conv_id", "pos", "entry", "run", "macros", "audit", "numbers"])

    return rows.mapInArrow(run, f"conv_id {kind}, pos long, entry int, run int, macros binary, audit string, numbers {numbers}")


class Repair:
    """The repair of a table of turns: edits of every segment, from which repaired rows, summaries and digests are made."""

    def __init__(self, turns: DataFrame):
        self.rows, brief = ordered(turns)
        segments = written(_segments(brief), "segments")
        self.edits = written(_edits(segments, _paths(segments)), "edits")

    def repaired(self, whole: bool = False) -> DataFrame:
        """conv_id, segment, place, edit (K, R, I), role, text of the turns that the repaired conversations have, in order of segment and place.

        Rows of a segment are in one task and in order; with ``whole`` those of a conversation are, for what has to read it from front to end."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        null = lambda t: F.lit(None).cast(t)
        texts = self.rows.select("conv_id", "part", "pos", F.lit(1).alias("kind"), null("int").alias("entry"), null("int").alias("run"), null("binary").alias("macros"), "copies", "role", "text")
        heads = self.edits.select("conv_id", F.shiftright("pos", 33).cast("int").alias("part"), "pos", F.lit(0).alias("kind"), "entry", "run", "macros")
        heads = heads.withColumns({"copies": null("long"), "role": null("string"), "text": null("string")})
        key = ["conv_id"] if whole else ["conv_id", "part"]
        rows = heads.unionByName(texts).repartition(*key).sortWithinPartitions("conv_id", "pos", "kind")
        names = {USER: "user", ASSISTANT: "assistant"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, macros, at, end, segment, place = START, b"", 0, 0, 0, 0
            for batch in batches:
                out: list[tuple] = []
                for conv, _, pos, row_kind, entry, last_run, edits, copies, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if row_kind == 0:
                        state, macros, at, end, segment, place = entry, edits, 0, last_run, pos, 0
                        continue
                    made = []
                    for macro in map(MACROS.__getitem__, macros[at : at + copies]):
                        for edit in macro:
                            if edit == "D":
                                continue
                            state = SYSTEM if edit == "K" and role.startswith("s") else TURN[state]
                            made.append(("K", role, text) if edit == "K" else (edit, names[state], text if edit == "R" else ""))
                    at += copies
                    for _ in range(end if at == len(macros) else 0):
                        state = TURN[state]
                        made.append(("I", names[state], ""))
                    out += [(conv, segment, place + i, *x) for i, x in enumerate(made)]
                    place += len(made)
                if out:
                    types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "segment", "place", "edit", "role", "text"])

        return rows.mapInArrow(run, f"conv_id {kind}, segment long, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256 (of ``role:text``, joined by line feeds) of the conversations that have turns left."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, digest = None, None
            for batch in batches:
                out = []
                for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                    if digest is not None and key == conv:
                        digest.update(b"\n")
                    else:
                        if digest is not None:
                            out.append((conv, digest.hexdigest()))
                        conv, digest = key, hashlib.sha256()
                    digest.update(f"{role}:{text}".encode())
                conv_type = batch.schema.field("conv_id").type
                yield pa.record_batch([pa.array([x[0] for x in out], conv_type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
            if digest is not None:
                yield pa.record_batch([pa.array([conv], conv_type), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        return self.repaired(whole=True).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")

    def summaries(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has a row."""
        pieces = F.array_sort(F.collect_list(F.struct("pos", "audit")))
        audit = F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit")
        return self.edits.groupBy("conv_id").agg(F.first("numbers", ignorenulls=True).alias("numbers"), audit).select("conv_id", "numbers.*", "audit")


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Summary and digest of the repair of ``turns`` for every conv_id of ``conversations``; zeros and empty strings where no row is left."""
    work = Repair(turns)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = work.summaries().join(work.digests().withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return rows.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)
