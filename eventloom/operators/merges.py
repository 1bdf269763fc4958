"""Merges of persons in time: identify events as a forest of persons, and who owned what when.

An identify event says that an anonymous id and a user are the same: the person that has the anonymous id at that moment goes into the
person that has the user's id at that moment, with all its ids. If they are one person already, nothing happens. So every person goes
into another at most once, later than all that went into it, and the merges are a forest whose edges get later towards the root. Chains,
circles and repeats come out as in a replay of the events one after another.

Identify events are grouped by connected persons first (stars are contracted round by round, each round written), and each group is replayed
in order of time by the task that has it; other groups don't matter to it. A group's persons have to fit into a task's memory, about a hundred bytes each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.fixtures import scratch
from eventloom.sources.package import ship

#: Pairs of persons up to which all are replayed as one group, which comes out the same and needs no rounds.
ONE_GROUP = 10_000


def _written(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def groups(edges: DataFrame) -> DataFrame:
    """person_id, root: the least of all persons that are connected by edges (a, b). Written."""
    folder, number, before = scratch(edges.sparkSession, "groups"), 0, None
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = _written(pairs, f"{folder}/0")
    while True:
        number += 1
        #: Larger neighbours go to the least of a person's neighbours and itself, then a person and its smaller neighbours to the least of those.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        pairs = _written(small, f"{folder}/{number}")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("person_id"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("person_id"), F.col("b").alias("root")).distinct())


class Forest:
    """Persons of a group, replayed: where each went and when."""

    def __init__(self):
        self.parent: dict[str, tuple] = {}
        self.short: dict[str, str] = {}

    def root(self, person: str) -> str:
        path = []
        while (up := self.short.get(person)) is not None:
            path.append(person)
            person = up
        for p in path:
            self.short[p] = person
        return person

    def merge(self, anonymous: str, user: str, at: tuple) -> bool:
        a, u = self.root(anonymous), self.root(user)
        if a == u:
            return False
        self.parent[a], self.short[a] = (*at, u), u
        return True

    def way(self, person: str) -> list[tuple]:
        """(ms, event_id, person from then on), in order of time."""
        found = []
        while person in self.parent:
            found.append(self.parent[person])
            person = found[-1][2]
        return found


WAYS = "person_id string, into_id string, final_id string, way array<struct<ms:long,event_id:string,person_id:string>>"
_ARROW = pa.schema([("person_id", pa.string()), ("into_id", pa.string()), ("final_id", pa.string()), ("way", pa.list_(pa.struct([("ms", pa.int64()), ("event_id", pa.string()), ("person_id", pa.string())])))])


def merge_ways(moves: DataFrame, one_group: int = ONE_GROUP) -> DataFrame:
    """A row a person that went into another: the person it went into, the one that has its ids in the end, and its way there.

    ``moves``: anonymous and user (persons before any of these moves), ms, event_id."""
    moves = moves.select("anonymous", "user", "ms", F.col("event_id").cast("string").alias("event_id")).where("anonymous <> user")
    #: A pair's first event is the only one that can do anything.
    moves = moves.groupBy("anonymous", "user").agg(F.min(F.struct("ms", "event_id")).alias("at")).select("anonymous", "user", "at.*")
    moves = _written(moves, scratch(moves.sparkSession, "moves"))
    ship(moves.sparkSession)
    n = moves.count()
    if not n:
        return moves.sparkSession.createDataFrame([], WAYS)
    if n <= one_group:
        rows = moves.withColumn("root", F.lit(""))
    else:
        root = groups(moves.select(F.col("anonymous").alias("a"), F.col("user").alias("b")))
        rows = moves.join(root.withColumnRenamed("person_id", "anonymous"), "anonymous")
    rows = rows.select("root", "ms", "event_id", "anonymous", "user")
    rows = rows.repartition("root").sortWithinPartitions("root", "ms", "event_id", "anonymous", "user")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, forest = None, Forest()

        def done() -> list[dict]:
            rows = []
            for person, (_, _, into) in forest.parent.items():
                way = forest.way(person)
                rows.append({"person_id": person, "into_id": into, "final_id": way[-1][2], "way": [dict(zip(("ms", "event_id", "person_id"), x)) for x in way]})
            return rows

        for batch in batches:
            out = []
            for root, ms, event_id, anonymous, user in zip(*(c.to_pylist() for c in batch.columns)):
                if root != group:
                    out += done()
                    group, forest = root, Forest()
                forest.merge(anonymous, user, (ms, event_id))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        yield pa.RecordBatch.from_pylist(done(), schema=_ARROW)

    return rows.mapInArrow(run, WAYS)


def persons_at(events: DataFrame, ways: DataFrame, person: str = "person_id") -> DataFrame:
    """``events`` with each event's person as of its (ms, event_id): merges at or before it count."""
    known = ways.select(F.col("person_id").alias("__from"), F.col("way").alias("__way"))
    at = F.struct(F.col("ms").alias("ms"), F.col("event_id").cast("string").alias("event_id"))
    passed = F.filter("__way", lambda x: F.struct(x["ms"].alias("ms"), x["event_id"].alias("event_id")) <= at)
    now = F.try_element_at(passed, F.lit(-1))["person_id"]
    return events.join(known, F.col(person) == F.col("__from"), "left").withColumn(person, F.coalesce(now, F.col(person))).drop("__from", "__way")


def persons_now(rows: DataFrame, ways: DataFrame, person: str = "person_id") -> DataFrame:
    """``rows`` with the person that has everything of theirs after all merges."""
    known = ways.select(F.col("person_id").alias("__from"), F.col("final_id").alias("__to"))
    return rows.join(known, F.col(person) == F.col("__from"), "left").withColumn(person, F.coalesce("__to", person)).drop("__from", "__to")


def merged_people(people: DataFrame, ways: DataFrame) -> DataFrame:
    """person_id, name, value after merges: a person's own value wins, then that of who went into it first, and so on down the forest.

    Each round takes the persons whose merges are all done into the next; there are as many rounds as the longest way has steps."""
    depth = ways.agg(F.max(F.size("way"))).first()[0] or 0
    order = ways.select(F.col("person_id").alias("__from"), "into_id", F.size("way").alias("steps"), F.get("way", F.lit(0)).alias("at"))
    folder = scratch(people.sparkSession, "people")
    for step in range(depth, 0, -1):
        moving = order.where(F.col("steps") == step)
        rows = people.join(moving, F.col("person_id") == F.col("__from"), "left")
        first = F.struct(F.col("__from").isNotNull().alias("foreign"), F.col("at.ms").alias("ms"), F.col("at.event_id").alias("event_id"))
        rows = rows.select(F.coalesce("into_id", "person_id").alias("person_id"), "name", "value", first.alias("first"))
        people = _written(rows.groupBy("person_id", "name").agg(F.min_by("value", "first").alias("value")), f"{folder}/{step}")
    return people
