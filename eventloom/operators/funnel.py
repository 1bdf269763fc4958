"""Funnels: ordered, strict and unordered; exclusions, breakdowns, time to convert, sampling.

Events are folded a person at a time: a person's step events are collected into one sorted array and read by higher-order
functions. Other events aren't collected, but in strict mode, where any event can break the order. Persons with more events than
``chunks.MOST_EVENTS`` are cut into chunks of their time, which are folded by many tasks and joined."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import timeutil as T
from eventloom.functions.filters import Filter, any_of, matches
from eventloom.functions.selection import exact_percentiles
from eventloom.functions.values import Property, half_up, history, percent
from eventloom.operators import chunks

UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000}
MOST_WINDOW, MOST_COHORTS = 90 * UNIT_MS["day"], 10


@dataclass(frozen=True)
class Step:
    names: tuple[str, ...]
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Exclusion:
    """An event that spoils the way from one step to another, by the steps' places."""

    name: str
    from_step: int
    to_step: int
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class FunnelSpec:
    steps: tuple[Step, ...]
    date_from: str
    date_to: str
    mode: str = "ordered"
    window: int = 14
    window_unit: str = "day"
    tz: str = "UTC"
    exclusions: tuple[Exclusion, ...] = field(default=())
    breakdown: str = ""
    breakdown_limit: int = 25
    sampling: float = 1.0
    most_events: int = chunks.MOST_EVENTS
    whole_bytes: int = chunks.WHOLE_BYTES

    @property
    def window_ms(self) -> int:
        return self.window * UNIT_MS[self.window_unit]

    def validate(self) -> None:
        if not 2 <= len(self.steps) <= 10:
            raise ValueError("a funnel has 2 to 10 steps")
        if self.sampling == self.sampling and not 0.01 <= self.sampling <= 1:
            raise ValueError("sampling takes 0.01 to 1 of the persons")
        if not 2 <= self.breakdown_limit <= 25:
            raise ValueError("a breakdown shows 2 to 25 values")
        if self.mode not in ("ordered", "strict", "unordered"):
            raise ValueError("mode is ordered, strict or unordered")
        if not 0 < self.window_ms <= MOST_WINDOW:
            raise ValueError("the window is at most 90 days")
        if len(self.exclusions) > 5 or any(not 0 <= x.from_step < x.to_step < len(self.steps) for x in self.exclusions):
            raise ValueError("up to 5 exclusions, each from a step to a later one")
        if self.mode == "unordered" and len({n for s in self.steps for n in s.names}) < sum(len(set(s.names)) for s in self.steps):
            raise ValueError("steps of an unordered funnel don't share events")


def sampled(events: DataFrame, share: float) -> DataFrame:
    """A fixed part of the persons; 1 and more, or no number, is all of them."""
    if share != share or share >= 1:
        return events
    return events.where(F.pmod(F.xxhash64("person_id"), F.lit(100)) < round(100 * share))


def _ordered_move(window: int):
    def move(acc: Column, e: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            hit = F.get(e["m"], i)
            before = F.get(acc, i - 1)
            return F.when((i == 0) & hit, e["ms"]).when((i > 0) & hit & before.isNotNull() & (e["ms"] <= before + window), before).otherwise(v)

        return F.transform(acc, one)

    return move


def _ordered(n: int, window: int) -> Column:
    """For each step the newest window start that reached it, or null; an event moves on by one step at most."""
    start = F.array_repeat(F.lit(None).cast("long"), n)
    return F.aggregate("h", start, _ordered_move(window), lambda acc: F.size(F.filter(acc, lambda x: x.isNotNull())))


def _strict_fold(n: int, window: int):
    """Level reached when every event counts: one that isn't the next step ends the way; a repeated first step begins again."""
    start = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("start"), F.lit(False).alias("done"))

    def move(acc: Column, e: Column) -> Column:
        level, first = acc["level"], F.get(e["m"], F.lit(0))
        restart = first & (level <= 1)
        on = (level > 0) & F.coalesce(F.get(e["m"], level), F.lit(False))
        inside = e["ms"] <= acc["start"] + window
        state = lambda a, b, c: F.struct(a.cast("int").alias("level"), b.alias("start"), c.alias("done"))
        return (
            F.when(acc["done"] | (level >= n), acc)
            .when(on & inside, state(level + 1, acc["start"], F.lit(False)))
            .when(restart, state(F.lit(1), e["ms"], F.lit(False)))
            .when(level == 0, acc)
            .otherwise(state(level, acc["start"], F.lit(True)))
        )

    return start, move


def _strict(n: int, window: int) -> Column:
    return F.aggregate("h", *_strict_fold(n, window), lambda acc: acc["level"])


def _cover(n: int, window: int, after: Column | None = None) -> Column:
    """best: for each step the newest time of it from which all steps follow in the window; most: how many steps do at best.

    One sweep from the newest event on: the next time of every step is known at each. ``after``: those behind the last event."""
    empty = lambda kind: F.array_repeat(F.lit(None).cast(kind), n)
    start = F.struct(F.lit(None).cast("long").alias("at"), F.array_repeat(F.lit(False), n).alias("here"), (empty("long") if after is None else after).alias("next"), empty("long").alias("best"), F.lit(0).alias("most"))

    def move(acc: Column, e: Column) -> Column:
        same = acc["at"].eqNullSafe(e["ms"])
        here = F.zip_with(acc["here"], e["m"], lambda a, b: (same & a) | b)  # steps with an event at this very time
        following = F.zip_with(acc["next"], e["m"], lambda a, b: F.when(b, e["ms"]).otherwise(a))
        found = F.size(F.filter(following, lambda x: x <= e["ms"] + window))
        best = F.zip_with(acc["best"], here, lambda a, b: F.when(a.isNull() & b & (found == n), e["ms"]).otherwise(a))
        new = F.struct(e["ms"].alias("at"), here.alias("here"), following.alias("next"), best.alias("best"), F.greatest(acc["most"], found).alias("most"))
        return F.when(F.exists(e["m"], lambda x: x), new).otherwise(acc)

    return F.aggregate(F.reverse("h"), start, move, lambda acc: F.struct(acc["best"].alias("best"), acc["most"].alias("most")))


def _spoiled(k: int, window: int, anchor: Column | None, before: Column | None = None) -> Column:
    """dirty and clean: whether a person has a way between exclusion k's steps with its event inside, and one without.

    ``x`` of an event says whether it begins such a way, ends one, or is the excluded one. Only what came strictly before counts:
    the last beginning, the last excluded event, and the last beginning before that one are enough for every end. ``before``: these three before the first event."""
    none = F.lit(None).cast("long")
    known = lambda c: (none if before is None else before[c]).alias(c)
    start = F.struct(none.alias("at"), F.lit(False).alias("new_f"), F.lit(False).alias("new_e"), known("f"), known("e"), known("fe"), F.lit(False).alias("dirty"), F.lit(False).alias("clean"))

    def move(s: Column, e: Column) -> Column:
        mark, later = F.get(e["x"], F.lit(k)), e["ms"] > s["at"]
        begins = mark["f"] if anchor is None else mark["f"] & F.coalesce((e["ms"] >= anchor) & (e["ms"] <= anchor + window), F.lit(False))
        last_e = F.when(later & s["new_e"], s["at"]).otherwise(s["e"])
        before_e = F.when(later & s["new_e"], s["f"]).otherwise(s["fe"])
        last_f = F.when(later & s["new_f"], s["at"]).otherwise(s["f"])
        near = lambda f: F.coalesce(f >= e["ms"] - window, F.lit(False))
        clean = s["clean"] | (mark["t"] & near(last_f) & F.coalesce(last_e <= last_f, F.lit(True)))
        stay = F.coalesce(~later, F.lit(False))
        return F.struct(
            e["ms"].alias("at"), ((stay & s["new_f"]) | begins).alias("new_f"), ((stay & s["new_e"]) | mark["e"]).alias("new_e"),
            last_f.alias("f"), last_e.alias("e"), before_e.alias("fe"), (s["dirty"] | (mark["t"] & near(before_e))).alias("dirty"), clean.alias("clean"),
        )

    return F.aggregate("h", start, move, lambda s: F.struct(s["dirty"].alias("dirty"), s["clean"].alias("clean")))


def _is_step(k: int):
    return lambda e: F.get(e["m"], F.lit(k))


def _from(column: str):
    return lambda x: x >= F.col(column)


def _marked(events: DataFrame, spec: FunnelSpec, ways: tuple[Exclusion, ...]) -> DataFrame:
    """Events that a funnel looks at: m (which steps each is), b (the breakdown's value), x (what it is to each exclusion)."""
    rows = sampled(events.where(T.in_range(spec.date_from, spec.date_to, spec.tz)), spec.sampling)
    mark = F.array(*[matches(s.names, s.filters) for s in spec.steps])
    is_step = any_of([matches(s.names, s.filters) for s in spec.steps])
    names = {x for s in spec.steps for x in s.names}
    named = lambda k: F.col("event_name").isin(*spec.steps[k].names)
    out_of_way = [F.struct(named(x.from_step).alias("f"), named(x.to_step).alias("t"), matches((x.name,), x.filters).alias("e")) for x in ways]
    rows = rows.withColumn("m", mark).withColumn("b", Property(spec.breakdown).text if spec.breakdown else F.lit("")).withColumn("x", F.array(*out_of_way) if ways else F.lit(0))
    if spec.mode == "strict":
        able = rows.where(is_step).select("person_id").distinct()
        rows = rows.join(able, "person_id", "left_semi")
    else:
        rows = rows.where(F.col("event_name").isin(*sorted(names | {x.name for x in ways})))
        rows = rows.where(is_step | F.exists("x", lambda x: x["f"] | x["t"] | x["e"])) if ways else rows.where(is_step)
    return rows.select("person_id", "ms", "event_id", "m", "b", "x")


def _any_step(e: Column) -> Column:
    return F.exists(e["m"], lambda x: x)


def _whole(rows: DataFrame, spec: FunnelSpec, ways: tuple[Exclusion, ...]) -> DataFrame:
    """person_id, max_step, t0, t1, ... (each step's times), anchor, first_value: a person's events as one array."""
    n, w = len(spec.steps), spec.window_ms
    out = rows.groupBy("person_id").agg(history("ms", "event_id", "m", "b", *(["x"] if ways else [])).alias("h"))
    if ways and spec.mode != "strict":
        out = out.where(F.exists("h", _any_step))
    times = [F.transform(F.filter("h", _is_step(k)), lambda e: e["ms"]).alias(f"t{k}") for k in range(n)]
    if spec.mode == "unordered":
        out = out.where(F.exists("h", _is_step(0))).select("person_id", "h", *times, _cover(n, w).alias("c"))
        full = F.get(F.filter("c.best", lambda x: x.isNotNull()), F.lit(0))
        out = out.withColumn("max_step", F.col("c.most")).withColumn("anchor", full).drop("c")
        value = F.get(F.transform(F.filter("h", lambda e: (e["ms"] == F.col("anchor")) & _any_step(e)), lambda e: e["b"]), F.lit(0))
    else:
        out = out.select("person_id", "h", *times, (_ordered(n, w) if spec.mode == "ordered" else _strict(n, w)).alias("max_step"), F.lit(None).cast("long").alias("anchor"))
        value = F.try_element_at(F.filter("h", _is_step(0)), F.lit(1 if spec.mode == "ordered" else -1))["b"]
    out = out.withColumn("first_value", F.coalesce(value, F.lit("")))
    for k in range(len(ways)):
        s = _spoiled(k, w, F.col("anchor") if spec.mode == "unordered" else None)
        fine = ~(s["dirty"] & ~s["clean"])
        out = out.where(F.col("anchor").isNull() | fine if spec.mode == "unordered" else fine)
    return out.drop("h")


def _cut(hot: DataFrame, spec: FunnelSpec, ways: tuple[Exclusion, ...]) -> DataFrame:
    """person_id, max_step, anchor, first_value of persons whose events are cut into chunks."""
    n, w = len(spec.steps), spec.window_ms
    steps, order = hot.where(F.exists("m", lambda x: x)), F.struct("ms", "event_id")
    if spec.mode == "unordered":
        out = chunks.covered_steps(hot, n, lambda after: _cover(n, w, after))
        out = out.join(hot.where(F.get("m", F.lit(0))).select("person_id").distinct(), "person_id", "left_semi")
        out = out.select("person_id", F.col("most").alias("max_step"), F.get(F.filter("best", lambda x: x.isNotNull()), F.lit(0)).alias("anchor"))
        at = steps.join(out.select("person_id", "anchor"), "person_id").where(F.col("ms") == F.col("anchor"))
        value = at.groupBy("person_id").agg(F.min_by("b", "event_id").alias("first_value"))
    else:
        found = chunks.ordered_steps(steps, n, w, _ordered_move(w)) if spec.mode == "ordered" else chunks.strict_steps(hot, n, *_strict_fold(n, w))
        out = found.select("person_id", F.col("out").alias("max_step"), F.lit(None).cast("long").alias("anchor"))
        pick = F.min_by if spec.mode == "ordered" else F.max_by
        value = hot.where(F.get("m", F.lit(0))).groupBy("person_id").agg(pick("b", order).alias("first_value"))
    for k in range(len(ways)):
        begins, rows, anchor = F.get("x", F.lit(k))["f"], hot, None
        if spec.mode == "unordered":
            rows, anchor = hot.join(out.select("person_id", "anchor"), "person_id"), F.col("anchor")
            begins = begins & F.coalesce((F.col("ms") >= F.col("anchor")) & (F.col("ms") <= F.col("anchor") + w), F.lit(False))
        spoiled = chunks.spoiled_persons(rows, k, begins, lambda before, k=k, anchor=anchor: _spoiled(k, w, anchor, before))
        out = out.join(spoiled, "person_id", "left_anti")
    return out.join(value, "person_id", "left").withColumn("first_value", F.coalesce("first_value", F.lit("")))


def _people(events: DataFrame, spec: FunnelSpec, exclude: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Persons by ``_whole``; and where some are cut, their events and the persons by ``_cut``."""
    spec.validate()
    ways = spec.exclusions if exclude else ()
    rows, hot = chunks.split(_marked(events, spec, ways), spec.most_events, spec.whole_bytes)
    return _whole(rows, spec, ways), hot, None if hot is None else _cut(hot, spec, ways)


def per_person(events: DataFrame, spec: FunnelSpec, exclude: bool = True) -> DataFrame:
    """person_id, max_step, anchor, first_value: one row a person with a step event.

    With exclusions their events are looked at too, and a person with a spoiled way and no clean one is left out; for them
    steps count by event name alone, and in unordered funnels a way begins at the anchor or after it."""
    whole, _, cut = _people(events, spec, exclude)
    columns = ["person_id", "max_step", "anchor", "first_value"]
    return whole.select(*columns) if cut is None else whole.select(*columns).unionByName(cut.select(*columns))


def step_counts(people: DataFrame, n: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """step (from 1), n_persons, conversion_rate, drop_off, drop_off_rate; a row a step, also without any person."""
    return _steps(_reached(people, n, by), n, by)


def _reached(people: DataFrame, n: int, by: list[str], *more: Column) -> DataFrame:
    """How many persons reached each step (c0, c1, ...), by groups."""
    return people.groupBy(*by).agg(*[F.count_if(F.col("max_step") >= k + 1).alias(f"c{k}") for k in range(n)], *more)


def _steps(sums: DataFrame, n: int, by: list[str]) -> DataFrame:
    rows = sums.select(*by, F.posexplode(F.array(*[f"c{k}" for k in range(n)])).alias("k", "n_persons"), F.col("c0").alias("top"), F.array(*[f"c{k}" for k in range(n)]).alias("all"))
    following = F.get("all", F.col("k") + 1)
    lost = F.when(following.isNull(), F.lit(0)).otherwise(F.col("n_persons") - following).cast("long")
    return rows.select(*by, (F.col("k") + 1).alias("step"), "n_persons", percent(F.col("n_persons"), F.col("top"), 1).alias("conversion_rate"), lost.alias("drop_off"), percent(lost, F.col("n_persons"), 1).alias("drop_off_rate"))


def funnel(events: DataFrame, spec: FunnelSpec) -> DataFrame:
    return step_counts(per_person(events, spec), len(spec.steps))


def funnel_breakdown(events: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Step counts by the value at the first step: the values with most converters, and the empty one always."""
    n = len(spec.steps)
    sums = _reached(per_person(events, spec), n, ["first_value"], F.count("*").alias("n"))
    none, order = F.col("first_value") == "", [F.desc(f"c{n - 1}"), F.desc("n"), "first_value"]
    #: One more than are shown, as the empty value is shown besides them.
    top = sums.orderBy(none.desc(), *order).limit(spec.breakdown_limit + 1)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy(none).orderBy(*order))).where(F.col("place") <= spec.breakdown_limit)
    rows = _steps(top, n, ["first_value"])
    return rows.withColumn("breakdown", F.when(F.col("first_value") == "", "(none)").otherwise(F.col("first_value"))).drop("first_value")


def funnel_by_cohort(events: DataFrame, spec: FunnelSpec, members: DataFrame) -> DataFrame:
    """Step counts by cohort (cohort_id, person_id), all cohorts in one pass."""
    members = members.select("cohort_id", "person_id").distinct()
    if members.select("cohort_id").distinct().limit(MOST_COHORTS + 1).count() > MOST_COHORTS:
        raise ValueError(f"a breakdown shows at most {MOST_COHORTS} cohorts")
    people = per_person(events, spec).join(members, "person_id")
    return step_counts(people, len(spec.steps), ["cohort_id"])


def _least(hot: DataFrame, people: DataFrame, k: int, condition: Column, name: str, best=F.min) -> DataFrame:
    """``people`` with the least time of step k under a condition on it and the people's columns; 0 without one."""
    rows = hot.where(F.get("m", F.lit(k))).select("person_id", "ms").join(people, "person_id").where(condition)
    return people.join(rows.groupBy("person_id").agg(best("ms").alias(name)), "person_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def average_time(events: DataFrame, spec: FunnelSpec) -> DataFrame:
    """avg_seconds and n_converted over persons who did all steps in some time."""
    n, w = len(spec.steps), spec.window_ms
    people, hot, cut = _people(events, spec)
    people = people.where(F.col("max_step") >= n)
    if spec.mode == "unordered":
        inside = [F.array_max(F.filter(f"t{k}", lambda x: (x >= F.col("anchor")) & (x <= F.col("anchor") + w))) for k in range(n)]
        people = people.withColumn("first", F.col("anchor")).withColumn("last", F.greatest(*inside, F.lit(0)))
    else:
        people = people.withColumn("last", F.array_min(f"t{n - 1}"))
        starts = F.filter("t0", lambda a: (a <= F.col("last")) & (F.col("last") <= a + w))
        people = people.withColumn("first", F.coalesce(F.array_max(starts) if spec.mode == "strict" else F.array_min(starts), F.lit(0)))
    people = people.select("first", "last")
    if hot is not None:
        cut = cut.where(F.col("max_step") >= n).select("person_id", "anchor")
        if spec.mode == "unordered":
            rows = hot.where(F.exists("m", lambda x: x)).join(cut, "person_id").where((F.col("ms") >= F.col("anchor")) & (F.col("ms") <= F.col("anchor") + w))
            cut = rows.groupBy("person_id").agg(F.max("anchor").alias("first"), F.max("ms").alias("last"))
        else:
            cut = _least(hot, cut, n - 1, F.lit(True), "last")
            near = (F.col("ms") <= F.col("last")) & (F.col("last") <= F.col("ms") + w)
            cut = _least(hot, cut, 0, near, "first", F.max if spec.mode == "strict" else F.min)
        people = people.unionByName(cut.select("first", "last"))
    timed = people.where("last > first and first > 0")
    return timed.agg(F.avg((F.col("last") - F.col("first")) / 1000.0).alias("avg_seconds"), F.count("*").alias("n_converted"))


def conversion_times(events: DataFrame, spec: FunnelSpec, from_step: int, to_step: int) -> DataFrame:
    """person_id, seconds from one step to a later one."""
    n, w = len(spec.steps), spec.window_ms
    people, hot, cut = _people(events, spec)
    ms, anchor = F.col("ms"), F.col("anchor")
    if spec.mode == "unordered":
        able = (F.col("max_step") >= n) & anchor.isNotNull()
        at = lambda k: F.coalesce(F.array_min(F.filter(f"t{k}", lambda x: (x >= anchor) & (x <= anchor + w))), F.lit(0))
        people = people.where(able).withColumn("a", at(from_step)).withColumn("b", at(to_step))
        if hot is not None:
            near = (ms >= anchor) & (ms <= anchor + w)
            cut = _least(hot, _least(hot, cut.where(able).select("person_id", "anchor"), from_step, near, "a"), to_step, near, "b")
        fine = (F.col("b") >= F.col("a")) & (F.col("a") > 0)
    else:
        people = people.where(F.col("max_step") >= to_step + 1).withColumn("p", F.array_min(f"t{to_step}"))
        people = people.withColumn("s0", F.coalesce(F.array_min(F.filter("t0", lambda a: (a <= F.col("p")) & (F.col("p") - a <= w))), F.lit(0)))
        for k in range(1, to_step + 1):
            people = people.withColumn(f"s{k}", F.coalesce(F.array_min(F.filter(f"t{k}", _from(f"s{k - 1}"))), F.lit(0)))
        if hot is not None:
            cut = _least(hot, cut.where(F.col("max_step") >= to_step + 1).select("person_id"), to_step, F.lit(True), "p")
            cut = _least(hot, cut, 0, (ms <= F.col("p")) & (F.col("p") - ms <= w), "s0")
            for k in range(1, to_step + 1):
                cut = _least(hot, cut, k, ms >= F.col(f"s{k - 1}"), f"s{k}")
            cut = cut.withColumn("a", F.col(f"s{from_step}")).withColumn("b", F.col(f"s{to_step}"))
        people = people.withColumn("a", F.col(f"s{from_step}")).withColumn("b", F.col(f"s{to_step}"))
        fine = F.col("a") > 0
    people = people.select("person_id", "a", "b")
    people = (people if hot is None else people.unionByName(cut.select("person_id", "a", "b"))).where(fine)
    people = people.withColumn("seconds", (F.col("b") - F.col("a")) / 1000.0)
    return people.where((F.col("seconds") >= 0) & (F.col("seconds") <= w / 1000.0)).select("person_id", "seconds")


def time_stats(times: DataFrame) -> DataFrame:
    """n, average and exact median of seconds."""
    return times.agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"))


def selected_time_stats(times: DataFrame) -> DataFrame:
    """As ``time_stats``, with a median that is narrowed down by passes, so that no buffer holds all persons' times."""
    median = exact_percentiles(times, F.col("seconds"), [0.5])[0]
    return times.agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds")).withColumn("median_seconds", F.lit(median).cast("double"))


def time_histogram(times: DataFrame) -> DataFrame:
    """bin, low, n: up to 60 bins of whole seconds' width, about the cube root of the number of persons; one if all are equal."""
    whole = times.agg(F.count("*").alias("n"), F.min("seconds").alias("low"), F.max("seconds").alias("high")).where("n > 0")
    bins = F.least(F.lit(60), F.greatest(F.lit(1), F.ceil(F.round(F.cbrt(F.col("n").cast("double")), 9)))).cast("int")
    whole = whole.withColumn("bins", F.when(F.col("high") == F.col("low"), 1).otherwise(bins))
    whole = whole.withColumn("width", F.greatest(F.lit(1.0), F.ceil((F.col("high") - F.col("low")) / F.col("bins")).cast("double")))
    empty = whole.select("low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    bin_ = F.least(F.floor((F.col("seconds") - F.col("low")) / F.col("width")).cast("int"), F.col("bins") - 1)
    #: One row on the right.
    counts = times.crossJoin(whole.select("low", "width", "bins")).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    joined = empty.join(counts, "bin", "left")
    return joined.select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n_persons"))


def overall_conversion(rows: DataFrame) -> DataFrame:
    """conversion of the last step to the first, over step counts."""
    ends = rows.agg(F.min_by("n_persons", "step").alias("first"), F.max_by("n_persons", "step").alias("last"))
    return ends.select(percent(F.col("last"), F.col("first"), 1).alias("conversion_rate"))


def incomplete(rows: DataFrame, as_of: str, unit: str) -> DataFrame:
    """Flags the period that holds ``as_of`` and later ones as not complete."""
    now = T.label(T.bucket(F.lit(as_of).cast("timestamp_ntz"), unit), unit)
    return rows.withColumn("incomplete", F.col("bucket") >= now)


def truncated(events: DataFrame, spec: FunnelSpec) -> DataFrame:
    """Whether a breakdown has more values than its limit."""
    values = per_person(events, spec).where("first_value <> ''").agg(F.count_distinct("first_value").alias("n"))
    return values.select((F.col("n") > spec.breakdown_limit).alias("breakdown_truncated"))


def aggregate_steps(rows: DataFrame, n: int) -> DataFrame:
    """Step counts over all groups of a breakdown; without any group, n steps of zero."""
    steps = rows.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("step"))
    sums = steps.join(rows.groupBy("step").agg(F.sum("n_persons").alias("n")), "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))
    #: At most ten rows from here on.
    wide = sums.groupBy().agg(*[F.sum(F.when(F.col("step") == k + 1, F.col("n"))).alias(f"c{k}") for k in range(n)])
    return _steps(wide, n, [])
