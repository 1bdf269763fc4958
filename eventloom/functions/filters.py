"""Property filters: 21 operators on direct columns and JSON properties."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.values import Property


@dataclass(frozen=True)
class Filter:
    """``property operator value``; ``values`` for in, not_in, between, not_between and the multi operators."""

    property: str
    operator: str
    value: str = ""
    values: tuple[str, ...] = ()


def condition(f: Filter) -> Column:
    """A filter as a boolean column, never null.

    Comparisons take a missing number as 0; not_regex, not_in and not_contains_multi hold for missing keys, neq and
    not_contains don't. Dates that can't be read never match."""
    p, v, op = Property(f.property), F.lit(f.value), f.operator
    low, high = (float(x) for x in f.values[:2]) if op in ("between", "not_between") else (0.0, 0.0)
    number = F.lit(float(f.value)) if op in ("gt", "lt", "gte", "lte") else None
    some = reduce(lambda a, b: a | b, [F.contains(p.text, F.lit(x)) for x in f.values], F.lit(False))
    same_day = lambda: F.to_date(p.moment) == F.to_date(F.lit(f.value))
    moment = F.lit(f.value).try_cast("timestamp_ntz")
    tests = {
        "eq": lambda: p.text == v,
        "neq": lambda: p.present & (p.text != v),
        "contains": lambda: F.contains(p.text, v),
        "not_contains": lambda: p.present & ~F.contains(p.text, v),
        "regex": lambda: p.text.rlike(f.value),
        "not_regex": lambda: ~p.text.rlike(f.value),
        "gt": lambda: p.number > number,
        "lt": lambda: p.number < number,
        "gte": lambda: p.number >= number,
        "lte": lambda: p.number <= number,
        "between": lambda: (p.number >= low) & (p.number <= high),
        "not_between": lambda: (p.number < low) | (p.number > high),
        "is_date_before": lambda: p.moment < moment,
        "is_date_after": lambda: p.moment > moment,
        "is_date_exact": same_day,
        "in": lambda: p.text.isin(*f.values) if f.values else F.lit(False),
        "not_in": lambda: ~p.text.isin(*f.values) if f.values else F.lit(True),
        "contains_multi": lambda: some,
        "not_contains_multi": lambda: ~some,
        "is_set": lambda: p.text != "",
        "is_not_set": lambda: p.text == "",
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op}; known are {', '.join(tests)}")
    return F.coalesce(tests[op](), F.lit(False))


OPERATORS = "eq neq contains not_contains regex not_regex gt lt gte lte between not_between is_date_before is_date_after is_date_exact in not_in contains_multi not_contains_multi is_set is_not_set".split()


def all_of(conditions) -> Column:
    """Conjunction; none give true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    """Disjunction; none give false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(names, filters=()) -> Column:
    """Events with one of the names (any event if there are none) that pass all filters."""
    return all_of([*([F.col("event_name").isin(*names)] if names else []), *map(condition, filters)])
