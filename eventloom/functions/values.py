"""Column helpers: rounding, JSON properties, sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.timeutil import read_time

#: What counts as a plain number in a property.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half up (-2.5 gives -2), as the results' consumers do."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded half up; 0 where the whole is 0."""
    return F.when(whole > 0, half_up(part * 100.0 / whole, digits)).otherwise(0.0)


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, half_up(part.cast("double") / whole, digits)).otherwise(0.0)


class Property:
    """A direct column, or a path in one of the two JSON bags.

    ``text`` is '' where the value is missing or JSON null; numbers and booleans are their JSON text. ``present`` says whether
    the key is there at all (JSON null counts). ``number`` is 0 where the text isn't a plain number."""

    def __init__(self, path: str):
        bag, _, key = path.partition(".")
        self.direct = bag not in ("properties", "user_properties") or not key
        if self.direct:
            self.text, self.present = F.coalesce(F.col(path).cast("string"), F.lit("")), F.lit(True)
        else:
            at = "$." + key
            value = F.try_variant_get(F.try_parse_json(F.col(bag)), at, "variant")
            self.text = F.coalesce(F.try_variant_get(F.try_parse_json(F.col(bag)), at, "string"), F.lit(""))
            self.present = value.isNotNull()

    @property
    def number(self) -> Column:
        return F.when(self.text.rlike(NUMBER), self.text.try_cast("double")).otherwise(0.0)

    @property
    def moment(self) -> Column:
        """Timestamp without zone, in UTC; null where the text names none."""
        return read_time(self.text)


def compact(names: Column) -> Column:
    """Array without repeats of the item before."""
    return F.filter(names, lambda x, i: (i == 0) | (x != F.try_element_at(names, i)))


def history(*fields: str) -> Column:
    """Aggregate: structs of a group's rows, sorted by the fields in turn."""
    return F.array_sort(F.collect_list(F.struct(*fields)))
