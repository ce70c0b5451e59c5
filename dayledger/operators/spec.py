"""Declarations of what a profile computes for each column of a table.

A declaration lists slots: what a row adds to a counter, and what the counter's sums say.
A class of one's own with ``column`` and ``slots()`` is a declaration like those here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayledger.functions.text import seconds_between

#: What an output takes from the sums of a slot: rows by value (as variant, text or entity),
#: number of elements, sum of x, largest x, or number, least, mean and largest x.
KINDS = ("variant", "text", "entity", "count", "sum", "max", "measure")


@dataclass(frozen=True)
class Slot:
    """What a row adds: one element, in rows that pass ``when`` (all, if None), with a value to count
    by and a number x; or one for each value of the array ``many``. outputs are (entity, kind).

    Outputs other than rows by value have a row in every group of the profile; values
    listed in known have one, too.
    """

    outputs: tuple[tuple[str | None, str], ...]
    value: Column | None = None
    x: Column | None = None
    when: Column | None = None
    many: Column | None = None
    known: tuple[str, ...] = ()


class Spec(Protocol):
    column: str

    def slots(self) -> list[Slot]: ...


def _items(column: str) -> Column:
    """An array's elements; one null element if there are none."""
    return F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.lit(None).cast("string")))


@dataclass(frozen=True)
class Rows:
    """Number of rows."""

    column: str = "rows"

    def slots(self) -> list[Slot]:
        return [Slot(((None, "count"),))]


@dataclass(frozen=True)
class ValueCounts:
    """Rows by value, null included."""

    column: str

    def slots(self) -> list[Slot]:
        return [Slot(((None, "variant"),), value=F.col(self.column))]


@dataclass(frozen=True)
class TextCounts:
    """Rows by free text, null included."""

    column: str

    def slots(self) -> list[Slot]:
        return [Slot(((None, "text"),), value=F.col(self.column))]


@dataclass(frozen=True)
class TextRows:
    """Rows with a text that isn't empty."""

    column: str

    def slots(self) -> list[Slot]:
        return [Slot((("rows_of_text", "count"),), when=F.char_length(self.column) > 0)]


@dataclass(frozen=True)
class ListStats:
    """Of an array: elements, most elements in a row, rows with elements, rows by element.

    A null or empty array counts as one null element.
    """

    column: str

    def slots(self) -> list[Slot]:
        n = F.array_size(self.column)
        return [Slot((("elements", "sum"), ("elements_per_row", "max")), x=n), Slot((("rows_with_elements", "count"),), when=n > 0), Slot(((None, "variant"),), many=_items(self.column))]


@dataclass(frozen=True)
class NullPattern:
    """Rows by which of several columns are set, all patterns included; names are those of the columns in entities."""

    column: str
    columns: tuple[str, ...]
    names: tuple[str, ...]

    def slots(self) -> list[Slot]:
        mask = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(self.columns)])
        patterns = tuple("_".join(n for i, n in enumerate(self.names) if k >> i & 1) or "is_null" for k in range(1 << len(self.columns)))
        return [Slot(((None, "entity"),), value=F.get(F.array(*map(F.lit, patterns)), mask), known=patterns)]


@dataclass(frozen=True)
class Duration:
    """Seconds from start to end where start <= end, and the number of rows where it is later."""

    column: str
    start: str
    end: str

    def slots(self) -> list[Slot]:
        start, end = F.col(self.start), F.col(self.end)
        return [Slot(((None, "measure"),), x=seconds_between(start, end), when=start <= end), Slot((("null_bc_negative", "count"),), when=start > end)]


@dataclass(frozen=True)
class CountsWith:
    """Value counts, and value counts over rows where another column is set."""

    column: str
    other: str
    is_list: bool = False
    entity: str = "with_end_date"

    def slots(self) -> list[Slot]:
        both, own, set_ = ((None, "variant"),), ((self.entity, "variant"),), F.col(self.other).isNotNull()
        if self.is_list:
            items = _items(self.column)
            return [Slot(both, many=items), Slot(own, many=F.when(set_, items).otherwise(F.slice(items, 1, 0)))]
        return [Slot(both, value=F.col(self.column)), Slot(own, value=F.col(self.column), when=set_)]


@dataclass(frozen=True)
class Dataset:
    """A table to profile: its day, its strata, and the specs of its columns.

    With gather, rows of one day and stratum are brought together before they are counted:
    for tables of very many strata, where a task sees few rows of each. The rows are written once for that.
    made are further columns, from the table's own and under other names; where rows are
    brought together, they are made after it, so they need not be moved.
    """

    specs: tuple[Spec, ...] = field(default=())
    day: str = "day"
    platform: str | None = "platform"
    category: str | None = None
    gather: bool = False
    made: dict[str, Column] = field(default_factory=dict)
