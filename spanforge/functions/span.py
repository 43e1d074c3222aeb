"""Half-open integer intervals as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column | int | str) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("bigint")


@dataclass(frozen=True)
class Span:
    """[start, end) of two columns; empty where start is not below end."""

    start: Column
    end: Column

    @staticmethod
    def of(start: Column | int | str, end: Column | int | str) -> Span:
        return Span(_long(start), _long(end))

    @staticmethod
    def point(at: Column | int | str) -> Span:
        return Span(_long(at), _long(at) + 1)

    @staticmethod
    def empty() -> Span:
        return Span.of(0, 0)

    def struct(self) -> Column:
        return F.struct(self.start.alias("start"), self.end.alias("end"))

    def length(self) -> Column:
        return F.greatest(self.end - self.start, _long(0))

    def is_empty(self) -> Column:
        return self.start >= self.end

    def contains(self, at: Column | int | str) -> Column:
        return (_long(at) >= self.start) & (_long(at) < self.end)

    def overlaps(self, other: Span) -> Column:
        return (self.start < other.end) & (other.start < self.end)

    def contains_span(self, other: Span) -> Column:
        return (other.start >= self.start) & (other.end <= self.end)

    def equals(self, other: Span) -> Column:
        return (self.start == other.start) & (self.end == other.end)

    def before(self, other: Span) -> Column:
        return self.end <= other.start

    def after(self, other: Span) -> Column:
        return self.start >= other.end

    def merge(self, other: Span) -> Span:
        """The hull, of disjoint spans too."""
        return Span(F.least(self.start, other.start), F.greatest(self.end, other.end))

    def intersect(self, other: Span) -> Column:
        """The common part as a struct; null if there is none."""
        start, end = F.greatest(self.start, other.start), F.least(self.end, other.end)
        return F.when(start < end, Span(start, end).struct())

    def distance(self, other: Span) -> Column:
        """0 if they overlap or touch, else the gap."""
        return F.greatest(_long(0), other.start - self.end, self.start - other.end)

    def extend(self, at: Column | int | str) -> Span:
        return Span(F.least(self.start, _long(at)), F.greatest(self.end, _long(at) + 1))

    def shrink(self, n: int) -> Span:
        """Both ends moved in; [0, 0) if nothing is left."""
        start, end = self.start + n, self.end - n
        return Span(F.when(start < end, start).otherwise(_long(0)), F.when(start < end, end).otherwise(_long(0)))

    def expand(self, n: int) -> Span:
        return Span(F.greatest(self.start - n, _long(0)), self.end + n)

    def shift(self, by: Column | int | str) -> Span:
        return Span(F.greatest(self.start + _long(by), _long(0)), F.greatest(self.end + _long(by), _long(0)))

    def split(self, at: Column | int | str) -> tuple[Span, Span]:
        """Left and right of a position; one of them is empty if the position is outside."""
        cut = F.greatest(F.least(_long(at), self.end), self.start)
        return Span(self.start, cut), Span(cut, self.end)

    def relative_position(self, at: Column | int | str) -> Column:
        """Where a position lies, 0 to 1; 0 for an empty span."""
        ratio = (_long(at) - self.start) / F.nullif(self.length(), _long(0))
        return F.coalesce(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))

    def clamp(self, at: Column | int | str) -> Column:
        return F.least(F.greatest(_long(at), self.start), self.end)

    def center(self) -> Column:
        return self.start + F.floor(self.length() / 2).cast("bigint")

    def slice(self, text: Column) -> Column:
        """The characters of the span, clamped to the text."""
        return F.substring(text, (F.greatest(self.start, _long(0)) + 1).cast("int"), self.length().cast("int"))

    def pack(self) -> Column:
        """Start in the upper, length in the lower 32 bits; negative from a start of 2^31 on."""
        return F.shiftleft(self.start, 32).bitwiseOR(self.length())

    @staticmethod
    def unpack(packed: Column) -> Span:
        start = F.shiftrightunsigned(packed, 32)
        return Span(start, start + packed.bitwiseAND(F.lit(4294967295)))
