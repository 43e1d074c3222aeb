"""A fluent query over the fact relation, compiled to a DataFrame plan and to SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import span_length, subject

#: Queryable fields: their column, and their SQL.
FIELDS: dict[str, tuple[Callable[[], Column], str]] = {
    "id": (lambda: F.col("id"), "id"),
    "source": (lambda: F.col("source"), "source"),
    "subject": (subject, "(span_start * 4294967296 + greatest(span_end - span_start, 0))"),
    "predicate": (lambda: F.col("predicate"), "predicate"),
    "object": (lambda: F.col("value_number"), "value_number"),
    "confidence": (lambda: F.col("confidence"), "confidence"),
    "span.start": (lambda: F.col("span_start"), "span_start"),
    "span.end": (lambda: F.col("span_end"), "span_end"),
    "span.length": (span_length, "greatest(span_end - span_start, 0)"),
    "value.type": (lambda: F.col("value_type"), "value_type"),
    "value.number": (lambda: F.col("value_number"), "value_number"),
    "value.float": (lambda: F.col("value_float"), "value_float"),
    "value.text": (lambda: F.col("value_text"), "value_text"),
    "value.atom": (lambda: F.col("value_atom"), "value_atom"),
    "generation": (lambda: F.col("generation"), "generation"),
    "timestamp": (lambda: F.col("ingest_ts"), "ingest_ts"),
}
COMPARISONS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
#: Aggregates: of a field's column, and in SQL. First and last are by id.
AGGREGATES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "count": (F.count, "count({})"),
    "sum": (F.sum, "sum({})"),
    "avg": (F.avg, "avg({})"),
    "min": (F.min, "min({})"),
    "max": (F.max, "max({})"),
    "first": (lambda c: F.min_by(c, F.col("id")), "arg_min({}, id)"),
    "last": (lambda c: F.max_by(c, F.col("id")), "arg_max({}, id)"),
    "count_distinct": (F.countDistinct, "count(DISTINCT {})"),
}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def column_name(name: str) -> str:
    return name.replace(".", "_")


@dataclass(frozen=True)
class Condition:
    """A condition as a column and as SQL; both are three-valued."""

    column: Callable[[], Column]
    sql: str

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda: self.column() & other.column(), f"({self.sql} AND {other.sql})")

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda: self.column() | other.column(), f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Condition:
        return Condition(lambda: ~self.column(), f"(NOT {self.sql})")


def condition(name: str, op: str, value=None) -> Condition:
    """field op value; op: a comparison, in, not in, between, not between, like, not like, is null, is not null."""
    make, sql = FIELDS[name]
    op = op.lower()
    if op.startswith("not "):
        return ~condition(name, op[4:], value)
    if op in COMPARISONS:
        return Condition(lambda: getattr(make(), COMPARISONS[op])(F.lit(value)), f"({sql} {op} {literal(value)})")
    if op == "in":
        listed = ", ".join(map(literal, value))
        return Condition(lambda: make().isin(list(value)) if value else F.lit(False), f"({sql} IN ({listed}))" if value else "FALSE")
    if op == "between":
        low, high = value
        return Condition(lambda: make().between(low, high), f"({sql} BETWEEN {literal(low)} AND {literal(high)})")
    if op == "like":
        return Condition(lambda: make().like(value), f"({sql} LIKE {literal(value)})")
    if op in ("is null", "is not null"):
        return Condition(lambda: make().isNull() if op == "is null" else make().isNotNull(), f"({sql} {op.upper()})")
    raise ValueError(f"no operator {op}")


@dataclass(frozen=True)
class Selected:
    """A field of the result, or an aggregate of one, under a name."""

    name: str
    aggregate: str | None = None
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or (f"{self.aggregate}_{column_name(self.name)}" if self.aggregate else column_name(self.name))

    def column(self) -> Column:
        c = F.lit(1) if self.name == "*" else FIELDS[self.name][0]()
        return (AGGREGATES[self.aggregate][0](c) if self.aggregate else c).alias(self.label)

    def sql(self) -> str:
        c = "*" if self.name == "*" else FIELDS[self.name][1]
        return f"{AGGREGATES[self.aggregate][1].format(c) if self.aggregate else c} AS {self.label}"


FACT_COLUMNS = ["id", "source", "predicate", "confidence", "span.start", "span.end", "value.number"]


@dataclass
class Query:
    """Filters, grouping, ordering and paging over facts. Methods return the query itself."""

    predicates: list[str] = field(default_factory=list)
    fields: list[Selected] = field(default_factory=list)
    condition: Condition | None = None
    groups: list[str] = field(default_factory=list)
    having_: tuple[str, str, str, object] | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit_: int | None = None
    offset_: int = 0
    one_per_group: bool = False

    def select_all(self) -> Query:
        self.predicates, self.fields = [], []
        return self

    def select(self, *predicates: str) -> Query:
        """Only facts with one of these predicates."""
        self.predicates = list(predicates)
        return self

    def select_fields(self, *fields: Selected | str) -> Query:
        self.fields = [Selected(x) if isinstance(x, str) else x for x in fields]
        return self

    def where(self, name: str, op: str, value=None) -> Query:
        return self._and(condition(name, op, value))

    and_where = where

    def or_where(self, name: str, op: str, value=None) -> Query:
        """Either all conditions so far, or this one; a later where narrows both."""
        new = condition(name, op, value)
        self.condition = new if self.condition is None else self.condition | new
        return self

    def where_not(self, name: str, op: str, value=None) -> Query:
        return self._and(~condition(name, op, value))

    def where_between(self, name: str, low, high) -> Query:
        return self.where(name, "between", (low, high))

    def where_in(self, name: str, values) -> Query:
        return self.where(name, "in", list(values))

    def _and(self, new: Condition) -> Query:
        self.condition = new if self.condition is None else self.condition & new
        return self

    def group_by(self, *names: str) -> Query:
        self.groups += names
        return self

    def first_per_group(self, *names: str) -> Query:
        """The fact with the smallest id of each group."""
        self.groups, self.one_per_group = list(names), True
        return self

    def having(self, aggregate: str, name: str, op: str, value) -> Query:
        self.having_ = (aggregate, name, op, value)
        return self

    def order_by(self, name: str, descending: bool = False) -> Query:
        """By a field or a label of the result; nulls last, equal keys by id."""
        self.order.append((name, descending))
        return self

    def limit(self, n: int) -> Query:
        self.limit_ = n
        return self

    def offset(self, n: int) -> Query:
        self.offset_ = n
        return self

    def _shown(self) -> list[Selected]:
        return self.fields or [Selected(x) for x in FACT_COLUMNS]

    def _condition(self) -> Condition | None:
        parts = ([condition("predicate", "in", self.predicates)] if self.predicates else []) + ([self.condition] if self.condition else [])
        return reduce(Condition.__and__, parts) if parts else None

    def _aggregated(self) -> bool:
        return not self.one_per_group and bool(self.groups or any(x.aggregate for x in self.fields))

    def _keys(self) -> list[tuple[str, bool]]:
        ties = [(g, False) for g in self.groups] if self._aggregated() else [("id", False)]
        named = {n for n, _ in self.order}
        return [*self.order, *(t for t in ties if t[0] not in named)] if self.order or self.limit_ is not None or self.offset_ else []

    def __call__(self, facts: DataFrame) -> DataFrame:
        """The query's plan over a fact relation."""
        where = self._condition()
        df = facts.where(where.column()) if where else facts
        labels = {x.label for x in self._shown()}
        if self._aggregated():
            wanted = [x for x in self._shown() if x.aggregate]
            df = df.groupBy(*[FIELDS[g][0]().alias(column_name(g)) for g in self.groups]).agg(*[x.column() for x in wanted], *self._having_column())
            if self.having_:
                _, _, op, value = self.having_
                df = df.where(getattr(F.col("_having"), COMPARISONS[op])(F.lit(value))).drop("_having")
            key = lambda n: F.col(column_name(n))
        else:
            if self.one_per_group:
                df = df.groupBy(*[FIELDS[g][0]().alias(f"_{i}") for i, g in enumerate(self.groups)]).agg(F.min_by(F.struct("*"), F.col("id")).alias("one")).select("one.*")
            key = lambda n: FIELDS[n][0]() if n in FIELDS else F.col(n)
        keys = [key(n).desc_nulls_last() if down else key(n).asc_nulls_last() for n, down in self._keys()]
        if keys:
            df = df.orderBy(*keys)
        if self.offset_:
            df = df.offset(self.offset_)
        if self.limit_ is not None:
            df = df.limit(self.limit_)
        if self._aggregated():
            return df.select(*[column_name(g) for g in self.groups], *[x.label for x in self._shown() if x.aggregate])
        return df.select(*[x.column() for x in self._shown()])

    def _having_column(self) -> list[Column]:
        if not self.having_:
            return []
        aggregate, name, *_ = self.having_
        return [AGGREGATES[aggregate][0](F.lit(1) if name == "*" else FIELDS[name][0]()).alias("_having")]

    def to_sql(self, relation: str = "facts") -> str:
        """The query as SQL over a relation with the fact columns."""
        where = self._condition()
        if self._aggregated():
            shown = [f"{FIELDS[g][1]} AS {column_name(g)}" for g in self.groups] + [x.sql() for x in self._shown() if x.aggregate]
        else:
            shown = [x.sql() for x in self._shown()]
        if self.one_per_group:
            by = ", ".join(FIELDS[g][1] for g in self.groups)
            inner = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY id) AS _rank FROM {relation}" + (f" WHERE {where.sql}" if where else "")
            relation, where = f"({inner})", Condition(lambda: F.lit(True), "_rank = 1")
        out = f"SELECT {', '.join(shown)} FROM {relation}"
        if where:
            out += f" WHERE {where.sql}"
        if self.groups and self._aggregated():
            out += " GROUP BY " + ", ".join(FIELDS[g][1] for g in self.groups)
        if self.having_:
            aggregate, name, op, value = self.having_
            out += f" HAVING {AGGREGATES[aggregate][1].format('*' if name == '*' else FIELDS[name][1])} {op} {literal(value)}"
        if keys := self._keys():
            name = lambda n: column_name(n) if self._aggregated() else FIELDS[n][1] if n in FIELDS else n
            out += " ORDER BY " + ", ".join(f"{name(n)} {'DESC' if d else 'ASC'} NULLS LAST" for n, d in keys)
        if self.limit_ is not None:
            out += f" LIMIT {self.limit_}"
        if self.offset_:
            out += f" OFFSET {self.offset_}"
        return out


def query_by_predicate(predicate: str) -> Query:
    return Query().select(predicate)


def query_high_confidence(least: float = 0.8) -> Query:
    return Query().where("confidence", ">=", least)


def query_by_span(start: int, end: int) -> Query:
    """Facts inside [start, end)."""
    return Query().where("span.start", ">=", start).where("span.end", "<=", end)


# The share of rows that a comparison is taken to keep.
SELECTIVITY = {"!=": 0.95, "<": 0.5, "<=": 0.5, ">": 0.5, ">=": 0.5, "between": 0.2, "in": 0.1, "not in": 0.9, "like": 0.3, "not like": 0.7, "is null": 0.1, "is not null": 0.9}
EQUAL = {"predicate": 0.05, "id": 0.001, "confidence": 0.3}


def estimate_selectivity(name: str, op: str) -> float:
    """The share of rows that field op value is taken to keep; Catalyst doesn't need it."""
    if op == "=":
        return EQUAL.get(name, 0.1)
    return 1 - SELECTIVITY["between"] if op == "not between" else SELECTIVITY[op]


def estimate_and(parts: list[float]) -> float:
    return reduce(lambda a, b: a * b, parts, 1.0)


def estimate_or(parts: list[float]) -> float:
    return reduce(lambda a, b: a + b - a * b, parts, 0.0)
