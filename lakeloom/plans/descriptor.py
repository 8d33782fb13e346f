"""The flat, immutable description of a query that the builder accumulates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from lakeloom.errors import QueryError

FILTER_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "between", "not_between", "like", "not_like", "is_null", "is_not_null")
AGGREGATES = ("sum", "avg", "min", "max", "count", "count_distinct", "stddev", "variance", "stddev_samp", "stddev_pop", "var_samp", "var_pop", "median", "percentile", "first", "last", "array_agg", "string_agg")
WINDOW_FUNCTIONS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value", "sum", "avg", "min", "max", "count")
JOINS = ("inner", "left", "right", "full", "cross", "semi", "anti")
SET_OPS = ("union", "union_all", "intersect", "except")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in FILTER_OPS:
            raise QueryError("INVALID_FILTER", f"no filter operator {self.op!r}")
        if self.op in ("between", "not_between") and (not isinstance(self.value, (tuple, list)) or len(self.value) != 2):
            raise QueryError("INVALID_FILTER", f"{self.op} takes two bounds")


@dataclass(frozen=True)
class Aggregate:
    fn: str
    column: str = "*"
    alias: str | None = None
    fraction: float = 0.5
    #: column that says which row is the first or the last
    order: str | None = None

    def __post_init__(self):
        if self.fn not in AGGREGATES or (self.column == "*" and self.fn != "count"):
            raise QueryError("INVALID_AGGREGATE", f"no aggregate {self.fn}({self.column})")
        if not 0 <= self.fraction <= 1:
            raise QueryError("INVALID_AGGREGATE", "a percentile lies between 0 and 1")

    @property
    def name(self) -> str:
        return self.alias or f"{self.fn}_{self.column}"


@dataclass(frozen=True)
class WindowSpec:
    fn: str
    alias: str
    column: str | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    #: ("rows" or "range", first, last); None in place of a bound: unbounded
    frame: tuple[str, int | None, int | None] | None = None
    offset: int = 1
    default: Any = None

    def __post_init__(self):
        if self.fn not in WINDOW_FUNCTIONS:
            raise QueryError("INVALID_AGGREGATE", f"no window function {self.fn!r}")


@dataclass(frozen=True)
class Join:
    right: Any
    left_key: str | None
    right_key: str | None
    how: str = "inner"

    def __post_init__(self):
        if self.how not in JOINS:
            raise QueryError("INVALID_FILTER", f"no join {self.how!r}")
        if self.how != "cross" and not (self.left_key and self.right_key):
            raise QueryError("INVALID_FILTER", "a join needs both keys")


@dataclass(frozen=True)
class Nearest:
    column: str
    vector: tuple[float, ...]
    k: int = 10
    metric: str = "cosine"


@dataclass(frozen=True)
class Query:
    """One query block.  The order of builder calls does not matter: ``lower`` applies the parts in a fixed order."""

    source: Callable[[], Any] | None = None
    name: str = "table"
    version: int | None = None
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    #: OR of AND groups, besides ``filters``
    groups: tuple[tuple[Filter, ...], ...] = ()
    conditions: tuple[Any, ...] = ()
    members: tuple[tuple[str, Any, bool], ...] = ()
    nearest: Nearest | None = None
    computed: tuple[tuple[str, Any], ...] = ()
    pipes: tuple[Callable, ...] = ()
    windows: tuple[WindowSpec, ...] = ()
    #: None: off; empty: all columns
    distinct: tuple[str, ...] | None = None
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    having: tuple[Any, ...] = ()
    set_ops: tuple[tuple[str, Any], ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    offset: int = 0
    limit: int | None = None
    projections: tuple[str, ...] = ()
    drops: tuple[str, ...] = ()
    renames: tuple[tuple[str, str], ...] = ()
    calls: tuple[tuple[str, tuple, tuple], ...] = field(default=(), compare=False)

    def with_(self, **changes) -> "Query":
        return replace(self, **changes)


def columns(names: Iterable[str] | str) -> tuple[str, ...]:
    return (names,) if isinstance(names, str) else tuple(names)


#: Names under which a JSON description may give a part.
_ALIASES = {"select": "projections", "orderBy": "sort", "order_by": "sort", "groupBy": "group_by", "filterGroups": "groups", "where": "filters"}


def from_json(text: str | dict) -> dict[str, Any]:
    """Checked parts of a query given as JSON: filters, groups, projections, sort, limit, offset, group_by, aggregates, windows, distinct, version."""
    raw = json.loads(text) if isinstance(text, str) else dict(text)
    raw = {_ALIASES.get(k, k): v for k, v in raw.items()}
    known = {f.name for f in fields(Query)} - {"source", "joins", "members", "pipes", "conditions", "calls", "computed", "set_ops", "nearest", "having"}
    extra = set(raw) - known - {"table"}
    if extra:
        raise QueryError("INVALID_FILTER", f"unknown parts: {', '.join(sorted(extra))}")
    try:
        out: dict[str, Any] = {}
        for key, value in raw.items():
            if key == "table":
                out["name"] = str(value)
            elif key == "filters":
                out[key] = tuple(Filter(**f) for f in value)
            elif key == "groups":
                out[key] = tuple(tuple(Filter(**f) for f in g) for g in value)
            elif key == "aggregates":
                out[key] = tuple(Aggregate(**a) for a in value)
            elif key == "windows":
                out[key] = tuple(WindowSpec(**w) for w in value)
            elif key == "sort":
                out[key] = tuple((s["column"], s.get("direction", "asc")) if isinstance(s, dict) else (s, "asc") for s in ([value] if isinstance(value, (str, dict)) else value))
            elif key in ("limit", "offset", "version"):
                if value is not None and (not isinstance(value, int) or value < 0):
                    raise QueryError("INVALID_FILTER", f"{key} is a number from 0")
                out[key] = value
            else:
                out[key] = columns(value)
        return out
    except (TypeError, KeyError) as e:
        raise QueryError("INVALID_FILTER", f"bad description: {e}") from e
