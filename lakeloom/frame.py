"""The lazy, immutable query builder."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.errors import QueryError, translated
from lakeloom.plans.descriptor import Aggregate, Filter, Join, Nearest, Query, WindowSpec, columns, from_json
from lakeloom.plans.lower import lower

_OPS = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
#: Kept results by the hash of their plan: until when, and the frame.
_cached: dict[int, list[tuple[float, DataFrame]]] = {}


def _filter(column: str, op: str, value=None) -> Filter:
    return Filter(column, _OPS.get(op, op), tuple(value) if isinstance(value, (list, set)) else value)


class Frame:
    """Each call returns a new frame; nothing runs before a terminal such as ``collect``.

    Names may be written ``where_between`` or ``whereBetween``.  Calls accumulate one description, so
    their order does not matter: ``limit`` before ``filter`` equals ``filter`` before ``limit``.
    """

    def __init__(self, query: Query):
        self._q = query

    @classmethod
    def of(cls, source: DataFrame | Callable[[], DataFrame], name: str = "table") -> "Frame":
        return cls(Query(source=source if callable(source) else lambda: source, name=name))

    @classmethod
    def described(cls, source: DataFrame, text: str | dict) -> "Frame":
        """A checked JSON description over a source."""
        return cls(Query(source=lambda: source, **from_json(text)))

    def __getattr__(self, name: str):
        snake = re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()
        if name.startswith("_") or snake == name:
            raise AttributeError(name)
        return getattr(self, snake)

    def _with(self, call: str, args: tuple, kwargs: dict | None = None, **changes) -> "Frame":
        return Frame(self._q.with_(calls=(*self._q.calls, (call, args, tuple((kwargs or {}).items()))), **changes))

    def _add(self, call: str, args: tuple, part: str, *values) -> "Frame":
        return self._with(call, args, **{part: (*getattr(self._q, part), *values)})

    # -- filters
    def filter(self, column, op: str | None = None, value=None) -> "Frame":
        """``filter("a", ">", 1)``, a SQL text, or a Column."""
        if op is None:
            return self._add("filter", (column,), "conditions", column)
        return self._add("filter", (column, op, value), "filters", _filter(column, op, value))

    where = filter

    def where_between(self, column: str, low, high) -> "Frame":
        return self._add("where_between", (column, low, high), "filters", Filter(column, "between", (low, high)))

    def where_not_between(self, column: str, low, high) -> "Frame":
        return self._add("where_not_between", (column, low, high), "filters", Filter(column, "not_between", (low, high)))

    def where_like(self, column: str, pattern: str) -> "Frame":
        return self._add("where_like", (column, pattern), "filters", Filter(column, "like", pattern))

    def where_not_like(self, column: str, pattern: str) -> "Frame":
        return self._add("where_not_like", (column, pattern), "filters", Filter(column, "not_like", pattern))

    def where_in(self, column: str, values) -> "Frame":
        return self._add("where_in", (column, list(values)), "filters", Filter(column, "in", tuple(values)))

    def where_not_in(self, column: str, values) -> "Frame":
        return self._add("where_not_in", (column, list(values)), "filters", Filter(column, "not_in", tuple(values)))

    def where_null(self, column: str) -> "Frame":
        return self._add("where_null", (column,), "filters", Filter(column, "is_null"))

    def where_not_null(self, column: str) -> "Frame":
        return self._add("where_not_null", (column,), "filters", Filter(column, "is_not_null"))

    def where_or(self, *groups) -> "Frame":
        """Each group is a list of (column, op, value) that hold together; one group must hold.  Calls add groups."""
        return self._add("where_or", groups, "groups", *[tuple(f if isinstance(f, Filter) else _filter(*f) for f in g) for g in groups])

    def filter_in(self, column: str, values: "Frame | DataFrame", negate: bool = False) -> "Frame":
        return self._add("filter_in", (column, values), "members", (column, values, negate))

    def exists_in(self, other: "Frame | DataFrame", left: str, right: str, negate: bool = False) -> "Frame":
        return self.join(other, {"left": left, "right": right}, "anti" if negate else "semi")

    # -- columns
    def select(self, *names: str) -> "Frame":
        return self._with("select", names, projections=tuple(names))

    def drop(self, *names: str) -> "Frame":
        return self._add("drop", names, "drops", *names)

    def rename(self, names: dict[str, str]) -> "Frame":
        return self._add("rename", (names,), "renames", *names.items())

    def computed(self, alias: str, value) -> "Frame":
        return self._add("computed", (alias, value), "computed", (alias, value))

    with_column = computed

    def fill_null(self, column: str, value) -> "Frame":
        return self._add("fill_null", (column, value), "computed", (column, F.coalesce(F.col(column), F.lit(value))))

    def cast(self, column: str, kind: str) -> "Frame":
        """To number, string, boolean or a Spark type; what cannot be read becomes null."""
        target = {"number": "double", "boolean": "boolean", "string": "string"}.get(kind, kind)
        return self._add("cast", (column, kind), "computed", (column, f"try_cast(`{column}` AS {target})"))

    def add_column(self, name: str, kind: str, default=None) -> "Frame":
        """A constant column; the frame itself where the column is there already."""
        if name in self.df.columns:
            return self
        return self._add("add_column", (name, kind, default), "computed", (name, F.lit(default).cast(kind)))

    def drop_column(self, name: str) -> "Frame":
        return self.drop(name)

    # -- joins, sets
    def join(self, other: "Frame | DataFrame", on: dict | str | None = None, how: str = "inner") -> "Frame":
        keys = on if isinstance(on, dict) else {"left": on, "right": on}
        how = {"outer": "full", "left_semi": "semi", "left_anti": "anti"}.get(how, how)
        return self._add("join", (other, on, how), "joins", Join(other, keys["left"], keys["right"], how))

    def union(self, other) -> "Frame":
        return self._add("union", (other,), "set_ops", ("union", other))

    def union_all(self, other) -> "Frame":
        return self._add("union_all", (other,), "set_ops", ("union_all", other))

    def intersect(self, other) -> "Frame":
        return self._add("intersect", (other,), "set_ops", ("intersect", other))

    def except_(self, other) -> "Frame":
        return self._add("except_", (other,), "set_ops", ("except", other))

    def distinct(self, *names: str) -> "Frame":
        return self._with("distinct", names, distinct=tuple(names))

    # -- aggregation, windows
    def group_by(self, *names: str) -> "Frame":
        return self._with("group_by", names, group_by=tuple(names))

    def aggregate(self, fn: str, column: str = "*", alias: str | None = None, fraction: float = 0.5, order: str | None = None) -> "Frame":
        """``order`` names the column that says which row is ``first`` or ``last``."""
        return self._add("aggregate", (fn, column, alias, fraction, order), "aggregates", Aggregate(fn, column, alias, fraction, order))

    agg = aggregate

    def percentile(self, column: str, p: float = 0.5, alias: str | None = None) -> "Frame":
        return self.aggregate("percentile", column, alias, p)

    def having(self, column, op: str | None = None, value=None) -> "Frame":
        return self._add("having", (column, op, value), "having", column if op is None else _filter(column, op, value))

    def value_counts(self, column: str) -> "Frame":
        return self.group_by(column).aggregate("count", "*", "count").sort("count", "desc").sort(column)

    def grouped(self, *names: str) -> "Grouped":
        """Grouping whose aggregates are methods: ``grouped("a").sum("x", "total").count("n")``."""
        return Grouped(self.group_by(*names))

    def quantile(self, column: str, p: float = 0.5, alias: str | None = None) -> "Frame":
        return self.percentile(column, p, alias)

    def group_by_near(self, column: str, k: int = 20) -> "Frame":
        """Rows grouped by nearness of their vectors to ``k`` centres: ``_cluster`` beside each row."""
        from lakeloom.operators.vector import clustered

        return Frame.of(clustered(self.df, column, k), self._q.name)

    def pivot(self, keys, column: str, values, fn: str, measure: str) -> "Frame":
        """One column for each of the listed values."""
        base = self.df.groupBy(*columns(keys)).pivot(column, list(values)).agg(getattr(F, fn)(measure))
        return Frame.of(base, self._q.name)

    def window(self, fn: str, alias: str, column: str | None = None, partition_by=(), order_by=(), frame=None, offset: int = 1, default=None) -> "Frame":
        order = tuple((o, "asc") if isinstance(o, str) else tuple(o) for o in ((order_by,) if isinstance(order_by, str) else order_by))
        return self._add("window", (fn, alias, column, partition_by, order_by, frame, offset, default), "windows", WindowSpec(fn, alias, column, columns(partition_by), order, frame, offset, default))

    def _ranked(self, fn: str, alias: str, partition_by, order_by, offset: int = 1) -> "Frame":
        return self.window(fn, alias, None, partition_by, order_by, offset=offset)

    def row_number(self, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("row_number", alias, partition_by, order_by)

    def rank(self, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("rank", alias, partition_by, order_by)

    def dense_rank(self, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("dense_rank", alias, partition_by, order_by)

    def percent_rank(self, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("percent_rank", alias, partition_by, order_by)

    def cume_dist(self, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("cume_dist", alias, partition_by, order_by)

    def ntile(self, n: int, alias: str, partition_by=(), order_by=()) -> "Frame":
        return self._ranked("ntile", alias, partition_by, order_by, n)

    def lag(self, column: str, alias: str, partition_by=(), order_by=(), offset: int = 1, default=None) -> "Frame":
        return self.window("lag", alias, column, partition_by, order_by, None, offset, default)

    def lead(self, column: str, alias: str, partition_by=(), order_by=(), offset: int = 1, default=None) -> "Frame":
        return self.window("lead", alias, column, partition_by, order_by, None, offset, default)

    def first_value(self, column: str, alias: str, partition_by=(), order_by=(), frame=None) -> "Frame":
        return self.window("first_value", alias, column, partition_by, order_by, frame)

    def last_value(self, column: str, alias: str, partition_by=(), order_by=(), frame=None) -> "Frame":
        return self.window("last_value", alias, column, partition_by, order_by, frame)

    def nth_value(self, column: str, n: int, alias: str, partition_by=(), order_by=(), frame=None) -> "Frame":
        return self.window("nth_value", alias, column, partition_by, order_by, frame, n)

    def over(self, fn: str, column: str, alias: str, partition_by=(), order_by=(), frame=None) -> "Frame":
        """``sum``, ``avg``, ``min``, ``max`` or ``count`` over a window."""
        return self.window(fn, alias, column, partition_by, order_by, frame)

    # -- order
    def sort(self, column: str, direction: str = "asc") -> "Frame":
        return self._add("sort", (column, direction), "sort", (column, direction))

    order_by = sort

    def limit(self, n: int) -> "Frame":
        return self._with("limit", (_count(n, "limit"),), limit=n)

    def offset(self, n: int) -> "Frame":
        return self._with("offset", (_count(n, "offset"),), offset=n)

    def after(self, value) -> "Frame":
        """Keyset pagination over the first sort column."""
        if not self._q.sort:
            raise QueryError("INVALID_FILTER", "after needs a sort")
        column, direction = self._q.sort[0]
        return self._add("after", (value,), "filters", Filter(column, "lt" if direction == "desc" else "gt", value))

    # -- vectors, pipes, versions
    def vector(self, column: str, query, k: int = 10, metric: str = "cosine", encoder: Callable | None = None) -> "Frame":
        values = encoder(query) if encoder else query
        return self._with("vector", (column, query, k, metric), nearest=Nearest(column, tuple(map(float, values)), k, metric))

    def pipe(self, fn: Callable[[DataFrame], DataFrame]) -> "Frame":
        return self._add("pipe", (fn,), "pipes", fn)

    # -- terminals
    @property
    def df(self) -> DataFrame:
        try:
            return lower(self._q)
        except QueryError:
            raise
        except Exception as e:
            raise translated(e) from e

    def collect(self, on_progress: Callable[[int], None] | None = None) -> list[dict[str, Any]]:
        rows = []
        for row in self.df.toLocalIterator(prefetchPartitions=True) if on_progress else self.df.collect():
            rows.append(row.asDict(recursive=True))
            if on_progress and len(rows) % 4096 == 0:
                on_progress(len(rows))
        if on_progress:
            on_progress(len(rows))
        return rows

    def stream(self, size: int = 4096) -> Iterator[list[dict[str, Any]]]:
        """Batches of rows in bounded memory."""
        batch = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    cursor = stream

    def page(self, offset: int, size: int) -> list[dict[str, Any]]:
        return self.offset(offset).limit(size).collect()

    def lazy(self) -> "Pages":
        """A handle for pages and rows; the result is kept at its first use and computed once."""
        return Pages(self)

    def first(self) -> dict[str, Any] | None:
        return next(iter(self.limit(1).collect()), None)

    def head(self, n: int = 5) -> list[dict[str, Any]]:
        return self.limit(n).collect()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def count(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        df = self.df
        return df.count(), len(df.columns)

    def columns(self) -> list[str]:
        return self.df.columns

    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def describe(self) -> dict[str, dict[str, Any]]:
        df = self.df
        row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}|{c}") for c in df.columns for n, f in (("count", F.count), ("min", F.min), ("max", F.max)) if dict(df.dtypes)[c] not in ("map", "variant")]).first().asDict()
        return {c: {n: row.get(f"{n}|{c}") for n in ("count", "min", "max")} for c in df.columns}

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def explain(self) -> dict[str, Any]:
        """Physical plan text and what reached the reader."""
        plan = self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return {"plan": plan, "pushed_filters": re.findall(r"PushedFilters: \[(.*?)\]", plan), "read_schema": re.findall(r"ReadSchema: (struct<.*?>)\n", plan), "shuffles": len(re.findall(r"^\(\d+\) Exchange", plan, re.M))}

    def sample(self, n: int, seed: int = 0, key: str | None = None) -> "Frame":
        """``n`` rows by a hash of the seed and a key column, or of all values: the same rows each time."""
        source = self.df
        by = F.md5(F.concat(F.lit(f"{seed}|"), F.col(f"`{key}`").cast("string"))) if key else F.xxhash64(F.lit(seed), F.to_json(F.struct(*[F.col(f"`{c}`") for c in source.columns])))
        return Frame.of(source.orderBy(by).limit(n), self._q.name)

    def cache(self, ttl: float | None = None) -> "Frame":
        """Keep the result; with ``ttl`` seconds a query of the same plan over the same source reuses it within them."""
        now, df = time.time(), self.df
        for h in list(_cached):
            for until, kept in [x for x in _cached[h] if x[0] < now or x[1].sparkSession != df.sparkSession]:
                _cached[h].remove((until, kept))
                if kept.sparkSession == df.sparkSession:
                    kept.unpersist()
        same = _cached.setdefault(df.semanticHash(), [])
        found = next((kept for _, kept in same if kept.sameSemantics(df)), None)
        if found is None:
            found = df.cache()
            same.append((now + (ttl if ttl is not None else 1e12), found))
        return Frame.of(found, self._q.name)

    materialize = cache

    def csv_lines(self, delimiter: str = ",") -> DataFrame:
        """One row ``line`` for each row: its values as CSV, made on the executors."""
        import csv
        import io

        import pyarrow as pa

        def run(batches):
            for b in batches:
                lines = []
                for row in zip(*[c.to_pylist() for c in b.columns]):
                    out = io.StringIO()
                    csv.writer(out, delimiter=delimiter, lineterminator="").writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
                    lines.append(out.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

        return self.df.mapInArrow(run, "line string")

    def json_lines(self) -> DataFrame:
        """One row ``line`` for each row: a JSON object, nulls left out."""
        df = self.df
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))

    def to_csv(self, delimiter: str = ",") -> str:
        import csv
        import io

        out = io.StringIO()
        df = self.df
        writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
        return out.getvalue()

    def to_json(self) -> str:
        return "[" + ",".join(self.df.toJSON().toLocalIterator()) + "]"

    def write(self, path: str, fmt: str = "parquet", partition_by=(), mode: str = "error", **options) -> None:
        """A format of Spark's, or ``arrow``, ``avro``, ``xlsx``, ``delta`` or ``iceberg``, which take no mode: files are new, tables grow."""
        if fmt in ("arrow", "avro", "xlsx", "delta", "iceberg"):
            from lakeloom.sources import write as writers

            getattr(writers, f"write_{fmt}")(self.df, path, **options)
            return
        writer = self.df.write.mode(mode).format(fmt).options(**options)
        (writer.partitionBy(*columns(partition_by)) if partition_by else writer).save(path)

    def materialize_as(self, path: str) -> "Frame":
        """Write Parquet and read it back."""
        df = self.df
        df.write.mode("overwrite").parquet(path)
        spark, schema = df.sparkSession, df.schema
        return Frame.of(lambda: spark.read.schema(schema).parquet(path), path)

    def to_code(self) -> str:
        """The builder calls that make this query, as Python text."""
        def text(x):
            return f"<{type(x).__name__}>" if isinstance(x, (Frame, DataFrame, Column)) or callable(x) else repr(x)

        return f"table({self._q.name!r})" + "".join(f".{c}({', '.join([*map(text, a), *[f'{k}={text(v)}' for k, v in kw]])})" for c, a, kw in self._q.calls)


class Grouped:
    """A grouped frame; each method adds an aggregate.  ``frame`` is the result."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def _agg(self, fn: str, column: str, alias: str | None, fraction: float = 0.5) -> "Grouped":
        return Grouped(self.frame.aggregate(fn, column, alias, fraction))

    def count(self, alias: str | None = None, column: str = "*") -> "Grouped":
        return self._agg("count", column, alias)

    def sum(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("sum", column, alias)

    def avg(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("avg", column, alias)

    def min(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("min", column, alias)

    def max(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("max", column, alias)

    def stddev(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("stddev_samp", column, alias)

    def stddev_pop(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("stddev_pop", column, alias)

    def variance(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("var_samp", column, alias)

    def var_pop(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("var_pop", column, alias)

    def median(self, column: str, alias: str | None = None) -> "Grouped":
        return self._agg("median", column, alias)

    def percentile(self, column: str, p: float = 0.5, alias: str | None = None) -> "Grouped":
        return self._agg("percentile", column, alias, p)

    def having(self, column, op: str | None = None, value=None) -> "Grouped":
        return Grouped(self.frame.having(column, op, value))

    @property
    def df(self) -> DataFrame:
        return self.frame.df

    def collect(self) -> list[dict[str, Any]]:
        return self.frame.collect()


class Pages:
    """Pages and rows of a result that is computed once, at the first call."""

    def __init__(self, frame: Frame):
        self._frame, self._kept = frame, None

    def _result(self) -> Frame:
        if self._kept is None:
            self._kept = Frame.of(self._frame.df.persist(), self._frame._q.name)
        return self._kept

    def page(self, offset: int, size: int) -> list[dict[str, Any]]:
        return self._result().page(offset, size)

    def row(self, i: int) -> dict[str, Any] | None:
        return next(iter(self.page(i, 1)), None)

    def stream(self, size: int = 4096) -> Iterator[list[dict[str, Any]]]:
        return self._result().stream(size)

    def close(self) -> None:
        if self._kept is not None:
            self._kept.df.unpersist()
            self._kept = None


def _count(n: int, what: str) -> int:
    if not isinstance(n, int) or n < 0:
        raise QueryError("INVALID_FILTER", f"{what} is a number from 0")
    return n


def table(spark: SparkSession, path: str) -> Frame:
    """Any readable file, directory or versioned table."""
    from lakeloom.sources.read import read_any

    return Frame.of(lambda: read_any(spark, path), path)
