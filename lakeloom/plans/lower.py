"""From a query description to one Spark plan, in a fixed order.

Joins, filters, subquery membership, vector search, computed columns, pipes, windows, distinct,
aggregation and HAVING, set operations, sort / top-k / limit, projection.  Filters stand right on the
scan, so Catalyst pushes them and the needed columns into the reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lakeloom.errors import QueryError
from lakeloom.operators import relational as R
from lakeloom.operators import vector as V
from lakeloom.plans.descriptor import Query


def need(df: DataFrame, names, what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise QueryError("COLUMN_NOT_FOUND", f"{what}: no column {', '.join(map(repr, missing))}; there are {', '.join(df.columns)}")


def condition(c) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def computed(df: DataFrame, alias: str, value) -> DataFrame:
    """A SQL text, a Column, or a Python function of a row (as a vectorised batch function)."""
    if callable(value) and not isinstance(value, Column):
        return batch_computed(df, alias, value)
    return df.withColumn(alias, condition(value))


_PYTHON_TYPES = {"bool": BooleanType, "int": LongType, "float": DoubleType, "str": StringType}


def batch_computed(df: DataFrame, alias: str, fn) -> DataFrame:
    """Apply ``fn(row: dict)`` in Arrow batches; its return annotation (bool, int, float, str) is the type, string otherwise."""
    import pyarrow as pa

    hint = getattr(fn, "__annotations__", {}).get("return", str)
    kind = _PYTHON_TYPES.get(hint if isinstance(hint, str) else hint.__name__, StringType)()
    kept = df.drop(alias)
    schema = StructType([*kept.schema.fields, StructField(alias, kind)])
    arrow = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}.get(kind.typeName(), pa.string())
    text = kind.typeName() == "string"

    def run(batches):
        for b in batches:
            values = [fn(row) for row in b.to_pylist()]
            if text:
                values = [None if v is None else str(v) for v in values]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, alias])

    return kept.mapInArrow(run, schema)


def lower(q: Query) -> DataFrame:
    df = q.source()
    for j in q.joins:
        df = R.joined(df, _frame(j.right), j)
    need(df, [f.column for f in (*q.filters, *(x for g in q.groups for x in g))], "filter")
    parts = [R.predicate(f) for f in q.filters] + ([R.any_group(q.groups)] if q.groups else []) + [condition(c) for c in q.conditions]
    if parts:
        df = df.where(reduce(lambda a, b: a & b, parts))
    for column, values, negate in q.members:
        need(df, [column], "filter")
        df = R.member(df, column, _frame(values), negate)
    if q.nearest:
        need(df, [q.nearest.column], "vector search")
        df = V.nearest(df, q.nearest.column, q.nearest.vector, q.nearest.k, q.nearest.metric)
    for alias, value in q.computed:
        df = computed(df, alias, value)
    for fn in q.pipes:
        df = fn(df)
    for w in q.windows:
        df = df.withColumn(w.alias, R.window(df, w))
    if q.distinct is not None:
        need(df, q.distinct, "distinct")
        if q.distinct:
            df = df.dropDuplicates(list(q.distinct))
        else:
            shown = [c for c in q.projections if c in df.columns] if q.projections and not q.aggregates else None
            df = (df.select(*[R.quoted(c) for c in shown]) if shown else df).distinct()
    if q.aggregates or q.group_by:
        need(df, [*q.group_by, *(a.column for a in q.aggregates if a.column != "*")], "aggregate")
        df = R.grouped(df, q.group_by, q.aggregates)
        for h in q.having:
            df = df.where(R.predicate(h) if hasattr(h, "op") else condition(h))
    if q.set_ops:
        df = _projected(df, q)
        for op, other in q.set_ops:
            df = R.combined(df, _frame(other), op)
    if q.sort:
        df = df.orderBy(*R.sort_keys(df, q.sort))
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df if q.set_ops else _projected(df, q)


def _projected(df: DataFrame, q: Query) -> DataFrame:
    if q.projections:
        need(df, q.projections, "select")
        extra = [] if q.aggregates or q.group_by or q.distinct is not None else [n for n in (*(a for a, _ in q.computed), *(w.alias for w in q.windows)) if n not in q.projections]
        extra += ["_distance", "_score"] if q.nearest and not q.aggregates else []
        df = df.select(*[R.quoted(c) for c in (*q.projections, *[e for e in extra if e in df.columns and e not in q.projections])])
    if q.drops:
        df = df.drop(*q.drops)
    return df.withColumnsRenamed(dict(q.renames)) if q.renames else df


def _frame(x) -> DataFrame:
    return x if isinstance(x, DataFrame) else x.df
