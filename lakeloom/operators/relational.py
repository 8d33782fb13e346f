"""Filters, sort keys, aggregates, windows, joins and set operations as Spark columns and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lakeloom.errors import QueryError
from lakeloom.plans.descriptor import Aggregate, Filter, Join, WindowSpec


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def predicate(f: Filter) -> Column:
    """SQL meaning: a comparison with NULL drops the row, negated ones too."""
    c, v = quoted(f.column), f.value
    match f.op:
        case "eq":
            return c == v
        case "neq":
            return c != v
        case "gt":
            return c > v
        case "gte":
            return c >= v
        case "lt":
            return c < v
        case "lte":
            return c <= v
        case "in":
            return c.isin(list(v)) if v else F.lit(False)
        case "not_in":
            return ~c.isin(list(v)) if v else c.isNotNull()
        case "between":
            return c.between(*v)
        case "not_between":
            return ~c.between(*v)
        case "like":
            return c.like(v)
        case "not_like":
            return ~c.like(v)
        case "is_null":
            return c.isNull()
        case _:
            return c.isNotNull()


def any_group(groups) -> Column:
    """OR over groups of ANDed filters; an empty group holds for every row."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(predicate, g), F.lit(True)) for g in groups])


def sort_keys(df: DataFrame, order) -> list[Column]:
    """Nulls last in both directions, NaN after all numbers and before nulls."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = []
    for name, direction in order:
        if name not in types:
            raise QueryError("COLUMN_NOT_FOUND", f"no column {name!r} to sort by")
        c = quoted(name)
        if direction == "desc" and isinstance(types[name], (DoubleType, FloatType)):
            keys += [c.isNull(), F.isnan(c), c.desc_nulls_last()]
        else:
            keys.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return keys


def aggregate(a: Aggregate) -> Column:
    c = F.lit(1) if a.column == "*" else quoted(a.column)
    over_one = lambda x: F.when(F.count(c) >= 2, x)  # noqa: E731  a spread needs two values
    match a.fn:
        case "count":
            out = F.count(F.lit(1)) if a.column == "*" else F.count(c)
        case "count_distinct":
            out = F.countDistinct(c)
        case "stddev" | "stddev_pop":
            out = over_one(F.stddev_pop(c)) if a.fn == "stddev" else F.stddev_pop(c)
        case "variance" | "var_pop":
            out = over_one(F.var_pop(c)) if a.fn == "variance" else F.var_pop(c)
        case "stddev_samp":
            out = F.stddev_samp(c)
        case "var_samp":
            out = F.var_samp(c)
        case "median":
            out = F.percentile(c, 0.5)
        case "percentile":
            out = F.percentile(c, a.fraction)
        case "array_agg":
            out = F.sort_array(F.collect_list(c))
        case "string_agg":
            out = F.array_join(F.sort_array(F.collect_list(c.cast("string"))), ",")
        case "first" | "last":
            if not a.order:
                raise QueryError("INVALID_AGGREGATE", f"{a.fn} needs an order: rows of a table have none")
            # of equal places the smaller, or larger, value; rows without a place do not count
            pair = F.when(quoted(a.order).isNotNull(), F.struct(quoted(a.order).alias("o"), c.alias("v")))
            out = (F.min if a.fn == "first" else F.max)(pair)["v"]
        case _:
            out = getattr(F, a.fn)(c)
    return out.alias(a.name)


def grouped(df: DataFrame, keys, aggregates) -> DataFrame:
    """Typed keys, a null group of its own, no row for an empty grouped input; keys alone give the distinct keys."""
    names = [quoted(k) for k in keys]
    if not aggregates:
        return df.select(*names).distinct()
    made = [aggregate(a) for a in aggregates]
    return df.groupBy(*names).agg(*made) if names else df.agg(*made)


def window(df: DataFrame, w: WindowSpec) -> Column:
    """With an order the default frame is ROWS up to the current row; without one it is the whole partition."""
    spec = Window.partitionBy(*[quoted(p) for p in w.partition_by]) if w.partition_by else Window.partitionBy(F.lit(0))
    order = sort_keys(df, w.order_by)
    if not order and w.fn in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
        raise QueryError("INVALID_AGGREGATE", f"{w.fn} needs an order")
    spec = spec.orderBy(*order) if order else spec
    name = w.column or (w.order_by[0][0] if w.order_by else None)
    c = quoted(name) if name and name != "*" else F.lit(1)
    match w.fn:
        case "row_number" | "rank" | "dense_rank" | "percent_rank" | "cume_dist":
            return getattr(F, w.fn)().over(spec)
        case "ntile":
            return F.ntile(w.offset).over(spec)
        case "lag" | "lead":
            return getattr(F, w.fn)(c, w.offset, w.default).over(spec)
    low, high = Window.unboundedPreceding, Window.currentRow if order else Window.unboundedFollowing
    kind = "rows"
    if w.frame:
        kind, first, last = w.frame
        low = Window.unboundedPreceding if first is None else first
        high = Window.unboundedFollowing if last is None else last
    framed = spec.rangeBetween(low, high) if kind == "range" else spec.rowsBetween(low, high)
    match w.fn:
        case "first_value":
            return F.first(c).over(framed)
        case "last_value":
            return F.last(c).over(framed)
        case "nth_value":
            return F.nth_value(c, w.offset).over(framed)
        case "count":
            return F.count(c).over(framed)
        case _:
            return getattr(F, w.fn)(c).over(framed)


def joined(left: DataFrame, right: DataFrame, j: Join) -> DataFrame:
    """The right key goes, other right columns that clash become ``right_<name>``; outer joins coalesce the key."""
    if j.how == "cross":
        return left.crossJoin(right.select(*[quoted(c).alias(f"right_{c}" if c in left.columns else c) for c in right.columns]))
    for df, key in ((left, j.left_key), (right, j.right_key)):
        if key not in df.columns:
            raise QueryError("COLUMN_NOT_FOUND", f"no join column {key!r}")
    if j.how in ("semi", "anti"):
        keys = right.select(quoted(j.right_key).alias("__right_key"))
        return left.join(keys, quoted(j.left_key) == F.col("__right_key"), f"left_{j.how}")
    others = [c for c in right.columns if c != j.right_key]
    side = right.select(quoted(j.right_key).alias("__right_key"), *[quoted(c).alias(f"right_{c}" if c in left.columns else c) for c in others])
    out = left.join(side, quoted(j.left_key) == F.col("__right_key"), j.how)
    if j.how in ("right", "full"):
        out = out.withColumn(j.left_key, F.coalesce(quoted(j.left_key), F.col("__right_key")))
    return out.drop("__right_key")


def member(df: DataFrame, column: str, values: DataFrame, negate: bool = False) -> DataFrame:
    """IN or NOT IN a subquery's first column, with SQL's rules for NULL."""
    inner = values.select(values[values.columns[0]].alias("__member"))
    if not negate:
        return df.join(inner, quoted(column) == F.col("__member"), "left_semi")
    nulls = inner.where("__member IS NULL").limit(1)
    kept = df.where(quoted(column).isNotNull()).join(inner, quoted(column) == F.col("__member"), "left_anti")
    return kept.join(nulls, F.lit(True), "left_anti").union(df.where(quoted(column).isNull()).join(inner.limit(1), F.lit(True), "left_anti"))


def combined(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Sides align by name; all but ``union_all`` have set semantics with equal NULLs."""
    if sorted(left.columns) != sorted(right.columns):
        raise QueryError("SCHEMA_MISMATCH", "the sides have different columns")
    right = right.select(*[quoted(c) for c in left.columns])
    match op:
        case "union_all":
            return left.unionByName(right)
        case "union":
            return left.unionByName(right).distinct()
        case "intersect":
            return left.intersect(right)
        case _:
            return left.subtract(right)
