"""File to file: select, filter, rename, cast and limit in one plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeloom.frame import Frame, table
from lakeloom.sources.read import detect


def transform(spark: SparkSession, source: str, target: str, select=(), where: str | None = None, rename: dict[str, str] | None = None, cast: dict[str, str] | None = None, limit: int | None = None, fmt: str = "parquet") -> Frame:
    """Read any format, apply the options in this order: filter, cast, limit, select, rename; write ``fmt``."""
    f = table(spark, source)
    if where:
        f = f.filter(where)
    for column, kind in (cast or {}).items():
        f = f.cast(column, kind)
    if limit is not None:
        f = f.limit(limit)
    df = f.df
    if select:
        df = Frame.of(df).select(*select).df
    out = Frame.of(df.withColumnsRenamed(rename or {}), target)
    out.write(target, fmt, **({"header": True} if fmt == "csv" else {}))
    return out


def ingest(spark: SparkSession, source: str, target: str) -> int:
    """Append a file of any readable format to a versioned table; the new version."""
    from lakeloom.sources.read import read_any
    from lakeloom.sources.versions import VersionedTable

    if detect(spark, source) == "versioned" and source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a table is not appended to itself")
    return VersionedTable(spark, target).append(read_any(spark, source))


def restricted(frame: Frame, role: str, rules: dict[str, str]) -> Frame:
    """A frame with the row filter of a role; a role without a rule sees nothing."""
    return frame.filter(rules.get(role, "false"))
