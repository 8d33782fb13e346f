"""Readers: one entry for every format, found by extension or by the first bytes."""

from __future__ import annotations

import csv as _csv
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.errors import QueryError

_readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_extensions = {
    "parquet": "parquet", "pq": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "psv": "csv", "json": "json", "jsonl": "json", "ndjson": "json",
    "arrow": "arrow", "feather": "arrow", "ipc": "arrow", "avro": "avro", "xlsx": "xlsx",
}
_magic = ((b"PAR1", "parquet"), (b"ORC", "orc"), (b"ARROW1", "arrow"), (b"Obj\x01", "avro"), (b"PK\x03\x04", "xlsx"))


def register_reader(kind: str, extensions: list[str], read: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a format of your own."""
    _readers[kind] = read
    _extensions.update(dict.fromkeys(extensions, kind))


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path of a location: anything that Spark itself can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_bytes(spark: SparkSession, path: str, limit: int | None = None) -> bytes:
    """A file (at most ``limit`` bytes of it) on the driver: heads and metadata only."""
    fs, p = filesystem(spark, path)
    size = fs.getFileStatus(p).getLen()
    n = size if limit is None else min(size, limit)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
    finally:
        stream.close()


def first_file(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
    if not names:
        raise QueryError("INVALID_FORMAT", f"{path} is empty")
    return f"{path.rstrip('/')}/{names[0]}"


def detect(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        raise QueryError("TABLE_NOT_FOUND", f"nothing at {path}")
    if fs.getFileStatus(p).isDirectory():
        Path = spark._jvm.org.apache.hadoop.fs.Path
        for name, kind in (("_manifests", "versioned"), ("_delta_log", "delta"), ("metadata", "iceberg")):
            if fs.exists(Path(p, name)):
                return kind
        names = [s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]
        plain = next((n for n in names if "=" not in n), None)
        return _by_name(plain) or "parquet" if plain else "parquet"
    kind = _by_name(path)
    if kind:
        return kind
    head = read_bytes(spark, path, 16)
    kind = next((k for m, k in _magic if head.startswith(m)), None)
    return kind or ("json" if head.lstrip()[:1] in (b"{", b"[") else "csv")


def _by_name(path: str) -> str | None:
    return _extensions.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = detect(spark, path)
    if kind in _readers:
        return _readers[kind](spark, path)
    if kind == "versioned":
        from lakeloom.sources.versions import VersionedTable

        return VersionedTable(spark, path).read()
    from lakeloom.sources import foreign

    readers = {"csv": read_csv, "json": read_json, "arrow": foreign.read_arrow, "avro": foreign.read_avro, "xlsx": foreign.read_xlsx, "delta": foreign.read_delta, "iceberg": foreign.read_iceberg}
    return readers[kind](spark, path) if kind in readers else spark.read.format(kind).load(path)


# -- CSV -------------------------------------------------------------------------------------------


def delimiter(line: str) -> str:
    """Of comma, tab, bar and semicolon the one most frequent outside quotes in the first line."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(",\t|;", key=lambda d: (bare.count(d), -",\t|;".index(d)))


def _clean(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "null", "na"), None).otherwise(t)


def infer(df: DataFrame) -> DataFrame:
    """Types of trimmed text columns from all rows, in one aggregation: only 0/1 and true/false are boolean, then long, double, string."""
    df = df.select(*[_clean(F.col(f"`{c}`")).alias(c) for c in df.columns])
    whole, number = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    tests = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        for name, ok in (("b", F.lower(v).isin("0", "1", "true", "false")), ("i", v.rlike(whole)), ("d", v.rlike(number))):
            tests.append(F.coalesce(F.bool_and(ok), F.lit(False)).alias(f"{name}{i}"))
    if not tests:
        return df
    row = df.agg(*tests).first()
    out = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        kind = "boolean" if row[f"b{i}"] else "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else None
        out.append((v.isin("1", "true", "True", "TRUE") if kind == "boolean" else v.cast(kind) if kind else v).alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, quote: str = '"', has_header: bool = True, skip_rows: int = 0, sep: str | None = None) -> DataFrame:
    """Header line, quoted fields with doubled quotes and line ends, blank lines dropped, types by ``infer``.

    Without a header columns are ``column_0`` and on; ``skip_rows`` lines at the start of each file go first.
    A line with an odd number of quotes means line ends inside fields: only then is a file read by one task.
    """
    lines = spark.read.text(path)
    if skip_rows:
        # only the rows of a file's first split are numbered
        placed = lines.select("value", F.input_file_name().alias("f"), F.input_file_block_start().alias("s"), F.monotonically_increasing_id().alias("i"))
        head = placed.where("s = 0").withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("i"))).where(F.col("n") > skip_rows)
        lines = head.select("value").union(placed.where("s > 0").select("value"))
    first = lines.where("trim(value) <> ''").first()
    if first is None:
        return spark.createDataFrame([], "value string").drop("value")
    sep = sep or delimiter(first.value)
    if skip_rows:
        names = next(_csv.reader([first.value], delimiter=sep, quotechar=quote))
        names = [n.strip() for n in names] if has_header else [f"column_{i}" for i in range(len(names))]
        body = lines.where(F.col("value") != first.value) if has_header else lines
        parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "quote": quote, "escape": quote})
        return infer(body.where("trim(value) <> ''").select(parsed.alias("r")).select("r.*"))
    broken = not lines.where((F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1).isEmpty()
    raw = spark.read.csv(path, multiLine=broken, header=has_header, sep=sep, quote=quote, escape=quote, mode="PERMISSIVE", enforceSchema=False)
    if not has_header:
        raw = raw.toDF(*[f"column_{i}" for i in range(len(raw.columns))])
    return infer(raw.dropna("all") if raw.columns else raw)


def from_csv(spark: SparkSession, text: str) -> DataFrame:
    import csv
    import io

    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return spark.createDataFrame([], "value string").drop("value")
    head, *rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(lines[0])) if any(x.strip() for x in r)]
    rows = [[*r, *[None] * (len(head) - len(r))][: len(head)] for r in rows]
    return infer(spark.createDataFrame(rows, ", ".join(f"`{h.strip()}` string" for h in head)))


# -- JSON ------------------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array or one object a line; broken lines are skipped; nested values become JSON text."""
    head = read_bytes(spark, first_file(spark, path), 4096)
    df = spark.read.json(path, multiLine=head.lstrip()[:1] == b"[", mode="DROPMALFORMED")
    return _flat(df.drop("_corrupt_record"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in df.schema.fields])


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Union of the keys of all rows, missing values null; whole and broken numbers make doubles, other mixtures text."""
    import json

    names = list(dict.fromkeys(k for r in rows for k in r))

    def kind(values) -> str:
        types = {type(v) for v in values if v is not None}
        if types <= {bool} and types:
            return "boolean"
        if types <= {int} and types:
            return "bigint"
        return "double" if types and types <= {int, float} else "string"

    kinds = {n: kind([r.get(n) for r in rows]) for n in names}

    def value(v, k):
        if v is None:
            return None
        if k == "double":
            return float(v)
        return v if k != "string" or isinstance(v, str) else json.dumps(v)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return spark.createDataFrame([tuple(value(r.get(n), kinds[n]) for n in names) for r in rows], schema)


#: The demonstration table is a design of this engine: shipments by port and cargo.
PORTS = ("aden", "bergen", "callao", "dakar", "eilat", "fremantle")
CARGO = ("grain", "steel", "timber", "cotton", "salt")


def demo(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """A small table of n rows, the same each time: id, region, category, amount, created_at.

    Row i follows from x = (i * 7919 + seed * 104729) % 1000003, so any SQL engine can make it too.
    """
    x = F.pmod(F.col("id") * 7919 + F.lit(seed) * 104729, F.lit(1_000_003))
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))
    return spark.range(1, n + 1).select(
        "id",
        pick(PORTS, x).alias("region"),
        pick(CARGO, F.floor(x / 7)).alias("category"),
        (F.pmod(x, F.lit(50_000)) / 100).alias("amount"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.floor(x / 11), F.lit(366)).cast("int")), "yyyy-MM-dd").alias("created_at"),
    )
