"""Formats without a reader in this Spark: Arrow files, Avro, XLSX, and the metadata of Iceberg and Delta tables."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.errors import QueryError
from lakeloom.sources.read import filesystem, first_file, from_rows, read_bytes


def _spread(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Decode whole files on the executors, one file a row."""
    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield from decode(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams; the schema comes from the first file."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def tables(data: bytes):
        source = pa.BufferReader(data)
        reader = pa.ipc.open_file(source) if data[:6] == b"ARROW1" else pa.ipc.open_stream(source)
        return reader.schema, [reader.get_batch(i) for i in range(reader.num_record_batches)] if data[:6] == b"ARROW1" else list(reader)

    schema, _ = tables(read_bytes(spark, first_file(spark, path)))
    return _spread(spark, path, lambda data: tables(data)[1], from_arrow_schema(schema))


# -- Avro ------------------------------------------------------------------------------------------


def unsnap(data: bytes) -> bytes:
    """Snappy block format: the length, then literals and copies."""
    size = shift = at = 0
    while True:
        b = data[at]
        at += 1
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                wide = n - 59
                n = int.from_bytes(data[at : at + wide], "little")
                at += wide
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            wide = 2 if tag & 3 == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + wide], "little")
            at += wide
        if not 0 < back <= len(out):
            raise QueryError("INVALID_FORMAT", "broken Snappy block")
        for _ in range(n):  # a copy may read what it writes
            out.append(out[-back])
    if len(out) != size:
        raise QueryError("INVALID_FORMAT", "broken Snappy block")
    return bytes(out)


class AvroFile:
    """Object container file: codecs null, deflate, snappy and zstandard."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:4] != b"Obj\x01":
            raise QueryError("INVALID_FORMAT", "not an Avro file")
        meta = self._value({"type": "map", "values": "bytes"})
        self.schema = json.loads(meta["avro.schema"])
        self.codec = meta.get("avro.codec", b"null").decode()
        self.sync, self.at = data[self.at : self.at + 16], self.at + 16
        self.names: dict[str, dict] = {}

    def _long(self) -> int:
        shift = value = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def _take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def _value(self, schema):
        if isinstance(schema, list):
            return self._value(schema[self._long()])
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, (dict, list)):
            return self._value(kind)
        match kind:
            case "null":
                return None
            case "boolean":
                return self._take(1) == b"\x01"
            case "int" | "long":
                return self._long()
            case "float":
                return struct.unpack("<f", self._take(4))[0]
            case "double":
                return struct.unpack("<d", self._take(8))[0]
            case "bytes":
                return self._take(self._long())
            case "string":
                return self._take(self._long()).decode()
            case "fixed":
                self.names[schema["name"]] = schema
                return self._take(schema["size"])
            case "enum":
                self.names[schema["name"]] = schema
                return schema["symbols"][self._long()]
            case "record":
                self.names[schema["name"]] = schema
                return {f["name"]: self._value(f["type"]) for f in schema["fields"]}
            case "array" | "map":
                out: list = []
                while n := self._long():
                    if n < 0:
                        self._long()
                        n = -n
                    for _ in range(n):
                        out.append(self._value(schema["items"]) if kind == "array" else (self._value("string"), self._value(schema["values"])))
                return out if kind == "array" else dict(out)
        return self._value(self.names[kind])

    def rows(self):
        data, at = self.data, self.at
        while at < len(data):
            self.data, self.at = data, at
            n, size = self._long(), self._long()
            block, at = data[self.at : self.at + size], self.at + size + 16
            if self.codec == "deflate":
                block = zlib.decompress(block, -15)
            elif self.codec == "snappy":  # four bytes of checksum follow
                block = unsnap(block[:-4])
            elif self.codec == "zstandard":
                import zstandard

                block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
            elif self.codec != "null":
                raise QueryError("INVALID_FORMAT", f"Avro codec {self.codec}")
            self.data, self.at = block, 0
            for _ in range(n):
                yield self._value(self.schema)

    def columns(self) -> list[tuple[str, str]]:
        kinds = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "bytes": "binary", "fixed": "binary", "enum": "string"}

        def kind(t):
            if isinstance(t, list):
                return next((kind(x) for x in t if x != "null"), "string")
            t = t["type"] if isinstance(t, dict) else t
            return kinds.get(t, "string") if isinstance(t, str) else kind(t)

        return [(f["name"], kind(f["type"])) for f in self.schema["fields"]]


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Flat records; nested values become JSON text.  The schema comes from the first file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = AvroFile(read_bytes(spark, first_file(spark, path))).columns()
    schema = ", ".join(f"`{n}` {k}" for n, k in names)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def decode(data: bytes):
        rows = []

        def batch():
            cols = [pa.array([json.dumps(r[f.name]) if isinstance(r[f.name], (dict, list)) else r[f.name] for r in rows], f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        for row in AvroFile(data).rows():
            rows.append(row)
            if len(rows) == 8192:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return _spread(spark, path, decode, schema)


# -- XLSX ------------------------------------------------------------------------------------------


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """First row as header; shared and inline strings, numbers, booleans.  A workbook is read on the driver."""
    book = zipfile.ZipFile(io.BytesIO(read_bytes(spark, path)))
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    rows = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{ns}row"):
        cells: dict[int, object] = {}
        for c in row.iter(f"{ns}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find(f"{ns}v"), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            elif v is not None and v.text is not None:
                number = v.text
                cells[at] = shared[int(number)] if kind == "s" else number == "1" if kind == "b" else number if kind in ("str", "e") else float(number) if re.search("[.eE]", number) else int(number)
        rows.append(cells)
    if not rows:
        raise QueryError("INVALID_FORMAT", "an empty sheet")
    head = {at: str(name) for at, name in rows[0].items()}
    return from_rows(spark, [{name: r.get(at) for at, name in head.items()} for r in rows[1:] if r])


# -- table metadata --------------------------------------------------------------------------------


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Replay the log from its last checkpoint: the Parquet files added and not removed up to a version.

    A log that begins after version 0 without a checkpoint, and deletion vectors, raise.
    """
    from urllib.parse import unquote

    fs, p = filesystem(spark, f"{path}/_delta_log")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    logs = {int(n[:20]): n for n in names if re.fullmatch(r"\d{20}\.json", n)}
    points: dict[int, list[str]] = {}
    for n in names:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.\d{10}\.(\d{10}))?\.parquet", n):
            points.setdefault(int(m[1]), []).append(n)
            if m[2] and int(m[2]) != sum(x.startswith(n[:20] + ".checkpoint.") for x in names):
                points.pop(int(m[1]), None)
    last = version if version is not None else max([*logs, *points], default=-1)
    base = max((v for v in points if v <= last), default=None)
    live: dict[str, dict] = {}
    partitions: list[str] = []

    def replay(action: dict) -> None:
        if add := action.get("add"):
            if add.get("deletionVector"):
                raise QueryError("INVALID_FORMAT", "deletion vectors are not supported")
            live[unquote(add["path"])] = add
        if remove := action.get("remove"):
            live.pop(unquote(remove["path"]), None)
        if meta := action.get("metaData"):
            partitions[:] = meta.get("partitionColumns") or []

    if base is not None:
        point = spark.read.parquet(*[f"{path}/_delta_log/{n}" for n in points[base]])
        wanted = [F.to_json(c).alias(c) for c in ("add", "metaData") if c in point.columns]
        for row in point.select(*wanted).toLocalIterator():
            replay({k: json.loads(v) for k, v in row.asDict().items() if v})
    for v in range(0 if base is None else base + 1, last + 1):
        if v not in logs:
            raise QueryError("INVALID_FORMAT", f"the log has no version {v}")
        for line in read_bytes(spark, f"{path}/_delta_log/{logs[v]}").decode().splitlines():
            if line.strip():
                replay(json.loads(line))
    if not live:
        raise QueryError("INVALID_FORMAT", "the table has no files")
    return spark.read.option("basePath", path).parquet(*[f if re.match(r"\w+:/|/", f) else f"{path}/{f}" for f in live])


def read_iceberg(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """Metadata JSON, manifest list and manifests (Avro) of a snapshot; live data files only.  Delete files raise."""
    fs, p = filesystem(spark, f"{path}/metadata")
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".metadata.json")]
    if not found:
        raise QueryError("INVALID_FORMAT", "no metadata")
    latest = max(found, key=lambda n: [int(x) for x in re.findall(r"\d+", n)[:1]] or [0])
    meta = json.loads(read_bytes(spark, f"{path}/metadata/{latest}"))
    wanted = snapshot if snapshot is not None else meta.get("current-snapshot-id")
    snap = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if snap is None:
        raise QueryError("INVALID_FORMAT", f"no snapshot {wanted}")
    here = lambda f: f.replace(meta["location"].rstrip("/"), path.rstrip("/"), 1)  # noqa: E731  a table may have moved
    files = []
    for manifest in AvroFile(read_bytes(spark, here(snap["manifest-list"]))).rows():
        if manifest.get("content", 0):
            raise QueryError("INVALID_FORMAT", "delete files are not supported")
        for entry in AvroFile(read_bytes(spark, here(manifest["manifest_path"]))).rows():
            if entry.get("status", 0) != 2:
                files.append(here(entry["data_file"]["file_path"]))
    if not files:
        raise QueryError("INVALID_FORMAT", "the snapshot has no files")
    return spark.read.parquet(*files)
