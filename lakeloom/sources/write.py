"""Writers for formats that this Spark has none for: Arrow, Avro and XLSX files, Delta and Iceberg tables.

Each partition becomes the bytes of one file on its executor; the driver passes one file at a time on to
Spark's file system, so it holds no more than the largest partition.  Table metadata is written last, so
a reader sees a whole table or none.
"""

from __future__ import annotations

import io
import json
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.errors import QueryError
from lakeloom.sources.read import filesystem


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file; an existing one is an error."""
    fs, p = filesystem(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def _files(df: DataFrame, encode: Callable[[pa.Table], bytes]) -> DataFrame:
    """One row ``content`` for each partition that has rows."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode(pa.Table.from_batches(held))], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


def _write_files(df: DataFrame, path: str, ending: str, encode, empty: Callable[[], bytes]) -> list[tuple[str, int]]:
    written = []
    for i, row in enumerate(_files(df, encode).toLocalIterator()):
        name = f"part-{i:05d}-{uuid.uuid4().hex}.{ending}"
        write_bytes(df.sparkSession, f"{path}/{name}", bytes(row.content))
        written.append((name, len(row.content)))
    if not written:
        write_bytes(df.sparkSession, f"{path}/part-00000-{uuid.uuid4().hex}.{ending}", empty())
    return written


# -- Arrow -----------------------------------------------------------------------------------------


def arrow_bytes(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def write_arrow(df: DataFrame, path: str) -> None:
    """A folder of Arrow files, one a partition; an empty table is one file without rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    _write_files(df, path, "arrow", arrow_bytes, lambda: arrow_bytes(to_arrow_schema(df.schema).empty_table()))


# -- Avro ------------------------------------------------------------------------------------------


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def avro_value(schema, v) -> bytes:
    """A value under a schema; of a union the null branch or the other one."""
    import struct

    if isinstance(schema, list):
        at = next(i for i, s in enumerate(schema) if (s == "null") == (v is None))
        return _long(at) + avro_value(schema[at], v)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return avro_value(kind, v)
    match kind:
        case "null":
            return b""
        case "boolean":
            return b"\x01" if v else b"\x00"
        case "int" | "long":
            return _long(int(v))
        case "float":
            return struct.pack("<f", v)
        case "double":
            return struct.pack("<d", v)
        case "bytes" | "string":
            data = v.encode() if isinstance(v, str) else bytes(v)
            return _long(len(data)) + data
        case "array":
            return (_long(len(v)) + b"".join(avro_value(schema["items"], x) for x in v) if v else b"") + b"\x00"
        case "map":
            return (_long(len(v)) + b"".join(avro_value("string", k) + avro_value(schema["values"], x) for k, x in v.items()) if v else b"") + b"\x00"
        case "record":
            return b"".join(avro_value(f["type"], v.get(f["name"])) for f in schema["fields"])
    raise QueryError("INVALID_FORMAT", f"no Avro type {kind}")


def snappy(data: bytes) -> bytes:
    """Snappy block of literals only, and its checksum as Avro wants it."""
    size, n = bytearray(), len(data)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    size.append(n)
    body = b"".join(bytes([61 << 2]) + (len(part) - 1).to_bytes(2, "little") + part for part in (data[at : at + 65536] for at in range(0, len(data), 65536)))
    return bytes(size) + body + zlib.crc32(data).to_bytes(4, "big")


def avro_bytes(schema: dict, rows: list[dict], codec: str = "deflate", meta: dict | None = None) -> bytes:
    """An object container file."""
    sync = uuid.uuid4().bytes
    pack = {"null": lambda b: b, "deflate": lambda b: zlib.compress(b)[2:-4], "snappy": snappy}[codec]
    heads = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()} | (meta or {})
    out = [b"Obj\x01", avro_value({"type": "map", "values": "bytes"}, heads), sync]
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        block = pack(b"".join(avro_value(schema, r) for r in part))
        out += [_long(len(part)), _long(len(block)), block, sync]
    return b"".join(out)


_AVRO = {"boolean": "boolean", "int": "int", "integer": "int", "short": "int", "byte": "int", "long": "long", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes"}


def avro_schema(df: DataFrame) -> dict:
    fields = []
    for f in df.schema.fields:
        kind = _AVRO.get(f.dataType.typeName())
        if kind is None:
            raise QueryError("INVALID_FORMAT", f"column {f.name}: no Avro type for {f.dataType.simpleString()}")
        fields.append({"name": f.name, "type": ["null", kind]})
    return {"type": "record", "name": "row", "fields": fields}


def write_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    """A folder of Avro files of flat records, one a partition; codecs null, deflate and snappy."""
    schema = avro_schema(df)
    _write_files(df, path, "avro", lambda t: avro_bytes(schema, t.to_pylist(), codec), lambda: avro_bytes(schema, [], codec))


# -- XLSX ------------------------------------------------------------------------------------------

#: Rows of a sheet, the header among them (fixed by the format).
SHEET_ROWS = 1_048_576
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def write_xlsx(df: DataFrame, path: str) -> None:
    """One workbook of one sheet, header first; more rows than a sheet holds are an error."""

    def cell(at: int, row: int, v) -> str:
        name = ""
        while at:
            at, rest = divmod(at - 1, 26)
            name = chr(65 + rest) + name
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{name}{row}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{name}{row}"><v>{v!r}</v></c>'
        return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            number = 0
            for row in ([*df.columns],):
                number += 1
                sheet.write(f'<row r="{number}">{"".join(cell(i, number, v) for i, v in enumerate(row, 1))}</row>'.encode())
            for row in df.toLocalIterator():
                number += 1
                if number > SHEET_ROWS:
                    raise QueryError("INVALID_FORMAT", "more rows than a sheet holds")
                sheet.write(f'<row r="{number}">{"".join(cell(i, number, v) for i, v in enumerate(row, 1))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    write_bytes(df.sparkSession, path, out.getvalue())


# -- Delta and Iceberg tables -----------------------------------------------------------------------


def _parquet_files(df: DataFrame, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the Parquet files of a new folder."""
    df.write.mode("error").parquet(path)
    fs, p = filesystem(df.sparkSession, path)
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def write_delta(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Append to a table, or put its rows in place of all others; returns the version."""
    spark, now = df.sparkSession, int(time.time() * 1000)
    fs, p = filesystem(spark, f"{path}/_delta_log")
    versions = sorted(int(s.getPath().getName()[:20]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
    version = versions[-1] + 1 if versions else 0
    actions: list[dict] = []
    if not versions:
        actions += [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": [], "configuration": {}, "createdTime": now}}]
    if overwrite and versions:
        from urllib.parse import quote, unquote

        from lakeloom.sources.foreign import read_delta

        old = [f.rsplit(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1] for f in read_delta(spark, path).inputFiles()]
        actions += [{"remove": {"path": quote(unquote(f)), "deletionTimestamp": now, "dataChange": True}} for f in old]
    folder = f"data-{uuid.uuid4().hex}"
    actions += [{"add": {"path": f"{folder}/{name}", "partitionValues": {}, "size": size, "modificationTime": now, "dataChange": True}} for name, size in _parquet_files(df, f"{path}/{folder}")]
    write_bytes(spark, f"{path}/_delta_log/{version:020d}.json", "\n".join(map(json.dumps, actions)).encode())
    return version


_FILE = {"type": "record", "name": "data_file", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}]}
_ENTRY = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "data_file", "type": _FILE}]}
_MANIFEST = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "partition_spec_id", "type": "int"}, {"name": "content", "type": "int"}, {"name": "added_snapshot_id", "type": "long"}]}


def write_iceberg(df: DataFrame, path: str) -> int:
    """Append a snapshot to a table; returns its id."""
    spark = df.sparkSession
    fs, p = filesystem(spark, f"{path}/metadata")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    versions = sorted(int(n[1:].split(".")[0]) for n in names if n.endswith(".metadata.json"))
    from lakeloom.sources.read import read_bytes

    meta = json.loads(read_bytes(spark, f"{path}/metadata/v{versions[-1]}.metadata.json")) if versions else {"format-version": 2, "table-uuid": str(uuid.uuid4()), "location": path.rstrip("/"), "snapshots": []}
    snapshot = len(meta["snapshots"]) + 1
    folder = f"{path}/data/{uuid.uuid4().hex}"
    files = _parquet_files(df, folder)
    counts = {f"{folder}/{n}": spark.read.parquet(f"{folder}/{n}").count() for n, _ in files}
    entries = [{"status": 1, "snapshot_id": snapshot, "data_file": {"content": 0, "file_path": f"{folder}/{n}", "file_format": "PARQUET", "record_count": counts[f"{folder}/{n}"], "file_size_in_bytes": size}} for n, size in files]
    manifest = f"{path}/metadata/manifest-{uuid.uuid4().hex}.avro"
    data = avro_bytes(_ENTRY, entries)
    write_bytes(spark, manifest, data)
    from lakeloom.sources.foreign import AvroFile

    before = list(AvroFile(read_bytes(spark, meta["snapshots"][-1]["manifest-list"])).rows()) if meta["snapshots"] else []
    listed = f"{path}/metadata/snap-{snapshot}-{uuid.uuid4().hex}.avro"
    write_bytes(spark, listed, avro_bytes(_MANIFEST, [*before, {"manifest_path": manifest, "manifest_length": len(data), "partition_spec_id": 0, "content": 0, "added_snapshot_id": snapshot}]))
    meta["snapshots"].append({"snapshot-id": snapshot, "timestamp-ms": int(time.time() * 1000), "manifest-list": listed, "summary": {"operation": "append"}})
    meta["current-snapshot-id"] = snapshot
    version = versions[-1] + 1 if versions else 1
    write_bytes(spark, f"{path}/metadata/v{version}.metadata.json", json.dumps(meta).encode())
    return snapshot
