"""Versioned tables: Parquet files and one JSON manifest for each version.

A commit creates the next manifest without overwriting, so of two writers one fails and starts again
from what the other wrote.  A manifest counts once it can be read whole; one that its writer left
unfinished is removed after ``STALE`` seconds, and a writer looks whether its own is there before it
reports a commit.  Readers take the file list of one manifest and never see half a commit.

Columns have numbers.  Each fragment says which numbers it holds and under which names, so a null stays
null, a column added later has its default in older files, and one dropped and added again starts anew.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.errors import QueryError
from lakeloom.sources.read import filesystem, read_bytes

RETRIES, STALE = 50, 30


class Overtaken(Exception):
    """What a commit was based on is no longer there."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests
    def _files_of_manifests(self) -> dict[int, int]:
        """Number and time of change, in milliseconds, of each manifest file, finished or not."""
        fs, p = filesystem(self.spark, f"{self.path}/_manifests")
        if not fs.exists(p):
            return {}
        return {int(m[1]): s.getModificationTime() for s in fs.listStatus(p) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))}

    def _read(self, version: int) -> dict | None:
        """A manifest; None while it is not whole."""
        try:
            return json.loads(read_bytes(self.spark, f"{self.path}/_manifests/{version}.json"))
        except ValueError:
            return None
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise

    def numbers(self) -> list[int]:
        """Finished versions; only the last file can be unfinished."""
        found = sorted(self._files_of_manifests())
        while found and self._read(found[-1]) is None:
            found.pop()
        return found

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        found = self._read(version) if version in self._files_of_manifests() else None
        if found is None:
            raise QueryError("TABLE_NOT_FOUND", f"no version {version} of {self.path}")
        return found

    def _commit(self, make) -> int:
        """``make(previous manifest or None)`` gives the next one; asked again while other writers are faster."""
        for _ in range(RETRIES):
            there = self._files_of_manifests()
            last = max(there, default=0)
            old = self._read(last) if last else None
            if last and old is None:  # another writer is at it, or left it
                if time.time() * 1000 - there[last] > STALE * 1000:
                    fs, target = filesystem(self.spark, f"{self.path}/_manifests/{last}.json")
                    fs.delete(target, False)
                time.sleep(0.1)
                continue
            own = uuid.uuid4().hex
            body = make(old) | {"version": last + 1, "timestamp": int(time.time() * 1000), "commit": own}
            fs, target = filesystem(self.spark, f"{self.path}/_manifests/{last + 1}.json")
            fs.mkdirs(target.getParent())
            try:
                out = fs.create(target, False)
            except Exception:  # another writer has this number
                if not fs.exists(target):
                    raise
                time.sleep(0.05)
                continue
            out.write(bytearray(json.dumps(body).encode()))
            out.close()
            if (self._read(last + 1) or {}).get("commit") == own:
                return last + 1
        raise QueryError("QUERY_FAILED", f"{RETRIES} commits were overtaken")

    @staticmethod
    def _number(field: dict) -> str:
        return str(field["metadata"]["number"])

    @staticmethod
    def _numbered(field: dict, number: int) -> dict:
        return field | {"nullable": True, "metadata": {"number": number}}

    # -- writing
    def append(self, df: DataFrame, partition_by: str | None = None, metadata: dict | None = None) -> int:
        """Add rows as new files and a new version; an empty frame makes no version.  Returns the version."""
        name = f"data-{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        files = self._files(name)
        rows = self.spark.read.parquet(f"{self.path}/{name}").count() if files else 0
        if not rows:
            return self.latest()
        fragment = {"name": name, "files": files, "rows": rows, "partition_by": partition_by}
        written = json.loads(df.schema.json())["fields"]

        def make(old):
            old = old or {}
            fields, top = list(old.get("schema", {}).get("fields", [])), old.get("columns_made", 0)
            known = {f["name"]: f for f in fields}
            for f in written:
                if f["name"] not in known:
                    known[f["name"]] = self._numbered(f, top)
                    fields.append(known[f["name"]])
                    top += 1
                elif known[f["name"]]["type"] != f["type"]:
                    raise QueryError("SCHEMA_MISMATCH", f"column {f['name']} was {known[f['name']]['type']}")
            held = {self._number(known[f["name"]]): f["name"] for f in written}
            return {"operation": "INSERT", "schema": {"type": "struct", "fields": fields}, "columns_made": top, "defaults": old.get("defaults", {}), "fragments": [*old.get("fragments", []), fragment | {"columns": held}], "metadata": metadata or {}}

        return self._commit(make)

    def delete_fragments(self, names: list[str]) -> int:
        """A version without some fragments."""
        return self._commit(lambda old: old | {"operation": "DELETE", "fragments": [f for f in old["fragments"] if f["name"] not in names]})

    def compact(self) -> int:
        """The same rows in one new fragment; fragments that others add meanwhile stay beside it.

        If others take away a fragment that was read, the work is done again from what they left.
        """
        for _ in range(RETRIES):
            base = self.manifest()
            name = f"data-{uuid.uuid4().hex}"
            df = self._frame(base, None)
            df.write.parquet(f"{self.path}/{name}")
            held = {self._number(f): f["name"] for f in base["schema"]["fields"]}
            fragment = {"name": name, "files": self._files(name), "rows": sum(f["rows"] for f in base["fragments"]), "partition_by": None, "columns": held}
            read = {f["name"] for f in base["fragments"]}

            def make(old):
                if not read <= {f["name"] for f in old["fragments"]}:
                    raise Overtaken
                return old | {"operation": "COMPACT", "fragments": [fragment, *[f for f in old["fragments"] if f["name"] not in read]]}

            try:
                return self._commit(make)
            except Overtaken:
                fs, p = filesystem(self.spark, f"{self.path}/{name}")
                fs.delete(p, True)
        raise QueryError("QUERY_FAILED", f"{RETRIES} commits were overtaken")

    def add_column(self, name: str, kind: str, default=None) -> dict:
        field = json.loads(self.spark.range(0).select(F.lit(None).cast(kind).alias(name)).schema.json())["fields"][0]

        def make(old):
            if name in [f["name"] for f in old["schema"]["fields"]]:
                raise Overtaken
            made = self._numbered(field, old["columns_made"])
            return old | {"operation": "ADD_COLUMN", "schema": {"type": "struct", "fields": [*old["schema"]["fields"], made]}, "columns_made": old["columns_made"] + 1, "defaults": old.get("defaults", {}) | {self._number(made): default}}

        try:
            self._commit(make)
        except Overtaken:  # it is there already
            pass
        return {"operation": "add_column", "column": name, "columns_after": [f["name"] for f in self.manifest()["schema"]["fields"]]}

    def drop_column(self, name: str) -> dict:
        self._commit(lambda m: m | {"operation": "DROP_COLUMN", "schema": {"type": "struct", "fields": [f for f in m["schema"]["fields"] if f["name"] != name]}})
        return {"operation": "drop_column", "column": name, "columns_after": [f["name"] for f in self.manifest()["schema"]["fields"]]}

    def drop(self) -> dict:
        fs, p = filesystem(self.spark, self.path)
        size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        n = len(self.manifest()["fragments"]) if self.numbers() else 0
        fs.delete(p, True)
        return {"fragments": n, "bytes": size}

    def _files(self, name: str) -> list[str]:
        fs, p = filesystem(self.spark, f"{self.path}/{name}")
        found, it = [], fs.listFiles(p, True)
        base = fs.resolvePath(p).toUri().getPath()
        while it.hasNext():
            f = it.next().getPath()
            if f.getName().endswith(".parquet"):
                found.append(name + fs.resolvePath(f).toUri().getPath()[len(base) :])
        return sorted(found)

    # -- reading
    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version in its schema; columns added later have their default in older files."""
        return self._frame(self.manifest(version), None)

    def _frame(self, m: dict, names: set[str] | None) -> DataFrame:
        schema = StructType.fromJson({"type": "struct", "fields": [f | {"metadata": {}} for f in m["schema"]["fields"]]})
        out = None
        parts: dict[tuple, list[dict]] = {}
        for f in m["fragments"]:
            if names is None or f["name"] in names:  # one scan for all fragments of the same columns; partitioned ones have a folder each
                parts.setdefault((tuple(sorted(f["columns"].items())), f["name"] if f["partition_by"] else None), []).append(f)
        for (held, folder), fragments in parts.items():
            here = dict(held)
            types = {here[self._number(f)]: f for f in m["schema"]["fields"] if self._number(f) in here}
            physical = StructType.fromJson({"type": "struct", "fields": [f | {"name": n, "metadata": {}} for n, f in types.items()]})
            reader = self.spark.read.schema(physical)
            reader = reader.option("basePath", f"{self.path}/{folder}") if folder else reader
            df = reader.parquet(*[f"{self.path}/{x}" for f in fragments for x in f["files"]])
            columns = []
            for f, kind in zip(m["schema"]["fields"], schema.fields):
                number = self._number(f)
                value = F.col(f"`{here[number]}`") if number in here else F.lit(m.get("defaults", {}).get(number)).cast(kind.dataType)
                columns.append(value.alias(f["name"]))
            out = df.select(*columns) if out is None else out.unionByName(df.select(*columns))
        return self.spark.createDataFrame([], schema) if out is None else out

    def versions(self) -> list[dict]:
        out = []
        for n in self.numbers():
            m = self.manifest(n)
            out.append({"version": n, "timestamp": m["timestamp"], "operation": m["operation"], "rows": sum(f["rows"] for f in m["fragments"]), "fragments": len(m["fragments"])})
        return out

    def history(self, limit: int | None = None) -> DataFrame:
        """Newest version first, with the change in rows."""
        v = self.versions()
        rows = [(x["version"], x["timestamp"], x["operation"], x["rows"], x["fragments"], x["rows"] - (v[i - 1]["rows"] if i else 0)) for i, x in enumerate(v)][::-1]
        return self.spark.createDataFrame(rows[:limit], "version long, timestamp long, operation string, rows long, fragments long, delta long")

    def diff(self, a: int, b: int) -> dict:
        """Fragments and rows added and removed from version a to b."""
        x, y = ({f["name"]: f for f in self.manifest(v)["fragments"]} for v in (a, b))
        added, removed = [y[n] for n in y if n not in x], [x[n] for n in x if n not in y]
        return {"added_fragments": len(added), "removed_fragments": len(removed), "added_rows": sum(f["rows"] for f in added), "removed_rows": sum(f["rows"] for f in removed)}

    def last_change(self) -> dict:
        """The newest version: number, time, operation and change in rows."""
        return self.history(1).first().asDict()

    def row_diff(self, a: int, b: int) -> DataFrame:
        """Rows of version b and not a as ADD, of a and not b as DELETE; only fragments that differ are read."""
        ma, mb = self.manifest(a), self.manifest(b)
        na, nb = ({f["name"] for f in m["fragments"]} for m in (ma, mb))
        old = self._frame(ma | {"schema": mb["schema"], "defaults": mb.get("defaults", {})}, na - nb)
        new = self._frame(mb, nb - na)
        return new.exceptAll(old).withColumn("change", F.lit("ADD")).union(old.exceptAll(new).withColumn("change", F.lit("DELETE")))


def version_number(t: VersionedTable, text: str) -> int:
    """``n``, ``-n`` and ``HEAD~n`` (before the latest), ``HEAD``, ``CURRENT``."""
    text = text.upper()
    if text in ("HEAD", "CURRENT"):
        return t.latest()
    if text.startswith("HEAD~"):
        return t.latest() - int(text[5:])
    return int(text) if int(text) >= 0 else t.latest() + int(text)
