"""SQL entry: Spark SQL over registered tables, and the statements that Spark lacks.

``col NEAR [..] [TOPK k]``, ``FROM 'path'``, ``SHOW VERSIONS FOR t [LIMIT n]``,
``DIFF t VERSION a [AND b] [LIMIT n]``, ``SHOW CHANGES FOR t SINCE VERSION v``,
``CREATE | DROP | SHOW VECTOR INDEX``, ``WITH DATA (name = 'path') SELECT``, ``FROM read_csv('path')`` and
``QUANTILE(x, p)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakeloom.errors import QueryError, translated
from lakeloom.frame import Frame

_NEAR = re.compile(r"\bWHERE\s+(?P<before>.*?\bAND\s+)?(?P<col>[\w.`]+)\s+NEAR\s+\[(?P<vec>[^\]]*)\](?:\s+TOPK\s+(?P<k>\d+))?(?P<after>\s+AND\s+.*?)?(?=\s+(?:GROUP|ORDER|HAVING|LIMIT|OFFSET)\b|\s*;?\s*$)", re.I | re.S)
_FROM_PATH = re.compile(r"\b(FROM|JOIN)\s+'([^']+)'", re.I)
#: Table functions that read a file, and the name that Spark has for a quantile.
_FROM_FILE = re.compile(r"\b(FROM|JOIN)\s+(?:read_\w+|scan_\w+)\s*\(\s*'([^']+)'\s*\)", re.I)
_QUANTILE = re.compile(r"\b(?:QUANTILE|QUANTILE_CONT|PERCENTILE_CONT)\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*,)", re.I)
_FROM = re.compile(r"\bFROM\s+([\w.`]+)", re.I)
_REF = r"(-?\d+|HEAD(?:~\d+)?|CURRENT)"


class Engine:
    """A session, its named tables, versioned tables and vector indexes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indexes: dict[str, dict] = {}
        self.versioned: dict[str, object] = {}
        self.stored: dict[str, object] = {}

    def _index(self, name: str, table: str, column: str, model: str) -> None:
        """``USING ivf`` stores an inverted file, which NEAR on that column then reads; other models are names only."""
        self.indexes[name] = {"name": name, "table": table, "column": column, "model": model, "shadow_column": f"__vec_{column}_{model}"}
        if model.lower() in ("ivf", "ivf_pq"):
            from lakeloom.operators.vector import IvfIndex
            from lakeloom.sources.scratch import scratch

            self.stored[name] = IvfIndex.build(self.spark.table(table), column, scratch(self.spark))

    def register(self, name: str, source) -> None:
        """A DataFrame, Frame, path or versioned table under a name."""
        from lakeloom.sources.read import read_any
        from lakeloom.sources.versions import VersionedTable

        if isinstance(source, VersionedTable):
            self.versioned[name] = source
            source = source.read()
        df = read_any(self.spark, source) if isinstance(source, str) else source.df if isinstance(source, Frame) else source
        df.createOrReplaceTempView(name)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def drop(self, name: str) -> dict:
        """Forget a table; a versioned one loses its files too."""
        self.spark.catalog.dropTempView(name)
        gone = self.versioned.pop(name, None)
        return gone.drop() if gone else {"fragments": 0, "bytes": 0}

    def sql(self, text: str, params: list | None = None) -> Frame:
        df = self._statement(text.strip().rstrip(";"), params)
        # a window without a name of its own is called after its function
        taken = set(df.columns)
        for c in df.columns:
            if (m := re.match(r"(\w+)\(.*\) OVER \(", c, re.S)) and (name := f"{m[1].lower()}_result") not in taken:
                df = df.withColumnRenamed(c, name)
                taken.add(name)
        return Frame.of(df, "sql")

    def _statement(self, text: str, params) -> DataFrame:
        from lakeloom.sources.versions import version_number

        if m := re.fullmatch(r"SHOW\s+VERSIONS\s+FOR\s+(\w+)(?:\s+LIMIT\s+(\d+))?", text, re.I):
            return self._table(m[1]).history(int(m[2]) if m[2] else None)
        if m := re.fullmatch(rf"DIFF\s+(\w+)\s+VERSION\s+{_REF}(?:\s+AND\s+{_REF})?(?:\s+LIMIT\s+(\d+))?", text, re.I):
            t = self._table(m[1])
            return t.row_diff(version_number(t, m[2]), version_number(t, m[3] or "HEAD")).limit(int(m[4]) if m[4] else 100)
        if m := re.fullmatch(rf"SHOW\s+CHANGES\s+FOR\s+(\w+)\s+SINCE\s+VERSION\s+{_REF}", text, re.I):
            t = self._table(m[1])
            return t.row_diff(version_number(t, m[2]), t.latest())
        if m := re.fullmatch(r"CREATE\s+VECTOR\s+INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*\((\w+)\)(?:\s+USING\s+(\w+))?", text, re.I):
            if m[1] not in self.indexes:
                self._index(m[1], m[2], m[3], m[4] or "flat")
            return self._indexes()
        if m := re.fullmatch(r"DROP\s+VECTOR\s+INDEX\s+(?:IF\s+EXISTS\s+)?(\w+)", text, re.I):
            self.indexes.pop(m[1], None)
            self.stored.pop(m[1], None)
            return self._indexes()
        if re.fullmatch(r"SHOW\s+VECTOR\s+INDEX(?:ES)?(?:\s+ON\s+\w+)?", text, re.I):
            return self._indexes()
        if m := re.match(r"WITH\s+DATA\s*\(([^)]*)\)\s*", text, re.I):
            for name, path in re.findall(r"(\w+)\s*=\s*'([^']+)'", m[1]):
                self.register(name, path)
            text = text[m.end() :]
        text = _FROM_FILE.sub(lambda m: f"{m[1]} {self._path_view(m[2])}", text)
        text = _QUANTILE.sub("percentile(", text)
        text = _FROM_PATH.sub(lambda m: f"{m[1]} {self._path_view(m[2])}", text)
        while m := _NEAR.search(text):
            text = self._near(text, m)
        try:
            return self.spark.sql(text, args=params) if params else self.spark.sql(text)
        except QueryError:
            raise
        except Exception as e:
            raise translated(e) from e

    def _table(self, name: str):
        if name not in self.versioned:
            raise QueryError("TABLE_NOT_FOUND", f"no versioned table {name!r}")
        return self.versioned[name]

    def _indexes(self) -> DataFrame:
        rows = [tuple(i[k] for k in ("name", "table", "column", "model", "shadow_column")) for i in self.indexes.values()]
        return self.spark.createDataFrame(rows, "name string, table string, column string, model string, shadow_column string")

    def _path_view(self, path: str) -> str:
        view = "path_" + re.sub(r"\W", "_", path)
        self.register(view, path)
        return view

    def _near(self, text: str, m: re.Match) -> str:
        """Search first among the rows that the other conditions leave, then the rest of the statement."""
        source = _FROM.search(text[: m.start()])
        if not source:
            raise QueryError("INVALID_FILTER", "NEAR needs a FROM")
        name = source[1]
        rest = " AND ".join(x.strip() for x in (re.sub(r"\bAND\s*$", "", m["before"] or "", flags=re.I), re.sub(r"^\s*AND\b", "", m["after"] or "", flags=re.I)) if x.strip())
        vector = [float(x) for x in m["vec"].split(",")]
        table, column = name.replace("`", ""), m["col"].split(".")[-1].strip("`")
        index = next((self.stored[n] for n, i in self.indexes.items() if n in self.stored and (i["table"], i["column"]) == (table, column)), None)
        found = Frame.of(index.candidates(vector).drop("__cell", "__code") if index else self.spark.table(table))
        found = (found.filter(rest) if rest else found).vector(column, vector, int(m["k"] or 10))
        view = f"near_{abs(hash((name, m.group(0)))):x}"
        found.df.createOrReplaceTempView(view)
        return text[: source.start(1)] + view + text[source.end(1) : m.start()] + text[m.end() :]
