import json
import math
import random
import re

import pytest

from lakeloom.errors import CODES, QueryError
from lakeloom.frame import Frame, table
from lakeloom.plans.pipeline import Pipeline
from lakeloom.plans.sql import Engine
from lakeloom.sources import read
from lakeloom.sources.versions import VersionedTable

A = [1, 2, 3, None, 5, None, 7, 0, -1, 10]
B = [10, None, 30, 40, None, 60, 70, 0, -10, 100]
C = ["foo", "bar", None, "baz", "qux", None, "quux", "foo%bar", "f_o", ""]
D = [1.5, 2.0, 3.0, None, 5.5, 6.0, 7.7, 0.0, -1.5, 10.0]


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(list(zip(A, B, C, D)), "a long, b long, c string, d double")


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("a NOT IN (1, NULL, 3)", 0), ("a IN (1, NULL, 3)", 2), (r"c LIKE '%\\%%'", 1), ("a BETWEEN 5 AND 2", 0), ("a = 1 OR b IS NULL", 3),
        ("NOT (a > 2)", 4), ("a <> 1", 7), ("a IS NULL AND b > 30", 2), ("c = ''", 1), ("a + b > 10", 4), ("a NOT BETWEEN 1 AND 5", 4), ("c NOT LIKE 'f%'", 5),
    ],
)
def test_null_logic(spark, nulls, where, n):
    e = Engine(spark)
    e.register("t", nulls)
    assert e.sql(f"SELECT * FROM t WHERE {where}").count() == n


def test_filters_drop_nulls(nulls):
    f = Frame.of(nulls)
    assert f.filter("a", "!=", 1).count() == 7
    assert f.where_not_in("a", [1, 3]).count() == 6
    assert f.where_not_in("a", []).count() == 8
    assert f.where_in("a", []).count() == 0
    assert f.where_between("a", 5, 2).count() == 0
    assert f.whereNull("a").count() == 2
    assert f.where_or([("a", "=", 1)], [("b", "=", 40), ("c", "=", "baz")]).count() == 2


def test_member_null_rules(spark, nulls):
    some = spark.createDataFrame([(1,), (None,)], "k long")
    assert Frame.of(nulls).filter_in("a", some).count() == 1
    assert Frame.of(nulls).filter_in("a", some, negate=True).count() == 0
    assert Frame.of(nulls).filter_in("a", some.where("k IS NOT NULL"), negate=True).count() == 7
    assert Frame.of(nulls).filter_in("a", some.limit(0), negate=True).count() == 10


def test_order_of_calls_does_not_matter(nulls):
    f = Frame.of(nulls).sort("a")
    assert f.limit(2).filter("a", ">", 1).collect() == f.filter("a", ">", 1).limit(2).collect()


def test_nan_and_null_order(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (3.0,)], "x double")
    up = [r["x"] for r in Frame.of(df).sort("x").collect()]
    down = [r["x"] for r in Frame.of(df).sort("x", "desc").collect()]
    assert up[:2] == [1.0, 3.0] and math.isnan(up[2]) and up[3] is None
    assert down[:2] == [3.0, 1.0] and math.isnan(down[2]) and down[3] is None


def test_spread_needs_two(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("y", 3.0)], "k string, v double")
    got = {r["k"]: r["stddev_v"] for r in Frame.of(df).group_by("k").aggregate("stddev", "v").collect()}
    assert got == {"x": None, "y": 1.0}


def test_empty_inputs(spark, nulls):
    none = nulls.limit(0)
    assert Frame.of(none).aggregate("count").collect() == [{"count_*": 0}]
    assert Frame.of(none).group_by("a").aggregate("sum", "b").collect() == []
    left = Frame.of(nulls.select("a")).join(none.select("a", "b"), "a", "left")
    assert left.columns() == ["a", "b"] and left.count() == 10


def test_join_names_and_keys(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    r = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id long, v string")
    got = sorted(Frame.of(l).join(r, "id", "full").collect(), key=lambda x: (x["id"] or 9, str(x["v"])))
    assert [(x["id"], x["v"], x["right_v"]) for x in got] == [(1, "a", None), (2, "b", "B"), (3, None, "C"), (None, None, "N"), (None, "n", None)]


def test_errors(nulls):
    for bad in (lambda: Frame.of(nulls).select("zz").df, lambda: Frame.of(nulls).sort("zz").df, lambda: Frame.of(nulls).filter("zz", "=", 1).df):
        with pytest.raises(QueryError) as e:
            bad()
        assert e.value.code == "COLUMN_NOT_FOUND"
    with pytest.raises(QueryError):
        Frame.of(nulls).limit(-1)
    with pytest.raises(QueryError):
        Frame.of(nulls).after(3)
    with pytest.raises(QueryError):
        Frame.of(nulls).aggregate("nope", "a")
    assert len(CODES) == 10


def test_terminals(nulls):
    f = Frame.of(nulls)
    assert f.shape() == (10, 4) and f.exists() and f.first() is not None and len(f.head(3)) == 3
    assert f.describe()["a"] == {"count": 8, "min": -1, "max": 10}
    assert sum(map(len, f.stream(3))) == 10
    seen = []
    assert len(f.collect(on_progress=seen.append)) == seen[-1] == 10
    assert f.sort("a").page(2, 2) == f.sort("a").offset(2).limit(2).collect()
    assert json.loads(f.select("a").to_json())
    assert f.select("c").sort("c").to_csv().startswith('c\n""\nbar\n') or f.select("c").sort("c").to_csv().startswith("c\n")
    assert f.filter("a", ">", 1).limit(2).to_code() == "table('table').filter('a', '>', 1).limit(2)"


def test_pushdown(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    plan = table(spark, str(tmp_path / "t")).filter("k", "=", 3).select("id").explain()
    assert "k" in plan["pushed_filters"][0] and plan["read_schema"] == ["struct<id:bigint,k:bigint>"] and plan["shuffles"] == 0


def test_json_description(nulls):
    f = Frame.described(nulls, {"select": ["a"], "filters": [{"column": "a", "op": "gt", "value": 1}], "orderBy": {"column": "a", "direction": "desc"}, "limit": 2})
    assert f.collect() == [{"a": 10}, {"a": 7}]
    with pytest.raises(QueryError):
        Frame.described(nulls, {"nonsense": 1})


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a|b|c|d|e\n1|0|1.5| x "y" |na\n2|1|2|"z|w"|\n\n3|1|NULL|"two\nlines"|7\n')
    df = read.read_any(spark, str(p))
    assert df.dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "double"), ("d", "string"), ("e", "bigint")]
    assert [r.d for r in df.orderBy("a").collect()][1:] == ["z|w", "two\nlines"]
    assert read.delimiter('"a,b";c;d') == ";"


def test_json_rules(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"a": 1, "b": true, "n": {"x": [1]}}\nbroken\n{"a": 1.5, "b": "s", "late": 3}\n')
    df = read.read_any(spark, str(p)).orderBy("a")
    assert dict(df.dtypes) == {"a": "double", "b": "string", "n": "string", "late": "bigint"} and df.first().n == '{"x":[1]}'
    q = tmp_path / "y.json"
    q.write_text('[{"a": 1}, {"a": 2}]')
    assert read.read_any(spark, str(q)).count() == 2


def test_foreign_formats(spark, tmp_path):
    import zipfile

    import pyarrow as pa

    t = pa.table({"id": [1, 2, None], "s": ["a", None, "c"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(str, read.read_any(spark, str(tmp_path / "t.arrow")).collect())) == sorted(["Row(id=1, s='a')", "Row(id=2, s=None)", "Row(id=None, s='c')"])

    def long(n):
        n = n << 1 ^ n >> 63
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    text = lambda b: long(len(b)) + b
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}]}).encode()
    block = long(7) + long(1) + text(b"x") + long(-3) + long(0)
    (tmp_path / "t.avro").write_bytes(b"Obj\x01" + long(1) + text(b"avro.schema") + text(schema) + long(0) + b"S" * 16 + long(2) + long(len(block)) + block + b"S" * 16)
    assert sorted((r.id, r.s) for r in read.read_any(spark, str(tmp_path / "t.avro")).collect()) == [(-3, None), (7, "x")]

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>4</v></c><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    assert [r.asDict() for r in read.read_any(spark, str(tmp_path / "t.xlsx")).collect()] == [{"id": 4, "name": "x"}]

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "d/a"))
    spark.range(5, 8).coalesce(1).write.parquet(str(tmp_path / "d/b"))
    part = lambda d: next(p for p in (tmp_path / "d" / d).iterdir() if p.suffix == ".parquet")
    (tmp_path / "d/_delta_log").mkdir()
    add = lambda d: json.dumps({"add": {"path": f"{d}/{part(d).name}"}})
    (tmp_path / "d/_delta_log" / f"{0:020}.json").write_text(add("a") + "\n" + add("b") + "\n")
    (tmp_path / "d/_delta_log" / f"{1:020}.json").write_text(json.dumps({"remove": {"path": f"a/{part('a').name}"}}))
    from lakeloom.sources.foreign import read_delta

    assert read.read_any(spark, str(tmp_path / "d")).where("id < 5").count() == 0
    assert read_delta(spark, str(tmp_path / "d"), 0).where("id >= 5").count() > 0


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, k string")
    assert t.append(df) == 1 and t.append(df.limit(0)) == 1
    assert t.append(spark.createDataFrame([(3, "y"), (4, None)], "id long, k string"), "k") == 2
    assert sorted(r.id for r in t.read().collect()) == [1, 2, 3, 4] and t.read(1).count() == 2
    assert t.diff(1, 2) == {"added_fragments": 1, "removed_fragments": 0, "added_rows": 2, "removed_rows": 0}
    assert t.add_column("z", "long", 7)["columns_after"] == ["id", "k", "z"]
    assert {r.z for r in t.read().collect()} == {7}
    assert t.compact() == 4 and t.read().count() == 4 and t.row_diff(3, 4).count() == 0
    with pytest.raises(QueryError):
        t.append(spark.createDataFrame([("s",)], "id string"))
    e = Engine(spark)
    e.register("v", t)
    assert [r["version"] for r in e.sql("SHOW VERSIONS FOR v LIMIT 2").collect()] == [4, 3]
    assert sorted(r["id"] for r in e.sql("DIFF v VERSION 1 AND 2").collect()) == [3, 4]
    assert e.sql("DIFF v VERSION HEAD~1").count() == 0
    assert e.sql("SHOW CHANGES FOR v SINCE VERSION 1").count() >= 2
    assert e.drop("v")["fragments"] == 1


def test_sql_extras(spark, tmp_path):
    e = Engine(spark)
    spark.range(10).write.parquet(str(tmp_path / "p.parquet"))
    assert e.sql(f"SELECT count(*) AS n FROM '{tmp_path}/p.parquet'").first() == {"n": 10}
    assert e.sql(f"WITH DATA (q = '{tmp_path}/p.parquet') SELECT * FROM q WHERE id > 7").count() == 2
    e.sql("CREATE VECTOR INDEX i ON t (v) USING minilm")
    assert e.sql("SHOW VECTOR INDEXES").first()["shadow_column"] == "__vec_v_minilm"
    assert e.sql("DROP VECTOR INDEX i").count() == 0
    with pytest.raises(QueryError) as x:
        e.sql("SELECT * FROM no_such_table").collect()
    assert x.value.code == "TABLE_NOT_FOUND"


def test_vectors(spark, tmp_path):
    from lakeloom.operators.vector import IvfIndex, nearest

    r = random.Random(1)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) + 3 * (i % 4) for _ in range(8)]) for i in range(400)] + [(400, [0.0] * 8), (401, None), (402, [1.0])], "id long, v array<double>")
    query = [3.0] * 8
    exact = [x.id for x in nearest(df, "v", query, 10, "l2").collect()]
    index = IvfIndex.build(df, "v", str(tmp_path / "index"), 8, metric="l2")
    assert index.rows.count() == 403 and index.rows.where("__cell = -1").count() == 2
    assert len(set(exact) & {x.id for x in index.search(query, 10, 4).collect()}) >= 9
    assert [x.id for x in IvfIndex.load(spark, str(tmp_path / "index")).search(query, 10, 8, again=41).collect()] == exact
    plan = index.candidates(query, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__cell" in plan or "PartitionFilters: [isnotnull(__cell" in plan
    assert nearest(df, "v", query, 403).where("id = 400").first()._distance == 1.0
    assert nearest(df, "v", query, 500).count() == 401


def test_pipeline(spark, nulls):
    out = Pipeline.create(Frame.of(nulls)).stage(lambda f: f.where_not_null("a")).stage(lambda f: f.aggregate("sum", "a", "s")).run()
    assert out.collect() == [{"s": 27}]


def test_fuzz_against_duckdb(spark):
    import duckdb
    import pandas as pd

    r = random.Random(42)
    rows = [(r.choice([None, *range(-9, 9)]), r.choice([None, *range(-9, 9)]), r.choice(["foo", "bar", "baz", None]), r.choice([None, 1.5, -2.5, 0.0])) for _ in range(100)]
    t = spark.createDataFrame(rows, "a long, b long, c string, d double")
    pdf = pd.DataFrame(rows, columns=list("abcd")).astype({"a": "Int64", "b": "Int64"})
    con = duckdb.connect()
    con.register("t", pdf)

    def term():
        k = r.randrange(6)
        n = r.choice("abd")
        return [f"{n} {r.choice(['<', '<=', '=', '<>', '>', '>='])} {r.randint(-5, 5)}", f"{r.choice('abcd')} IS {r.choice(['', 'NOT '])}NULL", f"{n} {r.choice(['', 'NOT '])}IN ({r.randint(-5, 5)}, {r.choice(['NULL', '2'])})",
                f"{n} BETWEEN {r.randint(-5, 0)} AND {r.randint(0, 5)}", f"c LIKE '{r.choice(['b%', '%o', '_a_'])}'", f"a < b"][k]

    e = Engine(spark)
    e.register("t", t)
    for _ in range(40):
        where = f"{r.choice(['', 'NOT '])}({term()} {r.choice(['AND', 'OR'])} {term()}) {r.choice(['AND', 'OR'])} {term()}"
        assert e.sql(f"SELECT count(*) AS n FROM t WHERE {where}").first()["n"] == con.sql(f"SELECT count(*) FROM t WHERE {where}").fetchall()[0][0], where


def test_windows_of_time(spark):
    from pyspark.sql import functions as F

    from lakeloom.streaming.windows import hop, session, tumble

    df = spark.createDataFrame([("a", 0), ("a", 50), ("a", 700), ("b", 65)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    n = {"n": F.count("*")}
    assert sorted(r.n for r in tumble(df, "ts", "1 minute", n).collect()) == [1, 1, 2]
    assert hop(df, "ts", "2 minutes", "1 minute", n).agg(F.sum("n")).first()[0] == 8
    assert sorted((r.k, r.n) for r in session(df, "ts", "5 minutes", n, ["k"]).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_of_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from lakeloom.streaming.windows import tumble

    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    out = tumble(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", {"n": F.count("*")})
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 100


def test_transform_and_ingest(spark, tmp_path):
    from lakeloom.operators.transform import ingest, restricted, transform

    (tmp_path / "x.csv").write_text("id,v,w\n1,2.5,a\n2,3.5,b\n3,9.5,c\n")
    transform(spark, str(tmp_path / "x.csv"), str(tmp_path / "y"), ["id", "v"], "v > 3", {"v": "value"}, {"id": "string"}, 5)
    assert sorted((r.id, r.value) for r in spark.read.parquet(str(tmp_path / "y")).collect()) == [("2", 3.5), ("3", 9.5)]
    assert ingest(spark, str(tmp_path / "x.csv"), str(tmp_path / "t")) == 1 and ingest(spark, str(tmp_path / "y"), str(tmp_path / "u")) == 1
    f = table(spark, str(tmp_path / "t"))
    assert restricted(f, "a", {"a": "id = 1"}).count() == 1 and restricted(f, "b", {}).count() == 0


def test_index_recall(spark, tmp_path):
    """Of the exact neighbours of every vector of vec_id % 20 = 0, the share that the stored index finds."""
    from lakeloom.operators.vector import IvfIndex, near_join

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0")
    for metric in ("l2", "cosine"):
        index = IvfIndex.build(e, "embedding", str(tmp_path / metric), metric=metric)
        exact, found = ({(r.left_id, r.right_id) for r in x.collect()} for x in (near_join(queries, "embedding", "vec_id", e, "embedding", "vec_id", 10, metric), index.join(queries, "embedding", "vec_id", "vec_id", 10)))
        assert len(exact & found) >= 0.9 * len(exact), (metric, len(exact & found), len(exact))
    near = sum(len({r.vec_id for r in index.search(q.embedding, 10).collect()} & {b for a, b in exact_of(spark, e, q)}) for q in queries.limit(8).collect())
    assert near >= 72


def exact_of(spark, e, q):
    from lakeloom.operators.vector import nearest

    return {(q.vec_id, r.vec_id) for r in nearest(e, "embedding", q.embedding, 10).collect()}


def test_near_join_of_odd_vectors(spark):
    from lakeloom.operators.vector import near_join

    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (1, [1.0, 0.0])], "a long, v array<double>")
    right = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 1.0]), (9, None), (6, [0.0, 1.0])], "b long, v array<float>")
    got = sorted((r.left_id, r["rank"], r.right_id) for r in near_join(left.limit(4), "v", "a", right, "v", "b", 2).collect())
    assert got == [(1, 1, 7), (1, 2, 6), (4, 1, 6), (4, 2, 7)]
    assert near_join(left.limit(0), "v", "a", right, "v", "b").count() == 0


def test_near_join_deals_pairs_to_tasks(spark, monkeypatch):
    """Groups of queries meet pieces of the rows in tasks of bounded pairs, and the ranks are those of all pairs."""
    from pyspark.sql import functions as F

    from lakeloom.operators import vector

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    e = e.union(e.selectExpr("vec_id + 1000", "embedding", "label").where("vec_id % 3 = 0"))  # exact copies tie
    queries = e.where("vec_id % 20 = 0")
    monkeypatch.setattr(vector, "PAIRS", 1000)
    got = vector.near_join(queries, "embedding", "vec_id", e, "embedding", "vec_id", 10, "l2", 7, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    tasks = int(re.search(r"shufflepartitionidpassthrough\(.*, (\d+)\)", plan).group(1))
    assert tasks >= queries.count() * e.count() / 1000 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    pairs = queries.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("q")).crossJoin(e.select(F.col("vec_id").alias("right_id"), "embedding"))
    exact = vector._ranked(pairs.select("left_id", "right_id", vector.distance(F.col("embedding"), F.col("q"), "l2").alias("distance")), 10)
    assert sorted(map(tuple, got.select("left_id", "rank", "right_id").collect())) == sorted(map(tuple, exact.select("left_id", "rank", "right_id").collect()))


def test_near_join_ranks_parallel_vectors_as_sql(spark):
    """Multiples of a vector are at distance 0 of it to the last digit, so that ties go by the id as in SQL."""
    import duckdb
    import pandas as pd

    from lakeloom.operators.vector import near_join

    r = random.Random(5)
    one = [[r.randint(-9, 9) for _ in range(24)] for _ in range(6)]
    rows = pd.DataFrame([(i, [float(x * by) for x in v]) for i, (by, v) in enumerate((by, v) for by in (1, 3, 11, 7, 5, 13) for v in one)], columns=["i", "v"])
    df = spark.createDataFrame(rows.values.tolist(), "i long, v array<double>")
    with duckdb.connect() as c:
        c.register("t", rows)
        d = "1 - list_cosine_similarity(a.v, b.v)"
        want = c.sql(f"SELECT a.i, row_number() OVER (PARTITION BY a.i ORDER BY {d}, b.i) AS rank, b.i AS other FROM t a, t b QUALIFY rank <= 6").fetchall()
    got = near_join(df, "v", "i", df, "v", "i", 6).select("left_id", "rank", "right_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_index_join_deals_pairs_to_tasks(spark, tmp_path, monkeypatch):
    """Cells meet in tasks of bounded pairs; with all cells probed the ranks are those of the exact join."""
    from lakeloom.operators import vector

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 64), (920, [0.5] * 63 + [None])], "vec_id long, embedding array<float>")
    queries = e.union(odd).where("vec_id % 20 = 0")
    index = vector.IvfIndex.build(e.union(odd), "embedding", str(tmp_path / "i"), cells=4)
    monkeypatch.setattr(vector, "PAIRS", 1000)
    found = index.join(queries, "embedding", "vec_id", "vec_id", 10, 4)
    tasks = int(re.search(r"shufflepartitionidpassthrough\(.*, (\d+)\)", found._jdf.queryExecution().executedPlan().toString()).group(1))
    assert tasks >= 25 * 500 / 1000
    exact = vector.near_join(queries.where("vec_id < 900"), "embedding", "vec_id", e, "embedding", "vec_id", 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_vector_index_in_sql(spark):
    e = Engine(spark)
    r = random.Random(3)
    e.register("vecs", spark.createDataFrame([(i, [r.gauss(0, 1) + 4 * (i % 5) for _ in range(6)]) for i in range(500)], "id long, v array<double>"))
    text = "SELECT id FROM vecs WHERE v NEAR [4, 4, 4, 4, 4, 4.5] TOPK 10"
    exact = {x["id"] for x in e.sql(text).collect()}
    e.sql("CREATE VECTOR INDEX fast ON vecs (v) USING ivf")
    plan = e.sql(text).df._jdf.queryExecution().executedPlan().toString()
    assert "__cell" in plan and len({x["id"] for x in e.sql(text).collect()} & exact) >= 9
    e.sql("DROP VECTOR INDEX fast")
    assert "__cell" not in e.sql(text).df._jdf.queryExecution().executedPlan().toString()


def test_compact_keeps_what_others_append(spark, tmp_path, monkeypatch):
    t, other = (VersionedTable(spark, str(tmp_path / "v")) for _ in range(2))
    t.append(spark.range(5).toDF("id"))
    t.append(spark.range(5, 8).toDF("id"))
    plain = VersionedTable._files
    meanwhile = [lambda: other.append(spark.range(100, 103).toDF("id"))]

    def files(self, name):  # between the read and the commit
        if self is t and meanwhile:
            meanwhile.pop()()
        return plain(self, name)

    monkeypatch.setattr(VersionedTable, "_files", files)
    t.compact()
    assert sorted(r.id for r in t.read().collect()) == [*range(8), 100, 101, 102]
    gone = t.manifest()["fragments"][0]["name"]
    meanwhile.append(lambda: other.delete_fragments([gone]))  # what was read goes: it must not come back
    t.compact()
    assert sorted(r.id for r in t.read().collect()) == [100, 101, 102]


def test_nulls_and_columns_of_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    t.append(spark.createDataFrame([(1, "a")], "id long, k string"))
    t.add_column("z", "long", 7)
    t.append(spark.createDataFrame([(2, "b", None), (3, None, 5)], "id long, k string, z long"))
    rows = lambda: {r.id: r.z for r in t.read().collect()}
    assert rows() == {1: 7, 2: None, 3: 5}
    t.compact()
    assert rows() == {1: 7, 2: None, 3: 5}
    t.drop_column("k")
    t.compact()
    t.add_column("k", "string")
    assert {r.k for r in t.read().collect()} == {None}
    t.drop_column("z")
    t.add_column("z", "string", "new")
    t.append(spark.createDataFrame([(4, "own")], "id long, z string"))
    assert {r.id: r.z for r in t.read().collect()} == {1: "new", 2: "new", 3: "new", 4: "own"}
    assert t.read(2).columns == ["id", "k", "z"] and t.last_change()["delta"] == 1


def test_unfinished_manifest(spark, tmp_path, monkeypatch):
    from lakeloom.sources import versions

    t = VersionedTable(spark, str(tmp_path / "v"))
    t.append(spark.range(3).toDF("id"))
    (tmp_path / "v/_manifests/2.json").write_text('{"fragments": [')
    assert t.latest() == 1 and t.read().count() == 3 and len(t.versions()) == 1
    monkeypatch.setattr(versions, "STALE", 0)
    assert t.append(spark.range(3, 5).toDF("id")) == 2 and t.read().count() == 5


def test_cache_tells_sources_apart(spark):
    a, b = Frame.of(spark.range(3)), Frame.of(spark.range(7))
    assert a.cache().count() == 3 and b.cache().count() == 7
    assert a.filter("id", ">", 0).cache().count() == 2 and b.filter("id", ">", 0).cache().count() == 6
    kept = Frame.of(spark.range(3)).cache(60)
    assert kept.df is Frame.of(spark.range(3)).cache(60).df


def test_first_and_last_need_an_order(spark):
    f = Frame.of(spark.createDataFrame([("a", 2, 5), ("a", 1, 9), ("a", None, 0), ("b", None, 1)], "g string, o int, v int")).group_by("g")
    got = {r["g"]: (r["x"], r["y"]) for r in f.aggregate("first", "v", "x", order="o").aggregate("last", "v", "y", order="o").collect()}
    assert got == {"a": (9, 5), "b": (None, None)}
    with pytest.raises(QueryError):
        f.aggregate("first", "v").collect()


def test_order_of_rows(spark):
    from .conftest import SF

    f = Frame.of(spark.read.parquet(f"{SF}/lineitem.parquet"))
    rows = f.sort("l_extendedprice", "desc").sort("l_orderkey").select("l_extendedprice", "l_orderkey").collect()
    assert rows == sorted(rows, key=lambda r: (-r["l_extendedprice"], r["l_orderkey"])) and len(rows) > 1000
    odd = Frame.of(spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 2.0)], "i int, x double"))
    assert [r["i"] for r in odd.sort("x").collect()] == [3, 4, 2, 1] and [r["i"] for r in odd.sort("x", "desc").collect()] == [4, 3, 2, 1]


def test_partitions_are_pruned(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    t.append(spark.createDataFrame([(i, f"k{i % 4}") for i in range(40)], "id long, k string"), "k")
    files = Frame.of(t.read()).where_in("k", ["k2"]).df
    assert files.count() == 10
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*k2", plan)


def test_csv_options(spark, tmp_path):
    from lakeloom.sources.read import read_csv

    (tmp_path / "a.csv").write_text("made by hand\nsecond line\na;b\n1;'x;y'\n2;z\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), quote="'", skip_rows=2, sep=";").orderBy("a").collect()] == [(1, "x;y"), (2, "z")]
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv")).collect()) == [(1, "x\ny"), (2, "z")]
    (tmp_path / "c.csv").write_text("5,q\n6,r\n")
    assert read_csv(spark, str(tmp_path / "c.csv"), has_header=False).columns == ["column_0", "column_1"]


def test_writers_of_other_formats(spark, tmp_path):
    from lakeloom.sources import foreign, write

    df = spark.createDataFrame([(1, "é", 1.5, True, None), (2, None, -0.25, False, b"\x00\xff"), (-(2**62), "x" * 300, None, None, b"")], "a long, b string, c double, d boolean, e binary")
    want = sorted(map(str, df.collect()))
    for i, codec in enumerate(("null", "deflate", "snappy")):
        write.write_avro(df.repartition(2), str(tmp_path / f"avro{i}"), codec)
        assert sorted(map(str, foreign.read_avro(spark, str(tmp_path / f"avro{i}")).collect())) == want
    write.write_arrow(df, str(tmp_path / "arrow"))
    assert sorted(map(str, foreign.read_arrow(spark, str(tmp_path / "arrow")).collect())) == want
    write.write_arrow(df.limit(0), str(tmp_path / "none"))
    assert foreign.read_arrow(spark, str(tmp_path / "none")).count() == 0
    assert foreign.unsnap(bytes([11, 2 << 2]) + b"abc" + bytes([(8 - 1) << 2 | 2, 3, 0])) == b"abcabcabcab"
    with pytest.raises(QueryError):
        foreign.unsnap(bytes([4, 0]) + b"a" + bytes([2, 9, 0]))


def test_delta_checkpoints(spark, tmp_path):
    from lakeloom.sources import foreign, write

    path = str(tmp_path / "d e")
    for i in range(3):
        write.write_delta(spark.range(10 * i, 10 * i + 4).toDF("id").coalesce(1), path)
    log = tmp_path / "d e" / "_delta_log"
    adds = [json.loads(x)["add"] for v in (0, 1) for x in (log / f"{v:020}.json").read_text().splitlines() if '"add"' in x]
    point = spark.createDataFrame([(a["path"],) for a in adds], "p string").selectExpr("struct(p AS path, map('', '') AS partitionValues) AS add")
    point.coalesce(1).write.parquet(str(tmp_path / "point"))
    next((tmp_path / "point").glob("part-*.parquet")).rename(log / f"{1:020}.checkpoint.parquet")
    (log / f"{0:020}.json").unlink()
    assert sorted(r.id for r in foreign.read_delta(spark, path).collect()) == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    (log / f"{1:020}.checkpoint.parquet").unlink()
    with pytest.raises(QueryError):
        foreign.read_delta(spark, path)
    for crc in log.glob(".*.crc"):
        crc.unlink()
    dv = {"add": {"path": "x", "deletionVector": {"storageType": "u"}}}
    (log / f"{0:020}.json").write_text(json.dumps(dv))
    with pytest.raises(QueryError):
        foreign.read_delta(spark, path)


def test_pages_and_sugar(spark):
    pages = Frame.of(spark.range(50).toDF("id")).sort("id").lazy()
    assert [r["id"] for r in pages.page(10, 3)] == [10, 11, 12] and pages.row(49) == {"id": 49} and pages.row(50) is None
    assert sum(map(len, pages.stream(20))) == 50
    pages.close()
    f = Frame.of(spark.range(50).toDF("id")).computed("g", "id % 3")
    assert f.quantile("id", 0.5, "q").collect() == [{"q": 24.5}]
    assert Frame.of(f.df).dense_rank("r", (), "g").collect()[0]["r"] in (1, 2, 3)

