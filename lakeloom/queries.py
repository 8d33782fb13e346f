"""Registered queries of the engine, each with the equivalent SQL for DuckDB.

``Q[name] = (query, sql)``; a query takes ``t``, which gives a ``Frame`` for a table name, or the
engine for SQL text.  Sums of doubles are rounded, as their last digits depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.frame import Frame
from lakeloom.functions import scalar as S
from lakeloom.operators.vector import near_join
from lakeloom.plans.sql import Engine
from lakeloom.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels", "conversations")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> Frame:
        return Frame.of(lambda: self.spark.read.parquet(f"{self.dir}/{name}.parquet"), name)

    def sql(self, text: str, params: list | None = None) -> Frame:
        engine = Engine(self.spark)
        for name in TABLES:
            if name in text:
                engine.register(name, self(name))
        return engine.sql(text, params)


Q: dict[str, tuple[Callable[[Tables], Frame | DataFrame], str | None]] = {}


def q(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def same(name: str, text: str, params: list | None = None, oracle: str | None = None) -> None:
    """A query through the SQL entry whose text DuckDB reads too."""
    Q[name] = (lambda t: t.sql(text, params), oracle or text)


def rounded(frame: Frame, *names: str, digits: int = 4) -> DataFrame:
    return frame.df.withColumns({n: F.round(n, digits) for n in names})


# -- pricing summary (flagship) -------------------------------------------------------------------


@q(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(t):
    f = t("lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'").computed("disc_price", "l_extendedprice * (1 - l_discount)")
    f = f.group_by("l_returnflag", "l_linestatus").aggregate("sum", "l_quantity", "sum_qty").aggregate("sum", "disc_price", "sum_disc").aggregate("avg", "l_discount", "avg_disc").aggregate("count", "*", "n")
    return f.df.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_disc": F.round("sum_disc", 2), "avg_disc": F.round("avg_disc", 6)})


# -- scans and filters ----------------------------------------------------------------------------

q("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")(lambda t: t("orders").select("o_orderkey", "o_custkey", "o_totalprice"))
LINE = "l_orderkey, l_linenumber, l_quantity"
_line = lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
q("filter_eq", f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R'")(lambda t: _line(t).filter("l_returnflag", "=", "R"))
q("filter_neq", f"SELECT {LINE} FROM lineitem WHERE l_returnflag <> 'R'")(lambda t: _line(t).filter("l_returnflag", "!=", "R"))
q("filter_range_ops", f"SELECT {LINE} FROM lineitem WHERE l_quantity > 10 AND l_quantity >= 11 AND l_discount < 0.09 AND l_tax <= 0.05")(
    lambda t: _line(t).filter("l_quantity", ">", 10).filter("l_quantity", ">=", 11).filter("l_discount", "<", 0.09).filter("l_tax", "<=", 0.05)
)
q("filter_in", f"SELECT {LINE} FROM lineitem WHERE l_linenumber IN (1, 3, 5)")(lambda t: _line(t).where_in("l_linenumber", [1, 3, 5]))
q("filter_not_in", f"SELECT {LINE} FROM lineitem WHERE l_linenumber NOT IN (1, 3, 5)")(lambda t: _line(t).where_not_in("l_linenumber", [1, 3, 5]))
q("filter_between", f"SELECT {LINE} FROM lineitem WHERE l_quantity BETWEEN 5 AND 10")(lambda t: _line(t).where_between("l_quantity", 5, 10))
q("filter_not_between", f"SELECT {LINE} FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 10")(lambda t: _line(t).where_not_between("l_quantity", 5, 10))
q("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_%'")(lambda t: t("part").where_like("p_type", "%A_%").select("p_partkey", "p_type"))
q("filter_not_like", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'")(lambda t: t("part").where_not_like("p_type", "%A%").select("p_partkey", "p_type"))
_maybe = lambda t: t("orders").computed("v", "nullif(o_orderstatus, 'F')")
q("filter_null", "SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') v FROM orders) WHERE v IS NULL")(lambda t: Frame.of(_maybe(t).df).where_null("v").select("o_orderkey"))
q("filter_not_null", "SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') v FROM orders) WHERE v IS NOT NULL")(lambda t: Frame.of(_maybe(t).df).where_not_null("v").select("o_orderkey"))
q("filter_or_groups", f"SELECT {LINE} FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 40) OR (l_linestatus = 'O' AND l_quantity < 3) OR l_tax = 0.08")(
    lambda t: _line(t).where_or([("l_returnflag", "=", "R"), ("l_quantity", ">", 40)], [("l_linestatus", "=", "O"), ("l_quantity", "<", 3)]).where_or([("l_tax", "=", 0.08)])
)
q("keyset_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")(lambda t: t("orders").select("o_orderkey", "o_totalprice").sort("o_orderkey").after(500).limit(50))
q("subquery_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(
    lambda t: t("orders").filter_in("o_custkey", t("customer").filter("c_acctbal", ">", 5000).select("c_custkey")).select("o_orderkey")
)
q("subquery_not_in", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(
    lambda t: t("orders").filter_in("o_custkey", t("customer").filter("c_acctbal", ">", 5000).select("c_custkey"), negate=True).select("o_orderkey")
)
same("sql_where_expr", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 - 1 > 50 AND NOT (l_tax = 0.02 OR l_returnflag = 'A')")
same("three_valued_logic", "SELECT n_nationkey, (nullif(n_regionkey, 1) = 2 OR n_nationkey > 10) AS a, NOT (nullif(n_regionkey, 1) = 2) AS b, nullif(n_regionkey, 1) IN (2, NULL) AS c FROM nation")
same("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)")
same("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
same("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'A%')")
same("params", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", [100000.0, "O"], "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")

# -- projections ----------------------------------------------------------------------------------

q("project", "SELECT c_custkey, c_name FROM customer")(lambda t: t("customer").select("c_custkey", "c_name"))
q("drop_columns", "SELECT n_nationkey, n_name FROM nation")(lambda t: t("nation").drop("n_regionkey"))
q("rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")(lambda t: t("nation").rename({"n_nationkey": "id", "n_name": "name"}))
q("computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber").computed("net", "l_extendedprice * (1 - l_discount)").computed("gross", "net * (1 + l_tax)")
)
q("fill_null", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS v FROM orders")(lambda t: _maybe(t).fill_null("v", "none").select("o_orderkey", "v"))
q("cast_column", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus FROM orders")(
    lambda t: t("orders").cast("o_custkey", "string").cast("o_orderstatus", "number").select("o_orderkey", "o_custkey", "o_orderstatus")
)
same("select_exprs", "SELECT p_partkey, p_size + 1 AS next_size, p_brand || '/' || p_type AS label, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS bucket, p_size > 10 AS over_ten FROM part")
same("select_alias", "SELECT n.n_name AS nation_name, n.n_regionkey AS r FROM nation n")


def _bucket(row) -> int:
    return int(row["p_size"]) // 10


q("udf_scalar", "SELECT p_partkey, CAST(p_size // 10 AS BIGINT) AS bucket FROM part")(lambda t: Frame.of(t("part").select("p_partkey", "p_size").computed("bucket", _bucket).df).select("p_partkey", "bucket"))
q("pipe", "SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0")(lambda t: t("part").pipe(lambda df: df.where("p_size % 2 = 0")).select("p_partkey", "p_size"))

# -- joins ----------------------------------------------------------------------------------------

q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: t("orders").join(t("customer"), {"left": "o_custkey", "right": "c_custkey"}).select("o_orderkey", "c_name"))
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")(lambda t: t("customer").join(t("orders"), {"left": "c_custkey", "right": "o_custkey"}, "left").select("c_custkey", "o_orderkey"))
q("join_right", "SELECT coalesce(o.o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM orders o RIGHT JOIN customer ON o_custkey = c_custkey")(
    lambda t: t("orders").join(t("customer"), {"left": "o_custkey", "right": "c_custkey"}, "right").select("o_custkey", "o_orderkey", "c_name")
)
q("join_full", "SELECT coalesce(s_suppkey, n_nationkey) AS s_suppkey, s_name, n_name FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey")(
    lambda t: t("supplier").join(t("nation"), {"left": "s_suppkey", "right": "n_nationkey"}, "full").select("s_suppkey", "s_name", "n_name")
)
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")(lambda t: t("region").join(t("nation"), {"left": None, "right": None}, "cross").select("r_name", "n_name"))
q("join_output_naming", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS right_n_name, b.n_regionkey AS right_n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")(lambda t: t("nation").join(t("nation"), "n_nationkey"))
q("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda t: t("customer").join(t("orders"), {"left": "c_custkey", "right": "o_custkey"}, "semi").select("c_custkey"))
q("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda t: t("customer").join(t("orders"), {"left": "c_custkey", "right": "o_custkey"}, "anti").select("c_custkey"))
same("join_using", "SELECT c_custkey, n FROM (SELECT c_custkey FROM customer) JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
same("join_natural", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
same("join_multiway", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name")
same("join_expression", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("join_where_after", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 1000 ")
# the stated query set of searches, vec_id divisible by 20, against all rows
q(
    "near_join",
    """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank
       FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20""",
)(lambda t: near_join(t("embeddings").df.where("vec_id % 20 = 0"), "embedding", "vec_id", t("embeddings").df, "embedding", "vec_id").withColumn("distance", F.round("distance", 6)))
q(
    "near_join_l2",
    """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS distance,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, b.vec_id)::INT AS rank
       FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""",
)(lambda t: near_join(t("embeddings").df.where("vec_id % 20 = 0"), "embedding", "vec_id", t("embeddings").df, "embedding", "vec_id", 10, "l2").withColumn("distance", F.round("distance", 6)))


def _ivf(t):
    from lakeloom.operators.vector import IvfIndex
    from lakeloom.sources.scratch import scratch

    return IvfIndex.build(t("embeddings").df, "embedding", scratch(t.spark))


# approximate searches of a stored index: tests hold their recall against exact ones
q("ivf_join", None)(lambda t: _ivf(t).join(t("embeddings").df.where("vec_id % 20 = 0"), "embedding", "vec_id", "vec_id").withColumn("distance", F.round("distance", 6)))
q("ivf_topk", None)(lambda t: _ivf(t).search(QUERY, 20).select("vec_id", "label", F.round("_distance", 6).alias("_distance")))
q("group_by_near", None)(lambda t: t("embeddings").group_by_near("embedding", 20).df.groupBy("_cluster").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")))

# -- aggregation ----------------------------------------------------------------------------------


def _agg(name: str, fn: str, column: str, expression: str, digits: int | None = 4, fraction: float = 0.5):
    shown = f"round({expression}, {digits})" if digits is not None else expression
    sql = f"SELECT l_returnflag, {shown} AS v FROM lineitem GROUP BY 1"

    def run(t):
        f = t("lineitem").group_by("l_returnflag").aggregate(fn, column, "v", fraction)
        return rounded(f, "v", digits=digits) if digits is not None else f

    q(name, sql)(run)


_agg("agg_sum", "sum", "l_quantity", "sum(l_quantity)")
_agg("agg_avg", "avg", "l_extendedprice", "avg(l_extendedprice)")
_agg("agg_min", "min", "l_shipdate", "min(l_shipdate)", None)
_agg("agg_max", "max", "l_linestatus", "max(l_linestatus)", None)
_agg("agg_count", "count", "l_tax", "count(l_tax)", None)
_agg("agg_count_star", "count", "*", "count(*)", None)
_agg("agg_count_distinct", "count_distinct", "l_suppkey", "count(DISTINCT l_suppkey)", None)
_agg("agg_stddev", "stddev", "l_quantity", "CASE WHEN count(l_quantity) >= 2 THEN stddev_pop(l_quantity) END")
_agg("agg_variance", "variance", "l_quantity", "CASE WHEN count(l_quantity) >= 2 THEN var_pop(l_quantity) END")
_agg("agg_stddev_samp", "stddev_samp", "l_quantity", "stddev_samp(l_quantity)")
_agg("agg_var_samp", "var_samp", "l_quantity", "var_samp(l_quantity)")
_agg("agg_stddev_pop", "stddev_pop", "l_quantity", "stddev_pop(l_quantity)")
_agg("agg_var_pop", "var_pop", "l_quantity", "var_pop(l_quantity)")
_agg("agg_median", "median", "l_extendedprice", "median(l_extendedprice)")
_agg("agg_percentile", "percentile", "l_extendedprice", "quantile_cont(l_extendedprice, 0.95)", 4, 0.95)
q("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY 1")(lambda t: t("nation").group_by("n_regionkey").aggregate("string_agg", "n_name", "v"))
q("agg_array", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS v FROM nation GROUP BY 1")(lambda t: t("nation").group_by("n_regionkey").aggregate("array_agg", "n_nationkey", "v"))
for _f, _d in (("first", "ASC"), ("last", "DESC")):
    q(f"agg_{_f}", f"SELECT o_custkey, arg_{'min' if _f == 'first' else 'max'}(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1")(lambda t, f=_f: t("orders").group_by("o_custkey").aggregate(f, "o_totalprice", "v", order="o_orderkey"))
same("agg_quantile_sql", "SELECT l_returnflag, round(quantile(l_extendedprice, 0.25), 4) AS v FROM lineitem GROUP BY l_returnflag", oracle="SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS v FROM lineitem GROUP BY l_returnflag")
q("grouped_methods", "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(stddev_samp(l_quantity), 4) AS d, round(var_pop(l_quantity), 4) AS v, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1 HAVING count(*) > 1")(
    lambda t: t("lineitem").grouped("l_linestatus").count("n").sum("l_quantity", "s").avg("l_tax", "a").min("l_shipdate", "lo").max("l_shipdate", "hi").stddev("l_quantity", "d").var_pop("l_quantity", "v").median("l_extendedprice", "m").having("n", ">", 1).df.withColumns({c: F.round(c, d) for c, d in (("s", 2), ("a", 6), ("d", 4), ("v", 4), ("m", 4))})
)
q("group_by_agg", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")(
    lambda t: rounded(t("orders").group_by("o_orderstatus", "o_orderpriority").aggregate("count", "*", "n").aggregate("sum", "o_totalprice", "total"), "total", digits=2)
)
q("agg_global", "SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_tax), 6) AS tax FROM lineitem")(
    lambda t: rounded(t("lineitem").aggregate("count", "*", "n").aggregate("min", "l_quantity", "lo").aggregate("max", "l_quantity", "hi").aggregate("avg", "l_tax", "tax"), "tax", digits=6)
)
q("group_keys_only", "SELECT DISTINCT o_orderstatus FROM orders")(lambda t: t("orders").group_by("o_orderstatus"))
q("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")(lambda t: t("orders").group_by("o_custkey").aggregate("count", "*", "n").having("n", ">", 12))
same("having_sql", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000 AND count(*) > 3")
same("agg_over_expr", "SELECT l_linestatus, round(sum(l_extendedprice * l_discount), 2) AS v FROM lineitem GROUP BY l_linestatus")
same("expr_over_agg", "SELECT l_linestatus, round(sum(l_quantity) / count(*), 4) AS v FROM lineitem GROUP BY l_linestatus")
q("value_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")(lambda t: t("part").value_counts("p_brand"))
q("count_metadata", "SELECT count(*) AS n FROM lineitem")(lambda t: t("lineitem").aggregate("count", "*", "n"))
same("partial_final_agg", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_suppkey")
q("pivot", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END)::BIGINT AS \"1-URGENT\", sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END)::BIGINT AS \"5-LOW\" FROM orders GROUP BY 1")(
    lambda t: t("orders").pivot("o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"], "count", "o_orderkey")
)

# -- windows --------------------------------------------------------------------------------------

BY_CUSTOMER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_orders = dict(partition_by=("o_custkey",), order_by=("o_orderdate", "o_orderkey"))


def _win(name: str, fn: str, expression: str, digits: int | None = None, **spec):
    spec = _orders | spec
    shown = f"round({expression}, {digits})" if digits is not None else expression

    def run(t):
        f = t("orders").window(fn, "v", **spec).select("o_orderkey", "v")
        return rounded(f, "v", digits=digits) if digits is not None else f

    q(name, f"SELECT o_orderkey, {shown} AS v FROM orders")(run)


ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_win("win_row_number", "row_number", f"(row_number() {BY_CUSTOMER}))::INT")
_win("win_rank", "rank", "(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INT", partition_by=("o_orderstatus",), order_by=("o_orderpriority",))
_win("win_dense_rank", "dense_rank", "(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC))::INT", partition_by=("o_orderstatus",), order_by=(("o_orderpriority", "desc"),))
_win("win_lag", "lag", f"lag(o_totalprice, 2, -1.0) {BY_CUSTOMER})", column="o_totalprice", offset=2, default=-1.0)
_win("win_lead", "lead", f"lead(o_totalprice) {BY_CUSTOMER})", column="o_totalprice")
for _f in ("sum", "avg", "min", "max"):
    _win(f"win_{_f}", _f, f"{_f}(o_totalprice) {BY_CUSTOMER} {ROWS}", 6, column="o_totalprice")
_win("win_count", "count", f"count(*) {BY_CUSTOMER} {ROWS}", column="*")
_win("win_frame_rows", "sum", f"sum(o_totalprice) {BY_CUSTOMER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", 2, column="o_totalprice", frame=("rows", -2, 1))
_win("win_frame_range", "count", "count(*) OVER (PARTITION BY o_custkey ORDER BY o_custkey + o_orderkey % 7 RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", column="*", order_by=("k",), frame=("range", -1, 1))
Q["win_frame_range"] = (lambda t: Frame.of(t("orders").computed("k", "o_custkey + o_orderkey % 7").df).window("count", "v", "*", ("o_custkey",), ("k",), ("range", -1, 1)).select("o_orderkey", "v"), Q["win_frame_range"][1])
_win("win_ntile", "ntile", f"(ntile(3) {BY_CUSTOMER}))::INT", offset=3)
_win("win_percent_rank", "percent_rank", f"percent_rank() {BY_CUSTOMER})", 6)
_win("win_cume_dist", "cume_dist", f"cume_dist() {BY_CUSTOMER})", 6)
_win("win_first_value", "first_value", f"first_value(o_totalprice) {BY_CUSTOMER} {ROWS}", column="o_totalprice")
_win("win_last_value", "last_value", f"last_value(o_totalprice) {BY_CUSTOMER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", column="o_totalprice", frame=("rows", None, None))
_win("win_nth_value", "nth_value", f"nth_value(o_totalprice, 2) {BY_CUSTOMER} {ROWS}", column="o_totalprice", offset=2)
_win("win_whole_partition", "sum", "sum(o_totalprice) OVER (PARTITION BY o_custkey)", 2, column="o_totalprice", order_by=())
q("win_methods", f"SELECT o_orderkey, (row_number() {BY_CUSTOMER}))::INT AS rn, lag(o_orderkey) {BY_CUSTOMER}) AS before, lead(o_orderkey) {BY_CUSTOMER}) AS next, first_value(o_orderkey) {BY_CUSTOMER} {ROWS} AS fv, (ntile(4) {BY_CUSTOMER}))::INT AS part, count(*) {BY_CUSTOMER} {ROWS} AS n FROM orders")(
    lambda t: t("orders").row_number("rn", **_orders).lag("o_orderkey", "before", **_orders).lead("o_orderkey", "next", **_orders).first_value("o_orderkey", "fv", **_orders).ntile(4, "part", **_orders).over("count", "*", "n", **_orders).select("o_orderkey", "rn", "before", "next", "fv", "part", "n")
)
same("win_unnamed_sql", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) FROM orders", oracle="SELECT o_orderkey, (rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INT AS rank_result FROM orders")
same("win_after_where", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O'", oracle="SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS rn FROM orders WHERE o_orderstatus = 'O'")

# -- order, limits, sets --------------------------------------------------------------------------

q("sort_external", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice")(lambda t: t("lineitem").sort("l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice"))
q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")(
    lambda t: t("lineitem").sort("l_extendedprice", "desc").sort("l_orderkey").sort("l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")
)
q("order_by_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_totalprice DESC")(lambda t: t("orders").sort("o_orderstatus").sort("o_totalprice", "desc").select("o_orderkey", "o_orderstatus"))
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")(lambda t: t("orders").sort("o_orderkey").offset(35).limit(20).select("o_orderkey"))
q("limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 1000)")(lambda t: Frame.of(t("lineitem").limit(1000).df).aggregate("count", "*", "n"))
q("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")(lambda t: _rows(t.spark, t("orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", "desc").sort("o_orderkey").head(7)))
q("page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 24")(lambda t: _rows(t.spark, t("orders").select("o_orderkey", "o_custkey").sort("o_orderkey").lazy().page(24, 12)))
q("describe", "SELECT * FROM (SELECT 'c_acctbal' AS name, count(c_acctbal) AS count, round(min(c_acctbal), 2)::VARCHAR AS low, round(max(c_acctbal), 2)::VARCHAR AS high FROM customer UNION ALL SELECT 'c_custkey', count(c_custkey), min(c_custkey)::VARCHAR, max(c_custkey)::VARCHAR FROM customer)")(
    lambda t: _rows(t.spark, [{"name": c, "count": v["count"], "low": str(v["min"]), "high": str(v["max"])} for c, v in t("customer").select("c_acctbal", "c_custkey").describe().items()])
)
q("shape", "SELECT count(*) AS rows, 3::BIGINT AS columns FROM nation")(lambda t: _rows(t.spark, [dict(zip(("rows", "columns"), t("nation").shape()))]))
q("sort_after_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")(lambda t: t("orders").group_by("o_custkey").aggregate("count", "*", "n").sort("n", "desc").sort("o_custkey").limit(10))
q("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t("lineitem").select("l_returnflag", "l_linestatus").distinct())
q("distinct_on", "SELECT DISTINCT o_custkey FROM orders")(lambda t: t("orders").distinct("o_custkey").select("o_custkey"))
same("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_c = lambda t: t("customer").select("c_nationkey").rename({"c_nationkey": "k"})
_s = lambda t: Frame.of(t("supplier").select("s_nationkey").rename({"s_nationkey": "k"}).df)
_cs = lambda t: Frame.of(_c(t).df)
for _name, _call, _word in (("union_all", "union_all", "UNION ALL"), ("union_distinct", "union", "UNION"), ("intersect", "intersect", "INTERSECT"), ("except", "except_", "EXCEPT")):
    q(_name, f"SELECT c_nationkey AS k FROM customer {_word} SELECT s_nationkey AS k FROM supplier")(lambda t, c=_call: getattr(_cs(t), c)(_s(t)))
same("set_ops_sql", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION SELECT 99 AS k ORDER BY k LIMIT 10")
same("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), by_c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM by_c JOIN customer ON c_custkey = o_custkey WHERE n >= 3")

same("table_function", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT id FROM range(3, 9))", oracle="SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT range FROM range(3, 9))")
q("file_function", "SELECT r_name, r_regionkey FROM region WHERE r_regionkey > 1")(lambda t: t.sql(f"SELECT r_name, r_regionkey FROM read_parquet('{t.dir}/region.parquet') WHERE r_regionkey > 1"))
q("sql_from_path", "SELECT count(*) AS n FROM nation")(lambda t: t.sql(f"SELECT count(*) AS n FROM '{t.dir}/nation.parquet'"))
q("with_data", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda t: t.sql(f"WITH DATA (a = '{t.dir}/nation.parquet', b = '{t.dir}/region.parquet') SELECT n_name, r_name FROM a JOIN b ON n_regionkey = r_regionkey"))

# -- scalar functions -----------------------------------------------------------------------------

same("fn_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
q("fn_length", "SELECT n_nationkey, strlen(n_name)::INT AS v FROM nation")(lambda t: t("nation").select("n_nationkey").computed("v", S.byte_length(F.col("n_name"))))
q("fn_trim", "SELECT n_nationkey, n_name AS v FROM nation")(lambda t: t("nation").select("n_nationkey").computed("v", S.trim(F.concat(F.lit(" \t\n"), F.col("n_name"), F.lit("\r ")))))
q("fn_concat", "SELECT n_nationkey, n_name || '-' || n_regionkey AS v FROM nation")(lambda t: t("nation").select("n_nationkey").computed("v", S.concat(F.col("n_name"), F.lit("-"), F.col("n_regionkey"))))
same("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS v FROM customer")
same("fn_round", "SELECT c_custkey, round(c_acctbal, 1) AS v FROM customer")
same("fn_floor_ceil", "SELECT c_custkey, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c FROM customer")
same("fn_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'x') AS v FROM orders")
DATE_PARTS = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "qt": "quarter", "doy": "dayofyear"}
q("fn_extract", "SELECT event_id, " + ", ".join(f"{p}(ts)::INT AS {n}" for n, p in DATE_PARTS.items()) + " FROM events")(lambda t: t("events").df.select("event_id", *[S.date_part(p, F.col("ts")).alias(n) for n, p in DATE_PARTS.items()]))
q("fn_dayofweek", "SELECT event_id, dayofweek(ts)::INT AS v FROM events")(lambda t: t("events").df.select("event_id", S.date_part("dow", F.col("ts")).alias("v")))
q("fn_week", "SELECT event_id, ((dayofyear(ts) - 1) // 7 + 1)::INT AS v FROM events")(lambda t: t("events").df.select("event_id", S.date_part("week", F.col("ts")).alias("v")))
q("fn_millisecond", "SELECT event_id, 0 AS v FROM events")(lambda t: t("events").df.select("event_id", S.date_part("millisecond", F.col("ts")).alias("v")))
q("fn_date_trunc", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('month', ts)::TIMESTAMP AS m FROM events")(lambda t: t("events").df.select("event_id", S.date_trunc("hour", F.col("ts")).alias("h"), S.date_trunc("month", F.col("ts")).alias("m")))
q(
    "fn_date_add",
    "SELECT o_orderkey, epoch(o_orderdate + INTERVAL 45 DAY)::BIGINT AS d, (epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) + epoch(o_orderdate) - epoch(date_trunc('month', o_orderdate)))::BIGINT AS m FROM orders",
)(lambda t: t("orders").df.select("o_orderkey", S.epoch(S.date_add(F.col("o_orderdate"), 45, "day")).alias("d"), S.epoch(S.date_add(F.col("o_orderdate"), 1, "month")).alias("m")))
q("fn_date_diff", "SELECT l_orderkey, l_linenumber, floor((epoch(l_shipdate) - epoch(TIMESTAMP '1995-06-17')) / 86400)::BIGINT AS d, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 6)::BIGINT AS m FROM lineitem")(
    lambda t: t("lineitem").df.select("l_orderkey", "l_linenumber", *[S.date_diff(F.col("l_shipdate"), F.lit("1995-06-17").cast("timestamp"), p).alias(n) for p, n in (("day", "d"), ("month", "m"))])
)
q("fn_epoch", "SELECT event_id, floor(epoch(ts))::BIGINT AS v FROM events")(lambda t: t("events").df.select("event_id", S.epoch(F.col("ts")).alias("v")))
q("expr_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS a, CASE WHEN l_linenumber - 1 <> 0 THEN l_orderkey // (l_linenumber - 1) END AS b, -l_tax AS c FROM lineitem")(
    lambda t: t("lineitem").df.select("l_orderkey", "l_linenumber", S.divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("a"), S.integer_divide(F.col("l_orderkey"), F.col("l_linenumber") - 1).alias("b"), (-F.col("l_tax")).alias("c"))
)
same("expr_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS a, CASE WHEN o_totalprice > 150000 THEN 2 WHEN o_totalprice > 50000 THEN 1 ELSE 0 END AS b FROM orders")
same("expr_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS VARCHAR(10)) AS s, TRY_CAST(l_returnflag AS INT) AS n FROM lineitem")
same("expr_compare", "SELECT n_nationkey, n_nationkey = n_regionkey AS eq, n_nationkey <> n_regionkey AS ne, n_nationkey >= 5.5 AS ge FROM nation")

# -- vectors --------------------------------------------------------------------------------------

QUERY = [round(((i * 37) % 64 - 32) / 32, 4) for i in range(64)]
_V = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
_E = "embedding::DOUBLE[]"
for _m, _d in (("cosine", f"1 - list_cosine_similarity({_E}, {_V})"), ("l2", f"list_distance({_E}, {_V}) ** 2"), ("dot", f"-list_inner_product({_E}, {_V})")):
    q(f"vector_topk_{_m}", f"SELECT vec_id, label, round({_d}, 6) AS _distance FROM embeddings ORDER BY {_d}, vec_id LIMIT 20")(lambda t, m=_m: rounded(Frame.of(t("embeddings").vector("embedding", QUERY, 20, m).df).select("vec_id", "label", "_distance"), "_distance", digits=6))
q("sql_near", f"SELECT vec_id, label FROM embeddings WHERE label < 5 ORDER BY 1 - list_cosine_similarity({_E}, {_V}), vec_id LIMIT 7")(
    lambda t: t.sql(f"SELECT vec_id, label FROM embeddings WHERE label < 5 AND embedding NEAR [{', '.join(map(str, QUERY))}] TOPK 7")
)
q("fn_vec_distance", f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_V}), 6) AS c FROM embeddings")(lambda t: _vec(t))


def _vec(t):
    from lakeloom.operators.vector import distance

    return t("embeddings").df.select("vec_id", F.round(distance(F.col("embedding"), QUERY), 6).alias("c"))


# -- product analytics on events ------------------------------------------------------------------

same("events_hourly", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
same("events_daily", "SELECT date_trunc('day', ts) AS d, round(sum(value), 2) AS v FROM events GROUP BY 1", oracle="SELECT date_trunc('day', ts)::TIMESTAMP AS d, round(sum(value), 2) AS v FROM events GROUP BY 1")
Q["events_hourly"] = (Q["events_hourly"][0], "SELECT date_trunc('hour', ts)::TIMESTAMP AS h, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
_SESSIONS = """WITH steps AS (SELECT user_id, ts, event_id, CASE WHEN epoch_gap > 1800 OR epoch_gap IS NULL THEN 1 ELSE 0 END AS starts FROM
 (SELECT user_id, ts, event_id, {epoch}(ts) - lag({epoch}(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch_gap FROM events)),
 numbered AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM steps)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM numbered GROUP BY 1, 2"""
same("events_sessions", _SESSIONS.format(epoch="unix_timestamp"), oracle=_SESSIONS.format(epoch="floor(epoch").replace("floor(epoch(ts)", "floor(epoch(ts))"))
same("events_first_last", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
same("events_funnel", "WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN a ON a.user_id = e.user_id AND e.ts > a.t WHERE event_type = 'click' GROUP BY 1), c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN b ON b.user_id = e.user_id AND e.ts > b.t WHERE event_type = 'purchase' GROUP BY 1) SELECT (SELECT count(*) FROM a) AS viewed, (SELECT count(*) FROM b) AS clicked, (SELECT count(*) FROM c) AS bought")
same("events_retention", "WITH f AS (SELECT user_id, min(date_trunc('day', ts)) AS d0 FROM events GROUP BY 1), x AS (SELECT DISTINCT e.user_id, {diff} AS k FROM events e JOIN f ON f.user_id = e.user_id) SELECT CAST(k AS BIGINT) AS k, count(*) AS users FROM x GROUP BY 1".replace("{diff}", "datediff(e.ts, f.d0)"),
     oracle="WITH f AS (SELECT user_id, min(date_trunc('day', ts)) AS d0 FROM events GROUP BY 1), x AS (SELECT DISTINCT e.user_id, date_diff('day', f.d0, e.ts) AS k FROM events e JOIN f ON f.user_id = e.user_id) SELECT CAST(k AS BIGINT) AS k, count(*) AS users FROM x GROUP BY 1")
same("events_journey", "SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b")
same("events_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25")
q("events_tumble", "SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS window_start, to_timestamp(floor(epoch(ts) / 900) * 900 + 900)::TIMESTAMP AS window_end, count(*) AS n FROM events GROUP BY 1, 2")(lambda t: windows.tumble(t("events").df, "ts", "15 minutes", {"n": F.count("*")}))
q(
    "events_hop",
    """SELECT to_timestamp((floor(epoch(ts) / 300) - k) * 300)::TIMESTAMP AS window_start, to_timestamp((floor(epoch(ts) / 300) - k) * 300 + 900)::TIMESTAMP AS window_end, event_type, count(*) AS n
       FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2, 3""",
)(lambda t: windows.hop(t("events").df, "ts", "15 minutes", "5 minutes", {"n": F.count("*")}, ["event_type"]))
q(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800 THEN 0 ELSE 1 END AS starts, event_id FROM events),
       s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT min(ts)::TIMESTAMP AS window_start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)(lambda t: windows.session(t("events").df, "ts", "30 minutes", {"n": F.count("*")}, ["user_id"]))


# -- sources, sinks and versions: written to the shared folder and read back -----------------------


def _back(fmt: str, name: str, **options):
    def run(t):
        from lakeloom.sources.read import read_any
        from lakeloom.sources.scratch import scratch

        path = f"{scratch(t.spark)}.{fmt if fmt != 'parquet_dir' else 'parquet'}"
        t(name).df.write.format("csv" if fmt in ("csv", "tsv", "psv") else "parquet" if fmt == "parquet_dir" else fmt).options(**options).save(path)
        return read_any(t.spark, path)

    return run


q("scan_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")(_back("csv", "customer", header=True))
q("scan_tsv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")(_back("tsv", "customer", header=True, sep="\t"))
q("scan_json", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")(_back("json", "customer"))
q("scan_orc", "SELECT * FROM customer")(_back("orc", "customer"))
q("scan_parquet_dir", "SELECT * FROM supplier")(_back("parquet_dir", "supplier"))
q("from_json_rows", "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, 'x'), (2, NULL, 'true'), (3, 2.0, NULL)) v(a, b, c)")(
    lambda t: _rows(t.spark, [{"a": 1, "b": 1.5, "c": "x"}, {"a": 2, "c": True}, {"a": 3, "b": 2}])
)
q("from_csv_string", "SELECT * FROM (VALUES (1::BIGINT, true, 'x, \"y\"'), (2, false, NULL), (3, true, 'z')) v(a, b, c)")(lambda t: _csv(t.spark, 'a;b;c\n1;1;"x, ""y"""\n\n2;0; na \n3;1;z\n'))
_X = "((id * 7919 + 42 * 104729) % 1000003)"
q(
    "demo_data",
    f"""SELECT id, (['aden', 'bergen', 'callao', 'dakar', 'eilat', 'fremantle'])[({_X} % 6 + 1)::INT] AS region, (['grain', 'steel', 'timber', 'cotton', 'salt'])[(({_X} // 7) % 5 + 1)::INT] AS category,
       ({_X} % 50000) / 100 AS amount, strftime(DATE '2024-01-01' + (({_X} // 11) % 366)::INT, '%Y-%m-%d') AS created_at FROM (SELECT unnest(range(1, 1001)) AS id)""",
)(lambda t: _demo(t.spark))


def _written(write, read, name: str, columns: tuple[str, ...]):
    """A table written by a writer of this engine and read back by its reader."""

    def run(t):
        from lakeloom.sources import foreign
        from lakeloom.sources import write as writers
        from lakeloom.sources.scratch import scratch

        path = scratch(t.spark)
        write(writers, t(name).select(*columns).df.repartition(3), path)
        return read(foreign, t.spark, path)

    return run


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal")
_CUSTOMERS = f"SELECT {', '.join(_CUSTOMER)} FROM customer"
q("scan_arrow", _CUSTOMERS)(_written(lambda w, df, p: w.write_arrow(df, p), lambda f, spark, p: f.read_arrow(spark, p), "customer", _CUSTOMER))
q("scan_avro", _CUSTOMERS)(_written(lambda w, df, p: w.write_avro(df, p), lambda f, spark, p: f.read_avro(spark, p), "customer", _CUSTOMER))
q("scan_avro_snappy", _CUSTOMERS)(_written(lambda w, df, p: w.write_avro(df, p, "snappy"), lambda f, spark, p: f.read_avro(spark, p), "customer", _CUSTOMER))
q("scan_xlsx", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")(_written(lambda w, df, p: w.write_xlsx(df, f"{p}/book.xlsx"), lambda f, spark, p: f.read_xlsx(spark, f"{p}/book.xlsx"), "supplier", ("s_suppkey", "s_name", "s_acctbal")))
q("scan_iceberg", f"{_CUSTOMERS} UNION ALL {_CUSTOMERS}")(_written(lambda w, df, p: (w.write_iceberg(df, p), w.write_iceberg(df, p)), lambda f, spark, p: f.read_iceberg(spark, p), "customer", _CUSTOMER))
q("scan_iceberg_snapshot", _CUSTOMERS)(_written(lambda w, df, p: (w.write_iceberg(df, p), w.write_iceberg(df, p)), lambda f, spark, p: f.read_iceberg(spark, p, 1), "customer", _CUSTOMER))
q("scan_delta", f"{_CUSTOMERS} WHERE c_acctbal > 0 UNION ALL {_CUSTOMERS}")(_written(lambda w, df, p: (w.write_delta(df, p), w.write_delta(df.where("c_acctbal > 0"), p, overwrite=True), w.write_delta(df, p)), lambda f, spark, p: f.read_delta(spark, p), "customer", _CUSTOMER))
q("scan_delta_version", _CUSTOMERS)(_written(lambda w, df, p: (w.write_delta(df, p), w.write_delta(df.where("c_acctbal > 0"), p, overwrite=True)), lambda f, spark, p: f.read_delta(spark, p, 0), "customer", _CUSTOMER))


def _csv_options(t):
    from lakeloom.sources.read import read_csv
    from lakeloom.sources.scratch import scratch

    path = scratch(t.spark)
    t("part").df.select("p_partkey", "p_size").write.csv(path)
    return read_csv(t.spark, path, has_header=False).toDF("p_partkey", "p_size")


q("scan_csv_no_header", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part")(_csv_options)
q("to_csv", "SELECT n_nationkey || ',' || n_name AS line FROM nation")(lambda t: t("nation").select("n_nationkey", "n_name").csv_lines())
q("to_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")(lambda t: t("nation").select("n_nationkey", "n_name").json_lines())


def _rows(spark, rows):
    from lakeloom.sources.read import from_rows

    return from_rows(spark, rows)


def _csv(spark, text):
    from lakeloom.sources.read import from_csv

    return from_csv(spark, text)


def _demo(spark):
    from lakeloom.sources.read import demo

    return demo(spark)


def _versions(t, partition_by=None):
    """Two appends of orders: version 1 holds status F, version 2 also O."""
    from lakeloom.sources.scratch import scratch
    from lakeloom.sources.versions import VersionedTable

    table = VersionedTable(t.spark, scratch(t.spark))
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table.append(orders.filter("o_orderstatus", "=", "F").df, partition_by)
    table.append(orders.filter("o_orderstatus", "=", "O").df, partition_by)
    return table


_O = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
q("append", f"{_O} WHERE o_orderstatus IN ('F', 'O')")(lambda t: _versions(t).read())
q("append_partitioned", f"{_O} WHERE o_orderstatus = 'O'")(lambda t: Frame.of(_versions(t, "o_orderstatus").read()).filter("o_orderstatus", "=", "O"))
q("time_travel", f"{_O} WHERE o_orderstatus = 'F'")(lambda t: _versions(t).read(1))
q("version_diff", "SELECT o_orderkey, o_orderstatus, o_totalprice, 'ADD' AS change FROM orders WHERE o_orderstatus = 'O'")(lambda t: _versions(t).row_diff(1, 2))
q("list_versions", "SELECT * FROM (SELECT 1::BIGINT AS version, 'INSERT' AS operation, count(*) AS rows, 1::BIGINT AS fragments FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'INSERT', count(*), 2 FROM orders WHERE o_orderstatus IN ('F', 'O'))")(
    lambda t: _versions(t).history().select("version", "operation", "rows", "fragments")
)


def _evolved(t):
    table = _versions(t)
    table.add_column("note", "string", "none")
    table.drop_column("o_totalprice")
    return table.read()


q("schema_evolution", "SELECT o_orderkey, o_orderstatus, 'none' AS note FROM orders WHERE o_orderstatus IN ('F', 'O')")(_evolved)
q("partition_prune", f"{_O} WHERE o_orderstatus IN ('F')")(lambda t: Frame.of(_versions(t, "o_orderstatus").read()).where_in("o_orderstatus", ["F"]))


def _stored(t):
    from lakeloom.sources.scratch import scratch

    return t("part").filter("p_size", ">", 25).select("p_partkey", "p_size").materialize_as(scratch(t.spark))


q("materialize_as", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")(_stored)
q("sample_n", "SELECT p_partkey, p_size FROM part ORDER BY md5('7|' || p_partkey) LIMIT 25")(lambda t: t("part").select("p_partkey", "p_size").sample(25, 7, "p_partkey"))


def _compacted(t):
    table = _versions(t)
    table.compact()
    return table.read()


q("compact", f"{_O} WHERE o_orderstatus IN ('F', 'O')")(_compacted)


def _statement(text: str):
    def run(t):
        engine = Engine(t.spark)
        engine.register("orders_v", _versions(t))
        return engine.sql(text)

    return run


q("show_versions", "SELECT * FROM (VALUES (2::BIGINT, 'INSERT'), (1, 'INSERT')) v(version, operation)")(lambda t: _statement("SHOW VERSIONS FOR orders_v")(t).df.select("version", "operation"))
q("show_changes", "SELECT o_orderkey, o_orderstatus, o_totalprice, 'ADD' AS change FROM orders WHERE o_orderstatus = 'O'")(_statement("SHOW CHANGES FOR orders_v SINCE VERSION 1"))
q("diff_statement", "SELECT count(*)::BIGINT AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' LIMIT 100)")(lambda t: _statement("DIFF orders_v VERSION HEAD~1")(t).df.agg(F.count("*").alias("n")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark, sf_dir):
            out = fn(Tables(spark, sf_dir))
            return out if isinstance(out, DataFrame) else out.df

        return run

    return {name: bind(fn) for name, (fn, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
