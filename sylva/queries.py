"""The registered queries of the node table engine, each with the SQL that gives its rows from the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import aggregate as ag
from sylva.operators import arrange as ar
from sylva.operators import edit
from sylva.operators.serialize import to_xml
from sylva.plans.match import first_wins, match, match_all
from sylva.plans.xpath import read_queries
from sylva.session import scratch_path
from sylva.sources import documents, publish
from sylva.sources.shred import register_udtf, shred

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# base tables with the positions that publishing gives
LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS q, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p
  FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey)"""
EVENTS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)"""
CUSTOMERS = """c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS b FROM customer)"""
LINE_PRE = "CAST(3 + (k - 1) * 7 + {} AS INTEGER)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _orders(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(publish.orders_documents(spark, d))


# --- aggregates -------------------------------------------------------------------------------------------------------


def _one(func: str, scalar: str, path: str, digits: int | None = None):
    def run(nodes: DataFrame) -> DataFrame:
        out = ag.aggregate(nodes, "/order", [ag.Agg(func, scalar, path, "v")])
        return out.withColumn("v", F.round("v", digits)) if digits is not None else out

    return _orders(run)


def _per_order(value: str, type_: str, empty: str = "NULL") -> str:
    return f"WITH {LINES}, g AS (SELECT l_orderkey, {value} AS v FROM l GROUP BY 1) SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS ctx_pre, CAST(coalesce(v, {empty}) AS {type_}) AS v FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"


query("agg_sum_float", _per_order("sum(CAST(l_quantity AS DECIMAL(18,2)))", "DOUBLE", "0"))(_one("sum", "float", "lineitem/quantity", 2))
query("agg_sum_int", _per_order("sum(CAST(trunc(l_quantity) AS BIGINT))", "BIGINT", "0"))(_one("sum", "int", "lineitem/quantity"))
query("agg_avg_float", _per_order("round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)", "DOUBLE"))(_one("average", "float", "lineitem/price", 6))
query("agg_avg_int", _per_order("sum(CAST(trunc(l_quantity) AS BIGINT)) // count(*)", "BIGINT"))(_one("average", "int", "lineitem/quantity"))
query("agg_min", _per_order("min(CAST(l_extendedprice AS DECIMAL(18,2)))", "DOUBLE"))(_one("min", "float", "lineitem/price"))
query("agg_max", _per_order("max(CAST(l_extendedprice AS DECIMAL(18,2)))", "DOUBLE"))(_one("max", "float", "lineitem/price"))
query("agg_sum_text", _per_order("string_agg(q, ' ' ORDER BY k)", "VARCHAR", "''"))(_one("sum", "text", "lineitem/quantity"))
query("agg_first", _per_order("arg_min(p, k)", "VARCHAR"))(_one("first", "text", "lineitem/price"))
query("agg_last", _per_order("arg_max(p, k)", "VARCHAR"))(_one("last", "text", "lineitem/price"))
query("agg_choice_n", _per_order("max(CASE WHEN k = 2 THEN p END)", "VARCHAR"))(_one("id#2", "text", "lineitem/price"))
query("agg_count", _per_order("count(*)", "BIGINT", "0"))(_one("count", "int", "lineitem"))
query("agg_count_text_runs", _per_order("2 * count(*)", "BIGINT", "0"))(_one("count_text_runs", "int", "lineitem"))
query("agg_depth", _per_order("max(2)", "BIGINT"))(_one("max", "depth", "//quantity"))


@query("agg_length", "SELECT conv_id AS doc_id, CAST(1 AS INTEGER) AS ctx_pre, CAST(sum(octet_length(encode(trim(text, ' ' || chr(9) || chr(10) || chr(13))))) AS BIGINT) AS v FROM conversations GROUP BY 1")
def agg_length(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate(publish.conversation_documents(spark, d), "/conversation", [ag.Agg("sum", "length", "turn", "v")])


@query("agg_default_context", f"WITH {EVENTS} SELECT user_id AS doc_id, CAST(0 AS INTEGER) AS ctx_pre, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM e GROUP BY 1")
def agg_default_context(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate(publish.events_documents(spark, d), "/", [ag.Agg("sum", "float", "//value", "v")]).withColumn("v", F.round("v", 2))


@query("agg_inner_context", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(1)} AS ctx_pre, CAST(l_quantity AS DOUBLE) AS q, p, CAST(1 AS BIGINT) AS n FROM l")
def agg_inner_context(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate(publish.orders_documents(spark, d), "/order/lineitem", [ag.Agg("sum", "float", "quantity", "q"), ag.Agg("first", "text", "price", "p"), ag.Agg("count", "int", "*/text()", "n0")]).select("doc_id", "ctx_pre", "q", "p", (F.col("n0") / 2).cast("bigint").alias("n"))


@query("agg_filtered_context", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(1)} AS ctx_pre, CAST(l_quantity AS DOUBLE) AS v FROM l WHERE l_returnflag = 'R'")
def agg_filtered_context(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate(publish.orders_documents(spark, d), "//lineitem[@flag='R']", [ag.Agg("max", "float", "quantity", "v")], strict=False)


TWO = [ag.Context("/order", (ag.Agg("sum", "int", "lineitem/quantity"), ag.Agg("count", "int", "lineitem"))), ag.Context("/order/lineitem", (ag.Agg("max", "float", "price"),))]


@query("agg_two_contexts", f"""WITH {LINES}, g AS (SELECT l_orderkey, sum(CAST(trunc(l_quantity) AS BIGINT)) AS s, count(*) AS n FROM l GROUP BY 1),
o AS (SELECT o_orderkey, CAST(coalesce(s, 0) AS VARCHAR) AS s, CAST(coalesce(n, 0) AS VARCHAR) AS n FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS ctx_ix, CAST(1 AS INTEGER) AS ctx_pre, '/order' AS ctx_path, CAST(0 AS INTEGER) AS agg_ix, 'sum' AS agg_type, 'lineitem/quantity' AS agg_path, s AS value FROM o
UNION ALL SELECT o_orderkey, 0, 1, '/order', 1, 'count', 'lineitem', n FROM o
UNION ALL SELECT l_orderkey, 1, {LINE_PRE.format(1)}, '/order/lineitem', 0, 'max', 'price', CAST(CAST(l_extendedprice AS DECIMAL(18,6)) AS VARCHAR) FROM l""")  # fmt: skip
def agg_two_contexts(spark: SparkSession, d: str) -> DataFrame:
    return ag.aggregate_report(publish.orders_documents(spark, d), TWO)


@query("agg_report_xml", """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, '<aggregates><context path="/region"><aggregate aggtype="count" path="nation">' || count(n_nationkey) || '</aggregate><aggregate aggtype="last" path="nation/name">' || coalesce(arg_max(n_name, n_nationkey), '') || '</aggregate></context></aggregates>' AS xml FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def agg_report_xml(spark: SparkSession, d: str) -> DataFrame:
    return ag.report_xml(ag.aggregate_report(publish.region_documents(spark, d), [ag.Context("/region", (ag.Agg("count", "text", "nation"), ag.Agg("last", "text", "nation/name")))]))


@query("agg_report_tags", """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, '<report><region path="/region"><nations aggtype="count" path="nation">' || count(n_nationkey) || '</nations><aggregate aggtype="last" path="nation/name">' || coalesce(arg_max(n_name, n_nationkey), '') || '</aggregate></region></report>' AS xml FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def agg_report_tags(spark: SparkSession, d: str) -> DataFrame:
    out_tag, contexts = ag.read_commands("-t report -c /region -t region -a nation count text -t nations\n-a nation/name last text")
    return ag.report_xml(ag.aggregate_report(publish.region_documents(spark, d), contexts), out_tag, contexts=contexts)


@query("agg_based_int", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS ctx_pre, CAST(3 * c_custkey AS BIGINT) AS v FROM customer")
def agg_based_int(spark: SparkSession, d: str) -> DataFrame:
    """Each key in decimal, hexadecimal and octal digits."""
    key = F.col("c_custkey")
    texts = [key.cast("string"), F.concat(F.lit("0x"), F.hex(key.cast("long"))), F.concat(F.lit("0"), F.conv(key.cast("string"), 10, 8))]
    nodes = publish.flat_documents(spark.read.parquet(f"{d}/customer.parquet"), key, publish.Leaf("keys", children=tuple(publish.Leaf("n", text=t) for t in texts)))
    return ag.aggregate(nodes, "/", [ag.Agg("sum", "int", "/keys/n", "v")])


# --- paths ------------------------------------------------------------------------------------------------------------


def _path(path: str, strict: bool = True, documents: Callable = publish.orders_documents):
    return lambda spark, d: match(documents(spark, d), path, strict=strict).select("doc_id", "pre", "value")


def _lines(place: int, value: str, where: str = "") -> str:
    return f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(place)} AS pre, CAST({value} AS VARCHAR) AS value FROM l {where}"


query("path_document", "SELECT o_orderkey AS doc_id, CAST(2 + 1 + 7 * count(l_orderkey) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(_orders(lambda n: edit.select_subtrees(n, "/").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))))
query("path_child", _lines(5, "q"))(_path("/order/lineitem/quantity/text()"))
query("path_descendant", _lines(7, "p"))(_path("//price/text()"))
query("path_star", _lines(7, "p"))(_path("/order/*/price/text()"))
query("path_attr", _lines(2, "l_partkey"))(_path("//lineitem/@part"))
query("path_any_attr", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(2)} AS pre, CAST(l_partkey AS VARCHAR) AS value FROM l UNION ALL SELECT l_orderkey, {LINE_PRE.format(3)}, l_returnflag FROM l")(_path("/order/lineitem/@*"))
query("path_text", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(5)} AS pre, q AS value FROM l UNION ALL SELECT l_orderkey, {LINE_PRE.format(7)}, p FROM l")(_path("//text()"))
query("path_self", _lines(3, "l_returnflag"))(_path("/order/./lineitem/@flag"))
query("pred_exists", _lines(5, "q"))(_path("/order/lineitem[@flag]/quantity/text()"))
query("pred_eq_int", _lines(7, "p", "WHERE l_partkey = 105"))(_path("/order/lineitem[@part=105]/price/text()"))
query("pred_eq_str", _lines(5, "q", "WHERE l_returnflag = 'R'"))(_path("//lineitem[@flag='R']/quantity/text()"))
query("pred_ne", _lines(5, "q", "WHERE l_returnflag <> 'R'"))(_path("//lineitem[@flag!='R']/quantity/text()"))
query("pred_lt_float", _lines(7, "p", "WHERE l_extendedprice < 20000.5"))(_path("/order/lineitem[price/text()<20000.5]/price/text()"))
query("pred_ge_int", _lines(2, "l_partkey", "WHERE l_partkey >= 100"))(_path("/order/lineitem[@part>=100]/@part"))
query("pred_position", _lines(2, "l_partkey", "WHERE k = 2"))(_path("/order/lineitem[2]/@part"))
query("pred_star_position", _lines(2, "l_partkey", "WHERE k = 1"))(_path("/order/*[1]/@part"))
query("pred_position_then_attr", _lines(7, "p", "WHERE k = 2 AND l_returnflag = 'R'"))(_path("/order/lineitem[2][@flag='R']/price/text()"))
query("pred_chain", _lines(5, "q", "WHERE l_returnflag = 'A' AND l_partkey < 50"))(_path("/order/lineitem[@flag='A'][@part<50]/quantity/text()"))
query("pred_last_step", _lines(6, "NULL", "WHERE l_extendedprice > 90000"))(_path("//price[text()>90000.0]", False))
query("pred_and_or", _lines(5, "q", "WHERE l_returnflag = 'A' AND l_partkey < 50 OR l_returnflag = 'N' AND l_partkey > 150"))(_path("//lineitem[@flag='A' and @part<50 or @flag='N' and @part>150]/quantity/text()", False))
query("pred_whole_text", _lines(6, "NULL", "WHERE l_extendedprice > 90000"))(_path("//price[.>90000.0]", False))
query("pred_element", _lines(2, "l_partkey", "WHERE l_quantity = 7"))(_path("//lineitem[quantity=7]/@part", False))
query("path_parent", _lines(2, "l_partkey", "WHERE l_quantity = 7"))(_path("//quantity[text()=7]/../@part", False))
query("path_alternation", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(5)} AS pre, q AS value FROM l UNION ALL SELECT l_orderkey, {LINE_PRE.format(7)}, p FROM l")(_path("/order/lineitem/(quantity|price)/text()", False))
CONVERSATION = "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id AS doc_id, CAST(2 + (k - 1) * 3 + 3 AS INTEGER) AS pre, text AS value FROM t WHERE {}"
query("pred_contains", CONVERSATION.format("contains(role, 'ss')"))(_path("//turn[contains(@role,'ss')]/text()", documents=publish.conversation_documents))
query("pred_starts", CONVERSATION.format("starts_with(role, 'us')"))(_path("//turn[starts-with(@role,'us')]/text()", documents=publish.conversation_documents))


@query("path_many", f"WITH {LINES} SELECT 'flags' AS var, l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 2 UNION ALL SELECT 'parts', l_orderkey, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'second', l_orderkey, count(*) FROM l WHERE k = 2 GROUP BY 2 UNION ALL SELECT 'attributes', o_orderkey, 2 + 2 * count(l_orderkey) FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 2")
def path_many(spark: SparkSession, d: str) -> DataFrame:
    found = match_all(publish.orders_documents(spark, d), {"flags": "//@flag", "parts": "/order/lineitem/@part", "attributes": "//@*", "second": "/order/lineitem[2]"})
    return found.groupBy("var", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("path_file", f"WITH {LINES} SELECT '//lineitem/@flag' AS var, l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 2 UNION ALL SELECT '/order/lineitem[@flag=''R'']/price', l_orderkey, count(*) FROM l WHERE l_returnflag = 'R' GROUP BY 2")
def path_file(spark: SparkSession, d: str) -> DataFrame:
    """The queries of a query file."""
    found = match_all(publish.orders_documents(spark, d), read_queries("//lineitem/@flag\n\n/order/lineitem[@flag='R']/price\n"))
    return found.groupBy("var", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("path_precedence", f"WITH {LINES} SELECT 'flags' AS var, l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 2 UNION ALL SELECT 'any', o_orderkey, 2 + count(l_orderkey) FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 2")
def path_precedence(spark: SparkSession, d: str) -> DataFrame:
    found = first_wins(match_all(publish.orders_documents(spark, d), {"flags": "//@flag", "any": "//@*"}), {"flags": 0.0, "any": 1.0})
    return found.groupBy("var", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("path_relative", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(1)} AS ctx_pre, {LINE_PRE.format(7)} AS pre, p AS value FROM l WHERE l_returnflag = 'R'")
def path_relative(spark: SparkSession, d: str) -> DataFrame:
    nodes = publish.orders_documents(spark, d)
    return match(nodes, "//price/text()", match(nodes, "/order/lineitem[@flag='R']", strict=False)).select("doc_id", "ctx_pre", "pre", "value")


@query("select_xml", f"""WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(1)} AS root_pre, '<lineitem part="' || l_partkey || '" flag="R"><quantity>' || q || '</quantity><price>' || p || '</price></lineitem>' AS xml FROM l WHERE l_returnflag = 'R'""")
def select_xml(spark: SparkSession, d: str) -> DataFrame:
    return to_xml(edit.select_subtrees(publish.orders_documents(spark, d), "//lineitem[@flag='R']", strict=False), ["doc_id", "root_pre"])


# --- sort, head, tail -------------------------------------------------------------------------------------------------


PRICE = "/order/lineitem/price/text()"


def _sorted(*keys: str):
    return _orders(lambda n: ar.sort(n, "/order", [ar.Elem("lineitem", keys)], paths=[PRICE]).where("path = '/order/lineitem/price/text()'").select("doc_id", "pre", "value"))


def _sorted_sql(order: str) -> str:
    return f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}, k) AS n FROM l) SELECT l_orderkey AS doc_id, CAST(3 + n * 7 AS INTEGER) AS pre, p AS value FROM r"


query("sort_one_key", _sorted_sql("p"))(_sorted("price/text()"))
query("sort_two_keys", _sorted_sql("l_returnflag, q"))(_sorted("@flag", "quantity"))


@query("sort_two_elements", f"""WITH {CUSTOMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY b, k) AS n, count(*) OVER (PARTITION BY c_nationkey) AS m FROM c)
SELECT CAST(c_nationkey AS BIGINT) AS doc_id, '/nation/customer/balance/text()' AS path, CAST(2 + n * 7 AS INTEGER) AS pre, b AS value FROM r
UNION ALL SELECT n_nationkey, '/nation/name/text()', CAST(2 + 7 * count(c_custkey) + 2 AS INTEGER), n_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")  # fmt: skip
def sort_two_elements(spark: SparkSession, d: str) -> DataFrame:
    nodes = ar.sort(publish.customer_documents(spark, d), "/nation", [ar.Elem("customer", ("balance/text()",)), ar.Elem("name")])
    return nodes.where("path in ('/nation/customer/balance/text()', '/nation/name/text()')").select("doc_id", "path", "pre", "value")


@query("sort_typed_key", f"WITH {CUSTOMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, CAST(regexp_extract(c_name, '^Customer#([0-9]+)$', 1) AS INTEGER), k) AS n FROM c) SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(2 + (n - 1) * 7 + 5 AS INTEGER) AS pre, c_name AS value FROM r")
def sort_typed_key(spark: SparkSession, d: str) -> DataFrame:
    nodes = edit.typed(publish.customer_documents(spark, d), "//customer/name:Customer#%i")
    return ar.sort(nodes, "/nation", [ar.Elem("customer", ("@segment", "name/text()"))]).where("path = '/nation/customer/name/text()'").select("doc_id", "pre", "value")


query("sort_first_path_wins", _sorted_sql("l_returnflag <> 'R'"))(_orders(lambda n: ar.sort(n, "/order", [ar.Elem("lineitem[@flag='R']"), ar.Elem("lineitem")], strict=False, paths=[PRICE]).where("path = '/order/lineitem/price/text()'").select("doc_id", "pre", "value")))
query("sort_whole_document", _sorted_sql("p") + " UNION ALL SELECT o_orderkey, CAST(2 AS INTEGER), CAST(o_orderkey AS VARCHAR) FROM orders")(_orders(lambda n: ar.sort(n, "/", [ar.Elem("//lineitem", ("price/text()",))]).where("path in ('/order/lineitem/price/text()', '/order/@key')").select("doc_id", "pre", "value")))


@query("sort_drops_the_rest", f"WITH {CUSTOMERS} SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(2 + 7 * count(c_custkey) AS BIGINT) AS n, CAST(0 AS BIGINT) AS names FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY 1")
def sort_drops_the_rest(spark: SparkSession, d: str) -> DataFrame:
    """What is no element of the context goes, but for the context's attributes."""
    nodes = ar.sort(publish.customer_documents(spark, d), "/nation", [ar.Elem("customer", ("balance",))])
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("path").startswith("/nation/name"), 1)).alias("names"))


@query("head_path_by_path", f"""WITH {CUSTOMERS} SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(2 + (k - 1) * 7 + 5 AS INTEGER) AS pre, c_name AS value FROM c WHERE k <= 2
UNION ALL SELECT n_nationkey, CAST(2 + 7 * least(2, count(c_custkey)) + 2 AS INTEGER), n_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def head_path_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Elements stand in the order of their paths, not of the document."""
    nodes = ar.head(publish.customer_documents(spark, d), "/nation", [ar.Elem("customer", n=2), ar.Elem("name")])
    return nodes.where("path in ('/nation/customer/name/text()', '/nation/name/text()')").select("doc_id", "pre", "value")


def _cut(keep: Callable, **options):
    return _orders(lambda n: keep(n, "/order", [ar.Elem("lineitem", **options)], paths=["/order/lineitem/@part"]).where("path = '/order/lineitem/@part'").select("doc_id", "pre", "value"))


query("head_n", _lines(2, "l_partkey", "WHERE k <= 2"))(_cut(ar.head, n=2))
query("head_negative", f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) AS up, count(*) OVER (PARTITION BY l_orderkey) AS m FROM l) SELECT l_orderkey AS doc_id, CAST(3 + (k - 1 - greatest(m - 2, 0)) * 7 + 2 AS INTEGER) AS pre, CAST(l_partkey AS VARCHAR) AS value FROM r WHERE up <= 2")(_cut(ar.head, n=-2))
query("tail_n", f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) AS up, count(*) OVER (PARTITION BY l_orderkey) AS m FROM l) SELECT l_orderkey AS doc_id, CAST(3 + (k - 1 - greatest(m - 3, 0)) * 7 + 2 AS INTEGER) AS pre, CAST(l_partkey AS VARCHAR) AS value FROM r WHERE up <= 3")(_cut(ar.tail, n=3))


@query("head_default", f"WITH {CUSTOMERS} SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(2 + (k - 1) * 7 + 5 AS INTEGER) AS pre, c_name AS value FROM c WHERE k <= 10")
def head_default(spark: SparkSession, d: str) -> DataFrame:
    return ar.head(publish.customer_documents(spark, d), "/nation", [ar.Elem("customer")]).where("path = '/nation/customer/name/text()'").select("doc_id", "pre", "value")


@query("head_whole_document", f"WITH {LINES} SELECT l_orderkey AS doc_id, CAST(3 + 2 AS INTEGER) AS pre, CAST(l_partkey AS VARCHAR) AS value FROM l WHERE k = 1")
def head_whole_document(spark: SparkSession, d: str) -> DataFrame:
    return ar.head(publish.orders_documents(spark, d), "/", [ar.Elem("//lineitem", n=1)]).where("path = '/order/lineitem/@part'").select("doc_id", "pre", "value")


# --- edits ------------------------------------------------------------------------------------------------------------


def _by_path(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depths"), F.sum("sib").alias("sibs"))


def _counts(*rows: tuple[str, str]) -> str:
    """Rows of (path, SQL of n, depths and sibs)."""
    return " UNION ALL ".join(f"SELECT '{p}' AS path, CAST(n AS BIGINT) AS n, CAST(n * {depth} AS BIGINT) AS depths, CAST({sibs} AS BIGINT) AS sibs FROM {of}" for p, depth, sibs, of in rows)


SUMS = f"WITH {LINES}, o AS (SELECT count(*) AS n FROM orders), a AS (SELECT count(*) AS n, sum(k) AS ks FROM l), r AS (SELECT count(*) AS n, sum(k) AS ks FROM l WHERE k > 1) "
ROOT = [("/order", 1, "n", "o"), ("/order/@key", 1, "NULL", "o"), ("/order/@status", 1, "NULL", "o")]
LEAVES = [("/order/lineitem/quantity", 3, "n", "{}"), ("/order/lineitem/quantity/text()", 3, "NULL", "{}"), ("/order/lineitem/price", 3, "n", "{}"), ("/order/lineitem/price/text()", 3, "NULL", "{}")]


def _of(rows, table: str):
    return [(p, d, s, t.format(table)) for p, d, s, t in rows]


query("delete_subtree", SUMS + _counts(*ROOT, ("/order/lineitem", 2, "ks - n", "r"), ("/order/lineitem/@part", 2, "NULL", "r"), ("/order/lineitem/@flag", 2, "NULL", "r"), *_of(LEAVES, "r")))(_orders(lambda n: _by_path(edit.delete(n, ["/order/lineitem[1]"]))))
query("delete_attr", SUMS + _counts(*ROOT, ("/order/lineitem", 2, "ks", "a"), ("/order/lineitem/@part", 2, "NULL", "a"), *_of(LEAVES[:2], "a")))(_orders(lambda n: _by_path(edit.delete(n, ["//@flag", "//price"]))))
query("flatten_outer", SUMS + _counts(*ROOT, ("/order/quantity", 2, "ks", "a"), ("/order/quantity/text()", 2, "NULL", "a"), ("/order/price", 2, "ks", "a"), ("/order/price/text()", 2, "NULL", "a")))(_orders(lambda n: _by_path(edit.flatten(n, ["//lineitem", "//price"]))))
query("flatten_recursive", SUMS + _counts(*ROOT, ("/order/quantity", 2, "ks", "a"), ("/order/quantity/text()", 2, "NULL", "a"), ("/order/text()", 1, "NULL", "a")))(_orders(lambda n: _by_path(edit.flatten(n, ["//lineitem", "//price"], recursive=True))))


PLACED = "doc_id", "pre", "last", "parent", "depth", "value"
query("delete_values", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(7)} AS pre, {LINE_PRE.format(7)} AS last, {LINE_PRE.format(6)} AS parent, CAST(3 AS INTEGER) AS depth, p AS value FROM l WHERE k > 1")(_orders(lambda n: edit.delete(n, ["/order/lineitem[1]", "//quantity"]).where("path = '/order/lineitem/price/text()'").select(*PLACED)))
query("flatten_values", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(7)} AS pre, {LINE_PRE.format(7)} AS last, CAST(1 AS INTEGER) AS parent, CAST(1 AS INTEGER) AS depth, p AS value FROM l UNION ALL SELECT l_orderkey, {LINE_PRE.format(5)}, {LINE_PRE.format(5)}, {LINE_PRE.format(4)}, 2, q FROM l")(_orders(lambda n: edit.flatten(n, ["//lineitem", "//price"], recursive=True).where("kind = 'text'").select(*PLACED)))
query("roundtrip_values", f"WITH {LINES} SELECT l_orderkey AS doc_id, {LINE_PRE.format(7)} AS pre, {LINE_PRE.format(7)} AS last, {LINE_PRE.format(6)} AS parent, CAST(3 AS INTEGER) AS depth, p AS value FROM l")(_orders(lambda n: shred(to_xml(n), paths=["/order/lineitem/price/text()"]).where("path = '/order/lineitem/price/text()'").select(*PLACED)))


@query("store_roundtrip", _lines(7, "p", "WHERE l_returnflag = 'R'"))
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A node table written in order of its paths, found to be one, and read again row group by row group."""
    path = scratch_path(spark, "sylva-nodes")
    documents.write_nodes(publish.orders_documents(spark, d), path)
    return match(documents.read_documents(spark, path), "//lineitem[@flag='R']/price/text()", once=True).select("doc_id", "pre", "value")


@query("read_files", "SELECT r_name AS name, CAST(count(n_nationkey) AS BIGINT) AS n, min(n_name) AS low FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def read_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document, written and read as XML."""
    path = scratch_path(spark, "sylva-files")
    to_xml(publish.region_documents(spark, d)).write.partitionBy("doc_id").text(path)
    nodes = documents.read_documents(spark, path)
    names = match(nodes, "/region/@name").select("doc_id", F.col("value").alias("name"))
    found = ag.aggregate(nodes, "/region", [ag.Agg("count", "text", "nation", "n")])
    low = match(nodes, "/region/nation/name/text()").groupBy("doc_id").agg(F.min("value").alias("low"))
    return names.join(found, "doc_id").join(low, "doc_id", "left").select("name", "n", "low")


@query("typed_extract", f"WITH {CUSTOMERS} SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(4 + (k - 1) * 7 + 5 AS INTEGER) AS pre, 'Customer#' AS t_prefix, CAST(regexp_extract(c_name, '^Customer#([0-9]+)$', 1) AS INTEGER) AS t_int, '' AS t_suffix FROM c")
def typed_extract(spark: SparkSession, d: str) -> DataFrame:
    return edit.typed(publish.customer_documents(spark, d), "//customer/name:Customer#%i").where("t_int is not null").select("doc_id", "pre", "t_prefix", "t_int", "t_suffix")


@query("cat_union", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(1 + 2 + 3 * count(n_nationkey) + count(n_nationkey) AS BIGINT) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT n_nationkey + 1 + (SELECT max(r_regionkey) FROM region), 4 + 7 * count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def cat_union(spark: SparkSession, d: str) -> DataFrame:
    return edit.concatenate(publish.region_documents(spark, d), publish.customer_documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- whole documents, text in and out ---------------------------------------------------------------------------------

query("stat_depth", f"WITH {LINES}, g AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1) SELECT o_orderkey AS doc_id, CAST(1 + 3 * coalesce(n, 0) AS BIGINT) AS n_elements, CAST(CASE WHEN n IS NULL THEN 1 ELSE 3 END AS INTEGER) AS max_depth, round(CAST(1 + 8 * coalesce(n, 0) AS DOUBLE) / (1 + 3 * coalesce(n, 0)), 6) AS avg_depth FROM orders LEFT JOIN g ON l_orderkey = o_orderkey")(_orders(lambda n: ag.statistics(n).withColumn("avg_depth", F.round("avg_depth", 6))))
query("count_elements", f"WITH {LINES} SELECT CAST((SELECT count(*) FROM orders) + 3 * count(*) AS BIGINT) AS n_elements FROM l")(_orders(ag.count_elements))
query("to_xml", f"""WITH {LINES} SELECT o_orderkey AS doc_id, '<order key="' || o_orderkey || '" status="' || o_orderstatus || '">' || coalesce(string_agg('<lineitem part="' || l_partkey || '" flag="' || l_returnflag || '"><quantity>' || q || '</quantity><price>' || p || '</price></lineitem>', '' ORDER BY k), '') || '</order>' AS xml FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")(_orders(to_xml))
query("xml_roundtrip", SUMS + _counts(*ROOT, ("/order/lineitem", 2, "ks", "a"), ("/order/lineitem/@part", 2, "NULL", "a"), ("/order/lineitem/@flag", 2, "NULL", "a"), *_of(LEAVES, "a")))(_orders(lambda n: _by_path(shred(to_xml(n)))))
query("shred_few_paths", _per_order("sum(CAST(l_extendedprice AS DECIMAL(18,2)))", "DOUBLE", "0"))(_orders(lambda n: ag.aggregate(shred(to_xml(n), paths=["/order", "/order/lineitem/price"]), "/order", [ag.Agg("sum", "float", "lineitem/price", "v")]).withColumn("v", F.round("v", 2))))


@query("shred_udtf", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(3 + 4 * count(n_nationkey) AS BIGINT) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def shred_udtf(spark: SparkSession, d: str) -> DataFrame:
    register_udtf(spark, "sylva_shred")
    to_xml(publish.region_documents(spark, d)).createOrReplaceTempView("sylva_region_xml")
    return spark.sql("SELECT t.doc_id, count(*) AS n FROM sylva_region_xml r, LATERAL sylva_shred(r.doc_id, r.xml) t GROUP BY t.doc_id")


@query("shred_lenient", f"WITH {LINES} SELECT l_orderkey AS doc_id, l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1, 2")
def shred_lenient(spark: SparkSession, d: str) -> DataFrame:
    loose = to_xml(publish.orders_documents(spark, d)).withColumn("xml", F.regexp_replace(F.regexp_replace("xml", '="(\\w+)"', " = $1"), "</price>", "</p>"))
    flags = match(shred(loose, dialect="lenient", paths=["/order/lineitem/@flag"]), "/order/lineitem/@flag")
    return flags.groupBy("doc_id", F.col("value").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("html_elements", "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<(p|li|h1|a)[ >]')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '<(p|li|h1|a)[ >]')")
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return shred(pages, dialect="html").where("kind = 'element' AND tag IN ('p', 'li', 'h1', 'a')").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


#: Depth by running sums over the tags, as the pages have them: a paragraph's end closes an open <b> too, one paragraph ends the one
#: before it unless a <b> is open, and the article closes what is open in it.
PAGE_STATISTICS = r"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'), '</?[a-z][a-z0-9]*') AS g FROM pages),
u AS (SELECT page_id, unnest(g) AS tag, unnest(range(len(g))) AS k FROM t),
v AS (SELECT *, lag(tag) OVER o AS b, lag(tag, 2) OVER o AS a FROM u WINDOW o AS (PARTITION BY page_id ORDER BY k)),
w AS (SELECT *, CASE WHEN tag IN ('<meta', '<br') THEN 0 WHEN tag = '</p' AND b = '<br' AND a = '<b' THEN -2 WHEN tag = '<p' AND b = '<p' THEN 0 WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS d FROM v),
x AS (SELECT page_id, tag, CASE WHEN tag = '<footer' THEN 3 ELSE sum(d) OVER (PARTITION BY page_id ORDER BY k) + CASE WHEN tag IN ('<meta', '<br') THEN 1 ELSE 0 END END AS depth FROM w)
SELECT page_id AS doc_id, count(*) AS n_elements, CAST(max(depth) AS INTEGER) AS max_depth, round(avg(depth), 6) AS avg_depth FROM x WHERE tag NOT LIKE '</%' GROUP BY 1"""


@query("html_pages_stat", PAGE_STATISTICS)
def html_pages_stat(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return ag.statistics(shred(pages, dialect="html")).withColumn("avg_depth", F.round("avg_depth", 6))


@query("html_links", "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<a href=%'")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return match(shred(pages, dialect="html", paths=["//a/@href"]), "//a/@href").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
