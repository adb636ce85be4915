"""What larger tables brought to light: prices between whole numbers, and plans that deal base rows by document once."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva.operators import aggregate as ag
from sylva.operators import arrange as ar
from sylva.operators import edit
from sylva.operators.serialize import to_xml
from sylva.plans.match import match
from sylva.queries import ORACLE_SQL, QUERIES
from sylva.sources import documents, publish
from sylva.sources.shred import shred


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Orders with and without lines, lines without an order, keys of no order at all, prices next to 90000."""
    d, con = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    con.sql(f"COPY (SELECT k AS o_orderkey, 'O' AS o_orderstatus FROM unnest([1, 2, 3, 40, NULL]::BIGINT[]) t(k)) TO '{d}/orders.parquet' (FORMAT parquet)")
    lines = ", ".join(f"({o}, {n}, {p}, {p}, '{f}', {q}, {x}, TIMESTAMP '2020-01-0{n}')" for o, n, p, f, q, x in [
        (1, 1, 7, "R", 3, 90000.0), (1, 2, 5, "A", 7, 90000.5), (1, 2, 4, "R", 7, 89999.99), (2, 1, 9, "N", 12, 90001.0), (2, 3, 9, "R", 2, 12.25), (40, 1, 1, "A", 7, 90000.01), (5, 1, 1, "R", 7, 95000.0), ("NULL", 1, 1, "R", 7, 95000.0),
    ])
    con.sql(f"COPY (SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, f AS l_returnflag, q::DOUBLE AS l_quantity, x::DOUBLE AS l_extendedprice, t AS l_shipdate FROM (VALUES {lines}) v(o, n, p, s, f, q, x, t)) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    return d


def same(spark, d, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet' WHERE {t[0]}_orderkey IS NOT NULL")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, d)
    got = got.where("doc_id is not null") if "doc_id" in got.columns else got
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["pred_whole_text", "pred_last_step"])
def test_prices_between_whole_numbers(spark, tables, name):
    same(spark, tables, name)


def code(spark, df) -> int:
    """Bytes of the largest method that Spark generates for a plan."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", [None, "sort_one_key", "sort_two_keys", "sort_first_path_wins", "head_n", "head_negative", "tail_n", "agg_filtered_context", "pred_and_or", "pred_element", "to_xml"])
def test_generated_code_is_compiled(spark, tables, name):
    """The JVM never compiles methods of 8,000 bytes and more."""
    assert code(spark, QUERIES[name](spark, tables) if name else publish.orders_documents(spark, tables)) < 8000


@pytest.mark.parametrize("how, keys", [(ar.sort, ("price/text()",)), (ar.sort, ("@flag", "quantity")), (ar.sort, ()), (ar.head, ()), (ar.tail, ())])
@pytest.mark.parametrize("paths", [("lineitem",), ("lineitem[@flag='R']", "lineitem"), ("lineitem[2]",), ("lineitem[@flag='R' or @part<6]",)])
def test_rows_that_are_asked_for(spark, tables, how, keys, paths):
    """Leaving out what is not asked for changes no row that is, and predicates on attributes are settled without a join."""
    nodes, asked = publish.orders_documents(spark, tables).where("doc_id is not null"), ["/order/lineitem/@part", "/order/lineitem"]
    elems = [ar.Elem(p, keys, 1) for p in paths]
    whole, some = how(nodes, "/order", elems, strict=False), how(nodes, "/order", elems, strict=False, paths=asked)
    rows = lambda df: sorted(map(tuple, df.where(F.col("path").isin(asked)).collect()), key=str)
    assert rows(some) == rows(whole) and rows(some)
    assert "Join" not in plan(some) and some.count() < whole.count()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sort_whole_document", "head_whole_document"])
def test_renumbering_joins_nothing(spark, tables, name):
    """What is joined can be broadcast, by estimates that know nothing of the nodes in a row."""
    same(spark, tables, name)
    assert "Join" not in plan(QUERIES[name](spark, tables))


def test_deletion_joins_nothing(spark, tables):
    same(spark, tables, "delete_values")
    assert "Join" not in plan(QUERIES["delete_values"](spark, tables))


def test_deletion_by_position_and_predicates(spark):
    nodes = shred(spark.createDataFrame([(1, "<a><b>1</b><b k='x'>2</b><c/><b>3</b></a>")], "doc_id long, xml string"))
    xml = lambda *paths: to_xml(edit.delete(nodes, list(paths), strict=False)).collect()[0]["xml"]
    assert xml("/a/b[1]") == '<a><b k="x">2</b><c/><b>3</b></a>' and xml("/a/*[3]", "/a/b[@k]") == "<a><b>1</b><b>3</b></a>"


@pytest.mark.parametrize("name", ["delete_values", "select_xml", "sort_one_key", "sort_two_keys", "head_n", "head_negative", "tail_n", "sort_first_path_wins", "flatten_values", "agg_filtered_context", "pred_and_or", "pred_element"])
def test_base_rows_are_dealt_once(spark, tables, name):
    """Only base rows are shuffled, by document; no node is."""
    same(spark, tables, name)
    dealt = [line for line in QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_tasks_grow_with_the_tables(spark, monkeypatch, tables):
    least = spark.sparkContext.defaultParallelism
    assert publish.orders_documents(spark, tables).rdd.getNumPartitions() == least
    monkeypatch.setattr(publish, "PART_BYTES", 10)
    assert publish.orders_documents(spark, tables).rdd.getNumPartitions() > 10 * least


def test_documents_of_odd_rows(spark, tables):
    """A null key is a document without children; lines of no order, or without key, are left out."""
    rows = publish.orders_documents(spark, tables).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
    assert {tuple(r) for r in rows.collect()} == {(None, 2, 3), (1, 24, 24), (2, 17, 17), (3, 3, 3), (40, 10, 10)}


def test_flatten_depths(spark):
    """Matches of three depths, within one another and apart."""
    nodes = shred(spark.createDataFrame([(1, "<a><b><b><b>1</b></b></b><c><b>2</b></c></a>")], "doc_id long, xml string"))
    assert to_xml(edit.flatten(nodes, ["//b"], recursive=True)).collect()[0]["xml"] == "<a>1<c>2</c></a>"
    apart = shred(spark.createDataFrame([(1, "<a><b>1</b><c><d><b>2</b></d></c></a>")], "doc_id long, xml string"))
    assert to_xml(edit.flatten(apart, ["//b"], recursive=True)).collect()[0]["xml"] == "<a>1<c><d>2</d></c></a>"
    assert to_xml(edit.flatten(apart, ["//x"], recursive=True)).collect()[0]["xml"] == "<a><b>1</b><c><d><b>2</b></d></c></a>"


def test_a_store_takes_no_shuffle_of_nodes(spark, tables, tmp_path):
    """Each task stores what it has made, in order of label path, and what it stores is whole."""
    nodes = publish.orders_documents(spark, tables)
    documents.write_nodes(nodes, store := str(tmp_path / "nodes"))
    again = documents.read_nodes(spark, store)
    assert again.exceptAll(nodes).isEmpty() and nodes.exceptAll(again).isEmpty()
    placed = [tuple(r) for r in again.select("doc_id", F.col("_metadata.file_name"), "path").collect()]
    files = {f: [p for _, g, p in placed if g == f] for _, f, _ in placed}
    assert all(paths == sorted(paths) for paths in files.values())
    assert all(len({f for d, f, _ in placed if d == doc}) == 1 for doc, _, _ in placed)


def test_store_is_read_once(spark, tables):
    same(spark, tables, "store_roundtrip")
    shown = plan(QUERIES["store_roundtrip"](spark, tables))
    assert "Join" not in shown and "Union" not in shown


def test_filtered_contexts_join_nothing(spark, tables):
    same(spark, tables, "agg_filtered_context")
    shown = plan(QUERIES["agg_filtered_context"](spark, tables))
    assert "Join" not in shown and shown.count("Union") == 2  # of orders and lines, in both plans


NESTED = "<r><a k='1' n='x'>s<b>1</b><a k='2'><b k='9'>2<c>5</c></b><a n='x' k='1'>t<b>4</b><a/></a></a></a><a n='x'><b k='2'>8</b></a><d k='1'><a k='1'><b>16</b></a><b>32</b></d></r>"


@pytest.mark.parametrize("path", ["//a[@k=1]/b/text()", "//a[@k='1']//text()", "//a[@k=1]/a/@k", "//a[@k]/a", "/r/a[@k=1]//b", "/r/a[@n='x'][@k]//a/@n", "//a[@k=2 or @n='x']/b/text()", "//a[@k=1 and @n='x']/a/b", "/r/a[2][@n]/b/@k", "//d[@k]/*/b", "//a[@*]/b"])
def test_below_elements_with_attributes(spark, path):
    """Elements within one another, each with attributes of its own, against steps taken by hand."""
    nodes = shred(spark.createDataFrame([(1, NESTED), (2, "<r><a k='2'><b>1</b></a></r>")], "doc_id long, xml string"))
    import xml.etree.ElementTree as ET

    tests = {"@k=1": lambda e: e.get("k") == "1", "@k='1'": lambda e: e.get("k") == "1", "@k": lambda e: "k" in e.attrib, "@n": lambda e: "n" in e.attrib, "@n='x'": lambda e: e.get("n") == "x", "@*": lambda e: bool(e.attrib)}
    tests |= {"@k=2 or @n='x'": lambda e: e.get("k") == "2" or e.get("n") == "x", "@k=1 and @n='x'": lambda e: e.get("k") == "1" and e.get("n") == "x"}

    def texts(e):
        return [t for t in [e.text, *[c.tail for c in e]] if t]

    def steps(found, rest):
        for skip, name, predicates in re.findall(r"/(/?)([^/\[]+)((?:\[[^\]]*\])*)", rest):
            if skip:
                found = [d for e in found for d in e.iter()]
            if name[0] == "@":
                return [e.get(name[1:]) for e in found if name[1:] in e.attrib]
            if name == "text()":
                return [t for e in dict.fromkeys(found) for t in texts(e)]
            new = []
            for e in found:
                here = [c for c in e if name in ("*", c.tag)]
                for p in re.findall(r"\[([^\]]*)\]", predicates):
                    here = [c for k, c in enumerate(here, 1) if (k == int(p) if p.isdigit() else tests[p](c))]
                new += here
            found = list(dict.fromkeys(new))
        return [None] * len(found)

    want = []
    for xml in (NESTED, "<r><a k='2'><b>1</b></a></r>"):
        top = ET.Element("top")
        top.append(ET.fromstring(xml))
        want += steps([top], path)
    found = match(nodes, path, strict=False, once=True)
    assert sorted(map(str, want)) == sorted(str(r["value"]) for r in found.collect())
    assert found.count() == found.dropDuplicates(["doc_id", "pre"]).count()


@pytest.mark.parametrize("context", ["//a[@k=1]", "//a[@k=2 or text()='s']", "/r/a[2][@n]"])
def test_aggregates_of_contexts_within_one_another(spark, monkeypatch, context):
    """One scan gives what matches of the contexts, and of each path from them, give."""
    nodes = shred(spark.createDataFrame([(1, NESTED), (2, "<r><a k='2'><b>1</b></a></r>")], "doc_id long, xml string"))
    specs = [("count", "int", "//a"), ("max", "float", "//b"), ("sum", "text", "a"), ("count", "int", ".")]
    aggs = [ag.Agg(*s, f"v{k}") for k, s in enumerate(specs)]
    rows = lambda: sorted(map(str, ag.aggregate(nodes, context, aggs, strict=False).collect()))
    got = rows()
    monkeypatch.setattr(ag, "by_owner", lambda steps: False)
    assert got == rows() and got
