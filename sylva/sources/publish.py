"""Relational tables as documents, without a detour over text.

A shape is a tree of elements. Leaves take their attributes and text from columns; a repeated element takes one row of a
child table each. Where all repetitions have the same number of nodes, positions follow from row numbers by arithmetic, so a
document is made with a window and an explode, and never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.model import ATTRIBUTE, COLUMNS, ELEMENT, TEXT


@dataclass(frozen=True)
class Leaf:
    """An element of fixed shape: its attributes, text and child leaves (values by column)."""

    tag: str
    attributes: dict[str, Column] = field(default_factory=dict)
    text: Column | None = None
    children: tuple[Leaf, ...] = ()

    def size(self) -> int:
        return 1 + len(self.attributes) + (self.text is not None) + sum(c.size() for c in self.children)


#: Columns that are alike in all documents of a shape.
FIXED = {"depth": "int", "kind": "string", "tag": "string"}


def _nodes(leaf: Leaf, at: Column, parent: Column, depth: int, path: str, sib: Column, nth: Column, last: Column | None = None) -> list[dict]:
    """The leaf's rows by column, its own at position `at`. Positions are pairs of a column and what is added to it."""

    def nodes(leaf, k, above, depth, path, sib, nth, last=None) -> list[dict]:
        row = lambda pre, last, parent, kind, tag, path, sib, nth, value: {"pre": (at, pre), "last": last if isinstance(last, tuple) else (at, last), "parent": parent, "depth": depth, "kind": kind, "tag": tag, "path": path, "sib": sib, "nth": nth, "value": value}
        own, here = f"{path}/{leaf.tag}", k
        out = [row(k, k + leaf.size() - 1 if last is None else (last, 0), above, ELEMENT, leaf.tag, own, sib, nth, None)]
        k += 1
        for name, value in leaf.attributes.items():
            out.append(row(k, k, (at, here), ATTRIBUTE, name, f"{own}/@{name}", None, None, value))
            k += 1
        if leaf.text is not None:
            out.append(row(k, k, (at, here), TEXT, None, f"{own}/text()", None, None, leaf.text))
            k += 1
        seen: dict[str, int] = {}
        for n, child in enumerate(leaf.children, 1):
            seen[child.tag] = seen.get(child.tag, 0) + 1
            out += nodes(child, k, (at, here), depth + 1, own, F.lit(seen[child.tag]), F.lit(n))
            k += child.size()
        return out

    return nodes(leaf, 0, (parent, 0), depth, path, sib, nth, last)


def _exploded(df: DataFrame, doc_id: Column, groups: list[list[dict]]) -> DataFrame:
    """A row of df becomes its nodes; of two groups, rows of roots (_top) become the first and others the second.

    Only a number is exploded and the columns are looked up by it, so what is not asked for is never made. What is fixed stands in
    arrays of constants: code that chooses by cases grows with nodes and columns beyond what the JVM compiles (8,000 bytes).
    """
    nodes = [n for group in groups for n in group]
    numbers = lambda a, b: F.array(*[F.lit(k) for k in range(a, b)])
    of = numbers(0, len(nodes)) if len(groups) == 1 else F.when(F.col("_top"), numbers(0, len(groups[0]))).otherwise(numbers(len(groups[0]), len(nodes)))
    rows = df.withColumn("_n", F.explode(of))
    n = F.col("_n")
    table = lambda values, t: F.get(F.array(*[F.lit(v).cast(t) for v in values]), n)

    def cases(values: list[Column | None], t: str) -> Column:
        """The value of the number, with a case for each column that is not null."""
        some = [(k, v) for k, v in enumerate(values) if v is not None]
        return reduce(lambda out, kv: (F if out is None else out).when(n == kv[0], kv[1].cast(t)), some, None) if some else F.lit(None).cast(t)

    def position(c: str) -> Column:
        """Groups share the column that most of their positions are counted from; the others have cases of their own."""
        out = None
        for first, group in zip((0, len(groups[0])), groups):
            base = group[0]["pre"][0]
            odd = [(first + k, r[c]) for k, r in enumerate(group) if r[c][0] is not base]
            plain = base.cast("int") + table([r[c][1] for g in groups for r in g], "int")
            for k, (column, more) in odd:
                plain = F.when(n == k, (column + more).cast("int")).otherwise(plain)
            out = plain if out is None else F.when(n < len(groups[0]), out).otherwise(plain)
        return out

    made = {c: position(c) for c in ("pre", "last", "parent")} | {c: table([r[c] for r in nodes], t) for c, t in FIXED.items()} | {c: cases([r[c] for r in nodes], "int") for c in ("sib", "nth")}
    made["value"] = cases([r["value"] for r in nodes], "string")
    made["path"] = cases([F.lit(r["path"]) for r in nodes], "string")  # by cases tests of label paths become tests of the number
    rows = rows.select(doc_id.cast("bigint").alias("doc_id"), *[made[c].alias(c) for c in nodes[0]])
    typed = rows.withColumn("t_prefix", F.lit(None).cast("string")).withColumn("t_int", F.lit(None).cast("int")).withColumn("t_suffix", F.lit(None).cast("string"))
    # a null attribute or text is no node; positions may have gaps
    return typed.where(F.col("value").isNotNull() | (F.col("kind") == ELEMENT)).select(*COLUMNS)


def flat_documents(parents: DataFrame, doc_id: Column, root: Leaf) -> DataFrame:
    """A document for each row, all of one shape."""
    return _exploded(parents, doc_id, [_nodes(root, F.lit(1), F.lit(0), 1, "", F.lit(1), F.lit(1))])


#: Estimated bytes of the tables' files for a task: some 100,000 rows, so what a task sorts and holds does not grow with the tables.
PART_BYTES = 1 << 20


def _parts(rows: DataFrame) -> int | None:
    """How many tasks rows are dealt to by their estimated size; None where Spark has no estimate (no job is run for it)."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 50 else min(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), 50_000)


def nested_documents(root_rows: DataFrame, doc_id: str, root: Leaf, child_rows: DataFrame, key: str, child: Leaf, order: list[Column]) -> DataFrame:
    """A document for each row of root_rows, with a child element for each row of child_rows of the same key, in that order.

    Columns of the two tables must differ in name, but for their keys. Child rows without a root row are left out.

    The base rows of both tables are dealt by document, once and before they become nodes; what follows by document (doc_id) needs
    no further shuffle.
    """
    tops = root_rows.withColumn("_doc", F.col(doc_id).cast("bigint")).withColumn("_top", F.lit(True))
    parts = child_rows.where(F.col(key).isNotNull()).withColumn("_doc", F.col(key).cast("bigint")).withColumn("_top", F.lit(False))
    both = tops.unionByName(parts, allowMissingColumns=True)
    n = _parts(both)
    both = both.repartition(n, "_doc") if n else both.repartition("_doc")
    by = Window.partitionBy("_doc").orderBy(F.col("_top").desc(), *order)  # of one order, so that one pass makes them all
    upto, whole = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.count(F.when(~F.col("_top"), 1))
    rows = both.withColumn("_k", below.over(upto)).withColumn("_children", below.over(whole)).withColumn("_known", F.max("_top").over(whole)).where("_known")
    head, size = root.size(), child.size()
    top = _nodes(root, F.lit(1), F.lit(0), 1, "", F.lit(1), F.lit(1), F.lit(head) + F.col("_children") * size)
    each = _nodes(child, F.lit(head + 1) + (F.col("_k") - 1) * size, F.lit(1), 2, f"/{root.tag}", F.col("_k"), F.col("_k") + len(root.children))
    return _exploded(rows, F.col("_doc"), [top, each])


# --- the shapes of the registered queries -----------------------------------------------------------------------------


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


#: l_orderkey and l_linenumber do not identify a line.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def orders_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: order(@key, @status, lineitem(@part, @flag, quantity(text), price(text))*), a document for each order."""
    root = Leaf("order", {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus")})
    line = Leaf("lineitem", {"part": F.col("l_partkey"), "flag": F.col("l_returnflag")}, children=(Leaf("quantity", text=money("l_quantity")), Leaf("price", text=money("l_extendedprice"))))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    return nested_documents(orders, "o_orderkey", root, lines, "l_orderkey", line, [F.col(c) for c in LINE_ORDER])


def events_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: log(@user, event(@type, value(text))*), a document for each user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    users = events.select("user_id").distinct().withColumnRenamed("user_id", "u")
    root = Leaf("log", {"user": F.col("u")})
    event = Leaf("event", {"type": F.col("event_type")}, children=(Leaf("value", text=money("value")),))
    return nested_documents(users, "u", root, events, "user_id", event, [F.col("ts"), F.col("event_id")])


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4: conversation(@id, turn(@role, text)*), a document for each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    root = Leaf("conversation", {"id": F.col("c")})
    turn = Leaf("turn", {"role": F.col("role")}, text=F.col("text"))
    return nested_documents(turns.select("conv_id").distinct().withColumnRenamed("conv_id", "c"), "c", root, turns, "conv_id", turn, [F.col("turn")])


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, by nation: nation(@key, name(text), customer(@key, @segment, name(text), balance(text))*)."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    root = Leaf("nation", {"key": F.col("n_nationkey")}, children=(Leaf("name", text=F.col("n_name")),))
    customer = Leaf("customer", {"key": F.col("c_custkey"), "segment": F.col("c_mktsegment")}, children=(Leaf("name", text=F.col("c_name")), Leaf("balance", text=money("c_acctbal"))))
    return nested_documents(nations, "n_nationkey", root, customers, "c_nationkey", customer, [F.col("c_custkey")])


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region(@key, nation(@key, name(text))*), a document for each region."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    root = Leaf("region", {"key": F.col("r_regionkey"), "name": F.col("r_name")})
    nation = Leaf("nation", {"key": F.col("n_nationkey")}, children=(Leaf("name", text=F.col("n_name")),))
    return nested_documents(regions, "r_regionkey", root, nations, "n_regionkey", nation, [F.col("n_nationkey")])
