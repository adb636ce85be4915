"""Delete, flatten, typed values and concatenation: node tables in, node tables out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.model import COLUMNS, ELEMENT, TEXT, SpecError
from sylva.operators.arrange import siblings
from sylva.plans.match import by_row, in_row, match, on_path, plain
from sylva.plans.xpath import parse


def _flagged(nodes: DataFrame, paths: list[str], strict: bool) -> DataFrame:
    """nodes with _hit: whether one of the paths selects the row."""
    parsed = [parse(p, strict) for p in paths]
    if any(p.is_document for p in parsed) or not parsed:
        raise SpecError("paths of nodes are needed")
    simple = [in_row(s) for p in parsed if all(by_row(a) for a in p.alternatives) for s in p.alternatives]
    test: Column = F.coalesce(reduce(lambda a, b: a | b, simple, F.lit(False)), F.lit(False))
    rest = [p for p in parsed if not all(by_row(a) for a in p.alternatives)]
    if not rest:
        return nodes.withColumn("_hit", test)
    hits = reduce(DataFrame.union, [match(nodes, p).select("doc_id", "pre") for p in rest]).distinct().withColumn("_m", F.lit(True))
    return nodes.join(hits, ["doc_id", "pre"], "left").withColumn("_hit", test | F.coalesce("_m", F.lit(False))).drop("_m")


def select_subtrees(nodes: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """The subtrees that a path selects: node columns and root_pre. A match within another match is a subtree of its own."""
    from sylva.plans.match import fixed, within

    parsed = parse(path, strict)
    if parsed.is_document:
        return nodes.withColumn("root_pre", F.lit(0))
    found = match(nodes, parsed).withColumn("root_pre", F.col("pre"))
    disjoint = len(parsed.alternatives) == 1 and fixed(parsed.steps)
    return within(found, nodes, disjoint, carry=["root_pre"], inclusive=True)


def delete(nodes: DataFrame, paths: list[str], strict: bool = True) -> DataFrame:
    """The node table without the matched subtrees, attributes and text runs.

    A running maximum of the ends of matches, in document order, covers all rows of a matched subtree.
    """
    order = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    flagged = _flagged(nodes, paths, strict).withColumn("_end", F.max(F.when(F.col("_hit"), F.col("last"))).over(order))
    return siblings(flagged.where(F.col("_end").isNull() | (F.col("_end") < F.col("pre"))))


def flatten(nodes: DataFrame, paths: list[str], recursive: bool = False, strict: bool = True) -> DataFrame:
    """The node table without the tags and attributes of matched elements; what they held stands in their place.

    Of matches within one another only the outermost is taken away, unless recursive. Text that comes to stand next to text
    stays a run of its own.
    """
    rows = _flagged(nodes, paths, strict).withColumn("_hit", F.col("_hit") & (F.col("kind") == ELEMENT))
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    levels = 1
    if recursive:
        # how deep matches lie within one another bounds the rounds; each takes one level away. The depths alone bound them too,
        # and a second round costs less than to see whether it is needed
        levels = rows.where("_hit").agg(F.max("depth") - F.min("depth") + 1).first()[0] or 1
        if levels > 2:
            depths = rows.where("_hit").select("doc_id", "pre", "last")
            levels = levels if depths.withColumn("_e", F.max("last").over(before)).where("_e >= pre").limit(1).count() else 1
    for _ in range(levels):
        outer = F.col("_hit") & (F.coalesce(F.max(F.when(F.col("_hit"), F.col("last"))).over(before), F.lit(-1)) < F.col("pre"))
        rows = rows.withColumn("_outer", outer)
        upto = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
        held = F.struct("pre", "last", "parent", "path")
        rows = rows.withColumn("_o", F.last(F.when(F.col("_outer"), held), ignorenulls=True).over(upto))
        inside = F.coalesce((F.col("pre") > F.col("_o.pre")) & (F.col("pre") <= F.col("_o.last")), F.lit(False))
        own = inside & (F.col("parent") == F.col("_o.pre"))
        rows = rows.where(~F.col("_outer") & ~(own & (F.col("kind") == "attribute")))
        above = F.regexp_replace(F.col("_o.path"), "/[^/]+$", "")
        rest = F.substring(F.col("path"), F.length("_o.path") + 1, F.length("path"))
        rows = rows.withColumn("path", F.when(inside, F.concat(above, rest)).otherwise(F.col("path")))
        rows = rows.withColumn("depth", F.when(inside, F.col("depth") - 1).otherwise(F.col("depth")))
        rows = rows.withColumn("parent", F.when(own, F.col("_o.parent")).otherwise(F.col("parent"))).select(*COLUMNS, "_hit")
    return siblings(rows)


TYPE = re.compile(r"(?P<path>[^:]+):(?P<prefix>[^%]*)%i(?P<suffix>.*)", re.S)


def typed(nodes: DataFrame, expression: str, strict: bool = True) -> DataFrame:
    """The node table with t_prefix, t_int and t_suffix where the text of a matched element has the form of the expression.

    `//name:pre%isuf` is a path, a prefix, an integer and a suffix. Only text directly within the element counts; value keeps
    the text as it is. Digits that do not fit 32 bits leave the text untyped.
    """
    m = TYPE.fullmatch(expression)
    if not m:
        raise SpecError(f"no type expression: {expression!r}")
    path = parse(m["path"], strict)
    quoted = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    shape = f"^{quoted(m['prefix'])}([0-9]+){quoted(m['suffix'])}$"
    number = F.nullif(F.regexp_extract("value", shape, 1), F.lit("")).try_cast("int")
    if all(plain(s) for s in path.alternatives):
        here = (F.col("kind") == TEXT) & reduce(lambda a, b: a | b, [on_path(s, r"/text\(\)") for s in path.alternatives])
        rows = nodes.withColumn("_t", F.when(here, number))
    else:
        owners = match(nodes, path).where(F.col("kind") == ELEMENT).select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("_in"))
        rows = nodes.join(owners, ["doc_id", "parent"], "left").withColumn("_t", F.when((F.col("kind") == TEXT) & F.col("_in"), number))
    put = lambda name, v: F.when(F.col("_t").isNotNull(), v).otherwise(F.col(name)).alias(name)
    made = {"t_prefix": F.lit(m["prefix"]), "t_int": F.col("_t"), "t_suffix": F.lit(m["suffix"])}
    return rows.select(*[put(c, made[c]) if c in made else F.col(c) for c in COLUMNS])


def concatenate(*tables: DataFrame) -> DataFrame:
    """All documents of several node tables, those of later tables with identifiers after those of earlier ones.

    Negative identifiers are refused. Each table's largest identifier is looked up, nothing else runs before the result does.
    """
    if not tables:
        raise SpecError("node tables are needed")
    out, shift = None, 0
    for t in tables:
        moved = t.select(*COLUMNS).withColumn("doc_id", F.col("doc_id") + F.lit(shift).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        low, high = t.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and low < 0:
            raise SpecError("document identifiers must not be negative")
        shift += 0 if high is None else high + 1
    return out
