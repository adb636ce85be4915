"""Aggregates of the text within each instance of a context, and statistics of whole documents."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.scalars import based_int, leading_float
from sylva.model import COLUMNS, ELEMENT, TEXT, SpecError
from sylva.plans.match import assigned, by_owner, fixed, match, on_path, owned, plain, within
from sylva.plans.xpath import Path, parse

NUMERIC = {"int", "float", "depth", "length"}
FUNCTIONS = {"sum", "min", "max", "avg", "first", "last", "choice", "count", "count_text_runs"}


@dataclass(frozen=True)
class Agg:
    """func: sum, min, max, average or avg, first, last, id#n or choice#n, count, count_text_runs.

    scalar: int, float, text, depth (of the enclosing element, the root has 0) or length (bytes of a text run). path is
    relative to the context. Only text runs have values; attributes and CDATA have none. count counts matched nodes. tag names
    the element of an XML report.
    """

    func: str
    scalar: str
    path: str
    name: str | None = None
    tag: str | None = None

    def parts(self) -> tuple[str, int]:
        m = re.fullmatch(r"(?:id|choice)#(\d+)", self.func)
        func = "choice" if m else "avg" if self.func == "average" else self.func
        if func not in FUNCTIONS or func == "choice" and not m:
            raise SpecError(f"no aggregate {self.func!r}")
        if self.scalar not in NUMERIC | {"text"}:
            raise SpecError(f"no scalar {self.scalar!r}")
        if self.scalar == "text" and func in ("min", "max", "avg"):
            raise SpecError(f"{func} takes no text")
        return func, int(m.group(1)) if m else 0

    def alias(self) -> str:
        return self.name or re.sub(r"\W+", "_", f"{self.func}_{self.scalar}_{self.path}").strip("_")


def scalar(kind: str) -> Column:
    return {"int": based_int(F.col("value")), "float": leading_float(F.col("value")), "depth": (F.col("depth") - 1).cast("bigint"), "length": F.octet_length("value").cast("bigint"), "text": F.col("value")}[kind]


def _expression(agg: Agg, node: Column, run: Column) -> Column:
    """The aggregate over rows where `node` marks matched nodes and `run` the text runs within them."""
    func, n = agg.parts()
    if func == "count":
        return F.count(F.when(node, 1))
    if func == "count_text_runs":
        return F.count(F.when(run, 1))
    value, place = F.when(run, scalar(agg.scalar)), F.when(run, F.col("pre"))
    if func == "sum" and agg.scalar == "text":
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(run, F.struct("pre", "value")))), lambda x: x["value"]), " ")
    if func == "sum":
        return F.coalesce(F.sum(value), F.lit(0).cast("double" if agg.scalar == "float" else "bigint"))
    if func == "avg":
        return F.avg(value) if agg.scalar == "float" else F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0)))
    if func in ("min", "max"):
        return F.min(value) if func == "min" else F.max(value)
    if func == "first":
        return F.min_by(value, place)
    if func == "last":
        return F.max_by(value, place)
    kept = F.transform(F.array_sort(F.collect_list(F.when(run, F.struct(F.col("pre"), scalar(agg.scalar).alias("v"))))), lambda x: x["v"])
    return F.try_element_at(kept, F.lit(n)) if n else F.lit(None)


def _type(agg: Agg) -> str:
    func, _ = agg.parts()
    return "bigint" if func.startswith("count") else {"int": "bigint", "float": "double", "depth": "bigint", "length": "bigint", "text": "string"}[agg.scalar]


def _typed(agg: Agg, e: Column) -> Column:
    return e.cast(_type(agg)).alias(agg.alias())


def aggregate(nodes: DataFrame, context: str, aggs: list[Agg], strict: bool = True) -> DataFrame:
    """doc_id, ctx_pre and a column for each aggregate; a row for each instance of the context, also where nothing matches.

    Without hits sum and count are 0, the others null. avg of int, depth and length is a whole number, cut towards 0. The context `/`
    is the document (ctx_pre 0). Contexts that lie within one another are aggregated each on its own.
    """
    ctx, paths = parse(context, strict), [parse(a.path, strict) for a in aggs]
    for a in aggs:
        a.parts()
    if len({a.alias() for a in aggs}) < len(aggs):
        raise SpecError("aggregates of one context need different names")
    simple = all(len(p.alternatives) == 1 and plain(p.steps) for p in [ctx, *paths]) and fixed(ctx.steps)
    if simple:
        return _one_pass(nodes, ctx, aggs, paths)
    if len(ctx.alternatives) == 1 and by_owner(ctx.steps) and all(len(p.alternatives) == 1 and not p.is_document and plain(p.steps) for p in paths):
        return _by_element(nodes, ctx, aggs, paths)
    if ctx.is_document:
        contexts = nodes.select("doc_id").distinct().withColumn("ctx_pre", F.lit(0))
    else:
        contexts = match(nodes, ctx)
    out = contexts.select("doc_id", "ctx_pre") if ctx.is_document else contexts.select("doc_id", F.col("pre").alias("ctx_pre"))
    for a, p in zip(aggs, paths, strict=True):
        found = match(nodes, p, None if ctx.is_document else contexts, ctx)
        if ctx.is_document:
            found = found.withColumn("ctx_pre", F.lit(0))
        hits = found.select(*COLUMNS, "ctx_pre", (F.col("kind") == TEXT).alias("_run"), F.lit(True).alias("_node"))
        runs = nodes.where(F.col("kind") == TEXT)
        flat = len(p.alternatives) == 1 and fixed(p.steps) and (ctx.is_document or fixed(ctx.steps))
        deep = within(found.where(F.col("kind") == ELEMENT).select(*COLUMNS, "ctx_pre"), runs, flat, carry=["ctx_pre"])
        if not flat:
            deep = deep.dropDuplicates(["doc_id", "ctx_pre", "pre"])
        rows = hits.unionByName(deep.select(*COLUMNS, "ctx_pre", F.lit(True).alias("_run"), F.lit(False).alias("_node")))
        made = rows.groupBy("doc_id", "ctx_pre").agg(_typed(a, _expression(a, F.col("_node"), F.col("_run"))))
        out = out.join(made, ["doc_id", "ctx_pre"], "left")
        if a.parts()[0] in ("sum", "count", "count_text_runs") and a.scalar != "text" or a.parts()[0].startswith("count"):
            out = out.withColumn(a.alias(), F.coalesce(a.alias(), F.lit(0).cast(_type(a))))
    return out


def _one_pass(nodes: DataFrame, ctx: Path, aggs: list[Agg], paths: list[Path]) -> DataFrame:
    """All aggregates from one scan: paths collapse into tests of the label path.

    The document and its root element are one instance a document, so a grouping by document with partial aggregates will
    do. Other contexts of fixed depth do not overlap; a running last value in document order finds the instance.
    """
    tests = []
    for p in paths:
        steps = ctx.steps + p.steps
        node = on_path(steps)
        element = not p.is_document and p.steps[-1].kind == "element"
        run = (F.col("kind") == TEXT) & (on_path(steps, r"(?:/[^/@()]+)*/text\(\)") if element or p.is_document else node)
        tests.append((node, run))
    here = on_path(ctx.steps) if not ctx.is_document else F.lit(False)
    wanted = reduce(lambda a, b: a | b, [t for pair in tests for t in pair], here)
    if ctx.is_document:
        made = nodes.groupBy("doc_id").agg(F.lit(0).alias("ctx_pre"), *[_typed(a, _expression(a, *t)) for a, t in zip(aggs, tests, strict=True)])
        return made.select("doc_id", "ctx_pre", *[a.alias() for a in aggs])
    rows = nodes.where(wanted)
    if len(ctx.steps) == 1:
        made = rows.groupBy("doc_id").agg(F.min(F.when(here, F.col("pre"))).alias("ctx_pre"), *[_typed(a, _expression(a, *t)) for a, t in zip(aggs, tests, strict=True)])
        return made.where("ctx_pre is not null").select("doc_id", "ctx_pre", *[a.alias() for a in aggs])
    order = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ctx_pre", F.last(F.when(here, F.col("pre")), ignorenulls=True).over(order))
    return rows.where("ctx_pre is not null").groupBy("doc_id", "ctx_pre").agg(*[_typed(a, _expression(a, *t)) for a, t in zip(aggs, tests, strict=True)])


def _by_element(nodes: DataFrame, ctx: Path, aggs: list[Agg], paths: list[Path]) -> DataFrame:
    """All aggregates from one scan, for contexts with tests of their own attributes and text, or within one another.

    Whatever is on the label path of a context is grouped with what lies within it; the tests are settled by the same grouping.
    """
    texts = [a.parts()[0] == "sum" and a.scalar == "text" for a in aggs]  # null without a match, empty without text in it
    disjoint, counted = fixed(ctx.steps), any(texts) or any(a.parts()[0] == "count" for a in aggs)
    here, tests, holds = owned(ctx.steps)
    ends = [r"(?:/[^/@()]+)*/text\(\)" if p.steps[-1].kind == "element" else "" for p in paths]
    text = F.col("kind") == TEXT
    wanted = [on_path(ctx.steps + p.steps) if counted else text & on_path(ctx.steps + p.steps, end) for p, end in zip(paths, ends, strict=True)]
    wanted += [text & on_path(ctx.steps + p.steps, end) for p, end in zip(paths, ends, strict=True) if counted and end]
    within_, own = reduce(lambda a, b: a | b, wanted), reduce(lambda a, b: a | b, tests.values(), F.lit(False))
    rows = nodes.where(here | own | within_)
    if counted:  # a context may be counted itself
        rows = rows.withColumn("_mark", F.explode(F.array_compact(F.array(F.when(here, F.lit(True)), F.when(own | within_, F.lit(False))))))
    else:
        rows = rows.withColumn("_mark", here)
    rows = rows.withColumn("_outer", F.when(F.col("_mark"), F.struct("pre", "last", "path"))).withColumn("_depth", F.col("depth"))
    rows = assigned(rows, disjoint).where(F.col("_at.last") >= F.col("pre"))
    rest, inner = F.substring(F.col("path"), F.length("_at.path") + 1, F.length("path")), F.col("_outer").isNull()
    made, flags = [], []
    for a, p, end, joined in zip(aggs, paths, ends, texts, strict=True):
        node = inner & on_path(p.steps, path=rest)
        run = inner & text & (on_path(p.steps, end, rest) if end else on_path(p.steps, path=rest))
        made.append(_typed(a, F.when(F.bool_or(node | run), _expression(a, node, run)) if joined else _expression(a, node, run)))
    for name, test in tests.items():
        flags.append(F.bool_or(inner & (F.col("parent") == F.col("_at.pre")) & test).alias(name))
    out = rows.groupBy("doc_id", F.col("_at.pre").alias("ctx_pre")).agg(*made, *flags)
    return out.where(holds).select("doc_id", "ctx_pre", *[a.alias() for a in aggs])


@dataclass(frozen=True)
class Context:
    path: str
    aggs: tuple[Agg, ...]
    tag: str | None = None


def read_commands(text: str) -> tuple[str | None, list[Context]]:
    """The tag of the whole report, if given, and the contexts of a command file: words with blanks or line ends between them.

    `-t tag` at the start names the report; `-c path` opens a context and `-a path function scalar` adds an aggregate to it, each
    with `-t tag` after it if its element is to have a name. Aggregates before any context belong to the document.
    """
    words, out_tag, contexts = text.split(), None, []

    def take(n: int) -> list[str]:
        taken = [words.pop(0) for _ in range(min(n, len(words)))]
        if len(taken) < n or any(w.startswith("-") for w in taken):
            raise SpecError(f"a command needs {n} words, not {taken}")
        return taken

    def tag() -> str | None:
        if words and words[0] in ("-t", "-tag"):
            words.pop(0)
            return take(1)[0]
        return None

    out_tag = tag()
    while words:
        option = words.pop(0)
        if option in ("-c", "-context"):
            contexts.append(Context(*take(1), (), tag()))
        elif option in ("-a", "-aggregate"):
            path, func, kind = take(3)
            context = contexts.pop() if contexts else Context("/", ())
            contexts.append(Context(context.path, (*context.aggs, Agg(func, kind, path, tag=tag())), context.tag))
        else:
            raise SpecError(f"no command {option!r}")
    if bare := [c.path for c in contexts if not c.aggs]:
        raise SpecError(f"contexts without an aggregate: {bare}")
    return out_tag, contexts


def aggregate_report(nodes: DataFrame, contexts: list[Context], strict: bool = True) -> DataFrame:
    """Several contexts at once, long: doc_id, ctx_ix, ctx_pre, ctx_path, agg_ix, agg_type, agg_path, value (text).

    Floats show six decimals; missing values are null.
    """
    out = []
    for k, c in enumerate(contexts):
        named = [Agg(a.func, a.scalar, a.path, f"a{i}", a.tag) for i, a in enumerate(c.aggs)]
        wide = aggregate(nodes, c.path, named, strict)
        shown = [F.struct(F.lit(i).alias("agg_ix"), F.lit(a.func).alias("agg_type"), F.lit(a.path).alias("agg_path"), (F.format_string("%.6f", f"a{i}") if _type(a) == "double" else F.col(f"a{i}").cast("string")).alias("value")) for i, a in enumerate(c.aggs)]
        shown = [F.when(F.col(f"a{i}").isNull(), s.withField("value", F.lit(None).cast("string"))).otherwise(s) for i, s in enumerate(shown)]
        long = wide.select("doc_id", F.lit(k).alias("ctx_ix"), "ctx_pre", F.lit(c.path).alias("ctx_path"), F.explode(F.array(*shown)).alias("a"))
        out.append(long.select("doc_id", "ctx_ix", "ctx_pre", "ctx_path", "a.*"))
    return reduce(DataFrame.unionByName, out)


def report_xml(report: DataFrame, out_tag: str = "aggregates", context_tag: str = "context", aggregate_tag: str = "aggregate", contexts: list[Context] | None = None) -> DataFrame:
    """doc_id and xml: the report of each document as one element with a child for each context instance.

    contexts: those of aggregate_report(), for the tags that they and their aggregates name; the others get the tags given here.
    """
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    around, each = F.lit(context_tag), F.lit(aggregate_tag)
    if contexts:
        around = F.element_at(F.array(*[F.lit(c.tag or context_tag) for c in contexts]), F.col("ctx_ix") + 1)
        tags = F.array(*[F.array(*[F.lit(a.tag or aggregate_tag) for a in c.aggs]) for c in contexts])
        each = F.element_at(F.element_at(tags, F.col("ctx_ix") + 1), F.col("agg_ix") + 1)
    one = F.concat(F.lit("<"), each, F.lit(' aggtype="'), F.col("agg_type"), F.lit('" path="'), escape(F.col("agg_path")), F.lit('">'), escape(F.coalesce("value", F.lit(""))), F.lit("</"), each, F.lit(">"))
    gather = lambda parts: F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["xml"]), "")
    inner = report.groupBy("doc_id", "ctx_ix", "ctx_pre", "ctx_path").agg(gather(F.struct("agg_ix", one.alias("xml"))).alias("xml"))
    ctx = F.concat(F.lit("<"), around, F.lit(' path="'), escape(F.col("ctx_path")), F.lit('">'), F.col("xml"), F.lit("</"), around, F.lit(">"))
    outer = inner.groupBy("doc_id").agg(gather(F.struct("ctx_ix", "ctx_pre", ctx.alias("xml"))).alias("xml"))
    return outer.select("doc_id", F.concat(F.lit(f"<{out_tag}>"), "xml", F.lit(f"</{out_tag}>")).alias("xml"))


def statistics(nodes: DataFrame) -> DataFrame:
    """doc_id, n_elements, max_depth and avg_depth of each document (depth 1 for the root)."""
    return nodes.where(F.col("kind") == ELEMENT).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_elements"), F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"))


def count_elements(nodes: DataFrame) -> DataFrame:
    """One row: the start tags of all documents."""
    return nodes.where(F.col("kind") == ELEMENT).agg(F.count(F.lit(1)).alias("n_elements"))
