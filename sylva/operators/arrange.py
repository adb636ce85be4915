"""Sort, head and tail: rearranging or cutting the matched elements of each context instance.

All of it is a handful of windows within documents, on one shuffle. Which rows are contexts, elements and keys is told by their
label paths, or by a join of matches where predicates take part. The elements of a context are laid end to end from where its
content began; no other node changes its position, so nothing has to be looked up again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.model import ATTRIBUTE, COLUMNS, ELEMENT, TEXT, SpecError
from sylva.plans.match import by_owner, fixed, flagged, match, needed, on_path, plain, within
from sylva.plans.xpath import Path, Step, parse

MISSING_INT = 2147483647


@dataclass(frozen=True)
class Elem:
    """An element path relative to the context, with its sort keys (paths relative to the element) or its count."""

    path: str
    keys: tuple[str, ...] = ()
    n: int = 10


def siblings(nodes: DataFrame) -> DataFrame:
    """The node table with sib and nth counted anew."""
    tag, any_ = Window.partitionBy("doc_id", "parent", "kind", "tag").orderBy("pre"), Window.partitionBy("doc_id", "parent", "kind").orderBy("pre")
    element = F.col("kind") == ELEMENT
    out = nodes.withColumn("sib", F.when(element, F.row_number().over(tag))).withColumn("nth", F.when(element, F.row_number().over(any_)))
    return out.select(*COLUMNS)


def renumber(rows: DataFrame, order: list[Column]) -> DataFrame:
    """A node table out of rows that are to stand in another order, with pre, last, parent, sib and nth counted anew.

    In the new order each node must be followed by those of its subtree that are left. Documents are numbered one by one.
    """
    in_new, in_old = Window.partitionBy("doc_id").orderBy(*order), Window.partitionBy("doc_id").orderBy("pre", "_end").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("doc_id", "parent")
    rows = rows.withColumn("_new", F.row_number().over(in_new)).select(*COLUMNS, "_new")
    # a slim row more for each element stands where it ends, to count what is left of its subtree, and one as its own child, to hand
    # its new position down; so it is all windows by document and no node is looked up in a join
    element = F.col("kind") == ELEMENT
    at = lambda place, owner, end: F.struct(place.alias("_at"), owner.alias("_own"), F.lit(end).alias("_end"))
    both = F.explode(F.when(element, F.array(at(F.col("pre"), F.col("pre"), 0), at(F.col("last"), F.col("pre"), 1))).otherwise(F.array(at(F.col("pre"), F.col("pre"), 0))))
    rows = rows.withColumn("_place", both)
    slim = lambda c, mark: F.when(mark == 0, F.col(c)).alias(c)
    kept = [c for c in COLUMNS if c not in ("doc_id", "pre", "last")]
    rows = rows.select("doc_id", F.col("_place._at").alias("pre"), F.col("_place._own").alias("_own"), F.col("_place._end").alias("_end"), *[slim(c, F.col("_place._end")) for c in kept], slim("_new", F.col("_place._end")))
    rows = rows.withColumn("_kept", F.count("_new").over(in_old))
    whole = Window.partitionBy("doc_id", "_own")
    rows = rows.withColumn("_size", F.coalesce(F.max(F.when(F.col("_end") == 1, F.col("_kept"))).over(whole) - F.col("_kept"), F.lit(0)).cast("int")).where("_end = 0")
    child = F.explode(F.when(element, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("_up", child).withColumn("parent", F.when(F.col("_up") == 1, F.col("pre")).otherwise(F.col("parent")))
    rows = rows.withColumn("_above", F.max(F.when(F.col("_up") == 1, F.col("_new"))).over(above)).where("_up = 0")
    out = rows.withColumn("parent", F.coalesce("_above", F.lit(0))).withColumn("pre", F.col("_new")).withColumn("last", F.col("_new") + F.col("_size"))
    return siblings(out)


def _outermost(rows: DataFrame, mark: str) -> DataFrame:
    """mark stays only where no marked row holds the row."""
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max(F.when(F.col(mark).isNotNull(), F.col("last"))).over(before), F.lit(-1)) >= F.col("pre")
    return rows.withColumn(mark, F.when(~held, F.col(mark)))


def _mark(rows: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    """rows with a column from found (doc_id, pre, mark)."""
    return rows.join(found.select("doc_id", "pre", mark).dropDuplicates(["doc_id", "pre"]), ["doc_id", "pre"], "left")


def _simple(path: Path) -> bool:
    return len(path.alternatives) == 1 and plain(path.steps)


def _absolute(ctx: Path, path: Path) -> tuple[Step, ...] | None:
    """The steps from the root to an element path's matches, where rows and windows by owner tell them; else None."""
    if not _simple(ctx) or len(path.alternatives) > 1 or not by_owner(path.steps) or not plain(path.steps) and not fixed(ctx.steps):
        return None
    return ctx.steps + path.steps


def _children(elems: list[Elem], strict: bool) -> list[str] | None:
    """The names of the element paths, if all of them are names of children (with predicates or not)."""
    names = [[s.name for s in a if s.axis == "child" and s.kind == "element"] for e in elems for a in parse(e.path, strict).alternatives]
    steps = [a for e in elems for a in parse(e.path, strict).alternatives]
    good = all(len(n) == len(a) == 1 and n[0] for n, a in zip(names, steps, strict=True))
    return [n[0] for n in names] if good else None


def _asked(nodes: DataFrame, context: str, elems: list[Elem], strict: bool, paths: list[str] | None) -> DataFrame:
    """The rows of nodes on the label paths, and those that tell where they go: contexts with their attributes, elements, what
    predicates speak of, and keys. All rows where a join would have to look for them, or positions are counted anew."""
    ctx, found = parse(context, strict), [parse(e.path, strict) for e in elems]
    if paths is None or ctx.is_document or not _simple(ctx):
        return nodes
    tests = [on_path(ctx.steps), on_path(ctx.steps, "/@[^/]+"), F.col("path").isin(paths)]
    for e, path in zip(elems, found, strict=True):
        steps = _absolute(ctx, path)
        if steps is None:
            return nodes
        tests.append(needed(steps))
        for key in (parse(k, strict) for k in e.keys):
            if not _simple(key):
                return nodes
            tests.append(on_path(steps + key.steps, "(?:/.*)?" if key.alternatives[0][-1:] and key.steps[-1].kind == "element" else ""))
    return nodes.where(reduce(lambda a, b: a | b, tests))


def elements(nodes: DataFrame, context: str, elems: list[Elem], strict: bool = True) -> DataFrame:
    """All rows of nodes with _ctx and _elem, structs of the context instance and of the matched element they stand in.

    Of contexts, and of matched elements, that lie within one another only the outermost count. An element that several
    paths match belongs to the first. _ctx is null outside contexts and for the context `/`.
    """
    if not elems:
        raise SpecError("an element path is needed")
    ctx, paths = parse(context, strict), [parse(e.path, strict) for e in elems]
    upto = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rows, contexts = nodes, None
    if not ctx.is_document:
        element = F.col("kind") == ELEMENT
        if _simple(ctx):
            rows = rows.withColumn("_c", F.when(element & on_path(ctx.steps), F.lit(1)))
        else:
            contexts = match(nodes, ctx).where(element)
            rows = _mark(rows, contexts.withColumn("_c", F.lit(1)), "_c")
        if not all(fixed(s) for s in ctx.alternatives) or len(ctx.alternatives) > 1:
            rows = _outermost(rows, "_c")
        place = F.struct("pre", "last") if _children(elems, strict) is not None else F.struct("pre", "last", "path", "depth")
        rows = rows.withColumn("_ctx", F.last(F.when(F.col("_c").isNotNull(), place), ignorenulls=True).over(upto))
        rows = rows.withColumn("_ctx", F.when(F.col("_ctx.last") >= F.col("pre"), F.col("_ctx"))).drop("_c")
    else:
        rows = rows.withColumn("_ctx", F.lit(None).cast("struct<pre:int,last:int,path:string,depth:int>"))
    ix = F.lit(None).cast("int")
    for k in reversed(range(len(paths))):
        if _simple(ctx) and _simple(paths[k]):
            ix = F.when((F.col("kind") == ELEMENT) & on_path(ctx.steps + paths[k].steps), F.lit(k)).otherwise(ix)
        elif (steps := _absolute(ctx, paths[k])) is not None:
            rows = flagged(rows, steps, f"_m{k}")
            ix = F.when(F.col(f"_m{k}"), F.lit(k)).otherwise(ix)
        else:
            if not ctx.is_document and contexts is None:
                contexts = match(nodes, ctx).where(F.col("kind") == ELEMENT)
            found = match(nodes, paths[k], contexts, ctx).where(F.col("kind") == ELEMENT)
            rows = _mark(rows, found.withColumn(f"_m{k}", F.lit(k)), f"_m{k}")
            ix = F.coalesce(F.col(f"_m{k}"), ix)
    inside = F.lit(True) if ctx.is_document else F.col("_ctx").isNotNull() & (F.col("pre") > F.col("_ctx.pre"))
    rows = rows.withColumn("_e", F.when(inside, ix)).drop(*[f"_m{k}" for k in range(len(paths))])
    one_depth = all(fixed(s) for s in ctx.alternatives) and len(ctx.alternatives) == 1 and _children(elems, strict) is not None
    if not one_depth and (len(paths) > 1 or not all(fixed(s) for p in [ctx, *paths] for s in p.alternatives)):
        rows = _outermost(rows, "_e")
    # children of the context keep their depth and label path, so their rows need not carry where they came from
    own = F.struct("pre", "last", *([] if one_depth else ["path", "depth"]), "parent", *([] if one_depth else ["tag"]), F.col("_e").alias("ix"))
    rows = rows.withColumn("_elem", F.last(F.when(F.col("_e").isNotNull(), own), ignorenulls=True).over(upto))
    return rows.withColumn("_elem", F.when(F.col("_elem.last") >= F.col("pre"), F.col("_elem"))).drop("_e")


def _keyed(nodes: DataFrame, rows: DataFrame, context: str, elems: list[Elem], strict: bool) -> tuple[DataFrame, list[Column]]:
    """rows with two columns for each key position, alike for all rows of an element, and the order they stand for.

    A key is the integer that typed text gives, then the text and attribute values within the key's matches, one after the
    other. Elements without integer come after those with one, and without text before those with text.
    """
    ctx, order = parse(context, strict), []
    leaf = F.col("kind").isin(TEXT, ATTRIBUTE)
    own = Window.partitionBy("doc_id", F.col("_elem.pre"))
    for i in range(max((len(e.keys) for e in elems), default=0)):
        tests = []
        for k, e in enumerate(elems):
            if i >= len(e.keys):
                continue
            path, above = parse(e.keys[i], strict), parse(e.path, strict)
            below = "(?:/.*)?" if path.alternatives[0][-1:] and path.steps[-1].kind == "element" else ""
            if _absolute(ctx, above) is not None and (_simple(above) or fixed(above.steps)) and _simple(path):
                tests.append((F.col("_elem.ix") == k) & leaf & on_path(ctx.steps + above.steps + path.steps, below))
            else:
                base = rows.where((F.col("_elem.ix") == k) & (F.col("_elem.pre") == F.col("pre"))).select(*COLUMNS)
                hits = match(nodes, path, base, parse("/", strict))
                inner = within(hits.where(F.col("kind") == ELEMENT).select(*COLUMNS), nodes.where(leaf), False, carry=[])
                found = hits.where(leaf).select("doc_id", "pre").union(inner.select("doc_id", "pre"))
                rows = _mark(rows, found.withColumn(f"_k{i}_{k}", F.lit(True)), f"_k{i}_{k}")
                tests.append((F.col("_elem.ix") == k) & F.coalesce(f"_k{i}_{k}", F.lit(False)))
        hit = reduce(lambda a, b: a | b, tests)
        text = F.collect_list(F.when(hit & F.col("t_int").isNull(), F.struct("pre", "value"))).over(own)
        rows = rows.withColumn(f"_key{i}_int", F.max_by(F.when(hit, F.col("t_int")), F.when(hit & F.col("t_int").isNotNull(), F.col("pre"))).over(own))
        rows = rows.withColumn(f"_key{i}_str", F.array_join(F.transform(F.array_sort(text), lambda x: x["value"]), ""))
        order += [F.coalesce(f"_key{i}_int", F.lit(MISSING_INT)), F.col(f"_key{i}_str")]
    return rows, order


def sort(nodes: DataFrame, context: str, elems: list[Elem], strict: bool = True, paths: list[str] | None = None) -> DataFrame:
    """The node table with the matched elements of each context instance in order of path, keys and document order.

    Within a context other than the document everything else goes, but for the context's own attributes, and the elements
    become children of the context. With the context `/` it stays; the elements of one parent stand together where the first
    of them stood.

    paths: label paths, as they are in nodes, of all that will be asked of the result; other rows may be left out. No position
    depends on it.
    """
    nodes = _asked(nodes, context, elems, strict, paths)
    rows, keys = _keyed(nodes, elements(nodes, context, elems, strict), context, elems, strict)
    return _placed(rows, keys, parse(context, strict).is_document, _children(elems, strict))


def head(nodes: DataFrame, context: str, elems: list[Elem], strict: bool = True, paths: list[str] | None = None) -> DataFrame:
    """The node table with the first n of each element path in each context instance (a negative n: the last).

    They stand path by path, in document order. What else stands in the context fares as in sort(), and so do paths.
    """
    rows = elements(_asked(nodes, context, elems, strict, paths), context, elems, strict)
    whole = Window.partitionBy("doc_id", F.col("_ctx.pre"))
    upto = whole.orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.lit(False)
    for k, e in enumerate(elems):
        if e.n:
            root = F.count(F.when((F.col("_elem.ix") == k) & (F.col("pre") == F.col("_elem.pre")), 1))
            kept = F.when(F.col("_elem.ix") == k, root.over(upto) <= e.n if e.n > 0 else root.over(whole) - root.over(upto) < -e.n).otherwise(kept)
    rows = rows.withColumn("_keep", kept).where(F.col("_elem").isNull() | F.col("_keep")).drop("_keep")
    return _placed(rows, [], parse(context, strict).is_document, _children(elems, strict))


def tail(nodes: DataFrame, context: str, elems: list[Elem], strict: bool = True, paths: list[str] | None = None) -> DataFrame:
    """The node table with the last n of each element path in each context instance (a negative n: the first)."""
    return head(nodes, context, [Elem(e.path, e.keys, -e.n) for e in elems], strict, paths)


def _placed(rows: DataFrame, keys: list[Column], is_document: bool, children: list[str] | None) -> DataFrame:
    """The node table of rows with _ctx and _elem, elements in order of path, keys and document order.

    All that counts elements is a running count or sum over one order; an element's own row comes first of its rows.
    children: the names of the elements, if all of them are children of their contexts.
    """
    moved = F.col("_elem").isNotNull()
    root = moved & (F.col("pre") == F.col("_elem.pre"))
    instance = Window.partitionBy("doc_id", F.col("_ctx.pre"))
    upto = instance.orderBy(F.col("_elem").isNull(), F.col("_elem.ix"), *keys, F.col("_elem.pre"), "pre").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.count(F.when(root, 1)).over(upto)
    if is_document:
        spot = F.min("_elem.pre").over(Window.partitionBy("doc_id", F.col("_elem.parent")))
        spotted = rows.withColumn("_rank", F.when(moved, rank)).withColumn("_spot", F.when(moved, spot).otherwise(F.col("pre")))
        return renumber(spotted, [F.col("_spot"), F.coalesce("_rank", F.lit(0)), F.col("pre")])
    own = (F.col("kind") == ATTRIBUTE) & (F.col("parent") == F.col("_ctx.pre"))
    rows = rows.where(F.col("_ctx").isNull() | moved | own | (F.col("pre") == F.col("_ctx.pre")))
    # elements lie end to end behind the context's attributes; together they are no longer than what stood there
    start = F.coalesce(F.max(F.when(own, F.col("pre"))).over(instance), F.col("_ctx.pre")) + 1
    length = F.sum(F.when(root, F.col("last") - F.col("pre") + 1)).over(upto) - (F.col("_elem.last") - F.col("_elem.pre") + 1)
    if children is None:
        sib = F.row_number().over(Window.partitionBy("doc_id", F.col("_ctx.pre"), root, "tag").orderBy("_rank"))
    else:
        sib = reduce(lambda out, name: F.when(F.col("tag") == name, F.count(F.when(root & (F.col("tag") == name), 1)).over(upto)).otherwise(out), dict.fromkeys(children), F.lit(None))
    rows = rows.select("*", rank.alias("_rank"), F.when(moved, start + length - F.col("_elem.pre")).otherwise(F.lit(0)).cast("int").alias("_by"), *([] if children is None else [sib.alias("_sib")]))
    made = {
        "pre": F.col("pre") + F.col("_by"), "last": F.col("last") + F.col("_by"),
        "parent": F.when(root, F.col("_ctx.pre")).when(moved, F.col("parent") + F.col("_by")).otherwise(F.col("parent")),
        "sib": F.when(root, sib if children is None else F.col("_sib")).otherwise(F.col("sib")).cast("int"), "nth": F.when(root, F.col("_rank")).otherwise(F.col("nth")).cast("int"),
    }
    if children is None:  # children keep their depth and label path
        path = F.concat(F.col("_ctx.path"), F.lit("/"), F.col("_elem.tag"), F.substring(F.col("path"), F.length("_elem.path") + 1, F.length("path")))
        up = F.col("_elem.depth") - F.col("_ctx.depth") - 1
        made |= {"depth": F.when(moved, F.col("depth") - up).otherwise(F.col("depth")), "path": F.when(moved, path).otherwise(F.col("path"))}
    return rows.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in COLUMNS])
