"""Paths over node tables, as filters on label paths and structural joins.

Steps without predicates collapse into one test of the label path: an equality where nothing is left open, which reaches the
scan, and otherwise a regular expression behind its literal prefix. A structural join stands only where a predicate ends such
a run, or where a path is relative to other matches.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.scalars import compare
from sylva.model import ATTRIBUTE, COLUMNS, ELEMENT, TEXT
from sylva.plans.xpath import Path, Predicate, Step, parse

NAME = "[^/@()]+"
#: What a relative match carries of the node it is relative to.
SCOPE = ["ctx_pre", "ctx_last", "ctx_path"]


def segment(step: Step) -> str:
    """The regular expression of one step in a label path."""
    if step.axis == "self":
        return ""
    last = {"element": re.escape(step.name) if step.name else NAME, "attribute": "@" + (re.escape(step.name) if step.name else "[^/]+"), "text": r"text\(\)"}[step.kind]
    return (f"(?:/{NAME})*/" if step.axis == "descendant" else "/") + last


def pattern(steps: tuple[Step, ...]) -> str:
    return "".join(segment(s) for s in steps)


def fixed(steps: tuple[Step, ...]) -> bool:
    """Whether all matches lie at one depth, so that none is within another."""
    return all(s.axis in ("child", "self") for s in steps)


def plain(steps: tuple[Step, ...]) -> bool:
    return all(not s.predicates and s.axis != "parent" for s in steps)


def by_row(steps: tuple[Step, ...]) -> bool:
    """Whether each row tells by itself that it is matched from the root: positions are asked for in the last step at most."""
    return plain(steps[:-1]) and all(s.axis != "parent" for s in steps) and all(p.kind == "position" for s in steps[-1:] for p in s.predicates)


def in_row(steps: tuple[Step, ...]) -> Column:
    """Whether a row is matched by steps for which by_row() holds."""
    return reduce(lambda a, b: a & b, [on_path(steps), *[_position(s, p) for s in steps[-1:] for p in s.predicates]])


def _position(step: Step, p: Predicate) -> Column:
    return F.col("nth" if step.name is None else "sib") == p.value


def on_path(steps: tuple[Step, ...], below: str = "", path: Column | None = None) -> Column:
    """Whether a label path is matched from the root; `below` is a pattern that may follow."""
    path = F.col("path") if path is None else path
    literal = ""
    for s in steps:
        if s.axis not in ("child", "self") or (s.kind != "text" and s.axis == "child" and s.name is None):
            break
        literal += "" if s.axis == "self" else "/" + {"element": s.name, "attribute": f"@{s.name}", "text": "text()"}[s.kind]
    else:
        if not below:
            return path == literal
    end = "" if below else _ending(steps)
    if end:  # above what is named only elements can stand, whose names have no /, @ or brackets
        return path.endswith(end)
    test = path.rlike(f"^{pattern(steps)}{below}$")
    return path.startswith(literal) & test if literal else test


def _ending(steps: tuple[Step, ...]) -> str:
    """What label paths end with if and only if steps match them: names below the first step, which skips levels; else nothing."""
    first, *more = [s for s in steps if s.axis != "self"]
    if first.axis != "descendant" or any(s.axis != "child" for s in more) or any(s.kind != "text" and s.name is None for s in (first, *more)):
        return ""
    return "".join("/" + {"element": s.name, "attribute": f"@{s.name}", "text": "text()"}[s.kind] for s in (first, *more))


def assigned(both: DataFrame, disjoint: bool, last: dict[str, Column] | None = None, level: Column | None = None) -> DataFrame:
    """both with _at, the nearest _outer that begins at or before the row, of each depth that outer nodes have.

    both: doc_id, pre, _depth and _outer, a struct for outer nodes and null for other rows. Nodes of one depth never overlap, so a
    running last value in document order finds them; where outer nodes may lie within one another a row stands once for each
    depth of the document's outer nodes. It is all one shuffle by document, and no pairs are made.

    last: further running last values, by name. level: the one depth that a row stands for, where it is known.
    """
    by = ["doc_id"]
    if not disjoint and level is not None:
        both, by = both.withColumn("_level", level), ["doc_id", "_level"]
    elif not disjoint:
        outer = F.col("_outer").isNotNull()
        depths = F.collect_set(F.when(outer, F.col("_depth"))).over(Window.partitionBy("doc_id"))
        levels = F.when(outer, F.array("_depth")).otherwise(F.filter(depths, lambda d: d <= F.col("_depth")))
        both, by = both.withColumn("_level", levels).withColumn("_level", F.explode("_level")), ["doc_id", "_level"]
    order = Window.partitionBy(*by).orderBy("pre", F.col("_outer").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *[F.last(c, ignorenulls=True).over(order).alias(name) for name, c in {"_at": F.col("_outer"), **(last or {})}.items()])


def _inside(inclusive: bool = False) -> Column:
    return F.col("_outer").isNull() & ((F.col("pre") > F.col("_at.pre")) | F.lit(inclusive)) & (F.col("pre") <= F.col("_at.last"))


def within(outer: DataFrame, inner: DataFrame, disjoint: bool, condition: Column | None = None, carry: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """inner's rows that lie within a row of outer, with outer's carried columns; a row for each such outer one. inclusive: an
    outer node lies within itself."""
    carry = SCOPE if carry is None else carry
    held = ["pre", "last", "path", *carry]
    repeated = not disjoint and bool(carry)  # one node may have been reached from several contexts
    if repeated:
        outer = outer.groupBy("doc_id", "pre", "last", "path", "depth").agg(F.collect_set(F.struct(*carry)).alias("_carried"))
        held = ["pre", "last", "path", "_carried"]
    own = [c for c in inner.columns if c not in ("doc_id", "pre", "depth")]
    marks = outer.select("doc_id", "pre", F.col("depth").alias("_depth"), F.struct(*[F.col(c).alias(c) for c in held]).alias("_outer"), *[F.lit(None).cast(inner.schema[c].dataType).alias(f"_{c}") for c in own])
    rows = inner.select("doc_id", "pre", F.col("depth").alias("_depth"), F.lit(None).cast(marks.schema["_outer"].dataType).alias("_outer"), *[F.col(c).alias(f"_{c}") for c in own])
    found = assigned(rows.unionByName(marks), disjoint).where(_inside(inclusive))
    found = found.select(*[F.col(c if c in ("doc_id", "pre") else f"_{c}").alias(c) for c in inner.columns], "_at")
    if repeated:
        found = found.withColumn("_c", F.explode("_at._carried"))
    found = found.select(*inner.columns, *[F.col(f"_at.{c}").alias(f"_o_{c}") for c in ("pre", "last", "path")], *[F.col(f"_c.{c}" if repeated else f"_at.{c}").alias(c) for c in carry])
    if condition is not None:
        found = found.where(condition)
    return found.select(*inner.columns, *carry)


def below_outer(steps: tuple[Step, ...], suffix: str = "") -> Column:
    """Whether the label path goes on from the outer node's as the steps say."""
    rest = F.substring(F.col("path"), F.length("_o_path") + 1, F.length("path"))
    return rest.rlike(f"^{pattern(steps)}{suffix}$")


def _below(target: tuple[str, ...], text: bool) -> str:
    """The pattern of what a predicate's target selects, as the rest of a label path. text: the text of elements is meant."""
    *names, last = target
    tail = [last] if last == "text()" or last.startswith("@") else [last, "text()"] if text else [last]
    return "".join("/@[^/]+" if n == "@*" else "/" + re.escape(n) for n in [*names, *tail])


def _leaves(predicates: list[Predicate]) -> list[Predicate]:
    """The single tests of predicates."""
    return [q for p in predicates for q in (_leaves(list(p.parts)) if p.kind in ("and", "or") else [p])]


def _holds(p: Predicate, number: dict[Predicate, int]) -> Column:
    if p.kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if p.kind == "and" else (lambda a, b: a | b), [_holds(q, number) for q in p.parts])
    return F.coalesce(F.col(f"_p{number[p]}"), F.lit(False))


def _test(p: Predicate, value: Column) -> Column:
    """Whether a value satisfies a single test."""
    return {"exists": lambda: F.lit(True), "contains": lambda: value.contains(p.value), "starts": lambda: value.startswith(p.value), "compare": lambda: compare(value, p.op, p.value)}[p.kind]()


def _whole(p: Predicate, texts: Column, spans: Column | None) -> Column:
    """Whether the text of an element satisfies a test: of the owner itself, or of one of the spans (pre, _last) below it."""
    join = lambda t: F.array_join(F.transform(t, lambda x: x["_value"]), "")
    each = F.array(join(texts)) if spans is None else F.transform(spans, lambda e: join(F.filter(texts, lambda t: (t["pre"] > e["pre"]) & (t["pre"] <= e["_last"]))))
    return F.exists(each, lambda v: _test(p, v))


def _own(leaves: list[Predicate]) -> bool:
    """Whether single tests speak of nothing but an element's own attributes and text."""
    return all(len(p.target) == 1 and p.target[0][0] == "@" or p.target == ("text()",) for p in leaves)


def by_owner(steps: tuple[Step, ...]) -> bool:
    """Whether flagged() can settle what is matched from the root: elements, with tests of their own attributes and text in the last step."""
    return bool(steps) and plain(steps[:-1]) and all(s.axis != "parent" for s in steps) and steps[-1].kind == "element" and _own(_leaves([p for p in steps[-1].predicates if p.kind != "position"]))


def needed(steps: tuple[Step, ...]) -> Column:
    """The rows that flagged() looks at: what may be matched, and what its tests speak of."""
    leaves = _leaves([p for p in steps[-1].predicates if p.kind != "position"])
    return reduce(lambda a, b: a | b, [on_path(steps), *[_below_run(steps, p) for p in leaves]])


def _below_run(run: tuple[Step, ...], p: Predicate) -> Column:
    target = p.target[0]
    return on_path(run + (Step("child", "text") if target == "text()" else Step("child", "attribute", None if target == "@*" else target[1:]),))


def flagged(nodes: DataFrame, steps: tuple[Step, ...], mark: str) -> DataFrame:
    """nodes with a column that tells what steps select from the root; by_owner() must hold.

    Attributes and text know their owner, so a window over each element and what is its own settles all tests: nothing is joined.
    """
    step = steps[-1]
    tests = [p for p in step.predicates if p.kind != "position"]
    hit = reduce(lambda a, b: a & b, [on_path(steps), F.col("kind") == ELEMENT, *[_position(step, p) for p in step.predicates if p.kind == "position"]])
    if not tests:
        return nodes.withColumn(mark, hit)
    number = {p: k for k, p in enumerate(dict.fromkeys(_leaves(tests)))}
    rows = nodes.withColumn("_owner", F.when(F.col("kind") == ELEMENT, F.col("pre")).otherwise(F.col("parent")))
    own = Window.partitionBy("doc_id", "_owner")
    rows = rows.select("*", *[F.coalesce(F.bool_or(_below_run(steps, p) & _test(p, F.col("value"))).over(own), F.lit(False)).alias(f"_p{k}") for p, k in number.items()])
    return rows.withColumn(mark, reduce(lambda a, b: a & b, [hit, *[_holds(p, number) for p in tests]])).drop("_owner", *[f"_p{k}" for k in number.values()])


def _settled_before(run: tuple[Step, ...], rest: tuple[Step, ...]) -> bool:
    """Whether below() can follow rest from the elements of run: attributes, which precede all else in an element, decide about them."""
    real = [s for s in rest if s.axis != "self"]
    tests = [p for p in run[-1].predicates if p.kind != "position"]
    return bool(tests) and by_owner(run) and bool(real) and plain(rest) and (fixed(run) or fixed(rest)) and real[0].kind != "attribute" and all(p.target[0][0] == "@" for p in _leaves(tests))


def owned(run: tuple[Step, ...]) -> tuple[Column, dict[str, Column], Column]:
    """For the elements that run selects from the root, where by_owner() holds: whether a row can be one, by the name of each test
    whether a row of its own passes it, and whether an element is one, by flags of these names."""
    step = run[-1]
    tests = [p for p in step.predicates if p.kind != "position"]
    number = {p: k for k, p in enumerate(dict.fromkeys(_leaves(tests)))}
    here = reduce(lambda a, b: a & b, [on_path(run), F.col("kind") == ELEMENT, *[_position(step, p) for p in step.predicates if p.kind == "position"]])
    passed = {f"_p{k}": (F.col("kind") != ELEMENT) & _below_run(run, p) & _test(p, F.col("value")) for p, k in number.items()}
    return here, passed, reduce(lambda a, b: a & b, [_holds(p, number) for p in tests], F.lit(True))


def below(nodes: DataFrame, run: tuple[Step, ...], rest: tuple[Step, ...]) -> DataFrame:
    """What rest selects below the elements that run selects from the root; _settled_before() must hold.

    One window in document order: the last element of run's label path, and for each test the owner of the last attribute that
    passed it. So nodes are read once, attributes that pass no test stay behind, and nothing is joined. Elements of run that lie
    within one another differ in depth, and rest tells how far above a match its own is.
    """
    disjoint = fixed(run)
    here, passed, holds = owned(run)
    owns, reached = reduce(lambda a, b: a | b, passed.values()), on_path(run + rest)
    rows, outer = nodes.where(here | owns | reached), F.struct("pre", "last", *([] if disjoint else ["path"]))
    if disjoint or rest[-1].kind == "text":
        rows = rows.withColumn("_target", ~(here | owns))
    else:  # what is reached from one element may be another one, or its attribute
        rows = rows.withColumn("_target", F.explode(F.array_compact(F.array(F.when(here | owns, F.lit(False)), F.when(reached, F.lit(True))))))
    mark = ~F.col("_target")
    up = F.when(mark, F.col("depth")).otherwise(F.col("depth") - sum(s.kind == "element" for s in rest if s.axis != "self"))
    last = {name: F.when(mark & test, F.col("parent")) for name, test in passed.items()}
    found = assigned(rows.withColumn("_outer", F.when(mark & here, outer)), disjoint, last, up).where(F.col("_target") & _inside())
    if not disjoint:
        found = found.where(on_path(rest, path=F.substring(F.col("path"), F.length("_at.path") + 1, F.length("path"))))
    found = found.withColumns({name: F.col(name) == F.col("_at.pre") for name in passed})
    return found.where(holds).select(*nodes.columns)


def _filtered(nodes: DataFrame, found: DataFrame | None, run: tuple[Step, ...], disjoint: bool) -> DataFrame:
    """Of found the nodes that satisfy the predicates of run's last step; without found, of the nodes that run selects.

    All predicates of a step are settled in one pass over the nodes they speak of, in document order.
    """
    step = run[-1]
    position = [_position(step, p) for p in step.predicates if p.kind == "position"]
    tests = [p for p in step.predicates if p.kind != "position"]
    if found is None:
        here = reduce(lambda a, b: a & b, [on_path(run), *position])
        if not tests:
            return nodes.where(here)
    else:
        found = found.where(reduce(lambda a, b: a & b, position)) if position else found
        if not tests:
            return found
    leaves = list(dict.fromkeys(_leaves(tests)))
    number = {p: k for k, p in enumerate(leaves)}
    if found is None and by_owner(run) and any(p.kind in ("and", "or") for p in tests):
        return flagged(nodes.where(needed(run)), run, "_hit").where("_hit").select(*nodes.columns)
    if _own(leaves):
        # attributes and text know their owner: those that pass a test are grouped by it
        below = {p: F.col("path").rlike(f"{_below(p.target, True)}$") if found is not None or "*" in p.target[0] else on_path(run, re.escape("/" + p.target[0])) for p in leaves}
        flags = [(below[p] & _test(p, F.col("value"))).alias(f"_p{number[p]}") for p in leaves]
        held = nodes.where(reduce(lambda a, b: a | b, below.values())).select("doc_id", F.col("parent").alias("_owner"), *flags).where(reduce(lambda a, b: a | b, [F.col(f"_p{k}") for k in number.values()]))
        if len(leaves) > 1:
            held = held.groupBy("doc_id", "_owner").agg(*[F.bool_or(f"_p{k}").alias(f"_p{k}") for k in number.values()])
        held = held.where(reduce(lambda a, b: a & b, [_holds(p, number) for p in tests])).select(F.col("doc_id").alias("_d"), "_owner")
        found = nodes.where(here) if found is None else found
        return found.join(held, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_owner")), "left_semi")
    whole = [p for p in leaves if p.target[-1] == "."]  # tests of an element's whole text gather it first
    below = {p: _below(p.target, p.kind != "exists") for p in leaves if p not in whole}
    spans = {p: "".join("/" + re.escape(n) for n in p.target[:-1]) for p in whole}
    for p in whole:
        below[p] = rf"{spans[p]}(?:/{NAME})*/text\(\)"
    shape = "(?:" + "|".join(dict.fromkeys([*below.values(), *filter(None, spans.values())])) + ")"
    reached = on_path(run, shape) if found is None else F.col("path").rlike(f"{shape}$")
    columns = nodes.columns if found is None else found.columns
    slim = [F.col("doc_id"), F.col("pre"), F.col("depth").alias("_depth")]
    leaf = {"_path": "path", "_value": "value", "_last": "last"}
    if found is None:
        role = F.explode(F.array_compact(F.array(F.when(here, F.lit(True)), F.when(reached, F.lit(False)))))
        both = nodes.where(here | reached).withColumn("_role", role)
        both = both.select(*slim, F.when(F.col("_role"), F.struct(*columns)).alias("_outer"), *[F.when(~F.col("_role"), F.col(c)).alias(n) for n, c in leaf.items()])
    else:
        marks = found.select(*slim, F.struct(*columns).alias("_outer"), *[F.lit(None).cast(nodes.schema[c].dataType).alias(n) for n, c in leaf.items()])
        both = nodes.where(reached).select(*slim, F.lit(None).cast(marks.schema["_outer"].dataType).alias("_outer"), *[F.col(c).alias(n) for n, c in leaf.items()]).unionByName(marks)
    rest = F.substring("_path", F.length("_at.path") + 1, F.length("_path"))
    both = assigned(both, disjoint)
    inside = _inside()
    flags = [F.bool_or(inside & rest.rlike(f"^{below[p]}$") & _test(p, F.col("_value"))).alias(f"_p{number[p]}") for p in leaves if p not in whole]
    gather = lambda shape, *c: F.array_sort(F.collect_list(F.when(inside & rest.rlike(f"^{shape}$"), F.struct(*c))))
    texts = [gather(below[p], "pre", "_value").alias(f"_t{number[p]}") for p in whole] + [gather(spans[p], "pre", "_last").alias(f"_s{number[p]}") for p in whole if spans[p]]
    out = both.where("_at is not null").groupBy("doc_id", F.col("_at.pre").alias("_owner")).agg(F.collect_list("_outer").alias("_found"), *flags, *texts)
    for p in whole:
        out = out.withColumn(f"_p{number[p]}", _whole(p, F.col(f"_t{number[p]}"), F.col(f"_s{number[p]}") if spans[p] else None))
    good = reduce(lambda a, b: a & b, [_holds(p, number) for p in tests])
    return out.where(good).select(F.explode("_found").alias("_f")).select(*[F.col(f"_f.{c}").alias(c) for c in columns])


def _kind(step: Step) -> Column:
    test = F.col("kind") == step.kind
    return test & (F.col("tag") == step.name) if step.name is not None and step.kind != "text" else test


def _walk(nodes: DataFrame, steps: tuple[Step, ...], scope: DataFrame | None, disjoint: bool, once: bool = False) -> DataFrame:
    """Matches of steps from the document, or from each node of scope (which has SCOPE)."""
    carry = [] if scope is None else SCOPE
    found, at_root = scope, scope is None
    trail: tuple[Step, ...] | None = () if scope is None else None  # the steps so far, where they say all about the label path
    while steps:
        if steps[0].axis == "parent":
            up = found.select(F.col("doc_id").alias("_d"), F.col("parent").alias("_up"), *carry).distinct()
            found = nodes.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_up"))).select(*nodes.columns, *carry)
            steps, at_root, trail = steps[1:], False, None
            continue
        n = next((k + 1 for k, s in enumerate(steps) if s.predicates or k + 1 < len(steps) and steps[k + 1].axis == "parent"), len(steps))
        run, steps = steps[:n], steps[n:]
        real = tuple(s for s in run if s.axis != "self")
        outer_disjoint = disjoint
        disjoint &= fixed(run)
        trail = None if trail is None else trail + run
        reached = nodes.where(on_path(trail)) if trail else nodes.where(_kind(real[-1])) if real else nodes
        if once and at_root and _settled_before(run, steps):
            return below(nodes, run, steps)
        if at_root:
            found, at_root = _filtered(nodes, None, run, disjoint), False
            continue
        if len(real) == 1 and real[0].axis == "child":
            up = found.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_up"), *carry)
            found = reached.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_up"))).select(*nodes.columns, *carry)
        elif real:
            found = within(found, reached, outer_disjoint, below_outer(run), carry)
            if not outer_disjoint:
                found = found.dropDuplicates(["doc_id", "pre", *carry[:1]])
        found = _filtered(nodes, found, run, disjoint)
    return found


def match(nodes: DataFrame, path: str | Path, scope: DataFrame | None = None, scope_path: Path | None = None, strict: bool = True, once: bool = False) -> DataFrame:
    """The nodes that a path selects, as rows of the node table.

    scope: matches that the path is relative to, with all node columns; the result then has ctx_pre, ctx_last and ctx_path of
    the match each node was reached from, and a node reached from several has several rows. Without scope a node has one row.
    once: below elements with tests of their attributes nodes are read once, by below(), and not joined; for large tables of which
    much is matched. A join carries less where few elements pass.
    The path `/` selects the document, which has no row; operators treat it apart.
    """
    path = parse(path, strict) if isinstance(path, str) else path
    if path.is_document:
        raise ValueError("the document itself has no row")
    base = None if scope is None else scope.select(*COLUMNS, F.col("pre").alias("ctx_pre"), F.col("last").alias("ctx_last"), F.col("path").alias("ctx_path"))
    disjoint = scope is None or scope_path is not None and all(fixed(s) for s in scope_path.alternatives) and len(scope_path.alternatives) == 1
    parts = [_walk(nodes, steps, base, disjoint, once) for steps in path.alternatives]
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "pre", *([] if scope is None else ["ctx_pre"])])


def match_all(nodes: DataFrame, paths: dict[str, str | Path] | list[Path], strict: bool = True) -> DataFrame:
    """Many paths at once: (var, node columns), a row for each path a node is matched by.

    paths: by the name that var gets, or the list that read_queries() makes of a file, where var is the path's text.

    All paths without predicates share one scan of nodes; the others add theirs.
    """
    named = paths if isinstance(paths, dict) else {p.text.strip(): p for p in paths}
    parsed = {var: parse(p, strict) if isinstance(p, str) else p for var, p in named.items()}
    simple = {var: p for var, p in parsed.items() if not p.is_document and all(plain(s) for s in p.alternatives)}
    out = []
    if simple:
        tests = [F.when(reduce(lambda a, b: a | b, [on_path(s) for s in p.alternatives]), F.lit(var)) for var, p in simple.items()]
        hits = F.array_compact(F.array(*tests))
        out.append(nodes.withColumn("_vars", hits).where(F.size("_vars") > 0).withColumn("var", F.explode("_vars")).select("var", *COLUMNS))
    out += [match(nodes, p).withColumn("var", F.lit(var)).select("var", *COLUMNS) for var, p in parsed.items() if var not in simple]
    return reduce(DataFrame.unionByName, out)


def first_wins(matches: DataFrame, precedence: dict[str, float]) -> DataFrame:
    """Of the rows of match_all() for one node those with the smallest precedence (0 unless given)."""
    rank = F.lit(0.0)
    for var, p in precedence.items():
        rank = F.when(F.col("var") == var, F.lit(float(p))).otherwise(rank)
    order = Window.partitionBy("doc_id", "pre").orderBy("_p")
    return matches.withColumn("_p", rank).withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_p", "_r")
