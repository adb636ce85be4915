"""Hand-written documents with hand-computed answers, and random trees against ElementTree."""

import random
import xml.etree.ElementTree as ET

import pytest

from sylva.functions.scalars import based_int, leading_float, leading_int
from sylva.model import MalformedDocumentError, SpecError
from sylva.operators import aggregate as ag
from sylva.operators import arrange as ar
from sylva.operators import edit
from sylva.operators.serialize import to_xml
from sylva.plans.match import first_wins, match, match_all
from sylva.sources.shred import shred

BIB = """<?xml version="1.0"?><!DOCTYPE bib><!-- c --><bib><book year="1999" lang="en"><title>XML &amp; more</title><author>B</author><author>A</author></book>
<?pi x?><book year="x12"><title>Other</title><price> 7.5 </price></book><book><title>Mixed <b>bold</b> tail</title><![CDATA[ <raw> ]]></book><empty/></bib>"""


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame([(1, BIB), (2, "<bib/>"), (3, None)], "doc_id long, xml string")
    return shred(docs).cache()


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("doc_id", "pre").select(*(columns or ["value"])).collect()]


def of(spark, *texts):
    return shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"))


def xml(nodes, doc=0):
    rows = to_xml(nodes).where(f"doc_id = {doc}").collect()
    return rows[0]["xml"] if rows else None


def test_shred(nodes):
    rows = nodes.where("doc_id = 1").orderBy("pre").collect()
    assert [r["pre"] for r in rows] == list(range(1, len(rows) + 1))
    assert (rows[0]["tag"], rows[0]["last"], rows[0]["depth"]) == ("bib", len(rows), 1)
    assert [r["value"] for r in rows if r["kind"] == "text"] == ["XML & more", "B", "A", "Other", "7.5", "Mixed", "bold", "tail"]
    assert [r["value"] for r in rows if r["kind"] == "cdata"] == [" <raw> "]
    assert [(r["sib"], r["nth"]) for r in rows if r["tag"] == "author"] == [(1, 2), (2, 3)]
    assert nodes.where("doc_id = 3").count() == 0


@pytest.mark.parametrize(
    "path, strict, expected",
    [
        ("/bib/book/@year", True, ["1999", "x12"]), ("//book/@*", True, ["1999", "en", "x12"]), ("//title/text()", True, ["XML & more", "Other", "Mixed", "tail"]),
        ("/bib/*/title/b/text()", True, ["bold"]), ("/bib/book[1]/author[2]/text()", True, ["A"]), ("/bib/*[4]", True, [None]), ("/bib/./book/price/text()", True, ["7.5"]),
        ("//book[@year=1999]/title/text()", True, ["XML & more"]), ("//book[@year<5]/title/text()", True, ["Other"]), ("//book[@year!='1999']/title/text()", True, ["Other"]),
        ("//book[@lang][@year]/author/text()", True, ["B", "A"]), ("//book[contains(title/text(),'XML')]/@lang", True, ["en"]), ("//book[starts-with(@year,'x')]/title/text()", True, ["Other"]),
        ("//title[text()='tail']/b/text()", True, ["bold"]), ("//price[text()=7.5]/text()", True, ["7.5"]), ("/bib/book[3][@year]/title/text()", True, []),
        ("//b/../text()", False, ["Mixed", "tail"]), ("//book[price or author]/@year", False, ["1999", "x12"]), ("//book[price=7 and @year]/@year", False, ["x12"]),
        ("//(author|price)/text()", False, ["B", "A", "7.5"]), ("//author[2]/text()", False, ["A"]), ("//title[.='Mixedboldtail']/b/text()", False, ["bold"]),
    ],
)
def test_paths(nodes, path, strict, expected):
    assert values(match(nodes, path, strict=strict)) == expected


def test_nested_matches(spark):
    n = of(spark, "<s><p><p><q>1</q><p><x>7</x><q>2</q></p></p><q>3</q></p></s>")
    assert values(match(n, "//p/p[1]/q/text()")) == ["1", "2"]
    scope = match(n, "//p")
    pairs = [(r["ctx_pre"], r["pre"]) for r in match(n, "//q", scope).collect()]
    assert len(pairs) == len(set(pairs)) == 6
    assert sorted(r["v"] for r in ag.aggregate(n, "//p", [ag.Agg("sum", "int", "q", "v")]).collect()) == [1, 2, 3]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_predicates_share_one_scan(spark, tmp_path, nodes):
    nodes.write.parquet(str(tmp_path / "n"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    tests = ["[contains(title/text(),'XML')]", "[@year]", "[@lang='en']", "[starts-with(author/text(),'B')]"]
    plans = [match(stored, f"//book{''.join(tests[:k])}/title/text()") for k in range(1, 5)]
    assert {scans(p) for p in plans} == {2}
    assert {scans(match(stored, f"//book{''.join(tests[1 : k + 1])}/title/text()")) for k in (1, 2)} == {3}
    assert [values(p) for p in plans] == [["XML & more"]] * 4
    assert scans(match(stored, "//book[@year][@lang='en']/title[text()]/text()")) == 5


def test_many_matches_in_one_document(spark):
    """Time grows with the matches, not with their square."""
    n = of(spark, "<r>" + "".join(f"<i k='{k}'><j>{k}</j></i>" for k in range(30_000)) + "</r>").cache()
    assert edit.select_subtrees(n, "//i").count() == 4 * 30_000
    assert match(n, "j/text()", match(n, "//i")).count() == 30_000


def test_many_paths_and_precedence(nodes):
    found = match_all(nodes, {"t": "//title", "b": "/bib/book", "any": "/bib/*", "y": "//book[@year]/title"})
    counts = {r["var"]: r["count"] for r in found.groupBy("var").count().collect()}
    assert counts == {"t": 3, "b": 3, "any": 4, "y": 2}
    assert first_wins(found, {"any": 1}).where("var = 'any'").count() == 1


def test_aggregates(spark):
    n = of(spark, "<r><g><n>3</n><n>0x10</n><n>-4</n><n>010</n></g><g/><g><n/><n>2.5</n></g></r>")
    aggs = [ag.Agg(f, s, "n", f"{f[:3]}_{s}") for f, s in (("sum", "int"), ("min", "int"), ("max", "int"), ("average", "int"), ("sum", "float"), ("first", "text"), ("last", "text"), ("sum", "text"), ("sum", "length"), ("max", "depth"))]
    aggs += [ag.Agg("count", "int", "n", "count"), ag.Agg("count_text_runs", "int", "n", "runs"), ag.Agg("id#2", "text", "n", "second"), ag.Agg("choice#0", "int", "n", "none")]
    rows = [r.asDict() for r in ag.aggregate(n, "/r/g", aggs).orderBy("ctx_pre").collect()]
    assert rows[0] | {"doc_id": 0, "ctx_pre": 2} == {"doc_id": 0, "ctx_pre": 2, "sum_int": 23, "min_int": -4, "max_int": 16, "ave_int": 5, "sum_float": 9.0, "fir_text": "3", "las_text": "010", "sum_text": "3 0x10 -4 010", "sum_length": 10, "max_depth": 2, "count": 4, "runs": 4, "second": "0x10", "none": None}
    assert (rows[1]["sum_int"], rows[1]["ave_int"], rows[1]["count"], rows[1]["fir_text"]) == (0, None, 0, None)
    assert (rows[2]["count"], rows[2]["runs"], rows[2]["sum_float"]) == (2, 1, 2.5)
    slow = [r.asDict() for r in ag.aggregate(n, "//g", aggs).orderBy("ctx_pre").collect()]
    assert slow[0] == rows[0] and slow[2] == rows[2]
    assert ag.aggregate(n, "/", [ag.Agg("count", "int", "//n", "c")]).collect()[0]["c"] == 6


@pytest.mark.parametrize("func, scalar", [("min", "text"), ("average", "text"), ("median", "int"), ("sum", "date"), ("choice", "int")])
def test_refused_aggregates(nodes, func, scalar):
    with pytest.raises(SpecError):
        ag.aggregate(nodes, "/bib", [ag.Agg(func, scalar, "book")])


def test_report(spark):
    n = of(spark, "<r><g><n>1</n></g></r>")
    report = ag.aggregate_report(n, [ag.Context("/r/g", (ag.Agg("sum", "float", "n"), ag.Agg("first", "text", "m")))])
    assert ag.report_xml(report, "out").collect()[0]["xml"] == '<out><context path="/r/g"><aggregate aggtype="sum" path="n">1.000000</aggregate><aggregate aggtype="first" path="m"></aggregate></context></out>'


def test_statistics(nodes):
    rows = {r["doc_id"]: r for r in ag.statistics(nodes).collect()}
    assert (rows[1]["n_elements"], rows[1]["max_depth"], rows[2]["n_elements"]) == (12, 4, 1)
    assert ag.count_elements(nodes).collect()[0][0] == 13


SHELF = '<s v="1"><b k="2"><t>y</t></b><c>skip</c><b k="1"><t>x</t></b><b><t>z</t></b><d k="2"/></s>'


def test_sort(spark):
    n = of(spark, SHELF)
    assert xml(ar.sort(n, "/s", [ar.Elem("b", ("@k",))])) == '<s v="1"><b><t>z</t></b><b k="1"><t>x</t></b><b k="2"><t>y</t></b></s>'
    assert xml(ar.sort(n, "/s", [ar.Elem("d"), ar.Elem("*", ("t",))])) == '<s v="1"><d k="2"></d><c>skip</c><b k="1"><t>x</t></b><b k="2"><t>y</t></b><b><t>z</t></b></s>'
    assert xml(ar.sort(n, "/", [ar.Elem("//b", ("t/text()",))])) == '<s v="1"><b k="1"><t>x</t></b><b k="2"><t>y</t></b><b><t>z</t></b><c>skip</c><d k="2"></d></s>'
    again = ar.sort(ar.sort(n, "/s", [ar.Elem("b", ("@k",))]), "/s", [ar.Elem("b", ("t",))])
    assert xml(again) == '<s v="1"><b k="1"><t>x</t></b><b k="2"><t>y</t></b><b><t>z</t></b></s>'
    assert [r["sib"] for r in again.where("tag = 'b'").orderBy("pre").collect()] == [1, 2, 3]


def test_typed_sort(spark):
    n = edit.typed(of(spark, "<s><i>p10s</i><i>p9s</i><i>other</i><i>p9</i><i>p99999999999s</i></s>"), "//i:p%is")
    assert [(r["t_int"], r["value"]) for r in n.where("kind = 'text'").orderBy("pre").collect()] == [(10, "p10s"), (9, "p9s"), (None, "other"), (None, "p9"), (None, "p99999999999s")]
    assert xml(ar.sort(n, "/s", [ar.Elem("i", ("text()",))])) == "<s><i>p9s</i><i>p10s</i><i>other</i><i>p9</i><i>p99999999999s</i></s>"


def test_head_and_tail(spark):
    n = of(spark, SHELF)
    assert xml(ar.head(n, "/s", [ar.Elem("b", n=2)])) == '<s v="1"><b k="2"><t>y</t></b><b k="1"><t>x</t></b></s>'
    assert xml(ar.tail(n, "/s", [ar.Elem("b", n=1), ar.Elem("c")])) == '<s v="1"><b><t>z</t></b><c>skip</c></s>'
    assert xml(ar.head(n, "/s", [ar.Elem("b", n=-1)])) == xml(ar.tail(n, "/s", [ar.Elem("b", n=1)]))
    assert xml(ar.head(n, "/s", [ar.Elem("b", n=0)])) == '<s v="1"></s>'
    assert xml(ar.head(n, "/", [ar.Elem("//b", n=1)])) == '<s v="1"><b k="2"><t>y</t></b><c>skip</c><d k="2"></d></s>'
    with pytest.raises(SpecError):
        ar.head(n, "/s", [])


def test_delete_and_flatten(spark):
    n = of(spark, "<a><b x='1'>t<b><c>u</c></b>v</b><c/></a>")
    assert xml(edit.delete(n, ["//b"])) == "<a><c/></a>"
    assert xml(edit.delete(n, ["//@x", "//b/text()"])) == "<a><b><b><c>u</c></b></b><c/></a>"
    assert xml(edit.delete(n, ["/a"])) is None
    assert xml(edit.flatten(n, ["//b"])) == "<a>t<b><c>u</c></b>v<c/></a>"
    flat = edit.flatten(n, ["//b"], recursive=True)
    assert xml(flat) == "<a>t<c>u</c>v<c/></a>"
    assert [(r["path"], r["depth"], r["sib"]) for r in flat.where("tag = 'c'").orderBy("pre").collect()] == [("/a/c", 2, 1), ("/a/c", 2, 2)]
    assert xml(edit.flatten(n, ["//c"])) == "<a><b x=\"1\">t<b>u</b>v</b></a>"
    with pytest.raises(SpecError):
        edit.delete(n, ["/"])


def test_select_and_concatenate(spark):
    n = of(spark, "<a><b>1</b><c><b>2</b></c></a>")
    assert [r["xml"] for r in to_xml(edit.select_subtrees(n, "//b"), ["doc_id", "root_pre"]).orderBy("root_pre").collect()] == ["<b>1</b>", "<b>2</b>"]
    both = edit.concatenate(n, of(spark, "<z/>", "<y/>"))
    assert [r["xml"] for r in to_xml(both).orderBy("doc_id").collect()] == ["<a><b>1</b><c><b>2</b></c></a>", "<z/>", "<y/>"]


def test_text_round_trip(spark):
    text = '<a q="&quot;&lt;&amp;&#10;x">x &lt; y &amp;&gt; z<b/>é<![CDATA[a]]]]><![CDATA[>b]]></a>'
    n = of(spark, text)
    again = shred(to_xml(n))
    assert n.exceptAll(again).count() == 0
    assert xml(of(spark, "<a><b><c/>t</b></a>")) == "<a><b><c/>t</b></a>"
    assert to_xml(of(spark, "<a><b>t</b></a>"), indent=2).collect()[0]["xml"] == "<a>\n  <b>t</b>\n</a>"


def test_malformed(spark):
    docs = spark.createDataFrame([(0, "<a><b>x</b><c></a>"), (1, ""), (2, "<ok/>")], "doc_id long, xml string")
    assert [r["doc_id"] for r in to_xml(shred(docs, on_error="drop")).collect()] == [2]
    assert xml(shred(docs, on_error="partial")) == "<a><b>x</b><c/></a>"
    with pytest.raises(Exception, match="mismatched|no element"):
        shred(docs).count()
    assert issubclass(MalformedDocumentError, ValueError)


def test_lenient(spark):
    texts = ["<!DOCTYPE a [<!ELEMENT a ANY>]><?p x?><a k=1 l = 'x>y' k=2 m=u/v><b>1 &lt; 2 &x;</c><d/><!-- <z> --><e>t", "<a></a></a>", "<a k>", "x < y", BIB, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    made = {r["doc_id"]: r["xml"] for r in to_xml(shred(docs, dialect="lenient", on_error="drop")).collect()}
    assert made.keys() == {0, 4}
    assert made[0] == '<a k="1" l="x&gt;y" m="u/v"><b>1 &lt; 2 &amp;x;</b><d/><e>t</e></a>'
    assert made[4] == xml(of(spark, BIB))
    with pytest.raises(Exception, match="nothing to close"):
        shred(docs.where("doc_id = 1"), dialect="lenient").count()


def test_report_tags(spark):
    out_tag, contexts = ag.read_commands("-t out -a //n sum int -c /r/g -t group -a n sum float -t total\n-a m first text")
    assert contexts == [ag.Context("/", (ag.Agg("sum", "int", "//n"),)), ag.Context("/r/g", (ag.Agg("sum", "float", "n", tag="total"), ag.Agg("first", "text", "m")), "group")]
    n = of(spark, "<r><g><n>1</n><m>q</m></g></r>")
    made = ag.report_xml(ag.aggregate_report(n, contexts), out_tag, contexts=contexts).collect()[0]["xml"]
    assert made == '<out><context path="/"><aggregate aggtype="sum" path="//n">1</aggregate></context><group path="/r/g"><total aggtype="sum" path="n">1.000000</total><aggregate aggtype="first" path="m">q</aggregate></group></out>'
    for bad in ("-c", "-c /a", "-a x sum", "-a x sum -t y", "-x", "-c /a -t -a n sum int"):
        with pytest.raises(SpecError):
            ag.read_commands(bad)


def test_path_set_push_down(spark):
    text = "<a k='1'><b><c>1</c><d>2</d></b><e><c>3</c></e></a>"
    docs = spark.createDataFrame([(0, text)], "doc_id long, xml string")
    few, all_ = shred(docs, paths=["/a/b[2]/c", "/a/b/c/text()"]), shred(docs)
    assert few.count() < all_.count()
    assert few.exceptAll(all_).count() == 0
    assert values(match(few, "/a/b/c/text()")) == ["1"]


def test_html(spark):
    page = "<!DOCTYPE html><html><body class=x><p>one<p>two<br>three<ul><li>a<li>b</ul><script>if (a<b) {}</script></body>"
    n = shred(spark.createDataFrame([(0, page)], "doc_id long, xml string"), dialect="html")
    assert values(match(n, "//li/text()")) == ["a", "b"]
    assert values(match(n, "/html/body/@class")) == ["x"]
    assert values(match(n, "//p/text()")) == ["one", "two", "three"]


def test_numbers(spark):
    df = spark.createDataFrame([(" 12abc",), ("-3.5e2x",), ("x",), ("0x1F",), ("-017",), ("",), (".5",)], "v string")
    rows = [tuple(r) for r in df.select(leading_int(df.v), leading_float(df.v), based_int(df.v)).collect()]
    assert rows == [(12, 12.0, 12), (-3, -350.0, -3), (0, 0.0, 0), (0, 0.0, 31), (-17, -17.0, -15), (0, 0.0, 0), (0, 0.5, 0)]


def random_tree(rng, depth=0):
    e = ET.Element(rng.choice("abc"))
    if rng.random() < 0.5:
        e.set(rng.choice("xy"), str(rng.randrange(5)))
    if rng.random() < 0.6:
        e.text = str(rng.randrange(9))
    for _ in range(rng.randrange(4) if depth < 4 else 0):
        e.append(random_tree(rng, depth + 1))
    return e


def test_random_trees(spark):
    rng = random.Random(7)
    trees = [random_tree(rng) for _ in range(60)]
    n = of(spark, *[ET.tostring(t, encoding="unicode") for t in trees]).cache()
    out = {r["doc_id"]: r["xml"] for r in to_xml(n).collect()}
    for k, t in enumerate(trees):
        assert ET.canonicalize(out[k]) == ET.canonicalize(ET.tostring(t, encoding="unicode"))
    for path, xpath in (("//a/b/text()", ".//a/b"), ("//a[@x=1]/c/text()", ".//a[@x='1']/c"), ("//*/c/text()", ".//c"), ("/a/b[2]/c/text()", None)):
        got = {}
        for r in match(n, path).orderBy("doc_id", "pre").collect():
            got.setdefault(r["doc_id"], []).append(r["value"])
        for k, t in enumerate(trees):
            top = ET.Element("top")
            top.append(t)
            if path == "//*/c/text()":
                want = [e.text for e in t.iterfind(".//c") if e.text]
            elif xpath is None:
                want = [e.text for e in top.iterfind("./a/b[2]/c") if e.text]
            else:
                hits = {id(e) for e in top.iterfind(xpath)}
                want = [e.text for e in top.iter() if id(e) in hits and e.text]
            assert got.get(k, []) == want, (path, k)
    for path, inner in (("//a", "//b"), ("//b", "*"), ("//c", "a/b")):
        pairs = sorted((r["doc_id"], r["ctx_pre"], r["pre"]) for r in match(n, inner, match(n, path)).collect())
        want = []
        for k, t in enumerate(trees):
            pre, count = {}, 0
            for e in t.iter():
                count += 1
                pre[e] = count
                count += len(e.attrib) + bool(e.text)
            want += [(k, pre[e], pre[x]) for e in t.iter(path[2:]) for x in e.iterfind("." + inner if inner[0] == "/" else inner)]
        assert pairs == sorted(want)
    for path, holds in (("//a[b/.='33']/c", lambda e: any("".join(x.itertext()) == "33" for x in e.findall("b"))), ("//a[b or @x=1]/c", lambda e: e.find("b") is not None or e.get("x") == "1"), ("//a[.!='' and c]/b", lambda e: "".join(e.itertext()) != "" and e.find("c") is not None)):
        count = sum(len(e.findall(path[-1])) for t in trees for e in t.iter("a") if holds(e))
        assert match(n, path, strict=False).count() == count, path
    for e in ("a", "b"):
        left = {r["doc_id"]: r["xml"] for r in to_xml(edit.delete(n, [f"//{e}"])).collect()}
        for k, t in enumerate(trees):
            assert (k in left) == (t.tag != e)
