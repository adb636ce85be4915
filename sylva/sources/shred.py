"""XML and HTML text to node tables: one pass over each document in Arrow batches.

Filters do not travel through the Python boundary by themselves, so the label paths that a query can reach may be given; rows
on other paths are never made.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sylva.model import ATTRIBUTE, CDATA, ELEMENT, NODES, TEXT, MalformedDocumentError, SpecError
from sylva.plans.match import NAME, pattern
from sylva.plans.xpath import parse
from sylva.session import ready

#: Elements of HTML that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open element of the key's kind ends where one of these starts.
ENDS = {"li": {"li"}, "p": {"p", "ul", "ol", "div", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "nav", "section"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Builder:
    """Collects the rows of one document from its events."""

    def __init__(self, doc_id: int | None, keep: Callable[[str], bool] | None = None):
        self.doc_id, self.keep, self.pre, self.rows = doc_id, keep, 0, []
        self.open: list[list] = []  # [row or None, path, pre, tag counts, children]
        self.roots: list = [None, "", 0, {}, 0]
        self.pending: list[str] = []

    def _row(self, path: str, parent: int, depth: int, kind: str, tag: str | None, sib: int | None, nth: int | None, value: str | None) -> list | None:
        self.pre += 1
        if self.keep is not None and not self.keep(path):
            return None
        row = [self.doc_id, self.pre, self.pre, parent, depth, kind, tag, path, sib, nth, value]
        self.rows.append(row)
        return row

    def start(self, tag: str, attributes: Iterable[tuple[str, str | None]]) -> None:
        self.flush()
        above = self.open[-1] if self.open else self.roots
        above[3][tag] = sib = above[3].get(tag, 0) + 1
        above[4] += 1
        path = f"{above[1]}/{tag}"
        row = self._row(path, above[2], len(self.open) + 1, ELEMENT, tag, sib, above[4], None)
        self.open.append([row, path, self.pre, {}, 0])
        at = self.pre
        for name, value in attributes:
            self._row(f"{path}/@{name}", at, len(self.open), ATTRIBUTE, name, None, None, value or "")

    def end(self) -> None:
        self.flush()
        row = self.open.pop()[0]
        if row is not None:
            row[2] = self.pre

    def text(self, data: str) -> None:
        self.pending.append(data)

    def flush(self) -> None:
        if self.pending:
            value = "".join(self.pending).strip(" \t\r\n")
            self.pending = []
            if value and self.open:
                self._row(f"{self.open[-1][1]}/text()", self.open[-1][2], len(self.open), TEXT, None, None, None, value)

    def cdata(self, data: str) -> None:
        self.flush()
        if self.open:
            self._row(f"{self.open[-1][1]}/cdata()", self.open[-1][2], len(self.open), CDATA, None, None, None, data)

    def finish(self) -> list[list]:
        while self.open:
            self.end()
        return self.rows


def shred_xml(doc_id: int | None, text: str, keep: Callable[[str], bool] | None = None) -> tuple[list[list], str | None]:
    """Rows of a document and what is wrong with it, if anything; the rows before an error are those of what was read."""
    builder, inside = Builder(doc_id, keep), []
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True

    def characters(data: str) -> None:
        if in_cdata[0]:
            inside.append(data)
        else:
            builder.text(data)

    in_cdata = [False]

    def start_cdata() -> None:
        builder.flush()
        in_cdata[0] = True

    def end_cdata() -> None:
        in_cdata[0] = False
        builder.cdata("".join(inside))
        inside.clear()

    parser.StartElementHandler = lambda tag, a: builder.start(tag, zip(a[::2], a[1::2], strict=True))
    parser.EndElementHandler = lambda tag: builder.end()
    parser.CharacterDataHandler = characters
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = start_cdata, end_cdata
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        return builder.finish(), str(e)
    return builder.finish(), None


class _Html(HTMLParser):
    def __init__(self, builder: Builder):
        super().__init__(convert_charrefs=True)
        self.builder, self.tags = builder, []

    def handle_starttag(self, tag, attrs):
        if self.tags and tag in ENDS.get(self.tags[-1], ()):
            self.handle_endtag(self.tags[-1])
        seen = {}
        for name, value in attrs:
            seen.setdefault(re.sub(r"[/@()\s]", "_", name) or "_", value)
        self.builder.start(re.sub(r"[/@()\s]", "_", tag), seen.items())
        self.tags.append(tag)
        if tag in VOID:
            self.handle_endtag(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.tags and self.tags[-1] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.tags:
            while self.tags.pop() != tag:
                self.builder.end()
            self.builder.end()

    def handle_data(self, data):
        self.builder.text(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.builder.cdata(data[6:])


def shred_html(doc_id: int | None, text: str, keep: Callable[[str], bool] | None = None) -> tuple[list[list], str | None]:
    """Rows of a page. Unclosed and stray tags are mended, unquoted attribute values read; nothing is ever an error."""
    builder = Builder(doc_id, keep)
    html = _Html(builder)
    html.feed(text)
    html.close()
    return builder.finish(), None


_NAME = r"""[^\s/@()<>='"]++"""
_ATTRIBUTE = rf"""({_NAME})\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?:[^\s>/"'<]|/(?!>))++))"""
#: A comment or instruction, a document type, CDATA, an end tag or a start tag.
_TOKEN = re.compile(rf"""<!--.*?-->|<\?.*?\?>|<!DOCTYPE(?:[^\[>]*+\[[^\]]*+\])?[^>]*+>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|(?P<end></[^>]*+>)|<(?P<start>{_NAME})(?P<at>(?:\s*+{_ATTRIBUTE})*+)\s*+(?P<empty>/?)>""", re.S)
_ONE = re.compile(_ATTRIBUTE)


def shred_lenient(doc_id: int | None, text: str, keep: Callable[[str], bool] | None = None) -> tuple[list[list], str | None]:
    """As shred_xml(), for what is not quite XML: attribute values need no quotes, an end tag closes the innermost element whatever
    its name, elements may stay open, and unknown entities stand for themselves. Of attributes with one name the first counts.
    Errors are markup that is neither, and end tags where nothing is open."""
    builder, at = Builder(doc_id, keep), 0
    while (mark := text.find("<", at)) >= 0:
        builder.text(unescape(text[at:mark]))
        token = _TOKEN.match(text, mark)
        if token is None or token["end"] and not builder.open:
            return builder.finish(), f"character {mark}: {'not well-formed' if token is None else 'nothing to close'}"
        if token["start"]:
            named: dict[str, str] = {}
            for name, *values in _ONE.findall(token["at"]):
                named.setdefault(name, unescape("".join(values)))
            builder.start(token["start"], named.items())
        if token["end"] or token["empty"]:
            builder.end()
        elif token["cdata"] is not None:
            builder.cdata(token["cdata"])
        at = token.end()
    builder.text(unescape(text[at:]))
    return builder.finish(), None


SHREDDERS = {"xml": shred_xml, "lenient": shred_lenient, "html": shred_html}


def reachable(paths: list[str]) -> str:
    """A pattern of the label paths that the given paths, and the nodes below their matches, can be on."""
    parts = []
    for p in paths:
        for steps in parse(p, strict=False).alternatives:
            if not steps or any(s.axis == "parent" for s in steps):
                return ".*"
            # every node on the way counts, with its attributes and text, as predicates may ask for them
            for k in range(1, len(steps) + 1):
                parts.append(pattern(steps[:k]) + (r"(?:/.*)?" if k == len(steps) or steps[k - 1].predicates else f"(?:/(?:@[^/]+|text\\(\\)))?"))
            if any(s.axis == "descendant" for s in steps):
                parts.append(f"(?:/{NAME})+")
    return "|".join(dict.fromkeys(parts))


ARROW = pa.schema([("doc_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("path", pa.string()), ("sib", pa.int32()), ("nth", pa.int32()), ("value", pa.string()), ("t_prefix", pa.string()), ("t_int", pa.int32()), ("t_suffix", pa.string())])


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
    columns += [[None] * len(rows)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW, strict=True)], schema=ARROW)


def shred(docs: DataFrame, text: str = "xml", doc_id: str = "doc_id", dialect: str = "xml", on_error: str = "fail", paths: list[str] | None = None) -> DataFrame:
    """The node table of the documents in a text column.

    dialect: xml, lenient (XML with loose ends, see shred_lenient()) or html.
    on_error: fail, partial (keep what was read before the error) or drop (leave the document out). Null texts give no rows.
    paths: all that will be asked of the result; other rows may be left out. Positions are counted before that.
    """
    if dialect not in SHREDDERS or on_error not in ("fail", "partial", "drop"):
        raise SpecError("dialect is xml, lenient or html, on_error fail, partial or drop")
    ready(docs.sparkSession)
    wanted = reachable(paths) if paths else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # label paths recur in all documents, so each is tested once, more or less
        keep = lru_cache(4096)(re.compile(f"(?:{wanted})").fullmatch) if wanted else None
        parse_one = SHREDDERS[dialect]
        for batch in batches:
            rows: list[list] = []
            for ident, body in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if body is None:
                    continue
                made, error = parse_one(ident, body, keep)
                if error and on_error == "fail":
                    raise MalformedDocumentError(f"document {ident}: {error}")
                if not error or on_error == "partial":
                    rows += made
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, NODES)


def register_udtf(spark: SparkSession, name: str = "shred") -> None:
    """SQL: SELECT t.* FROM docs, LATERAL shred(doc_id, xml) t. Malformed documents give what was read before the error."""

    class Shred:
        def eval(self, doc_id: int, xml: str):
            if xml is not None:
                for row in shred_xml(doc_id, xml)[0]:
                    yield (*row, None, None, None)

    ready(spark).udtf.register(name, udtf(Shred, returnType=NODES))
