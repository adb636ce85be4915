"""Node tables to XML text, with native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.model import ATTRIBUTE, CDATA, ELEMENT


def escape(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if not attribute:
        return F.replace(out, F.lit("\r"), F.lit("&#13;"))
    for raw, named in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def to_xml(nodes: DataFrame, by: list[str] | None = None, indent: int = 0) -> DataFrame:
    """One row for each document, or for each group of `by` (such as doc_id and root_pre): the columns of `by` and xml.

    Each element becomes a start and an end event. An open start tag is closed by the next event that is no attribute, so one
    look back per event will do; the pieces are put together in order. With indent > 0 elements that hold no text start on
    lines of their own.
    """
    by = by or ["doc_id"]
    event = lambda at, b, c, kind: F.struct(F.col(at).alias("_a"), F.lit(b).alias("_b"), c.alias("_c"), kind.alias("kind"))
    start, end = event("pre", 0, F.lit(0), F.col("kind")), event("last", 1, -F.col("depth"), F.lit("end"))
    both = F.explode(F.when(F.col("kind") == ELEMENT, F.array(start, end)).otherwise(F.array(start)))
    order = Window.partitionBy(*by).orderBy("_a", "_b", "_c")
    events = nodes.select(*by, "tag", "value", "depth", both.alias("_event")).select(*by, "tag", "value", "depth", "_event.*")
    events = events.withColumn("_before", F.lag("kind").over(order))
    kind, before = F.col("kind"), F.col("_before")
    pending = before.isin(ELEMENT, ATTRIBUTE)
    close = F.when(pending & (kind != ATTRIBUTE), F.lit(">")).otherwise(F.lit(""))
    line = F.lit("")
    if indent:
        pad = F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), F.col("depth") - 1))
        line = F.when(before.isNull() | before.isin("text", CDATA), F.lit("")).when((kind == ELEMENT) | ((kind == "end") & (before == "end")), pad).otherwise(F.lit(""))
    value = F.coalesce("value", F.lit(""))
    piece = (
        F.when(kind == ELEMENT, F.concat(close, line, F.lit("<"), "tag"))
        .when(kind == ATTRIBUTE, F.concat(F.lit(" "), F.col("tag"), F.lit('="'), escape(value, True), F.lit('"')))
        .when(kind == CDATA, F.concat(close, F.lit("<![CDATA["), F.replace(value, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")))
        .when((kind == "end") & (before == ELEMENT), F.lit("/>"))
        .when(kind == "end", F.concat(close, line, F.lit("</"), "tag", F.lit(">")))
        .otherwise(F.concat(close, escape(value)))
    )
    rows = events.select(*by, F.struct("_a", "_b", "_c", piece.alias("piece")).alias("e"))
    made = rows.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return made.select(*by, F.array_join(F.transform("e", lambda x: x["piece"]), "").alias("xml"))
