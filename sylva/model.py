"""The node table: one row for each element, attribute, text run and CDATA run of a document.

(doc_id, pre) is document order. A node's subtree are the rows of its document with pre from its own to its last. Attributes
follow their element at once, then come its text runs and child elements in order. depth is 1 for the root element;
attributes and text runs have the depth of their element. sib counts an element among its siblings of the same tag, nth among
all of them. pre may have gaps, nothing relies on their absence.
"""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("pre", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("sib", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("value", T.StringType()),
    T.StructField("t_prefix", T.StringType()), T.StructField("t_int", T.IntegerType()), T.StructField("t_suffix", T.StringType()),
])
COLUMNS = NODES.names
ELEMENT, ATTRIBUTE, TEXT, CDATA = "element", "attribute", "text", "cdata"


class SylvaError(ValueError):
    """Base of all errors that users can cause."""


class PathSyntaxError(SylvaError):
    """The path is no path."""


class UnsupportedPathError(SylvaError):
    """The path is well formed, but what it asks for is not available (in strict mode)."""


class SpecError(SylvaError):
    """An operator's specification makes no sense."""


class MalformedDocumentError(SylvaError):
    """A document is not well formed."""
