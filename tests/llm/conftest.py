import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
SCHEMAS = {
    "documents": DOCUMENTS, "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]), "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
}


def doc(doc_id, text, lang="en", source="a"):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text and characters of all lengths.
ODD = [
    doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one"), doc(4, "one"), doc(None, "nobody knows this text at all"), doc(None, None, None, None), doc(5, "é ß 日本 \U0001f600 x y", None, None),
    doc(6, "word " * 60_000, "en", "b"), doc(7, "The cat sat on the mat. " * 3), doc(8, "the CAT sat on the mat. " * 3, "fr", None), doc(9, "1234 5678", "en"), doc(-3, "below zero"), doc(9, "another text with the same name", "en"),
]


@pytest.fixture
def tables(tmp_path):
    def write(**rows):
        for name, schema in SCHEMAS.items():
            given = rows.get(name, [])
            if isinstance(given, pa.Table):
                pq.write_table(given, tmp_path / f"{name}.parquet")
            else:
                pq.write_table(pa.Table.from_pylist(given, schema=schema), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def clashing():
    """ODD with columns that carry the names operators use."""
    names = ["slot", "shard", "kept", "score", "lang_pred", "digest", "node", "bytes", "mix_slot", "size", "_order", "predicted"]
    return pa.Table.from_pylist([r | dict.fromkeys(names, 7) for r in ODD], schema=pa.schema([*DOCUMENTS, *[(n, pa.int32()) for n in names]]))


SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
