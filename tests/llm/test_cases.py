"""Every operator on odd rows, on empty tables and on columns with clashing names."""

import hashlib
import zlib

import pyarrow as pa
import pytest

import corpus_pipeline
from sylva.llm.queries import QUERIES

from .conftest import ODD, SCHEMAS, doc

ALL = sorted(QUERIES)


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables()).collect() == []


def result(spark, tables, name, **more):
    return [r.asDict() for r in QUERIES[name](spark, tables(documents=ODD, labels=[{"doc_id": 7, "quality": 1, "toxic": 0}, {"doc_id": None, "quality": None, "toxic": 1}, {"doc_id": 8, "quality": 0, "toxic": None}], benchmark=[{"item_id": 1, "text": "below zero"}, {"item_id": None, "text": "x"}, {"item_id": 2, "text": None}, {"item_id": 3, "text": ""}], **more)).collect()]


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


@pytest.mark.parametrize("name", ["op1_sharding", "op3_near_duplicates", "op4_quality", "op5_language", "op6_tokens", "op7_mixing", "op8_toxicity"])
def test_odd_rows_all_stay(spark, tables, name):
    assert ids(result(spark, tables, name)) == ids(ODD)


def test_odd_values(spark, tables):
    size = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in result(spark, tables, "op1_sharding")}
    assert size[1] == size[2] == (8, 0) and size[5] == (8 + len(ODD[7]["text"].encode()), zlib.crc32(ODD[7]["text"].encode()))
    near = result(spark, tables, "op3_near_duplicates")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near if r["doc_id"] in (1, 3, 4, 6, 7, 8)} == {1: (0, 1, True), 3: (0, 3, True), 4: (1, 4, True), 6: (1, 6, True), 7: (6, 7, True), 8: (6, 7, False)}
    assert all(r["component_id"] is None and r["kept"] for r in near if r["doc_id"] is None)
    quality = {r["doc_id"]: r for r in result(spark, tables, "op4_quality")}
    assert (quality[1]["n_words"], quality[1]["base_failed"], quality[1]["kept"]) == (0, True, False)
    assert (quality[6]["n_words"], quality[6]["word_chars"], quality[6]["n_repeat_words"], quality[6]["base_failed"]) == (60_000, 240_000, 60_000, True)
    language = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in result(spark, tables, "op5_language")}
    assert language[1] == language[2] == language[3] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in language.values())


def test_clashing_columns(spark, tables, clashing):
    names = ["digest", "payload", "big", "first", "copies", "revisit", "refers_to", "bytes"]
    pages = pa.Table.from_pylist([page(1, "x" * 1000) | dict.fromkeys(names, 7), page(2, "x" * 1000) | dict.fromkeys(names, 7)], schema=pa.schema([*SCHEMAS["pages"], *[(n, pa.int32()) for n in names]]))
    path = tables(documents=clashing, benchmark=[{"item_id": 1, "text": "no such words here"}], pages=pages)
    for name in ALL:
        rows = QUERIES[name](spark, path).collect()
        assert name != "op2_warc" or {(r["page_id"], r["refers_to"]) for r in rows} == {(1, 2), (2, None)}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        assert {r["kept"] for r in kept.collect()} == {7}


def test_repeated_rows_in_near_dedup_stage(spark, tables):
    docs = spark.read.parquet(f"{tables(documents=ODD)}/documents.parquet")
    rows = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "None", "None", "5", "6", "7", "9", "9", "-3"])


def page(k, html, url="http://x/"):
    return {"page_id": k, "url": url, "html": html}


def test_warc_cases(spark, tables):
    big, other, small = "<p>" + "x" * 1000, "é" * 500, "y" * 999
    path = tables(pages=[page(1, big), page(5, big), page(3, big, None), page(2, small), page(4, small), page(6, None), page(7, ""), page(8, other), page(8, other), page(None, big), page(9, "z" * 20_000_000)])
    rows = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in QUERIES["op2_warc"](spark, path).collect())
    of = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert [r[:3] for r in rows] == [(-1, "revisit", 5), (1, "revisit", 5), (2, "response", None), (3, "revisit", 5), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (8, "revisit", 8), (9, "response", None)]
    assert rows[0][3:] == (1003, of(big)) and rows[6][3:] == rows[7][3:] == (0, of("")) and rows[8][3:] == rows[9][3:] == (1000, of(other)) and rows[10][3] == 20_000_000


def test_leaks_and_passages(spark, tables):
    item = "which planet of our system has the most moons and what is the name of the largest one answer saturn titan"
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(words[:70])
    rows = [doc(1, "start here " + item + " end here"), doc(2, "which planet of our system has the most"), doc(3, " ".join(f"a{k}" for k in range(90)) + " " + passage), doc(4, passage + " " + " ".join(f"b{k}" for k in range(90))), doc(5, " ".join(words[100:140])), doc(6, " ".join(words[100:140]))]
    fuzzy = passage.split()
    fuzzy[20] = "changed"
    fuzzy[41:42] = ["one", "more"]
    rows.append(doc(7, "c1 c2 c3 " + " ".join(fuzzy)))
    path = tables(documents=rows, benchmark=[{"item_id": 9, "text": item.upper() + "!"}])
    assert [(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontamination"](spark, path).collect()] == [(1, 9)]
    found = {r["doc_id"]: r for r in QUERIES["op9_passages"](spark, path).collect()}
    assert set(found) == {4, 7}
    assert (found[4]["start"], found[4]["end"], found[4]["source_ids"]) == (0, 70, [3])
    assert (found[7]["start"], found[7]["end"]) == (3, 74) and 3 in found[7]["source_ids"]
    from sylva.llm.common import Scratch
    from sylva.llm.passages import without_passages

    left = {r["doc_id"]: r["text"] for r in without_passages(spark.read.parquet(f"{path}/documents.parquet"), Scratch(spark, "t")).collect()}
    assert left[7] == "c1 c2 c3" and left[4].startswith("b0 b1") and left[3] == rows[2]["text"]
