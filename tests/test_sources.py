import os
import time

from sylva.model import COLUMNS
from sylva.operators import aggregate as ag
from sylva.operators.serialize import to_xml
from sylva.plans.match import match
from sylva.sources import documents, filesystem
from sylva.streaming.documents import each_batch, stream_nodes


def put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    return str(folder)


def test_documents_and_store(spark, tmp_path):
    path = put(tmp_path / "xml", a="<r><x>1</x></r>", b="<r><x>2</x></r>")
    assert documents.detect(spark, path) == "xml"
    nodes = documents.read_documents(spark, path)
    assert sorted(r["xml"] for r in to_xml(nodes).collect()) == ["<r><x>1</x></r>", "<r><x>2</x></r>"]
    documents.write_nodes(nodes, store := str(tmp_path / "nodes"))
    assert documents.detect(spark, store) == "nodes"
    again = documents.read_documents(spark, store)
    assert again.columns == COLUMNS and again.exceptAll(nodes).count() == 0
    found = match(again, "/r/x/text()")
    assert sorted(r["value"] for r in found.collect()) == ["1", "2"]
    assert "EqualTo(path,/r/x/text())" in found._jdf.queryExecution().executedPlan().toString()
    documents.write_xml(nodes, out := str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["<r><x>1</x></r>", "<r><x>2</x></r>"]
    documents.discard(nodes)
    assert documents.detect(spark, put(tmp_path / "html", p="<!DOCTYPE html><p>x")) == "html"


def test_records_of_one_large_file(spark, tmp_path):
    path = put(tmp_path / "big", f='<all v="1">' + "".join(f'<rec n="{k}"><v>{k}</v></rec>\n' for k in range(500)) + "</all>")
    out = ag.aggregate(documents.read_documents(spark, path, record="rec"), "/rec", [ag.Agg("sum", "int", "v", "v")])
    assert (out.count(), out.agg({"v": "sum"}).collect()[0][0]) == (500, sum(range(500)))


def test_filesystem(spark, tmp_path):
    put(tmp_path / "top", b="xx", a="y")
    put(tmp_path / "top" / "sub", c="zzz")
    os.symlink(tmp_path / "top" / "a", tmp_path / "top" / "link")
    nodes = filesystem.list_files(spark, str(tmp_path / "top"))
    names = [r["value"] for r in match(nodes, "//name/text()").orderBy("pre").collect()]
    assert names == ["top", "a", "b", "sub", "c"]
    sizes = [r["value"] for r in match(nodes, "//file/size/text()").orderBy("pre").collect()]
    assert sizes == ["1", "2", "3"]
    assert match(nodes, "//file/filelink/@*").count() == 6


def test_stream(spark, tmp_path):
    path = put(tmp_path / "in", a="<r><x>1</x></r>", bad="<r><x>")
    work = lambda: each_batch(stream_nodes(spark, path), lambda n: ag.aggregate(n, "/r", [ag.Agg("sum", "int", "x", "v")]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    work()
    put(tmp_path / "in", c="<r><x>2</x><x>3</x></r>")
    time.sleep(0.1)
    work()
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 5]
