"""Plans over files: batch, stream, error rows, and the registered queries against SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from foliant import queries
from foliant.operators import relational
from foliant.plans import extract
from foliant.sources.pdf import from_column, read_pdfs
from foliant.sources.writer import simple_pdf, text_pdf
from foliant.streaming.ingest import extract_stream, write_texts

SF = "/root/testdata/sf0.001"
HELLO = b"BT /F1 12 Tf 72 700 Td (Hello World) Tj ET "


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdfs")
    (d / "a.pdf").write_bytes(simple_pdf([HELLO]))
    (d / "b.pdf").write_bytes(text_pdf("one\ntwo"))
    (d / "c.pdf").write_bytes(b"not a pdf")
    (d / "d.pdf").write_bytes(b"%PDF-1.7\nstartxref\n5\n")
    (d / "e.txt").write_bytes(b"ignored")
    return str(d)


def _by_name(rows):
    return {os.path.basename(r["doc_id"]): (r["text"], r["error_class"]) for r in rows}


def test_batch_error_rows_and_stream_agree(spark, folder, tmp_path):
    batch = _by_name(extract.extract_text(read_pdfs(spark, folder)).collect())
    assert batch == {"a.pdf": ("Hello World\n", None), "b.pdf": ("one\ntwo\n", None), "c.pdf": (None, "Malformed"), "d.pdf": (None, "Malformed")}
    write_texts(extract_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert _by_name(spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_stages_are_tables(spark, folder):
    files = read_pdfs(spark, folder)
    assert extract.pages(files).count() == 2
    assert {r["source"] for r in extract.objects(files).collect()} == {"xref"}
    assert extract.content_ops(files).filter("op = 'Tj'").count() == 3
    assert extract.fonts(files).filter("subtype = 'Type0'").count() == 1
    meta = {os.path.basename(r["doc_id"]): r for r in extract.documents_meta(files).collect()}
    assert meta["a.pdf"]["n_pages"] == 1 and meta["c.pdf"]["error_message"] == "no startxref"
    null = spark.createDataFrame([("x", None)], "id string, raw binary")
    assert extract.extract_text(from_column(null, "raw", "id")).first()["error_class"] == "Malformed"


def test_only_what_is_asked_for_is_read(spark, folder):
    plan = extract.extract_text(read_pdfs(spark, folder).filter("path like '%a.pdf'"))._jdf.queryExecution().executedPlan().toString()
    assert "modificationTime" not in plan.split("ReadSchema")[-1]
    assert "Exchange" not in plan


def test_relational_helpers(spark):
    values = spark.createDataFrame([("d", 1), ("d", 2), ("d", 9)], "doc_id string, ref int")
    objects = spark.createDataFrame([("d", 1, 5, "xref"), ("d", 1, None, "objstm"), ("d", 2, None, "objstm")], "doc_id string, obj_id int, offset long, source string")
    got = {r["ref"]: r["source"] for r in relational.lookup(values, objects, "ref").collect()}
    assert got == {1: "xref", 2: "objstm", 9: None}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)


def test_queries_without_sql_run(spark):
    plain = set(queries.QUERIES) - set(queries.ORACLE_SQL)
    assert plain == {"between_exists", "layout_boxes", "plane_full"}
    assert queries.layout_boxes(spark, SF).count() == queries.layout_lines(spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inherited_values_in_deep_trees_and_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, 1.0 if i == 0 else 2.0 if i == 150 else None) for i in range(301)]
    rows += [("x", "y", None), ("y", "x", None), ("z", "x", None), ("p", "q", None), ("q", "p", 5.0), ("r", "p", None), ("orphan", "gone", None), ("alone", None, None)]
    got = {r["id"]: r["box"] for r in relational.inherited(spark.createDataFrame(rows, "id string, parent string, box double"), "id", "parent", "box").collect()}
    want = {f"n{i}": 1.0 if i < 150 else 2.0 for i in range(301)}
    assert got == want | {"x": None, "y": None, "z": None, "p": 5.0, "q": 5.0, "r": 5.0, "orphan": None, "alone": None}


def test_columns_equal_the_engine(spark):
    from pyspark.sql import functions as F

    from foliant.functions import columns, filters, syntax

    texts = ["[a b", "(x", "<<", "<41", "/Name x", "12 0 R ", "12 0", "plain text/with[marks(and<signs", "  \t12 1 R x", "é漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", columns.object_kind(F.col("t")).alias("kind"), columns.utf8_length(F.col("t")).alias("n"), columns.tokens(F.col("t")).alias("tokens")).collect()
    for r in got:
        raw = r["t"].encode()
        assert r["kind"] == syntax.kind_at(raw, 0)[0] and r["n"] == syntax.code_points(raw)
        assert [x.encode() for x in r["tokens"]] == queries._tokens(raw)
    digits = spark.createDataFrame([("4 1\n42",), ("414",), ("",), ("aBcD",)], "t string")
    for r in digits.select("t", columns.hex_string(F.col("t")).alias("h"), columns.ascii_hex(F.concat("t", F.lit(">zz"))).alias("a")).collect():
        assert bytes(r["h"]) == syntax.hex_string(b"<" + r["t"].encode() + b">") and bytes(r["a"]) == filters.ascii_hex(r["t"].encode() + b">zz")
