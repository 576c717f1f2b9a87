"""Table functions in SQL against the DataFrame functions; percentiles of crowded values; pages whose tables cannot be found."""

import random

from pyspark.sql import functions as F

from docstrata.operators import pages
from docstrata.operators.evaluation import percentiles_nearest
from docstrata.plans import documents
from docstrata.sources import table_functions

SF = "/root/testdata/sf0.001"


def test_chunks_in_sql_are_those_of_the_operator(spark):
    got, want = documents.chunk_pages_sql(spark, SF), documents.chunk_greedy(spark, SF)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 500


def test_pages_come_in_order(spark):
    table_functions.register(spark)
    rows = [(d, p, f"line {p} of {d}", []) for d in ("a", "b") for p in range(12, 0, -1)]
    spark.createDataFrame(rows, "doc_id string, page_no int, text string, tables array<string>").repartition(4).createOrReplaceTempView("made_pages")
    got = {r.doc_id: r for r in spark.sql("SELECT * FROM chunk_pages(TABLE(made_pages) PARTITION BY doc_id ORDER BY page_no)").collect()}
    assert got["a"].text.split("\n") == [f"line {p} of a" for p in range(1, 13)] and (got["b"].page_start, got["b"].page_end) == (1, 12)


def test_files_are_parsed_in_sql(spark):
    files = spark.createDataFrame([("1", b"<p>Body text</p>", "html"), ("2", b"x", "doc"), ("3", None, "html"), ("4", b"no", "pdf")], "key string, content binary, extension string")
    table_functions.register(spark)
    files.createOrReplaceTempView("some_files")
    got = sorted((r.key, r.page_no, r.text, r.error) for r in spark.sql("SELECT * FROM parse_files(TABLE(some_files))").collect())
    want = sorted((r.key, r.page_no, r.text, r.error) for r in pages.parse_files(files).collect())
    assert got == want and len(got) == 4


def test_crowded_values_are_dealt_out(spark):
    r = random.Random(5)
    # 99 of 100 values lie in a thousandth of the range
    data = {"crowd": [r.random() for _ in range(9900)] + [r.random() * 1000 for _ in range(100)], "small": [5.0, 7.0, 9.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    found = {x.k: x for x in percentiles_nearest(rows, "k", "v", p1=1, p50=50, p95=95).collect()}
    for k, vs in data.items():
        vs = sorted(vs)
        assert [found[k].p1, found[k].p50, found[k].p95] == [vs[round(p * (len(vs) - 1))] for p in (0.01, 0.5, 0.95)]
    # what one task orders: about a range's share
    cuts = rows.where("k = 'crowd'").agg(F.percentile_approx("v", [i / 128 for i in range(1, 128)], F.lit(1280))).first()[0]
    held = [sum(a < v <= b for v in data["crowd"]) for a, b in zip([-1.0, *cuts], [*cuts, 1e9])]
    assert max(held) < 3 * len(data["crowd"]) / 128


def test_a_page_whose_tables_cannot_be_found_keeps_its_text():
    class Page:
        def find_tables(self):
            raise RuntimeError("odd drawing")

    assert pages._page_tables(Page()) == []
