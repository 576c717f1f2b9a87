"""Queries over whole tables that SQL cannot follow, against plain Python."""

import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators.chunking import Chunking, Packer, Words
from docstrata.plans.catalogue import queries

SF = "/root/testdata/sf0.001"
QUERIES = queries()


def clean(t):
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", t.replace("\u00ad", ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t\u00a0]+", " ", t)).strip()


def normalized(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s\-\.]", "", t.lower())).strip()


def exact(t):
    return sorted({m.strip(".,").lower() for m in re.findall(T.EXACT_TERM, t) if m.upper() not in ("OEB", "THE")} - {""})


CASES = ["\u00e93 \u00c9TAT 12\u20ac", "exam-\nple \u00e9-\nt\u00e9 a\u00a0 b", "Stra\u00dfe \u00fcber 1,200.50 EB-2026-0015\u00e9 IESO", "\u00bfQu\u00e9?  Da\u00df!", "x" * 400 + "?  \u00c9nd"]


def test_cases(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, t string").orderBy("i")
    got = rows.select(T.clean_text(F.col("t")), T.normalize_question(F.col("t")), T.exact_terms(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(clean(t), normalized(t), exact(t)) for t in CASES]


def whole(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,plain", [("clean_text_all", clean), ("normalize_question_all", normalized), ("exact_terms_all", lambda t: " ".join(exact(t)))])
def test_every_document(spark, name, plain):
    assert dict(map(tuple, QUERIES[name](spark, SF).collect())) == {r["doc_id"]: plain(r["text"]) for r in whole("documents")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_turn(spark):
    want = {(normalized(f" {r['text'].upper()}?"), r["conv_id"] % 2) for r in whole("conversations")}
    assert QUERIES["cache_key_all"](spark, SF).first().keys == len(want)


def test_chunk_tables_hold_every_order(spark, tmp_path):
    orders = [(k, k * k % 7, f"{k % 5}-URGENT", k + 0.5) for k in range(1, 201)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    want = set()
    for customer in {o[1] for o in orders}:
        packer = Packer(Chunking(max_table_tokens=100), Words())
        body = [f"| {k} | {p} | {x} |" for k, c, p, x in orders if c == customer]
        packer.page(1, "", {}, ["\n".join(["| key | priority | price |", "|---|---|---|", *body])])
        want |= {(str(customer), c["ordinal"], c["text"]) for c in packer.finish()}
    got = QUERIES["chunk_tables"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.ordinal, r.text) for r in got} == want
    assert sum(r.text.count("\n") - 1 for r in got) == len(orders)
