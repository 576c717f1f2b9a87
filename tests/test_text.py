"""Text functions against their stated examples and plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_text_hash_ignores_case_digits_and_space(spark):
    a, b, c = values(spark, T.text_hash(F.col("t")), "Order 12\n of  2024 ", "order 99 of 1999", "order of")
    plain = re.sub(r"\s+", " ", re.sub(r"\d", "0", "Order 12\n of  2024 ".lower())).strip()
    assert a == b == hashlib.sha256(plain.encode()).hexdigest() != c


def test_clean_text(spark):
    got = values(spark, T.clean_text(F.col("t")), "soft­hyphen", "exam-\nple", "a \t  b", "a\n\n\n\nb", "  x \n")
    assert got == ["softhyphen", "example", "a b", "a\n\nb", "x"]


@pytest.mark.parametrize(
    "line,want",
    [
        ("1. INTRODUCTION AND SUMMARY", True),
        ("DECISION AND ORDER", True),
        ("2.1 Background of the Application", True),
        ("JANE DOE", False),
        ("BY EMAIL", False),
        ("page 3 DECISION", False),
        ("A. Smith and others", False),
        ("IV. CONCLUSION", True),
        ("ORDER 2024", False),
        ("abc", False),
        ("3 the applicant filed its evidence late, and so,", False),
        ("", False),
    ],
)
def test_headings(spark, line, want):
    assert values(spark, T.is_heading(F.col("t")), line) == [want]


def test_dockets(spark):
    got = values(spark, T.find_docket(F.lit(None).cast("string"), F.col("t")), "see_EB-2025-0009_x", "XEB-2025-0009", "RP-2001-0001 EB-2025-0001", "AUC Proceeding 28000 and", "none")
    assert got == ["EB-2025-0009", None, "EB-2025-0001", "28000", None]


def test_terms(spark):
    assert values(spark, T.terms(F.col("t")), "What is the Rate-Order v1.2? é3") == [["rate-order", "v1.2", "3"]]
    assert values(spark, T.exact_terms(F.col("t")), "EB-2026-0015 of OEB: IESO paid 1,200.50, in 2024.") == [["1,200.50", "2024", "eb-2026-0015", "ieso"]]


def test_citations(spark):
    assert values(spark, T.citations(F.col("t"), F.lit(4)), "Approved [1]. Also [2, 3] and [9].", "none", "[4] [4] [0]") == [[1, 2, 3], [], [4]]


def test_cache_key_is_about_the_question_and_its_scope(spark):
    a, b, c = values(spark, T.cache_key(F.col("t"), v=F.lit("v1")), "What is  it?", "what is it", "what was it")
    (d,) = values(spark, T.cache_key(F.col("t"), v=F.lit("v2")), "what is it")
    assert a == b != c and a != d


def test_markdown(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", None], [None, ""], ["x  y\nz"]],), ([["only"], ["one"]],), ([["a", "b"]],)], "r array<array<string>>")
    assert [r[0] for r in df.select(T.table_to_markdown(F.col("r"))).collect()] == ["| a | b |\n|---|---|\n| 1 |  |\n| x y z |  |", None, None]


def test_small_ones(spark):
    assert values(spark, T.safe_name(F.col("t")), "a b/ç.pdf", "x" * 90) == ["a_b_.pdf", "x" * 80]
    assert values(spark, T.index_version(F.lit("v1-ab"), F.col("t")), "Org/bge-small-en-v1.5") == ["v1-ab__bge_small_en_v1_5"]
    assert values(spark, T.context_header(F.lit("T"), F.lit(None).cast("string"), F.col("t")), "S", "") == ["T | S", "T"]
    assert values(spark, T.pages_label(F.lit(1), F.length("t")), "a", "abc") == ["p. 1", "pp. 1-3"]
