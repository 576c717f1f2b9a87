"""Rows that share an id, nulls and clashing columns in every stage of the pipeline."""

import pytest

import corpus_pipeline
from docstrata.llm import storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS _n", "3 AS kept_text", "4 AS print", "5 AS added")


def rows_of(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def test_rows_with_one_id_are_judged_each_for_itself(spark):
    a, b, c = ("the quick brown fox jumps over it", "una frase muy distinta de las otras", "and yet another sentence about nothing")
    rows = [(7, a, None, None, None), (7, None, "x", None, 1), (7, "12 !", "x", "s", 1), (7, b, "en", "s", 1), (7, b, "de", "s", 1), (9, b, "en", "s", 1), (3, c, "en", "s", 1), (None, c, "en", "s", 1), (None, "1", None, None, None)]
    spoken = corpus_pipeline.language_id(spark, frame(spark, rows), "")
    assert spoken.columns == corpus_pipeline.COLUMNS
    assert rows_of(spoken) == sorted([(r[0], r[1]) for r in rows if r[1] and r[1] not in ("12 !", "1")], key=repr)
    single = corpus_pipeline.simhash_dedup(spark, frame(spark, [tuple(r) for r in spoken.collect()]), "")
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert rows_of(single) == sorted([(7, a), (7, b), (3, c)], key=repr)
    assert [r.lang for r in single.collect() if r.text == b] == ["de"]
    # repeated rows are combined before they are dealt out, so that no window holds them
    assert plan.count("Window ") == 0 and plan.count("hashpartitioning(_id") <= 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_nothing_and_of_nulls(spark, name, stage):
    assert stage(spark, frame(spark, []), "").count() == 0
    rows = [(1, None, None, None, None), (1, "", None, None, None), (None, "mail a@b.co here", None, "s", 1), (2, "word " * 40_000, "en", None, 1), (2, "word " * 40_000, "en", None, 1)]
    got = stage(spark, frame(spark, rows), "").collect()
    kept = {
        "language_id": [(None, 16), (2, 200_000), (2, 200_000)],
        "simhash_dedup": [(None, 16), (1, 0), (2, 200_000)],
        "suffix_dedup": [(None, 16), (2, 200_000), (2, 200_000)],
        "pii_redaction": [(1, 0), (1, 0), (None, 17), (2, 200_000), (2, 200_000)],
    }
    if name == "packing":
        assert {r.doc_id for r in got} == {1, 2, None}
        return
    assert sorted([(r.doc_id, len(r.text or "")) for r in got], key=repr) == sorted(kept[name], key=repr)
    assert name in ("language_id", "simhash_dedup") or all(r.n_chars == len(r.text) for r in got)


def test_only_the_last_table_is_left(spark, tmp_path):
    frame(spark, [(i, f"the text {i} of many words " * 5, "en", "s", 1) for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(storage._written)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(storage._written) - before
    # packing's table of pieces has been read by then, and so has every stage's but the last
    assert len(left) == 1 and left.pop().endswith("4-packing") and out.count() > 0
