"""Golden-set evaluation: ranks of expected sources, needles in contexts, rates and latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import squeeze

RANGES = 128


def percentiles_nearest(rows: DataFrame, by: str, value: str, ranges: int = RANGES, **percents: float) -> DataFrame:
    """Nearest-rank percentiles of a numeric column (half ranks to even), one column for each name; exact.

    Equal values of a group are counted first. A sketch of the different values (quantiles of those of each group, merged from all tasks)
    cuts them into ranges that hold about as many each, wherever the values crowd; counts by range tell which range holds a rank,
    and values are put in order in those ranges only. What is gathered for a group is a row for each range, and what one task orders is a part of about 1/``ranges`` of it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    # the sketch and the number of rows of each group; both are merged from partial ones
    sketch = counts.groupBy(by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], F.lit(10 * ranges)).alias("_cuts"), F.sum("_c").alias("_n"))
    ranged = counts.join(sketch, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = ranged.groupBy(by, "_range").agg(F.sum("_c").alias("_sum"), F.max("_n").alias("_n"))
    below = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy(by).orderBy("_range"))).withColumn("_before", F.col("_upto") - F.col("_sum"))
    place = lambda p: F.bround(F.lit(p / 100) * (F.col("_n") - 1)).cast("long") + 1
    within = lambda p, a, b: (place(p) > a) & (place(p) <= b)
    wanted = below.where(reduce(lambda a, b: a | b, (within(p, F.col("_before"), F.col("_upto")) for p in percents.values()))).select(by, "_range", "_before")
    here = F.sum("_c").over(Window.partitionBy(by, "_range").orderBy(value))
    ranked = ranged.join(wanted, [by, "_range"]).withColumn("_upto", here + F.col("_before"))
    return ranked.groupBy(by).agg(*(F.max(F.when(within(p, F.col("_upto") - F.col("_c"), F.col("_upto")), F.col(value))).alias(name) for name, p in percents.items()))


def first_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """question_id, first: the best rank at which an expected source was found, null if none.

    results: question_id, rank, source_id; expected: question_id, source_id.
    """
    hits = results.join(expected.distinct(), ["question_id", "source_id"]).groupBy("question_id").agg(F.min("rank").alias("first"))
    return expected.select("question_id").distinct().join(hits, "question_id", "left")


def needle_ranks(results: DataFrame, needles: DataFrame) -> DataFrame:
    """question_id, answer_rank: the best rank whose context holds a needle, whatever case and white space."""
    plain = lambda c: squeeze(F.lower(c))
    hits = results.join(needles, "question_id").where(F.contains(plain(F.col("context")), plain(F.col("needle"))))
    found = hits.groupBy("question_id").agg(F.min("rank").alias("answer_rank"))
    return needles.select("question_id").distinct().join(found, "question_id", "left")


def summary(ranks: DataFrame, k: int = 6) -> DataFrame:
    """One row: n_questions, hit rates at 1, 3 and k, and the mean reciprocal rank."""
    within = lambda n: F.round(F.avg(F.coalesce(F.col("first") <= n, F.lit(False)).cast("double")), 6)
    mrr = F.round(F.avg(F.coalesce(1 / F.when(F.col("first") <= k, F.col("first")), F.lit(0.0))), 6)
    return ranks.agg(F.count("*").alias("n_questions"), within(1).alias("hit_1"), within(3).alias("hit_3"), within(k).alias("hit_k"), mrr.alias("mrr"))


def report(rows: DataFrame, k: int = 6) -> DataFrame:
    """One row of an evaluation. rows: one for each question, with first, answer_rank, retrieval_ms, total_ms, and where there is an answer: answer_right, cited_expected,
    read_tokens, written_tokens, input_tokens, and, if it was judged, judge_correct; ``error`` where the question failed, which counts for nothing else."""
    done = F.col("error").isNull()
    rate = lambda c: F.round(F.avg(F.when(done, F.coalesce(c, F.lit(False)).cast("double"))), 6)
    known = lambda c: F.round(F.avg(F.when(done & F.col(c).isNotNull(), F.col(c).cast("double"))), 6)
    tokens = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    first, read, written, fresh = F.col("first"), tokens("read_tokens"), tokens("written_tokens"), tokens("input_tokens")
    one = rows.agg(
        F.count_if(done).alias("n_questions"),
        F.count_if(~done).alias("n_errors"),
        rate(first <= 1).alias("hit_1"),
        rate(first <= 3).alias("hit_3"),
        rate(first <= k).alias("hit_k"),
        rate(F.col("answer_rank") <= k).alias("answer_hit_k"),
        F.round(F.avg(F.when(done, F.coalesce(1 / F.when(first <= k, first), F.lit(0.0)))), 6).alias("mrr"),
        F.round(F.avg(F.when(done, F.col("retrieval_ms"))), 6).alias("retrieval_ms_mean"),
        known("answer_right").alias("answer_acc"),
        known("cited_expected").alias("cited_expected_rate"),
        *([known("judge_correct").alias("answer_acc_judged"), F.count_if(done & F.col("judge_correct").isNotNull()).alias("judge_graded")] if "judge_correct" in rows.columns else []),
        read.alias("read_tokens"),
        written.alias("written_tokens"),
        fresh.alias("uncached_input_tokens"),
        F.round(read / F.greatest(F.lit(1), read + written + fresh), 6).alias("cache_hit_ratio"),
    )
    timed = rows.where(done).select(F.lit(1).alias("all"), "retrieval_ms", "total_ms")
    for name in ("retrieval_ms", "total_ms"):
        one = one.join(percentiles_nearest(timed, "all", name, **{f"{name}_p50": 50, f"{name}_p95": 95}).drop("all"), how="left")
    return one


def to_markdown(summary: dict, rows: list[dict], title: str = "Evaluation") -> str:
    """The report as a page: the rates, then a line for each question."""
    shown = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| metric | value |", "|---|---|", *(f"| {name} | {shown(v)} |" for name, v in summary.items())]
    lines += ["", "| question | first | answer found | ms |", "|---|---|---|---|"]
    lines += [f"| {r['question_id']} | {r['first'] or 'miss'} | {'yes' if r['answer_rank'] else 'no'} | {shown(r.get('retrieval_ms'))} |" for r in rows]
    return "\n".join(lines) + "\n"
