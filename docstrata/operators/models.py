"""Models behind Arrow batches: loaded once in a worker, fed with texts of like length, for embedders, pair scorers and judges.

A model is any object with one of the methods ``encode(texts)`` (a vector for each), ``score(questions, passages)`` (a number for each)
or ``judge(questions, references, answers)`` (correct or None, and a reason, for each). What pads a batch to its longest text wastes
the rest of it, so rows are buffered and dealt to batches by length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docstrata.functions.text import STOP_WORDS, TERM

VERDICT = "struct<correct:boolean,reason:string>"
_loaded: dict[str, object] = {}


@dataclass(frozen=True)
class BatchModel:
    """``load`` makes the model in a worker, once for each ``name``; ``batch`` texts go to it at a time, of ``buffered`` rows that are ordered by length."""

    name: str
    load: Callable[[], object]
    batch: int = 64
    buffered: int = 4096

    def get(self) -> object:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]


def by_length(lengths: list[int], size: int) -> list[np.ndarray]:
    """Places of the rows for each batch: of like length, and no more than ``size``."""
    order = np.argsort(np.array(lengths, np.int64), kind="stable")
    return [order[a : a + size] for a in range(0, len(order), size)]


def padding(lengths: list[int], batches: list[np.ndarray]) -> float:
    """Share of what the batches take that is padding."""
    n = np.array(lengths, np.int64)
    taken = sum(int(n[b].max()) * len(b) for b in batches if len(b))
    return 1 - int(n.sum()) / taken if taken else 0.0


def applied(df: DataFrame, model: BatchModel, method: str, inputs: list[str], out: str, kind: str) -> DataFrame:
    """``df`` with the model's answer for each row. A row with a null input has a null answer; texts go to the model whole."""
    field = T.StructField(out, T._parse_datatype_string(kind))
    schema, arrow = T.StructType([*(f for f in df.schema if f.name != out), field]), to_arrow_type(field.dataType)
    names = [f.name for f in schema if f.name != out]

    def answers(table: pa.Table) -> pa.Array:
        columns = [table[c].to_pylist() for c in inputs]
        whole = [i for i, r in enumerate(zip(*columns)) if None not in r]
        lengths = [sum(len(str(c[i])) for c in columns) for i in whole]
        found: list = [None] * table.num_rows
        call = getattr(model.get(), method)
        for places in by_length(lengths, model.batch):
            rows = [whole[p] for p in places.tolist()]
            for i, answer in zip(rows, call(*([c[i] for i in rows] for c in columns)), strict=True):
                found[i] = answer
        return pa.array(found, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            done = table.select(names).append_column(out, answers(table))
            yield from done.to_batches(max_chunksize=model.buffered)

        for batch in batches:
            for a in range(0, batch.num_rows, model.buffered):
                held.append(batch.slice(a, model.buffered))
                if sum(b.num_rows for b in held) >= model.buffered:
                    yield from flush()
        if held:
            yield from flush()

    return df.mapInArrow(run, schema)


def dealt_by_length(df: DataFrame, text: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt to tasks by ranges of text length, so that the batches of a task are alike; texts of one length are spread by their hash."""
    keys = [F.length(text), F.xxhash64(text)]
    return df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)


def embedded(df: DataFrame, embed: Callable[[Column], Column] | BatchModel, text: str, out: str = "embedding") -> DataFrame:
    """Vectors of a text column by a column function or by a model."""
    if isinstance(embed, BatchModel):
        return applied(df, embed, "encode", [text], out, "array<double>")
    return df.withColumn(out, embed(F.col(text)))


def rescored(hits: DataFrame, score: Callable[[DataFrame], Column] | BatchModel, out: str = "rescored") -> DataFrame:
    """Scores of (qtext, context and text) by a column function of the hits or by a model for pairs."""
    if isinstance(score, BatchModel):
        passage = F.concat_ws("\n", F.coalesce("context", F.lit("")), "text")
        return applied(hits.withColumn("_passage", passage), score, "score", ["qtext", "_passage"], out, "double").drop("_passage")
    return hits.withColumn(out, score(hits))


def judged(rows: DataFrame, judge: BatchModel, question: str = "question", reference: str = "reference", answer: str = "answer") -> DataFrame:
    """``rows`` with judge_correct (null where the judge fails or declines) and judge_reason."""
    made = applied(rows, judge, "judge", [question, reference, answer], "_verdict", VERDICT)
    return made.withColumns({"judge_correct": F.col("_verdict.correct"), "judge_reason": F.col("_verdict.reason")}).drop("_verdict")


class HashEmbedder:
    """A stand-in without a model, with the vectors of ``retrieval.hash_embedding``."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.term, self.stop = dim, re.compile(TERM), frozenset(STOP_WORDS)

    def encode(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for text in texts:
            counts = np.zeros(self.dim)
            for term in self.term.findall(text.lower()):
                if term not in self.stop:
                    counts[int(hashlib.md5(term.encode()).hexdigest()[:2], 16) % self.dim] += 1
            norm = float(np.sqrt((counts * counts).sum()))
            out.append((counts / norm if norm else counts).tolist())
        return out


class OverlapScorer:
    """A stand-in without a model, with the scores of ``retrieval.overlap_score``."""

    def __init__(self) -> None:
        self.term, self.stop = re.compile(TERM), frozenset(STOP_WORDS)

    def _terms(self, text: str) -> set[str]:
        return {t for t in self.term.findall(text.lower()) if t not in self.stop}

    def score(self, questions: list[str], passages: list[str]) -> list[float]:
        asked = [self._terms(q) for q in questions]
        return [round(len(a & self._terms(p)) / max(1, len(a)), 6) for a, p in zip(asked, passages)]


class PhraseJudge:
    """A stand-in without a model: an answer is right if it holds one of the reference phrases (a line each), whatever case and white space."""

    def judge(self, questions: list[str], references: list[str], answers: list[str]) -> list[dict]:
        plain = lambda t: " ".join(t.lower().split())
        found = [next((r for r in refs.split("\n") if r.strip() and plain(r) in plain(a)), None) for refs, a in zip(references, answers)]
        return [{"correct": f is not None, "reason": f"holds: {f}" if f else "holds none of the phrases"} for f in found]
