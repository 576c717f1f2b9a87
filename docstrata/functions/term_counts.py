"""Terms of whole batches of texts, counted with Arrow and numpy: the terms of ``functions.text.terms``, for tasks that read very many texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docstrata.functions.text import STOP_WORDS

# A term is a run of these without dots and dashes at its ends; any other byte of a lower-cased text parts runs.
_RUNS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789-." else 32 for b in range(256))
BLOCK_BYTES = 16 << 20


@dataclass
class Counts:
    """How often (``tf``) the ``term``-th of ``terms`` occurs in the ``text``-th text, by term, then text; ``total``: all terms of each text."""

    terms: pa.Array
    term: np.ndarray
    text: np.ndarray
    tf: np.ndarray
    total: np.ndarray


def count_terms(texts: list[str | None]) -> Counts:
    runs = [None if t is None else t.lower().encode("utf-8", "surrogatepass").translate(_RUNS) for t in texts]
    words = pc.ascii_split_whitespace(pa.array(runs, pa.large_binary()).cast(pa.large_string()))
    text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = pc.ascii_trim(words.flatten(), "-.").dictionary_encode()
    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    counts = ~pc.is_in(terms, value_set=pa.array(["", *STOP_WORDS], terms.type)).to_numpy(zero_copy_only=False)
    real = counts[code]
    code, text = code[real], text[real]
    n = max(1, len(texts))
    pairs, tf = np.unique(code * n + text, return_counts=True)
    return Counts(terms, pairs // n, pairs % n, tf, np.bincount(text, minlength=len(texts)))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of text, or one longer text."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        for i in np.flatnonzero(np.diff((size + np.cumsum(lengths)) // most, prepend=size // most)).tolist():
            held.append(batch.slice(begin, i + 1 - begin))
            yield pa.Table.from_batches(held).combine_chunks()
            held, begin = [], i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
        size = int(size + lengths.sum()) % most
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def hash_vectors(texts: list[str | None], dim: int = 64) -> pa.Array:
    """The vectors of ``retrieval.hash_embedding``; those of texts without terms are zero."""
    found = count_terms(texts)
    used = np.unique(found.term)
    place = np.zeros(len(found.terms), np.int64)
    place[used] = [int(hashlib.md5(t.encode()).hexdigest()[:2], 16) % dim for t in found.terms.take(pa.array(used)).to_pylist()]
    counts = np.bincount(found.text * dim + place[found.term], weights=found.tf, minlength=len(texts) * dim).reshape(-1, dim)
    norm = np.sqrt((counts * counts).sum(axis=1))
    counts /= np.where(norm > 0, norm, 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(counts.reshape(-1)))


def hashed(rows: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """``rows`` with the vectors of ``retrieval.hash_embedding`` in the place of a text column, made a block at a time."""
    schema = T.StructType([*(f for f in rows.schema if f.name != text), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            made = hash_vectors(block[text].to_pylist())
            yield from block.drop_columns([text]).append_column(out, made).to_batches()

    return rows.mapInArrow(run, schema)
