"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together in another order with markers.

A text is read twice by a lazy match iterator: once to count its units, once to advance to the two ranks at which it is cut. No
list of units is ever made, so what a text takes beside itself does not grow with it.

Defined results: a null text counts as empty, and an empty text is plain; a null id draws as an empty number does; rows are told
apart by nothing, so repeated rows give repeated results; an empty table gives an empty one; texts of any length are cut whole;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINTS = r"(?s)."
# The marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count_units(units: re.Pattern, text: str) -> int:
    n = 0
    for n, _ in enumerate(units.finditer(text), 1):  # noqa: B007
        pass
    return n


def cuts(units: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the text is cut after ``low`` and after ``high`` units (low <= high), by one pass that stops there."""
    matches = units.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, numbers: list[int], units: re.Pattern, plain_from: int = 90, spm_below: int = 20, markers: tuple[str, str, str] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in its new order."""
    n = count_units(units, text)
    if not text or any(m in text for m in markers) or numbers[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    first, second = cuts(units, text, *sorted((numbers[0] % (n + 1), numbers[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = markers
    if numbers[3] % 100 < spm_below:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, units: str = CODE_POINTS, plain_from: int = 90, spm_below: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output. ``units``: a pattern whose matches stand side by side; what no match covers goes with the piece in which it stands."""
    if len({m[0] for m in markers} | {m[-1] for m in markers}) > 2 or any(len(m) < 3 or m[0] in m[1:] or m[-1] in m[:-1] for m in markers) or len(set(markers)) < 3:
        raise ValueError("markers are different, and begin and end with two characters that stand nowhere else in them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(units)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [transform(text.as_py() or "", draws(seed, doc), pattern, plain_from, spm_below, markers) for doc, text in zip(ids, batch.column(1))]
            n, form, prefix, middle, output = zip(*made) if made else [()] * 5
            out = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before, from output and form: a marker stands in the output once, as no text has it."""
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def fill_in_middle_report(docs: DataFrame, **options) -> DataFrame:
    """Every document's cut and form, with digests of the output and of the text that is restored from it."""
    made = fill_in_middle(docs, **options)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    return """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(text, 1, low) AS pre, substring(text, low + 1, high - low) AS mid, substring(text, high + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256 FROM p"""
