r"""Text functions as Spark columns.

Java's ``\s`` and ``\d`` know ASCII only; ``(?U)`` makes them Unicode-aware, as the rules want.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as search terms.
STOP_WORDS = (
    "the a an of and or to in on for is was what which did does how by with that this be are were its it as at from who when where why much many oeb board"
).split()
# Words of which an unnumbered heading in capitals must hold one.
HEADING_WORDS = (
    "decision decisions order orders introduction summary background findings finding analysis process application applications submission submissions costs cost implementation schedule "
    "appendix reasons issues issue conclusion conclusions rate rates evidence overview disposition procedural load forecast revenue capital operating deferral variance accounts account "
    "settlement interrogatories questions question notice licence license purpose recommendations attachment exhibit part section chapter policy proposal relief request response consultation "
    "approval approvals requirement requirements plan effective date discussion matters conditions contents table glossary definitions scope determination determinations ruling hearing motion "
    "review framework report"
).split()
# Words that may stay in lower case in a title.
SMALL_WORDS = "and or of the to for in on a an by with at from vs".split()
# Patterns of terms, of codes and amounts, of case numbers, and of lines that are no heading.
TERM = r"[a-z0-9][a-z0-9\-\.]*[a-z0-9]|[a-z0-9]"
EXACT_TERM = r"\b(?:[A-Z]{2,}-?\d[\w\-]*|[A-Z]{2,}\d*|\d[\d,\.\-/]*(?:\d|[A-Za-z]{1,3})|\d)\b"
DOCKETS = [(r"(?<![A-Za-z0-9])EB-\d{4}-\d{4}(?!\d)", 0), (r"(?<![A-Za-z0-9])RP-\d{4}-\d{4}(?!\d)", 0), (r"(?i)\bProceeding\s+(?:ID\s+)?(\d{5})\b", 1)]
NOT_HEADING = r"(?i)[~@]|\bpage\s+\d|\b(?:tel|fax|t|f)[.:]?\s*\d{3}|\d{3}[.\-\s]\d{3}[.\-\s]\d{4}|\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b|www\.|\.com\b"
NUMBERED = r"^((?:\d{1,2}|[A-Z]|[IVX]{1,4})(?:\.\d{1,2}){0,3})\.?\s+(\S.{1,90})$"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of the text without regard to case, digits and white space: equal for re-issued copies."""
    return F.sha2(squeeze(F.regexp_replace(F.lower(text), r"(?U)\d", "0")), 256)


def clean_text(text: Column) -> Column:
    """No soft hyphens, words joined over line ends, single blanks, at most one empty line in a row."""
    steps = [("­", ""), (r"(?U)(\w)-\n(\w)", "$1$2"), ("[ \t ]+", " "), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def line_key(line: Column) -> Column:
    """Lines that differ in case, blanks and numbers only have one key."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), "[ \t ]+", " "), r"(?U)\d+", "#")


def terms(text: Column) -> Column:
    """Search terms in order, with repeats. ASCII letters and digits only."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def exact_terms(text: Column) -> Column:
    """Codes, amounts, years and acronyms: lower case, sorted, each once."""
    found = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + EXACT_TERM), F.lit(0)), lambda t: ~F.upper(t).isin("OEB", "THE"))
    tidy = F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"^[.,]+|[.,]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda t: t != "")))


def find_docket(*texts: Column) -> Column:
    """The first case number in the first text that has one; patterns in order inside a text."""
    return F.coalesce(*(F.nullif(F.regexp_extract(t, p, g), F.lit("")) for t in texts for p, g in DOCKETS))


def normalize_question(q: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(q), r"(?U)[^\w\s\-\.]", ""))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 80)


def model_slug(model: Column) -> Column:
    return F.lower(F.translate(F.element_at(F.split(model, "/"), -1), ".-", "__"))


def index_version(chunk_version: Column, model: Column) -> Column:
    return F.concat(chunk_version, F.lit("__"), model_slug(model))


def context_header(*parts: Column) -> Column:
    """The parts that are neither null nor empty, with bars between."""
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def chunk_id(doc_id: Column, version: Column, ordinal: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", doc_id, version, ordinal.cast("string")), 256), 1, 32)


def pages_label(first: Column, last: Column) -> Column:
    return F.when(first.eqNullSafe(last), F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))


def citations(answer: Column, n_sources: Column) -> Column:
    """Numbers in [n] or [n, m] that name a source, sorted, each once."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= n_sources))))


def cache_key(question: Column, **scope: Column) -> Column:
    """A key of the normalised question and all that can change the answer."""
    fields = [normalize_question(question).alias("q"), *(scope[k].alias(k) for k in sorted(scope))]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def table_to_markdown(rows: Column) -> Column:
    """array<array<string>> to a markdown table; null below two rows or two columns. Null cells are empty."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), "[ \t ]+", " "))
    tidy = F.filter(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    # the width is found once, in a struct with the rows
    sized = F.transform(F.array(tidy), lambda t: F.struct(t.alias("rows"), F.array_max(F.transform(t, F.size)).alias("width")))
    line = lambda r, width: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width), ""))
    lines = F.transform(sized, lambda t: F.struct(t["width"].alias("width"), F.transform(t["rows"], lambda r: line(r, t["width"])).alias("lines")))
    whole = lambda t: F.concat_ws("\n", F.element_at(t["lines"], 1), rule(t["width"]), F.array_join(F.slice(t["lines"], 2, F.size(t["lines"]) - 1), "\n"))
    return F.element_at(F.transform(lines, lambda t: F.when((F.size(t["lines"]) >= 2) & (t["width"] >= 2), whole(t))), 1)


def is_heading(line: Column) -> Column:
    """Is this line a section heading? Numbered ones need a title; others capitals and a word that headings have."""
    s = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    number, title = F.regexp_extract(s, NUMBERED, 1), F.regexp_extract(s, NUMBERED, 2)
    capitals = lambda t: t.rlike(r"\p{L}") & (F.upper(t) == t)
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z'’\-]*"), F.lit(0))
    share = lambda t, keep: F.size(F.filter(words(t), keep)) / F.size(words(t))
    all_caps = lambda w: (F.upper(w) == w) & (F.length(w) > 1)
    titled = lambda w: w.rlike("^[A-Z]") | F.lower(w).isin(SMALL_WORDS)
    shaped = F.size(words(title)).between(1, 12) & ~title.rlike(r"[.,;]\s*$") & (F.length(title) - F.length(F.replace(title, F.lit(","), F.lit(""))) <= 2)
    title_like = shaped & ((share(title, all_caps) >= 0.7) | ((share(title, titled) >= 0.8) & F.element_at(words(title), 1).rlike("^[A-Z]")))
    numbered = title_like & (number.rlike(r"^\d") | capitals(title))
    plain = capitals(s) & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 6) & (F.size(F.split(squeeze(s), " ")) <= 10) & ~s.rlike(r"\d{4}")
    known = F.arrays_overlap(F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), F.array(*map(F.lit, HEADING_WORDS)))
    right = F.when(number != "", numbered).otherwise(plain & known)
    return F.coalesce(F.length(s).between(4, 100) & ~s.rlike(NOT_HEADING) & right, F.lit(False))
