"""Licence scan: whole texts in canonical form, hash-joined to the digests of known licences. No Python on executors.

The canonical form is lower case, without copyright lines, with one spelling for equivalent words, and
with every run of other characters than a-z and 0-9 as one blank.

Defined results: a null text counts as empty; the empty canonical form matches nothing; texts of any length are read
whole, in time that grows with their length; no two known licences have one form, so there are no ties; repeated
rows and ids are scanned each for itself; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.licence_texts import KNOWN, LONG, TITLES, VARIANTS

# Equivalent spellings, (pattern, spelling), applied in this order to lower-case text.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|[(]c[)]|©)[^a-z0-9\n]*([(]c[)]|©|[0-9]{4}|by |the )[^\n]*"
RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*"
# The same lines for an engine that tries again with fewer characters: whatever stands before a mark is taken once and never given
# back, so a line's time grows with its length. Before the first mark may stand other signs; a © may be that mark itself.
_SIGNS, _SIGNS_OR_C = r"(?:[^a-z0-9\n©(]|[(](?!c[)]))*+", r"(?:[^a-z0-9\n(]|[(](?!c[)]))*+"
_SECOND = rf"{_SIGNS}(?:[(]c[)]|©|[0-9]{{4}}|by |the )[^\n]*+"
COPYRIGHT_ONCE = rf"(^|\n)(?:{_SIGNS_OR_C}(?:copyright|[(]c[)]){_SECOND}|{_SIGNS}©{_SECOND})"
RESERVED_ONCE = r"(^|\n)[^a-z0-9\n]*+all rights reserved[^a-z0-9\n]*+"
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http:", "https:"),
    ("&", " and "),
]


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_ONCE, "\n"), RESERVED_ONCE, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def canonical_text(text: str | None) -> str:
    """The same for one text, for the table of known licences."""
    out = re.sub(RESERVED, "\n", re.sub(COPYRIGHT, "\n", (text or "").lower()))
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", out).strip(" ")


def known_digests() -> list[tuple[str, str]]:
    return [(name, hashlib.sha256(canonical_text(text).encode()).hexdigest()) for name, text in KNOWN.items()]


def all_digests() -> list[tuple[str, str]]:
    """Those, other wordings, the same under the usual titles, and long licences; the SQL knows only the first."""
    forms = {canonical_text(f"{title}\n\n{text}"): name for name, text in VARIANTS for title in ("", *TITLES[name])}
    return [*((name, hashlib.sha256(form.encode()).hexdigest()) for form, name in forms.items()), *LONG]


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and digest of the canonical form, licence (null: none known)."""
    values = ", ".join(f"('{name}', '{digest}')" for name, digest in (all_digests() if known is None else known))
    table = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS known(licence, digest)")
    form = canonical(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), form.alias("form"))
    rows = rows.select("doc_id", F.when(F.col("form") == "", F.lit(0)).otherwise(F.size(F.split("form", " "))).cast("long").alias("n_words"), F.sha2("form", 256).alias("digest"))
    # the known licences are a list in this module: the broadcast never grows with the data
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "n_words", "digest", "licence")


def oracle() -> str:
    form = "lower(coalesce(text, ''))"
    for p in (COPYRIGHT, RESERVED):
        form = f"regexp_replace({form}, '{p}', chr(10), 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    known = ", ".join(f"('{n}', '{d}')" for n, d in known_digests())
    return f"""WITH known(licence, digest) AS (VALUES {known}),
forms AS (SELECT doc_id, trim(regexp_replace({form}, '[^a-z0-9]+', ' ', 'g')) AS form FROM documents),
digests AS (SELECT doc_id, CASE WHEN form = '' THEN 0 ELSE len(string_split(form, ' ')) END::BIGINT AS n_words, sha256(form) AS digest FROM forms)
SELECT d.doc_id, d.n_words, d.digest, k.licence FROM digests d LEFT JOIN known k ON d.digest = k.digest"""
