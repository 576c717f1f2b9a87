"""A training corpus from raw documents, in five stages, each over all that the one before has kept.

What holds for every stage: columns other than those of documents are dropped, whatever their names; an empty table
gives an empty one; texts of any length are read whole. A row is told from others by its id and its text, so that of two
rows which share an id only, each has its own decision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.language import UNKNOWN, learn, predict_languages
from docstrata.llm.packing import pack_documents
from docstrata.llm.pii import redact
from docstrata.llm.queries import tokenizer_path
from docstrata.llm.simhash import text_key
from docstrata.llm.simhash_similar import similar_keepers
from docstrata.llm.storage import drop, intermediates, note, shared_dir
from docstrata.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# by the stop words of a text, answers from this score on are right more often than the labels that they differ from, those below less often
SURE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language at all go, and the others have the language by which ``packing`` deals them.

    The network's answer is the language of a text without one, and of a text with one that the network has learnt, if the score is ``SURE``
    or more; a language which it has not learnt stays. Null and empty texts and those without a letter go. Texts with letters stay, with the
    language that they had, if there was nothing to learn from. Repeated rows stay, each for itself; a null in a column other than lang stays a null.
    """
    net = learn(docs)
    answers = predict_languages(docs, net, keep=tuple(COLUMNS))
    accepted = F.col("kept_text").isNotNull() & ((F.col("lang_pred") != UNKNOWN) | F.col("kept_text").rlike(r"\p{L}"))
    learnt = F.col("kept_lang").cast("string").isin(net.languages if net else [])
    answered = (F.col("lang_pred") != UNKNOWN) & (F.col("kept_lang").isNull() | (learnt & (F.col("score") >= SURE)))
    lang = F.when(answered, F.col("lang_pred")).otherwise(F.col("kept_lang"))
    return answers.where(accepted).withColumn("kept_lang", lang).select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; near-duplicates share four fifths of their five-word shingles.

    Of different texts under that id, one stays; of rows with that id and text, the first by language, source and length. Null and blank
    texts are near-duplicates of each other; a null id comes after any other.
    """
    kept = similar_keepers(docs).select(F.coalesce("kept_id", F.lit(-1)).alias("_id"), F.col("kept_key").alias("_key"))
    # the key tells a missing id from -1; repeated rows are one before they are dealt out, and the join has the same keys
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), text_key().alias("_key"))
    first = keyed.groupBy("_id", "_key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_row"))
    return first.join(kept, ["_id", "_key"], "left_semi").select(*(F.col(f"_row.{c}").alias(c) for c in COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has go, and documents that are left with no text.

    Null and empty texts go with them. Rows that share an id take nothing from each other, repeated ones included.
    """
    left = remove_repeats(docs.select(*COLUMNS), keep_text=True, carry=("lang", "source")).where("length(text) > 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by the name of their kind; of overlapping ones, by the first kind's. No row goes; a null text becomes the empty one."""
    return redact(docs.select(*COLUMNS), ("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in pieces of token sequences, each of one language; a null or empty text is the end token alone, and a repeated row is packed again."""
    return pack_documents(docs.select(*COLUMNS), tokenizer_path("byte_bpe_50k.json"), by="lang")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("pii_redaction", pii_redaction),
    ("packing", packing),
]

# Networks, fingerprints and packing are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written goes when the next one has been; the last table stays for its reader and goes with the application."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/docstrata/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = note(spark, f"{folder}/{i}-{name}")
        with intermediates():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
