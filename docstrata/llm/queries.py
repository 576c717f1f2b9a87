"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import conversation_trie, embeddings, fill_in_middle, licences
from docstrata.llm.embeddings import embedding_groups
from docstrata.llm.html import extract_pages
from docstrata.llm.language import identify_languages
from docstrata.llm.media import text_media_report
from docstrata.llm.packing import pack_documents
from docstrata.llm.pii import pii_report
from docstrata.llm.sampling import decode_ids, sample_segmentations
from docstrata.llm.simhash import simhash_groups
from docstrata.llm.storage import table
from docstrata.llm.suffixes import remove_repeats
from docstrata.llm.token_store import token_report


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct segmentations of every conversation turn, as digests of its ids and of the text that they decode to."""
    model, keys = tokenizer_path("piece_bpe_32k.model"), ["conv_id", "turn"]
    turns = table(spark, sf_dir, "conversations")
    sampled = decode_ids(sample_segmentations(turns, keys, model), model)
    ids = F.crc32(F.array_join("ids", ",").cast("binary"))
    return sampled.select(*keys, "sample", F.size("ids").cast("long").alias("n_ids"), ids.alias("ids_crc32"), F.round("log_prob", 6).alias("log_prob"), F.round("inclusion", 6).alias("inclusion"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op11_orc_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction,
        op2_packing,
        op3_suffix_dedup,
        op4_embedding_near_dedup,
        op5_language_id,
        op6_licence_scan,
        op7_sentencepiece_sampling,
        op8_simhash_near_dedup,
        op9_media_columns,
        op10_pii,
        op11_orc_token_store,
        op12_conversation_trie,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the other operators are held against brute force, round trips or held-out rows in tests/llm."""
    return {"op12_conversation_trie": conversation_trie.oracle(), "op13_fill_in_middle": fill_in_middle.oracle(), "op4_embedding_near_dedup": embeddings.oracle(), "op6_licence_scan": licences.oracle()}
