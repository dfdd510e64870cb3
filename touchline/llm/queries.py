"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, chat, decontaminate, langid, licenses, media, packing, quality, simhash, structure, trie, urls
from touchline.llm.common import read_table
from touchline.llm.pii import find_pii


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


#: The place of the tokenizer file, on the driver and on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_media(media.store_documents(read_table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_conversations(chat.format_conversations(chat.with_probe(read_table(spark, sf_dir, "conversations"))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_openings(read_table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.audit_conversations(structure.damage(read_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_packing": op2_packing,
        "op3_chat": op3_chat,
        "op4_language": op4_language,
        "op5_licenses": op5_licenses,
        "op6_urls": op6_urls,
        "op7_bpe": op7_bpe,
        "op8_near_copies": op8_near_copies,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
        "op11_decontamination": op11_decontamination,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    """For the others, see tests/llm: each is compared with a plain version of what it computes."""
    return {"op3_chat": chat.SQL, "op5_licenses": licenses.sql(), "op11_decontamination": decontaminate.SQL, "op12_prefix_trie": trie.SQL, "op13_structure_repair": structure.SQL}
