"""Registered queries of the corpus operators; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, code_compression, hash_search, html_blocks, language_id, license_scan, mixing, packing, pivot_search, secret_scan, simhash, tool_calls, turn_repair
from strandweave.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.format_messages(read_table(spark, sf_dir, "conversations"))


def op4_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.search(read_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(read_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(read_table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(read_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of op3 on a table that has calls: conversations told as calls and results."""
    found = tool_calls.link(tool_calls.with_calls(read_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "kind", "id", "state", "level", F.coalesce(F.size("wrong"), F.lit(0)).alias("n_wrong"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_tool_calls": op3_tool_calls,
    "op4_hash_search": op4_hash_search,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_html_blocks": op7_html_blocks,
    "op8_pivot_search": op8_pivot_search,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
    "op11_code_compression": op11_code_compression,
    "op12_turn_repair": op12_turn_repair,
    "op13_packing": op13_packing,
    "tool_call_links": tool_call_links,
}
#: The others have no SQL form on these tables; they are tested against brute force, a round trip or held-out rows.
ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_tool_calls": tool_calls.ORACLE,
    "op8_pivot_search": pivot_search.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op11_code_compression": code_compression.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "tool_call_links": tool_calls.LINKS_ORACLE,
}
