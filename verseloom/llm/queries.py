"""Queries opN_<name> of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.llm import bpe, chat, exact_dedup, fingerprints, near_dedup, packing, quality, tokens, toxicity, warc
from verseloom.llm.shared import crc_mod

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"), least=0)


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", quality.HELD_FOLDS) == quality.HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", toxicity.HELD_FOLDS) == toxicity.HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first character."""
    return tokens.section_tokens(_read(spark, sf_dir, "documents"), BPE_FILE, rule="start")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), BPE_FILE)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_read(spark, sf_dir, "documents")).drop("mark")


def op8_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.classify(_read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "n_links", "kept")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), BPE_FILE)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}')], "id long, record string")
    turns = chat.turns_from_table(_read(spark, sf_dir, "conversations")).unionByName(chat.turns_from_json(extra, "id", "record"))
    return chat.read_back(chat.format_turns(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cws_fingerprints": op1_cws_fingerprints,
    "op2_warc_archive": op2_warc_archive,
    "op4_section_tokens": op4_section_tokens,
    "op6_packing": op6_packing,
    "op3_mil_quality": op3_mil_quality,
    "op7_lexicon_toxicity": op7_lexicon_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op8_icws_near_dedup": op8_icws_near_dedup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_chat_format": op10_chat_format,
}

_ESCAPE = r"""regexp_replace({0}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"""

SQL: dict[str, str] = {
    "op10_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        p AS (SELECT *, '<|im_start|>' || {_ESCAPE.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} || chr(10) || {_ESCAPE.format("text")} || '<|im_end|>' || chr(10) AS piece FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(piece))::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
