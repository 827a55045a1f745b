"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, embed, html, langid, lines, minhash, packing, phrases, quality, substrings, urlfilter
from .shared import Scratch, read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select("doc_id", "n_removed", "text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = Scratch(spark).keep(chat.blocks_of(read_table(spark, sf_dir, "conversations")))
    known = blocks.filter(~F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = chat.fit(known)
    return chat.parse(chat.transcripts_of(blocks), model).select("conv_id", "turn_no", "role", "rendered")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", "quality.*")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(read_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    made = (op1_line_dedup, op2_chat_formatting, op3_embedding_near_dedup, op4_quality_rules, op5_html_extraction, op6_best_fit_packing, op7_minhash_near_dedup)
    return {f.__name__: f for f in (*made, op8_bpe_round_trip, op9_url_filters, op10_language_id, op11_filter_audit, op12_substring_dedup, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": audit.SQL, "op13_phrase_collocations": phrases.SQL}
