"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, langid, line_dedup, mixing, neardup, quality, secret_scan, sharding, suffix_dedup, token_output, url_filter, vector_codes

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Lines in a row that make a repeated run.
MIN_LINES = 3
#: Words that make a repeated run of fewer lines.
MIN_WORDS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.LanguageModel.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = model.predict(docs.select("doc_id", "text"))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES)
    return placed.select("doc_id", *sharding.RESULT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *decontaminate.RESULT)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_LINES)
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept_text").alias("kept_md5"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op6_line_dedup``, whose SQL knows lines alone, and repeated passages of fewer lines with ``MIN_WORDS`` words."""
    cut = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_LINES, MIN_WORDS)
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept_text").alias("kept_md5"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES).drop("url")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), neardup.Settings(words=4))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = vector_codes.error_by(coded.select("vec_id", "label", "code", "error"), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count_of(F.col("secrets"), kind).alias(f"n_{kind}") for kind in (*secret_scan.PLAIN, "key", "jwt")]
    base = F.sha2(secret_scan.listed(F.col("secrets"), secret_scan.PLAIN), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, secret_scan.listed(F.col("secrets")).alias("spans"), *counts[3:])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    harmed = conversations.damage(table(spark, sf_dir, "conversations"))
    judged = conversations.judge(harmed)
    repaired = conversations.digests(harmed, judged).withColumnRenamed("conv_id", "own_id")
    both = judged.join(repaired, judged["conv_id"].eqNullSafe(repaired["own_id"]), "left")
    return both.select("conv_id", *conversations.RESULT, "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_sharding, op3_decontamination, op4_mixing, op5_suffix_dedup, op6_line_dedup, op6_passage_dedup, op7_url_filter, op8_token_output, op9_quality_rules, op10_minhash_near_dedup, op11_vector_codes, op12_secret_scan, op13_conversation_repair)
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding.oracle(SHARD_BYTES),
    "op3_decontamination": decontaminate.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.oracle(MIN_LINES),
    "op7_url_filter": url_filter.ORACLE,
    "op11_vector_codes": vector_codes.oracle(vector_codes.Settings()),
}
