"""The queries of this subpackage: thin, over whole tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, line_rules, merkle, packing, phrase_index, pivot_index, repair, secret_scan, simhash, token_counts, token_files, url_reputation, wrappers
from .shared import read_table, settle


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.with_quality(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed", "lost_words"
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_index(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated", F.col("near_items").alias("n_near_items"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_spans(documents, secret_scan.train(documents))
    return found.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.listed(F.col("_base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("_spans")).alias("spans"),
    )


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_reputation.labelled_outcomes(pages, read_table(spark, sf_dir, "labels"))
    return url_reputation.judge_urls(pages, outcomes)


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    key, source, part, size, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.crc32(key.cast("string")) % 7 == 0
    more = size.cast("decimal(20,0)") + 1
    digests = documents.select(
        part.cast("string").alias("part"),
        key.cast("long").alias("id"),
        merkle.leaf_digest(key, source, part, size, text).alias("leaf"),
        F.when(tampered & size.isNotNull(), merkle.leaf_digest(key, source, part, more, text)).alias("other"),
    )
    leaves = settle(digests, "leaves").select("part", "id", "leaf", F.coalesce("other", "leaf").alias("claim"))
    return merkle.manifest(leaves).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_chat_formatting,
        op3_token_files,
        op4_simhash_groups,
        op5_decontamination,
        op6_packing,
        op7_token_counts,
        op8_secret_scan,
        op9_url_reputation,
        op10_html_wrappers,
        op11_structure_repair,
        op12_top_vectors,
        op13_merkle_manifest,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.ORACLES)
