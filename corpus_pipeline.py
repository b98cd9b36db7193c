"""Five stages that turn the table ``documents`` into packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet to the shared folder and reads it as the next one's
input, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import line_rules, packing, phrase_index, secret_scan, simhash
from posegrid.llm.queries import tokenizer
from posegrid.llm.shared import forget, packed_rows, read_table, settle, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the line and document rules; failed lines of the others go."""
    return line_rules.clean(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """``_key``, a written number of each row, and ``_row``: a doc_id may be null or stand on several rows."""
    rows = packed_rows(docs).withColumn("_key", F.monotonically_increasing_id())
    return settle(rows, "numbered")


def _by_key(numbered: DataFrame) -> DataFrame:
    """The texts under their row number, for operators that name a row by its doc_id."""
    return numbered.select(F.col("_key").alias("doc_id"), F.col("_row").getField("text").alias("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the least doc_id, a row without an id only if no other has one, of equal ids any one.

    Groups are linked at five-word shingles and a similarity of 0.8; wholly equal rows are one group, whatever their ids.
    """
    rows = _numbered(docs)
    groups = simhash.similar_documents(_by_key(rows)).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    named = settle(rows.select("_key", F.col("_row").getField("doc_id").alias("_id")).join(groups, "_key"), "named")
    forget(groups)
    first = named.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).getField("_key").alias("_first"))
    others = named.join(first, "_group").filter("_key <> _first").select("_key")
    return unpacked(rows.join(others, "_key", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go, each by its own text."""
    rows = _numbered(docs)
    found = phrase_index.contamination(_by_key(rows), read_table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("_key"))
    return unpacked(rows.join(hit, "_key", "left_anti"), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; every document stays."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

#: Tokens and packed sequences can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
