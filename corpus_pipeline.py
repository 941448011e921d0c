"""A training-data pipeline over documents: rules, near-dedup, decontamination, redaction, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, pii, quality, simhash
from gridloom.llm.common import settle, table
from gridloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that of the smallest doc_id, null last.

    Rows are told apart by a number of their own that is written with them, so
    different texts of one doc_id, or without one, are rows of their own. Of rows
    of one doc_id in a component the one with the least hash of its columns stays.
    """
    names = [f"c_{i}" for i in range(len(docs.columns))]  # columns of docs may have any names
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    mine = settle(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    hashed = [f.name for f in mine.schema.fields if f.name != "row" and "map<" not in f.dataType.simpleString()]  # maps have no hash
    groups = simhash.near_duplicates(mine.select("row", text.alias("text")), "row").select("row", "component_id")
    rank = F.struct(doc_id.isNull(), doc_id, F.xxhash64(*hashed), "row").alias("rank")
    kept = mine.select("row", rank).join(groups, "row").groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    return mine.join(kept, "row", "left_semi").select(*names).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes [KIND]; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each text, and the digest of the text that they decode to."""
    out = bpe.tokenize(docs, vocabulary())
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the first stage (a trained model) nor the last (a vocabulary); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
