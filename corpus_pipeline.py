"""The corpus pipeline: language, near-duplicate documents, repeated passages, personal data, packing.

Each stage takes the documents that the one before kept and returns the documents' columns, the
last one the packed pieces. Stages 1 to 4 keep every document that they have nothing against.

Defined cases: a null text, or one without a letter, has no language and goes in the first stage; repeated rows are one
document after the second, also without a doc_id; other columns go along unchanged, whatever their names, but n_chars, which is
counted anew where a stage cuts texts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobweave.llm import jaccard_join, language_id, packing, pii, registry, substring_dedup
from blobweave.llm.common import Scratch
from blobweave.session import ship

#: Documents whose language scores less go, besides those without a language.
LEAST_SCORE = 0.2
#: Near duplicates: five-word shingles, and the similarity from which documents are linked.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (operator 10)."""
    ship(spark)
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = language_id.fit(docs, F.coalesce(learn, F.lit(False)))
    return language_id.recognised(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest doc_id, and of repeated rows one (operator 4)."""
    ship(spark)
    return jaccard_join.firsts(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a document of nothing else goes (operator 8)."""
    ship(spark)
    return _counted(substring_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each identifier (operator 1)."""
    return _counted(pii.masked(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence (operator 5)."""
    ship(spark)
    return packing.pack(docs, registry.tokenizer("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]

#: SQL can't express the trained and the tokenising stages; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
    return docs
