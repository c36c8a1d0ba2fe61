"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. A stage's result is written and read again as the next one's docs.

Null texts count as empty; rows of the same or no doc_id are told apart; columns beyond those of
documents are dropped; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import jaccard_join, packing, pii_surrogates, quality_crf, registry, suffix_dedup
from sparkward.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this percentage of their n-grams of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the line model reject. The model is fitted on the stage's input."""
    repeated = quality_crf.repeated_lines(docs)
    model = quality_crf.fit_line_model(docs, table(spark, sf_dir, "labels"), repeated)
    return quality_crf.keep_quality(docs.select(*COLUMNS), model, repeated)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id (null first), then text. Rows of the same or no id are told apart."""
    return jaccard_join.first_of_similar(docs, NEAR_WORDS, NEAR_PERCENT, carry=("lang", "source", "n_chars")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings that occur earlier. Characters that a cut goes through go whole; a document of which no word is left goes, too."""
    kept = suffix_dedup.remove_repeated(docs, carry=("lang", "source"), whole_characters=True)
    left = kept.select(
        "doc_id", F.col("kept").cast("string").alias("text"), "lang", "source", (F.octet_length("kept") < F.col("n_bytes")).alias("cut")
    )
    return left.filter(~F.col("cut") | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    replaced = pii_surrogates.replace_pii(docs, registry.pii_key(), carry=("lang", "source"))
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training windows."""
    return packing.pack_documents(docs, registry.word_bpe())


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages),
    ("PII", private_data), ("packing", packed_windows)
]

#: The line model, surrogates and tokens can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
