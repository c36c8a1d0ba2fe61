"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import functools
import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_rotation, conversation_repair, host_reputation, importance_resampling, jaccard_join, media_fingerprint, packing, pii_surrogates, posting_search,
    quality_crf, spelling_variants, suffix_dedup, unigram_codec
)
from .common import table


def word_bpe() -> str:
    """The place of the public tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe() -> str:
    """The place of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def pii_key() -> bytes:
    """The secret of the surrogates: PII_SURROGATE_KEY, or a random one for the life of this driver, by which no later run can link its surrogates."""
    key = os.environ.get("PII_SURROGATE_KEY")
    return key.encode() if key else secrets.token_bytes(32)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe()))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.remove_repeated(table(spark, sf_dir, "documents")))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repeated = quality_crf.repeated_lines(docs)
    model = quality_crf.fit_line_model(docs, table(spark, sf_dir, "labels"), repeated)
    return quality_crf.judge_quality(docs, model, repeated)


def op4_unigram_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, kinds = unigram_codec.read_pieces(piece_bpe())
    decoded = unigram_codec.decode_ids(unigram_codec.encode_texts(table(spark, sf_dir, "documents"), pieces, kinds), pieces, kinds)
    return unigram_codec.round_trip_digests(decoded, [i for i, k in enumerate(kinds) if k == "byte"])


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op6_media_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_fingerprint.media_digests(media_fingerprint.fingerprint_media(table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the labelled documents of good quality that aren't toxic."""
    target = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return importance_resampling.resample(table(spark, sf_dir, "documents"), target)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_pii(table(spark, sf_dir, "documents"), pii_key())


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are taken for the pages of the same id; low quality and toxicity are bad outcomes."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op11_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_search.search_nearest(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped_variants(spelling_variants.misspelled_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_packing, op2_suffix_dedup, op3_quality_crf, op4_unigram_codec, op5_chat_rotation, op6_media_fingerprint, op7_jaccard_join,
        op8_importance_resampling, op9_pii_surrogates, op10_host_reputation, op11_posting_search,
        op12_conversation_repair, op13_spelling_variants
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_rotation": chat_rotation.SQL, "op10_host_reputation": host_reputation.SQL, "op12_conversation_repair": conversation_repair.SQL,
        "op13_spelling_variants": spelling_variants.SQL,
    }
