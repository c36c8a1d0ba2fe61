"""Selection of text like a target: importance weights of hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, lower_ascii, texts, written

#: Buckets of hashed unigrams and bigrams.
BUCKETS = 10_000
#: Share of the rows that the sample takes, and the seed of its noise.
SHARE, SEED = 0.8, 17
#: The target model is fitted on at most so many labelled documents, those first by a hash of their ids.
FIT_DOCS = 20_000
#: Words up to so many bytes are kept with their hashes, at most so many of them in a task.
WORD_BYTES, WORDS_KEPT = 48, 400_000
#: N-grams that a task counts at once.
COUNTED = 200_000
#: The selection looks at so many bits of the keys at a time.
RADIX_BITS = 16


class NgramHasher:
    """Buckets of the unigrams and bigrams of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.known = np.uint64(buckets), {}

    def of(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = zlib.crc32(w) << 32 | zlib.adler32(w)
                if len(w) <= WORD_BYTES:
                    known[w] = h
            hashes.append(h)
        one = np.asarray(hashes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] * np.uint64(31) + one[1:]) * np.uint64(0xD6E8FEB86659FD93)
        return (np.concatenate([one, two]) >> np.uint64(24)) % self.buckets


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of hashed n-grams over all rows and over target rows: bucket, n_raw, n_target.

    docs has text (lower case) and in_target. Each task sums up what it reads, so that what is
    shuffled doesn't depend on how frequent an n-gram is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, target = NgramHasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        pending: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def add() -> None:
            for part, total in zip(pending, (raw, target), strict=True):
                if part:
                    total += np.bincount(np.concatenate(part).astype(np.int64), minlength=buckets)
                part.clear()

        held = 0
        for batch in batches:
            for text, chosen in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                grams = hasher.of(text)
                pending[0].append(grams)
                if chosen:
                    pending[1].append(grams)
                held += len(grams)
                if held >= COUNTED:
                    add()
                    held = 0
        add()
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "n_raw", "n_target"])

    parts = docs.mapInArrow(run, "bucket long, n_raw long, n_target long")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target's over raw text's probability of each bucket, one added to each count. As many rows as buckets at most come to the driver."""
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():
        raw[r.bucket] += r.n_raw
        target[r.bucket] += r.n_target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel_noise(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on key and seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def ordered_bits(value: Column) -> Column:
    """A long that orders as the decimal fixed-point value does."""
    return F.round(value * 1e9).cast("long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, found exactly by counting its digits from the top.

    Each step counts all rows still in question by their next 16 bits; at most 65536 counts come to
    the driver. Nulls don't count; None if there are fewer than k values.
    """
    if k < 1:
        return None
    shifted = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned
    prefix, left = 0, k
    for low in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        rows = values.filter(F.col(column).isNotNull())
        if low < 64 - RADIX_BITS:
            rows = rows.filter(F.shiftrightunsigned(shifted, low + RADIX_BITS) == prefix)
        digit = F.shiftrightunsigned(shifted, low).bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
        for r in sorted(rows.groupBy(digit.alias("digit")).count().collect(), key=lambda r: -r.digit):
            if left <= r["count"]:
                prefix = prefix << RADIX_BITS | r.digit
                break
            left -= r["count"]
        else:
            return None
    return prefix - (1 << 63)


def resample(
    docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = SEED, buckets: int = BUCKETS, fit_docs: int = FIT_DOCS
) -> DataFrame:
    """Importance resampling of docs (doc_id, text) towards the documents of target_ids (doc_id).

    Returns one row for each document: doc_id, log_weight (the sum of its n-grams' log ratios),
    sample_key (log_weight with Gumbel noise) and kept, true for the largest keys: as many rows as
    share of the table, rounded up, and those that tie with the last of them. The raw model is
    counted over all texts, the target's over fit_docs of target_ids at most; all rows are scored.

    A null or empty text weighs 0. The noise depends on doc_id, seed and weight, so repeated rows
    tie. With no target the weights are those of a flat model. Other columns are ignored; an empty
    table gives no rows.
    """
    wanted = target_ids.select(F.col("doc_id").alias("target_id")).filter("target_id IS NOT NULL").distinct().orderBy(
        F.xxhash64("target_id"), "target_id"
    ).limit(fit_docs).withColumn("in_target", F.lit(True))
    ids = docs.select(F.col("doc_id").cast("long"), lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))
    ratios = log_ratios(
        ngram_counts(ids.join(F.broadcast(wanted), F.col("doc_id") == F.col("target_id"), "left").select("text", F.coalesce("in_target", F.lit(False)).alias("in_target")), buckets),
        buckets
    )
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = NgramHasher(buckets), Rows(schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                rows.add(doc_id, round(float(ratios[hasher.of(text).astype(np.int64)].sum()), 6))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    scored = written(ids.mapInArrow(run, "doc_id long, log_weight double").withColumn(
        "sample_key", F.round(F.col("log_weight") + gumbel_noise(F.struct("doc_id", "log_weight"), seed), 9)
    ))
    bits = scored.withColumn("bits", ordered_bits(F.col("sample_key")))
    cut = kth_largest(bits, "bits", -(-scored.count() * int(share * 10_000) // 10_000))
    return bits.select("doc_id", "log_weight", "sample_key", (F.col("bits") >= F.lit(cut) if cut is not None else F.lit(False)).alias("kept"))
