"""Similarity join of texts by the Jaccard index of their word n-grams, with rare-first prefix filtering.

N-grams are ordered from rare to frequent by one table of counts over all texts. Two sets of
similarity t or more share an n-gram within the first |x| - ceil(t|x|) + 1 of each, so texts are
joined on these alone. Length and positional filters act within that join, a suffix filter (how many
n-grams can be common by their hash classes) on its pairs, and what is left is verified once per pair.

An n-gram in the prefixes of many different texts would give pairs in the square of their number. Such
groups are resolved by what their texts have in common, the n-grams of more than half of them: with
d(x) the n-grams in which x and these differ, |x - y| = |d(x)| + |d(y)| - 2 |d(x) & d(y)|. The slack of
x is what similarity allows x to differ, less |d(x)|. Two texts whose slacks add up to 0 or more are
similar, and so is each of them to the text of the most slack: one link each joins them all. All other
similar pairs share enough differences, and a prefix-filtered join on these, with the same filters,
finds them. Differences that many texts share make groups of their own, each at most half as large as
the one it comes from, which are resolved in the same way by what they have in common; so families of
near copies that are unlike each other cost as much as their texts, not as their pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, discard, numbered, of_process, texts, written
from .components import connected_components

#: Words of an n-gram and the least similarity, in percent.
WORDS, PERCENT = 3, 90
#: Counters of the frequency table, as a power of two, and counters of each of its blocks.
COUNTER_BITS, BLOCK = 22, 1 << 16
#: Partial sums of a block.
SALTS = 64
#: N-grams that a task counts at once; above 255 its counts of a counter stay there.
COUNTED = 500_000
#: Groups of more texts than this are resolved by what they have in common; within these, so many doubtful texts of a difference are joined with all that share it.
MOST_DIRECT, MOST_DOUBTFUL = 32, 256
#: Hash classes of the suffix filter.
CLASSES = 64
#: Bits of the filter that tells which texts are worth reading again, and the most rids that it is used for; beyond, texts are joined.
FILTER_BITS, FILTERED = 24, 4_000_000
#: Halvings of a group after which something must be wrong.
DEPTH = 64
#: Words up to so many bytes are kept with their hashes, about so many in a worker process.
WORD_BYTES, WORDS_KEPT = 48, 200_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Sets of hashed word n-grams of texts."""

    def __init__(self, words: int):
        self.words, self.known = words, of_process(("word hashes",), dict)

    def of(self, text: bytes) -> np.ndarray:
        """The set as sorted distinct 64-bit hashes. A text of fewer words has its whole sequence as the only one; none has no words."""
        words, known = text.lower().split(), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = word_hash(w)
                if len(w) <= WORD_BYTES:
                    known[w] = h
            hashes.append(h)
        if not words:
            return np.zeros(0, np.uint64)
        x = np.asarray(hashes, np.uint64)
        n = min(self.words, len(x))
        with np.errstate(over="ignore"):
            out = np.full(len(x) - n + 1, np.uint64(n) * M3)
            for i in range(n):
                out = (out ^ x[i : len(x) - n + 1 + i]) * M1
                out ^= out >> np.uint64(29)
            out = out * M2
        return np.unique(out ^ (out >> np.uint64(32)))


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """The 128 bits that a set is known by, as two numbers."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def counters(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def add_counts(counts: np.ndarray, pending: list[np.ndarray]) -> None:
    at, times = np.unique(np.concatenate(pending), return_counts=True)
    counts[at] += times.astype(counts.dtype)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def read_sets(base: DataFrame, words: int) -> DataFrame:
    """For each text of base (rid, text): rid, n (size of its set), cid and cid2 (the same for equal sets, null for empty ones); and for each task its counts of n-grams, by block."""
    schema = pa.schema([
        *((c, pa.int64()) for c in ("rid", "n", "cid", "cid2")), ("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rows, counts = Shingler(words), Rows(schema), np.zeros(1 << COUNTER_BITS, np.int32)
        pending, held = [], 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                tokens = shingler.of(text)
                rows.add(rid, len(tokens), *(set_id(tokens) if len(tokens) else (None, None)), None, None, None)
                pending.append(counters(tokens))
                held += len(tokens)
                if held >= COUNTED:
                    add_counts(counts, pending)
                    pending, held = [], 0
                if rows.full:
                    yield rows.take()
        if pending:
            add_counts(counts, pending)
        counts = np.minimum(255, counts).astype(np.uint8)
        for i in range(0, len(counts), BLOCK):
            if (part := counts[i : i + BLOCK]).any():
                rows.add(None, None, None, None, i // BLOCK, TaskContext.get().partitionId() % SALTS, zlib.compress(part.tobytes(), 1))
        yield rows.take()

    return base.select("rid", "text").mapInArrow(run, "rid long, n long, cid long, cid2 long, block int, salt int, counts binary")


def frequency_levels(read: DataFrame) -> np.ndarray:
    """Steps on a logarithmic scale of how frequent the n-grams of each counter are, over all texts. Its size is fixed."""

    def add(table: pa.Table, dtype: str) -> np.ndarray:
        total = np.zeros(BLOCK, np.int64)
        for part in table["counts"]:
            total += np.frombuffer(zlib.decompress(part.as_py()), dtype)
        return total

    def partial(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()),
            "counts": pa.array([zlib.compress(add(table, "u1").astype("<i8").tobytes(), 1)], pa.binary())
        })

    def level(key: tuple, table: pa.Table) -> pa.Table:
        steps = np.minimum(255, 8 * np.log2(1 + add(table, "<i8").astype(np.float64))).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([steps.tobytes()], pa.binary())})

    parts = read.filter("counts IS NOT NULL").select("block", "salt", "counts").groupBy("block", "salt").applyInArrow(
        partial, "block int, counts binary"
    )
    levels = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in parts.groupBy("block").applyInArrow(level, "block int, counts binary").toLocalIterator():
        levels[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(bytes(row.counts), np.uint8)
    return levels


def prefixes(base: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """The prefix of each text's set, rare n-grams first: token, cid, cid2, n, pos. A set that a task has met already isn't repeated; sets too small to be similar to another have no rows."""
    schema = pa.schema([*((c, pa.int64()) for c in ("token", "cid", "cid2")), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met, table, out, held = Shingler(words), set(), levels.value, [], 0
        for batch in batches:
            for text in texts(batch.column(0)):
                tokens = shingler.of(text)
                n = len(tokens)
                if n * 100 < percent * (n + 1) or not n or (cid := set_id(tokens)) in met:
                    continue
                if len(met) < WORDS_KEPT:
                    met.add(cid)
                k = prefix_length(n, percent)
                first = tokens[np.lexsort((tokens, table[counters(tokens)]))[:k]]
                out.append((first.view(np.int64), np.full(k, cid[0]), np.full(k, cid[1]), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
                held += k
                if held >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return base.select("text").mapInArrow(run, "token long, cid long, cid2 long, n int, pos int")


def filter_bit(column: str) -> Column:
    """Place of a rid in the filter."""
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def worth_reading(rids: DataFrame) -> np.ndarray:
    """A filter of fixed size that passes all rids of a table and few others, as 64-bit words."""
    bit = filter_bit("rid")
    words = rids.select(
        F.shiftright(bit, 6).cast("int").alias("word"), F.expr("shiftleft(1L, int(xxhash64(rid) & 63L))").alias("bits")
    ).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out


def sets_of(base: DataFrame, rids: DataFrame, words: int) -> DataFrame:
    """The sets of the texts of rids, and of few others: rid, n, classes (sizes by hash class), tokens.

    A filter of fixed size tells which texts to read where rids are FILTERED at most; texts of more rids are joined.
    """
    spark = base.sparkSession
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("classes", pa.binary()), ("tokens", pa.binary())])
    if rids.count() <= FILTERED:
        passes, source = spark.sparkContext.broadcast(worth_reading(rids)), base
    else:
        passes, source = None, base.join(rids.select(F.col("rid").alias("read_rid")), F.col("rid") == F.col("read_rid"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rows = Shingler(words), Rows(schema)
        for batch in batches:
            hits = np.arange(batch.num_rows)
            if passes is not None:
                bits = batch.column(2).to_numpy()
                hits = np.flatnonzero(passes.value[bits >> 6] >> (bits & 63) & 1)
            for i, text in zip(hits.tolist(), texts(batch.column(1).take(pa.array(hits))), strict=True):
                tokens = shingler.of(text)
                rows.add(batch.column(0)[i].as_py(), len(tokens), class_sizes(tokens).tobytes(), tokens.tobytes(), size=8 * len(tokens))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return written(source.select("rid", "text", filter_bit("rid").alias("bit")).mapInArrow(run, "rid long, n long, classes binary, tokens binary"))


def class_sizes(tokens: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.bincount((tokens & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)).astype("<u2")


def prefix_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that meet in a group of texts with a common prefix n-gram, past the length and positional filters."""
    x, y = (groups.select(*(F.col(c).alias(c + s) for c in ("token", "rid", "n", "pos"))) for s in ("_a", "_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    on = (F.col("token_a") == F.col("token_b")) & (F.col("rid_a") < F.col("rid_b")) & (small * 100 >= large * percent) & (room * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return x.join(y, on).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct()


def past_suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that can share enough n-grams by the sizes of their hash classes: a, b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, CLASSES) for i in (2, 3))
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            full = (x == 65535).any(1) | (y == 65535).any(1)
            keep = pa.array(full | (np.minimum(x, y).sum(1, dtype=np.int64) * (100 + percent) >= n * percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    x, y = (sets.select(F.col("rid").alias("rid" + s), F.col("n").alias("n" + s), F.col("classes").alias("classes" + s)) for s in ("_x", "_y"))
    joined = pairs.join(x, F.col("a") == F.col("rid_x")).join(y, F.col("b") == F.col("rid_y"))
    return joined.select("a", "b", "classes_x", "classes_y", "n_x", "n_y").mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = (sets.select(F.col("rid").alias("rid" + s), F.col("tokens").alias("tokens" + s)) for s in ("_x", "_y"))
    return pairs.join(x, F.col("a") == F.col("rid_x")).join(y, F.col("b") == F.col("rid_y")).select("a", "b", "tokens_x", "tokens_y")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar: a, b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def common_grams(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The n-grams that more than half of a group's texts have: pivot (the group's name), common."""
    schema = pa.schema([("pivot", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pivot, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(tokens.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), pivot)), pa.array(tokens)], schema=schema)

    sizes = members.groupBy(F.col("pivot").alias("group")).agg(F.count("*").alias("members"))
    tokens = members.join(
        sets.select(F.col("rid").alias("set_rid"), "tokens"), F.col("rid") == F.col("set_rid")
    ).select("pivot", "tokens").mapInArrow(run, "pivot long, token long")
    counts = tokens.groupBy("pivot", "token").agg(F.count("*").alias("n"))
    usual = counts.join(sizes, F.col("pivot") == F.col("group")).filter("2 * n > members")
    return usual.groupBy(F.col("pivot").alias("group")).agg(F.collect_list("token").alias("common"))


def differences_of(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each text of a group with how it differs from what is common there: pivot, rid, n, size, slack, grams and marks.

    N-grams beyond the common ones come first, those it lacks last. slack is (100 - percent) n - (100 +
    percent) size. marks are 256 bits, those at the n-grams' hash classes set.
    """
    schema = pa.schema([
        ("pivot", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("slack", pa.int64()),
        ("grams", pa.list_(pa.int64())), *((f"m{i}", pa.int64()) for i in range(4))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for pivot, rid, tokens, common in zip(*(batch.column(i) for i in range(4)), strict=True):
                x = np.frombuffer(tokens.as_py(), np.uint64)
                y = np.sort(common.values.to_numpy().view(np.uint64)) if common.is_valid else x[:0]
                grams = np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)])
                marks = np.zeros(256, np.uint8)
                marks[(grams & np.uint64(255)).astype(np.int64)] = 1
                words = np.packbits(marks).view(np.int64).tolist()
                rows.add(
                    pivot.as_py(), rid.as_py(), len(x), len(grams), (100 - percent) * len(x) - (100 + percent) * len(grams),
                    grams.view(np.int64), *words, size=8 * len(grams)
                )
                if rows.full:
                    yield rows.take()
        yield rows.take()

    known = sets.select(F.col("rid").alias("set_rid"), "tokens")
    joined = members.join(known, F.col("rid") == F.col("set_rid")).join(common_grams(members, sets), F.col("pivot") == F.col("group"), "left")
    out = joined.select("pivot", "rid", "tokens", "common").mapInArrow(
        run, "pivot long, rid long, n long, size long, slack long, grams array<long>, m0 long, m1 long, m2 long, m3 long"
    )
    return written(out)


def with_best(differences: DataFrame) -> DataFrame:
    """differences with the text of the most slack in the group (best) and its slack (top), and the size of the group (members)."""
    best = differences.groupBy(F.col("pivot").alias("group")).agg(
        F.max(F.struct("slack", (-F.col("rid")).alias("r"))).alias("b"), F.count("*").alias("members")
    )
    joined = differences.join(best, F.col("pivot") == F.col("group"))
    return joined.withColumns({"best": -F.col("b.r"), "top": F.col("b.slack")}).drop("group", "b")


def slack_links(known: DataFrame) -> DataFrame:
    """Links of texts with the one of the most slack, where slacks say that they are similar."""
    return known.filter("slack + top >= 0 AND rid <> best").select(F.least("rid", "best").alias("a"), F.greatest("rid", "best").alias("b"))


def difference_rows(known: DataFrame, percent: int) -> DataFrame:
    """The prefixes of the differences of known: a row for each of their n-grams, with its place (pos).

    With any partner a text must share at least as many differences as with one of the most slack, which
    makes its prefix short. Rows stay where their n-gram has a partner whose slack leaves the two in doubt.
    doubtful is the number of the n-gram's texts of a slack below 0, one of which is in each pair in doubt;
    first is the least of its texts by a hash.
    """
    least = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + F.col("top")) / (2.0 * (100 + percent)) - 1e-9)).cast("int")
    some = known.withColumn("k", F.col("size").cast("int") - least + 1).filter("k > 0")
    rows = some.select(
        "pivot", "rid", "n", "size", "slack", "members", "m0", "m1", "m2", "m3",
        F.posexplode(F.slice("grams", F.lit(1), F.col("k"))).alias("pos", "token")
    )
    at = rows.groupBy(F.col("pivot").alias("at_pivot"), F.col("token").alias("at_token"))
    counted = at.agg(
        F.count("*").alias("crowd"), F.count_if(F.col("slack") < 0).alias("doubtful"), F.min("slack").alias("low"),
        F.min(F.struct(F.xxhash64("rid"), "rid")).alias("least")
    )
    met = rows.join(counted.filter("crowd > 1 AND low < 0"), (F.col("pivot") == F.col("at_pivot")) & (F.col("token") == F.col("at_token")))
    return met.filter("slack + low < 0").withColumn("first", F.col("least.rid")).drop("at_pivot", "at_token", "crowd", "low", "least")


def difference_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that meet in a row of difference_rows and can share as many differences as similarity takes, past the length, positional and suffix filters.

    Doubtful texts are joined with all, so an n-gram costs the product of their numbers at most.
    """
    x, y = (of.select(*(F.col(c).alias(c + s) for c in rows.columns)) for of, s in ((rows.filter("slack < 0"), "_a"), (rows, "_b")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    room = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    surplus = -(F.col("slack_a") + F.col("slack_b"))  # twice the differences that must be common, times 100 + percent
    bits = lambda f: sum((f(i) for i in range(1, 4)), f(0))
    both = bits(lambda i: F.bit_count(F.col(f"m{i}_a").bitwiseAND(F.col(f"m{i}_b"))))
    crowded = F.least(*(F.col(f"size_{s}") - bits(lambda i, s=s: F.bit_count(F.col(f"m{i}_{s}"))) for s in "ab"))  # n-grams that share their class with another
    on = (F.col("pivot_a") == F.col("pivot_b")) & (F.col("token_a") == F.col("token_b")) & (F.col("rid_a") != F.col("rid_b")) & (small * 100 >= large * percent) & (surplus > 0) & (room * 2 * (100 + percent) >= surplus) & ((both + crowded) * 2 * (100 + percent) >= surplus)
    return x.join(y, on).select(F.least("rid_a", "rid_b").alias("a"), F.greatest("rid_a", "rid_b").alias("b")).distinct()


def crowds(rows: DataFrame) -> DataFrame:
    """The groups of texts that share a crowded difference: rid, pivot (the group's name).

    Groups of a pivot with the same first text become one, as they mostly are the same texts, unless that
    were more than half of the group they come from. An n-gram by which all differ from what more than
    half have in common is one of half of them at most, so groups halve with each step.
    """
    named = rows.select(
        "rid", "members", "token", F.xxhash64("pivot", "first").alias("joint"), F.xxhash64("pivot", "token", F.lit("own")).alias("own")
    )
    sizes = named.select("joint", "rid", "members").distinct().groupBy(F.col("joint").alias("joint_name")).agg(
        F.count("*").alias("joined"), F.max("members").alias("of")
    )
    placed = named.join(sizes, F.col("joint") == F.col("joint_name"))
    return placed.select("rid", F.when(F.col("joined") * 2 <= F.col("of"), F.col("joint")).otherwise(F.col("own")).alias("pivot")).distinct()


def resolved_crowds(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What joins the similar texts of groups (members: rid, pivot) of any size: sure links, and pairs that are to be verified."""
    links, pairs = [], []
    for _ in range(DEPTH):
        known = written(with_best(differences_of(members, sets, percent)))
        links.append(slack_links(known))
        rows = written(difference_rows(known, percent))
        pairs.append(difference_pairs(rows.filter(F.col("doubtful") <= MOST_DOUBTFUL), percent))
        crowded = rows.filter(F.col("doubtful") > MOST_DOUBTFUL)
        if crowded.isEmpty():
            break
        members = written(crowds(crowded))
    else:
        raise RuntimeError(f"groups haven't been resolved after {DEPTH} halvings")
    return reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, pairs)


def similar_links(base: DataFrame, classes: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """Links a, b that join all texts of similar, different sets. base has rid and text, classes cid, cid2 and rid of one text of each set."""
    held = base.sparkSession.sparkContext.broadcast(levels)
    rows = written(prefixes(base, held, words, percent))
    ends = rows.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.min("cid2").alias("low2"), F.max("cid2").alias("high2"))
    shared = ends.filter("low <> high OR low2 <> high2").select(F.col("token").alias("shared_token"))
    met = rows.join(shared, F.col("token") == F.col("shared_token")).select("token", "cid", "cid2", "n", "pos").distinct()
    named = classes.select(F.col("cid").alias("class_cid"), F.col("cid2").alias("class_cid2"), "rid")
    met = written(met.join(named, (F.col("cid") == F.col("class_cid")) & (F.col("cid2") == F.col("class_cid2"))).select("token", "rid", "n", "pos"))
    discard(rows)
    groups = met.groupBy(F.col("token").alias("group_token")).agg(
        F.count("*").alias("members"), F.min(F.struct(F.xxhash64("rid"), "rid")).alias("least")
    )
    met = written(met.join(groups, F.col("token") == F.col("group_token")).select(
        "token", "rid", "n", "pos", "members", F.col("least.rid").alias("pivot")
    ))
    few, many = met.filter(F.col("members") <= MOST_DIRECT), met.filter(F.col("members") > MOST_DIRECT)
    pairs = written(prefix_pairs(few, percent))
    members = written(many.select("rid", "pivot").distinct())
    needed = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select("b").toDF("rid")).unionByName(members.select("rid")).distinct()
    sets = sets_of(base, written(needed), words)
    sure, more = resolved_crowds(members, sets, percent)
    left = written(past_suffix_filter(pairs.unionByName(more).distinct(), sets, percent))  # so that no task runs two workers
    return sure.unionByName(verified(left, sets, percent))


def first_of_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row of docs (doc_id, text, columns named in carry) for each component of join_similar: the first by doc_id (null first), then text.

    Rows of the same or no doc_id are told apart by their number. Null texts and texts without words
    are each their own component.
    """
    base = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry))
    first = similar_rows(base, words, percent).filter("rid = component").select(F.col("rid").alias("first_rid"))
    return base.join(first, F.col("rid") == F.col("first_rid"), "left_semi").select("doc_id", "text", *carry)


def similar_rows(base: DataFrame, words: int, percent: int) -> DataFrame:
    """The component of each row of base (rid, doc_id, text): rid, n_shingles, component, the smallest rid that links reach."""
    base = base.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = written(read_sets(base, words))
    known = read.filter("rid IS NOT NULL").select("rid", "n", "cid", "cid2")
    classes = written(known.filter("cid IS NOT NULL").groupBy("cid", "cid2").agg(F.min("rid").alias("rid")))
    components = connected_components(similar_links(base, classes, frequency_levels(read), words, percent))
    named = classes.select(F.col("cid").alias("class_cid"), F.col("cid2").alias("class_cid2"), "rid")
    labels = written(named.join(components, F.col("rid") == F.col("node"), "left").select(
        "class_cid", "class_cid2", F.coalesce("component", "rid").alias("component")
    ))
    same = (F.col("cid") == F.col("class_cid")) & (F.col("cid2") == F.col("class_cid2"))
    return known.join(labels, same, "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component"))


def join_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of the texts of docs (doc_id, text) whose sets of word n-grams are similar.

    Words are divided by ASCII white space and A-Z is lower-cased. Two texts are linked when the
    Jaccard index of their sets is at least percent / 100. Returns for each row doc_id, n_shingles
    (the set's size) and component_id, the smallest doc_id that links reach.

    A text of fewer words has its whole sequence as its only n-gram; a null text or one without words
    has an empty set, is linked with nothing and is its own component. Rows of the same or no doc_id
    each keep a row. Other columns are ignored; an empty table gives no rows. Sets are of 64-bit
    hashes of n-grams and known by 128 bits.
    """
    base = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    out = similar_rows(base, words, percent)
    if "own_id" not in base.columns:
        return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    ids = base.select(F.col("rid").alias("id_rid"), F.col("doc_id"))
    firsts = ids.toDF("first_rid", "component_id")
    return out.join(ids, F.col("rid") == F.col("id_rid")).join(
        firsts, F.col("component") == F.col("first_rid")
    ).select("doc_id", "n_shingles", "component_id")
