"""What stays of the times of a key when each one that stays is followed by silence: a scan over composed functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Spans of the silence's length that one task takes at a time, and functions that are composed at a time.
SPANS, FAN = 16, 256
#: A last time that can't matter any more.
LONG_AGO = -(1 << 62)
STEPS = "starts array<bigint>, exits array<bigint>, rest bigint"


def last_times(times: np.ndarray, silent: int, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The function of a block's sorted distinct times: for each time of its first span, and for none of them, the last time that stays, given that this one stays first.

    That is a time of the block's last span, or LONG_AGO where none stays there, which is as if none had
    stayed at all. Since at most one time stays in a span, the answer for a time is that for the
    first time after its silence, found from the last span backwards.
    """
    spans = times // span
    first, last = spans[0] // SPANS * SPANS, spans[0] // SPANS * SPANS + SPANS - 1
    following = np.searchsorted(times, times + silent, side="right")
    exits = np.where(spans == last, times, LONG_AGO)
    for one in range(last - 1, first - 1, -1):
        at = np.arange(*np.searchsorted(spans, [one, one + 1]))
        known = at[following[at] < len(times)]
        exits[known] = exits[following[known]]
    begins = int(np.searchsorted(spans, first + 1))
    return times[:begins], exits[:begins], int(exits[begins]) if begins < len(times) else LONG_AGO


def applied(entries: np.ndarray, silent: int, starts: np.ndarray, exits: np.ndarray, rest: int) -> np.ndarray:
    """Where a block's function leads from last times before it."""
    place = np.searchsorted(starts, entries + silent, side="right")
    return np.append(exits, rest)[place]


def stayed(times: np.ndarray, silent: int, entry: int) -> list[int]:
    """The times that stay in a block, one after the other."""
    kept, at = [], int(np.searchsorted(times, entry + silent, side="right")) if entry != LONG_AGO else 0
    while at < len(times):
        kept.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + silent, side="right"))
    return kept


def step_arrays(made: list[tuple[np.ndarray, np.ndarray, int]]) -> list[pa.Array]:
    lists = [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(2)]
    return [*lists, pa.array([m[2] for m in made], pa.int64())]


def step_of(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
    return np.array(row["starts"], np.int64), np.array(row["exits"], np.int64), row["rest"]


def after_silence(found: DataFrame, key: str, at: str, silent: int, before: DataFrame | None = None) -> DataFrame:
    """The times (key, at, longs) that stay when a time stays only if it is more than silent after the last of its key that stayed.

    Nulls in at don't count; null keys are one key, repeated times one time. before has the last time (key, at)
    that stayed earlier of some keys.

    Within a span of the silence's length at most one time stays, so a block of spans is a function from the last time that stayed
    before it to the last one that stays in it, known by its values at the times of its first span. Blocks become
    functions side by side; FAN neighbours are composed at a time, until so few are left for each key; then
    entries come down the tree, and all blocks are read side by side. A key without any silence is as many
    tasks as blocks, and no task holds more than the times of one block and of the first spans of two others.
    """
    span, kind = max(silent, 1), found.schema[key].dataType.simpleString()
    width = span * SPANS
    rows = found.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at")).filter("at IS NOT NULL")
    if before is not None:  # what its last time silences goes, and the next one stays
        last = before.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(at).cast("long")).alias("_last"))
        heard = F.col("_last").isNull() | (F.col("at") > F.col("_last") + silent)
        rows = rows.join(last, F.col("key").eqNullSafe(F.col("_key")), "left").filter(heard).select("key", "at")
    placed = rows.withColumn("block", F.expr(f"(at - pmod(at, {width}L)) div {width}L"))
    blocks = written(placed.groupBy("key", "block").agg(F.sort_array(F.collect_set("at")).alias("times")))
    low, high = blocks.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return rows.select(F.col("key").alias(key), "at")
    blocks = blocks.withColumn("block", F.col("block") - low)
    steps, names = f"key {kind}, block bigint, {STEPS}", ["key", "block", "starts", "exits", "rest"]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [last_times(np.asarray(t.values), silent, span) for t in batch["times"]]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], *step_arrays(made)], names=names)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = made = kind_of_key = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group[0]], kind_of_key), pa.array([group[1]], pa.int64()), *step_arrays([made])], names=names)

        for batch in batches:
            kind_of_key = batch.schema.field("key").type
            for row in batch.to_pylist():
                step, now = step_of(row), (row["key"], row["part"])
                if now != group:
                    if group:
                        yield out()
                    group, made = now, step
                else:
                    made = made[0], applied(made[1], silent, *step), int(applied(np.array([made[2]]), silent, *step)[0])
        if group:
            yield out()

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, LONG_AGO
        for batch in batches:
            keys, numbers, entries = [], [], []
            for row in batch.to_pylist():
                if (now := (row["key"], row["part"])) != group:
                    group, last = now, LONG_AGO
                if row["block"] is None:
                    last = row["entry"]
                    continue
                keys.append(row["key"])
                numbers.append(row["block"])
                entries.append(last)
                last = int(applied(np.array([last]), silent, *step_of(row))[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(numbers, pa.int64()), pa.array(entries, pa.int64())], names=["key", "block", "entry"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stayed(np.asarray(t.values), silent, e) for t, e in zip(batch["times"], batch["entry"].to_pylist(), strict=True)]
            whose = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(whose)), pa.array([x for f in found for x in f], pa.int64())], names=["key", "at"])

    part = F.expr(f"block div {FAN}")
    levels, count = [blocks.mapInArrow(functions, steps)], high - low + 1
    while count > FAN:
        dealt = levels[-1].withColumn("part", part).repartition("key", "part").sortWithinPartitions("key", "part", "block")
        levels.append(written(dealt.mapInArrow(composed, steps)))
        count = -(-count // FAN)
    entries = levels[-1].limit(0).select("key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("entry"))
    for level in reversed(levels):
        above = entries.select("key", F.col("block").alias("part"), F.lit(None).cast("long").alias("block"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STEPS.split(", ")), "entry")
        both = level.withColumns({"part": part, "entry": F.lit(None).cast("long")}).unionByName(above)
        dealt = both.repartition("key", "part").sortWithinPartitions("key", "part", F.asc_nulls_first("block"))
        entries = dealt.mapInArrow(entered, f"key {kind}, block bigint, entry bigint")
    entries = entries.select(F.col("key").alias("_key"), F.col("block").alias("_block"), "entry")
    # a merge deals blocks out by number, however small they are
    met = blocks.hint("merge").join(entries, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).select("key", "times", "entry")
    return met.mapInArrow(kept, f"key {kind}, at bigint").select(F.col("key").alias(key), "at")
