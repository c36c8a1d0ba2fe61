"""A learned sequence score: each user's level is followed by a Kalman filter, and a row is scored by how far it is from what was expected."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_blocks, percentile

#: Bounds of the gain. With the least one, what lies FORGOTTEN / LEAST rows back weighs less than rounding.
LEAST_GAIN, MOST_GAIN, FORGOTTEN = 0.02, 0.98, 37.0
#: Differences of more usual deviations are cut when the filter is fitted.
CUT = 4.0
#: Rows of a user in a block, and rows of a user before a score counts.
ROWS, WARM = 16_384, 5


class Filter(NamedTuple):
    """A local level: each value is the user's level and noise; the level moves by steps. gain is how much of a surprise moves it; spread is the usual deviation."""

    gain: float
    spread: float

    @property
    def halo(self) -> int:
        """Rows after which a start is forgotten."""
        return math.ceil(FORGOTTEN / self.gain)


def fit_filter(logs: DataFrame, rows: int = ROWS) -> Filter:
    """The filter of values that follow each other, by the moments of their differences over all users.

    Differences of neighbours have the variance q + 2 r and the covariance -r with the next difference, where q is that of the
    level's steps and r that of the noise; the steady gain follows from q / r. Differences are cut at CUT usual deviations (by
    their median), so that rare jumps don't make levels seem restless. Two rows of sums come to the driver.
    """
    before = Window.partitionBy("user_id", "_block").orderBy("_place")
    blocks = in_blocks(valued(logs), "user_id", "timestamp", "event_id", 2, rows)
    steps = blocks.withColumn("d", F.col("response_time") - F.lag("response_time").over(before)).withColumn("e", F.lag("d").over(before)).filter("_own AND d IS NOT NULL")
    usual = percentile(steps.withColumn("size", F.abs("d")), "size", 0.5)
    most = CUT * 1.4826 * usual if usual else math.inf
    d, e = (F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c))) for c in ("d", "e"))
    variance, covariance = steps.agg(F.avg(d * d), F.avg(F.when(F.col("e").isNotNull(), d * e))).first()
    if not variance:
        return Filter(LEAST_GAIN, 0.0)
    noise = min(max(-(covariance or 0.0), 1e-9 * variance), variance / 2)
    moves = max(variance - 2 * noise, 0.0)
    level = (moves + math.sqrt(moves * moves + 4 * moves * noise)) / 2
    gain = min(MOST_GAIN, max(LEAST_GAIN, level / (level + noise)))
    return Filter(gain, math.sqrt(level + noise))


def valued(logs: DataFrame) -> DataFrame:
    """The rows that have a value, with what the filter needs."""
    return logs.select("event_id", "user_id", "timestamp", F.col("response_time").cast("double").alias("response_time")).filter("response_time IS NOT NULL")


def followed(values: np.ndarray, gain: float, level: float | None = None, spread: float = 0.0, seen: int = 0) -> tuple[np.ndarray, float, float, int]:
    """The score of each value, one after the other, and the state after them: level, mean square of surprises, and number of values.

    The score is the surprise in deviations of earlier surprises, 0 for the first values. Surprises of more than four
    deviations count as four for the state, so that one outlier doesn't hide the next.
    """
    scores = np.zeros(len(values))
    for k, x in enumerate(values.tolist()):
        if level is None:
            level, seen = x, 1
            continue
        surprise, deviation = x - level, math.sqrt(spread)
        scores[k] = abs(surprise) / deviation if seen >= WARM and deviation > 0 else 0.0
        if seen >= WARM and deviation > 0:
            surprise = max(-4 * deviation, min(4 * deviation, surprise))
        weight = max(gain, 1 / (seen + 1))
        level += weight * surprise
        spread += weight * (surprise * surprise - spread)
        seen += 1
    return scores, level, spread, seen


def level_scores(logs: DataFrame, fitted: Filter, rows: int = ROWS) -> DataFrame:
    """Scores of all rows with a value: event_id, user_id, level_score.

    A user's rows are cut into blocks with a halo after which the filter has forgotten where it started, so a
    user of any number of rows is many tasks and is scored as by one pass, up to rounding.
    """
    blocks = in_blocks(valued(logs), "user_id", "timestamp", "event_id", min(rows, fitted.halo), rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (None, 0.0, 0)
        for batch in batches:
            users, numbers = batch["user_id"].to_pylist(), batch["_block"].to_pylist()
            values, own = np.asarray(batch["response_time"], float), np.asarray(batch["_own"].cast(pa.uint8()), bool)
            starts = [0, *(k for k in range(1, len(users)) if (users[k], numbers[k]) != (users[k - 1], numbers[k - 1])), len(users)]
            scores = np.zeros(len(users))
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if now != (users[a], numbers[a]):
                    now, state = (users[a], numbers[a]), (None, 0.0, 0)
                scores[a:b], *state = followed(values[a:b], fitted.gain, *state)
            kept = batch.select(["event_id", "user_id"])
            out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores)], names=["event_id", "user_id", "level_score"])
            yield out.filter(pa.array(own))

    dealt = blocks.repartition("user_id", "_block").sortWithinPartitions("user_id", "_block", "_place")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return dealt.mapInArrow(score, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, level_score double")


def stream_level_scores(rows: DataFrame, fitted: Filter) -> DataFrame:
    """level_scores on a stream (event_id, user_id, at, response_time), with each user's state: level, mean square of surprises, number of values.

    Rows of a batch are taken by time; a row that comes in a later batch than a younger one is scored when it comes.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Level(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("state", "level double, spread double, seen long")

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            batch = pd.concat(list(rows)).dropna(subset=["response_time"]).sort_values(["at", "event_id"])
            held = self.state.get() if self.state.exists() else (None, 0.0, 0)
            scores, *state = followed(batch["response_time"].to_numpy(float), fitted.gain, *held)
            if len(batch):
                self.state.update((float(state[0]), float(state[1]), int(state[2])))
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], "level_score": scores})

        def close(self) -> None:
            pass

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("event_id", "user_id", "at", F.col("response_time").cast("double").alias("response_time")).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Level(), outputStructType=f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, level_score double", outputMode="Append", timeMode="None"
    )
