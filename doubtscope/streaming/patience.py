"""The early-halting score on a stream of tokens.

Tokens of an answer arrive as rows; the state of an answer is its few highest scores, its counters
and tokens that came too early. A result row leaves as soon as the rule halts, at the end marker,
or when the watermark has passed. Later tokens of a finished answer are ignored. Fed with the same
tokens, in any order, the results equal ``patience_agg``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doubtscope.functions.tokens import HEAP_DEFAULT, PATIENCE_DEFAULT

OUTPUT = "seq bigint, mean double, tau int, triggered boolean"
STATE = (
    "top array<double>, idle int, tau int, next_pos bigint, wait_pos array<bigint>, "
    "wait_score array<double>, last_pos bigint, done boolean"
)


class _Fold:
    """State of one answer between micro-batches; tokens that wait for earlier ones are sorted arrays."""

    def __init__(self, m: int, w: int, saved: tuple | None = None):
        self.m, self.w = m, w
        top, self.idle, self.tau, self.next_pos, pos, score, self.last_pos, self.done = saved or (
            [], 0, 0, 0, [], [], -1, False
        )
        self.top, self.triggered = list(top), False
        self.pos = np.asarray(pos, np.int64)
        self.missing = np.array([x is None for x in score], bool)
        self.score = np.array([0.0 if x is None else x for x in score], float)

    def saved(self) -> tuple:
        score = [None if gone else x for x, gone in zip(self.score.tolist(), self.missing.tolist())]
        return (self.top, self.idle, self.tau, self.next_pos, self.pos.tolist(), score, self.last_pos, self.done)

    def take(self, pos: np.ndarray, score: np.ndarray, missing: np.ndarray, last: np.ndarray) -> None:
        """Add a frame of tokens; of those with one position the first counts."""
        if last.any():
            self.last_pos = int(pos[last][-1])
        new = pos >= self.next_pos
        self.pos, first = np.unique(np.concatenate([self.pos, pos[new]]), return_index=True)
        self.score = np.concatenate([self.score, score[new]])[first]
        self.missing = np.concatenate([self.missing, missing[new]])[first]

    def finish(self) -> None:
        """Keep nothing but the mark that the answer is finished."""
        self.done, self.top = True, []
        self.pos, self.score, self.missing = self.pos[:0], self.score[:0], self.missing[:0]

    def read(self, score: float | None) -> None:
        if score is None:
            return
        self.tau += 1
        if len(self.top) < self.m:
            bisect.insort(self.top, score)
            self.idle = 0
        elif score > self.top[0] and not math.isnan(score):
            del self.top[0]
            bisect.insort(self.top, score)
            self.idle = 0
        else:
            self.idle += 1
            self.triggered = self.idle >= self.w

    def advance(self, skip_gaps: bool = False) -> bool:
        """Read the tokens that are next in order. True when the answer is finished."""
        ready = len(self.pos) if skip_gaps else int((self.pos == self.next_pos + np.arange(len(self.pos))).cumprod().sum())
        for score, missing in zip(self.score[:ready].tolist(), self.missing[:ready].tolist()):
            self.read(None if missing else score)
            if self.triggered:
                break
        if ready:
            self.next_pos = int(self.pos[ready - 1]) + 1
            self.pos, self.score, self.missing = self.pos[ready:], self.score[ready:], self.missing[ready:]
        ended = self.last_pos >= 0 and self.next_pos > self.last_pos
        return self.triggered or ended or skip_gaps

    def result(self, seq: int) -> pd.DataFrame:
        mean = math.fsum(self.top) / len(self.top) if self.top else None
        return pd.DataFrame(
            {"seq": [seq], "mean": [mean], "tau": [self.tau], "triggered": [self.triggered]}
        )


def stream_patience(
    tokens: DataFrame,
    m: int = HEAP_DEFAULT,
    w: int = PATIENCE_DEFAULT,
    event_time: str | None = None,
    delay: str = "10 minutes",
    delay_ms: int = 600_000,
) -> DataFrame:
    """(seq, pos from 0, score or null, is_last) → one row per finished answer.

    With ``event_time`` an answer without end marker is closed when the watermark passes its newest
    token by ``delay_ms``: gaps are skipped then and its state is dropped. Without it there is no clock to drop
    by, and the mark that an answer is finished stays, to keep late tokens out.
    """
    timed = event_time is not None
    source = tokens.withWatermark(event_time, delay) if timed else tokens
    score = F.col("score").cast("double")  # pandas takes null for NaN, which counts as a token
    # every column costs a conversion per answer and micro-batch: the place and both flags travel as one
    # number, the time only if it is used; a place that is null lies before all others
    place = F.shiftleft(F.coalesce(F.col("pos").cast("bigint"), F.lit(-1).cast("bigint")), 2)
    flags = F.when(score.isNull(), 2).otherwise(0) + F.when(F.col("is_last"), 1).otherwise(0)
    columns = ["seq", place.bitwiseOR(flags.cast("bigint")).alias("mark"), F.coalesce(score, F.lit(0.0)).alias("score")]
    rows = source.select(*columns, *([event_time] if timed else []))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = _Fold(m, w, state.get if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            if not fold.done:
                fold.advance(skip_gaps=True)
                yield fold.result(key[0])
            return
        newest = None
        for frame in frames:
            if fold.done:
                continue
            mark = frame["mark"].to_numpy()
            fold.take(mark >> 2, frame["score"].to_numpy(), mark & 2 > 0, mark & 1 > 0)
            if timed and len(frame):
                top = frame[event_time].max()
                newest = top if newest is None or top > newest else newest
        out = None
        if not fold.done and fold.advance():
            out = fold.result(key[0])
            fold.finish()
        state.update(fold.saved())
        if timed:
            due = int(newest.timestamp() * 1000) if newest is not None else 0
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs()) + delay_ms)
        if out is not None:
            yield out

    return rows.groupBy("seq").applyInPandasWithState(
        update, OUTPUT, STATE, "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout,
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Process all that is available, append to a parquet table, and return the finished query."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
