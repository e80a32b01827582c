"""Streaming editions of two sequential rules: consecutive good frames, and a sustained drop below a baseline.

State is a few numbers per video and ends with a time-out on the watermark. Rows of a video must arrive in order of
time within a micro-batch's reach; later ones than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def good_streaks(frames: DataFrame, least: int, delay: str = "10 seconds", timeout_ms: int = 60_000) -> DataFrame:
    """One row (video_id, frame_no, streak) whenever a video has had `least` consecutive good frames; the count then
    starts again. Columns video_id string, frame_no long, ts timestamp, good boolean."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for r in pdf.sort_values("frame_no").itertuples():
                streak = streak + 1 if r.good else 0
                if streak == least:
                    out.append((key[0], r.frame_no, streak))
                    streak = 0
        state.update((streak,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + timeout_ms)
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "streak"]).astype({"frame_no": "int64", "streak": "int64"})

    marked = frames.withWatermark("ts", delay)
    return marked.groupBy("video_id").applyInPandasWithState(step, "video_id string, frame_no long, streak long", "streak long", "append", "EventTimeTimeout")


def sustained_drops(samples: DataFrame, part: float = 0.78, baseline: int = 5, length: int = 3, delay: str = "10 seconds", timeout_ms: int = 60_000) -> DataFrame:
    """One row (video_id, frame_no, level) at the first of `length` consecutive samples below part of the mean of the
    video's first `baseline` samples. Columns video_id string, frame_no long, ts timestamp, value double."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, low, first, done = state.get if state.exists else (0, 0.0, 0, 0, False)
        out = []
        for pdf in batches:
            for r in pdf.sort_values("frame_no").itertuples():
                if n < baseline:
                    n, total = n + 1, total + r.value
                    continue
                below = r.value < part * total / n
                first, low = (r.frame_no if low == 0 else first, low + 1) if below else (0, 0)
                if low == length and not done:
                    out.append((key[0], first, total / n))
                    done = True
        state.update((n, float(total), low, int(first), done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + timeout_ms)
        yield pd.DataFrame(out, columns=["video_id", "frame_no", "level"]).astype({"frame_no": "int64", "level": "float64"})

    marked = samples.withWatermark("ts", delay)
    return marked.groupBy("video_id").applyInPandasWithState(step, "video_id string, frame_no long, level double", "n long, total double, low long, first long, done boolean", "append", "EventTimeTimeout")
