"""Alerting per machine with state: hysteresis, one alert per episode, silence closes it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Windows that open an alert; ``window_start`` in epoch seconds.
OPENED = "machine_id string, window_start long, anomaly_score double, consecutive_windows int"
COLUMNS = ["machine_id", "window_start", "anomaly_score", "consecutive_windows"]
STATE = "is_open int, consecutive int, last_window_start long"


def advance(state: tuple[int, int, int] | None, windows: pd.DataFrame, open_after: int, gap_seconds: int) -> tuple[tuple[int, int, int], list[tuple[int, float, int]]]:
    """The state after more windows (window_start, anomaly_score) of one machine, and the windows that open an alert.

    Of several updates of a window the strongest counts; windows at or before the last one counted are old news.
    """
    is_open, n, last = state if state is not None else (0, 0, -1)
    best = windows.sort_values("anomaly_score", ascending=False, kind="stable").drop_duplicates("window_start").sort_values("window_start")
    opened = []
    for start, score in zip(best["window_start"].tolist(), best["anomaly_score"].tolist(), strict=True):
        if last >= 0 and start <= last:
            continue
        if last >= 0 and start - last > gap_seconds:
            is_open, n = 0, 0
        n, last = n + 1, start
        if not is_open and n >= open_after:
            is_open = 1
            opened.append((start, score, n))
    return (int(is_open), int(n), int(last)), opened


def alerts(anomalous: DataFrame, open_after: int = 2, gap_seconds: int = 120, closings: bool = False) -> DataFrame:
    """Opening windows of a stream (machine_id, window_start long, anomaly_score) with a watermark on another column.

    A machine that stays silent until the watermark has passed its last window by the gap is forgotten. With ``closings`` that is a row
    too: the last window, NaN as score, and 0 as ``consecutive_windows``.
    """

    def handle(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[2]
            state.remove()
            if closings:
                yield pd.DataFrame([(key[0], last, float("nan"), 0)], columns=COLUMNS)
            return
        rows = [f[["window_start", "anomaly_score"]] for f in frames]
        if not rows:
            return
        now, opened = advance(state.get if state.exists else None, pd.concat(rows), open_after, gap_seconds)
        state.update(now)
        if now[2] >= 0:
            # a timeout behind the watermark would fail the query; then the silence has passed already
            state.setTimeoutTimestamp(max((now[2] + gap_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        if opened:
            yield pd.DataFrame([(key[0], *o) for o in opened], columns=COLUMNS)

    return anomalous.groupBy("machine_id").applyInPandasWithState(handle, OPENED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Episodes(StatefulProcessor):
    """The same rules as a stateful processor: the episode is a value state of the machine, silence is a timer in event time."""

    def __init__(self, open_after: int, gap_seconds: int, closings: bool) -> None:
        self.open_after, self.gap_seconds, self.closings = open_after, gap_seconds, closings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", STATE)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        windows = [f[["window_start", "anomaly_score"]] for f in rows]
        if not windows:
            return
        now, opened = advance(tuple(map(int, self.episode.get())) if self.episode.exists() else None, pd.concat(windows), self.open_after, self.gap_seconds)
        self.episode.update(now)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # where the silence has passed already, the next batch ends the episode
        self.handle.registerTimer(max((now[2] + self.gap_seconds) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        if opened:
            yield pd.DataFrame([(key[0], *o) for o in opened], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = int(self.episode.get()[2])
        self.episode.clear()
        if self.closings:
            yield pd.DataFrame([(key[0], last, float("nan"), 0)], columns=COLUMNS)

    def close(self) -> None:
        pass


def episodes(anomalous: DataFrame, open_after: int = 2, gap_seconds: int = 120, closings: bool = False) -> DataFrame:
    """``alerts`` by a stateful processor (needs the RocksDB state store, see ``jobs.STATE_STORE``): value state per machine, a timer ends the episode."""
    return anomalous.groupBy("machine_id").transformWithStateInPandas(Episodes(open_after, gap_seconds, closings), OPENED, "Append", "EventTime")
