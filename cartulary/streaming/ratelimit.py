"""A sliding-window limit per key. Whether a request is accepted depends on which earlier ones were, so it is a
stateful operator and no window aggregate. State per key: the accepted times of the last window."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 3600


def accept(times: list[float], at: float, budget: int, window: float = WINDOW_S) -> tuple[list[float], bool]:
    """(accepted times still in the window, is this one accepted). Refused requests are not kept; at least one fits."""
    times = [t for t in times if at - t < window]
    ok = len(times) < max(1, budget)
    return ([*times, at] if ok else times), ok


def _decide(frame: pd.DataFrame, times: list[float], budget: int, window: float) -> tuple[pd.DataFrame, list[float]]:
    frame = frame.sort_values(["at", "id"], kind="stable")
    said = []
    for at in frame["at"].tolist():
        times, ok = accept(times, at, budget, window)
        said.append(ok)
    return frame.assign(accepted=said)[["key", "id", "at", "accepted"]], times


def limit(requests: DataFrame, budget: int, window: float = WINDOW_S) -> DataFrame:
    """requests (key, id, at) with accepted, over a whole table; requests of one time in the order of their ids.

    Spark sorts each key's requests, which may spill, and a task goes through them in order: it holds the accepted times of one
    window (at most the budget), however many requests a key has. A null key is a key.
    """
    most = max(1, budget)

    def judge(frames):
        now, held, first = None, deque(), True
        for frame in frames:
            said = []
            for key, at in zip(frame["key"].tolist(), frame["at"].tolist(), strict=True):
                if first or key != now:
                    now, held, first = key, deque(), False
                while held and at - held[0] >= window:
                    held.popleft()
                said.append(len(held) < most)
                if said[-1]:
                    held.append(at)
            yield frame.assign(accepted=said)

    rows = requests.select("key", "id", "at").repartition("key").sortWithinPartitions("key", "at", "id")
    return rows.mapInPandas(judge, "key string, id string, at double, accepted boolean")


def limit_stream(requests: DataFrame, budget: int, window: float = WINDOW_S, expire: bool = True) -> DataFrame:
    """The same over a stream; each micro-batch is judged in time order.

    expire: a key's state goes after a window without requests. A query that waits for that never ends by itself, so a one-pass
    run (trigger availableNow) has to do without.
    """

    def judge(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        frame, times = _decide(pd.concat(list(frames)), times, budget, window)
        state.update((times,))
        if expire:
            state.setTimeoutDuration(max(1, int(window * 1000)))
        yield frame

    return requests.select("key", "id", "at").groupBy("key").applyInPandasWithState(judge, "key string, id string, at double, accepted boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
