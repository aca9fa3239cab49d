"""Rate limits and caches over event time, per key: exact folds in batch, the same folds as stateful streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingWindow:
    """Admits an event if fewer than ``most`` were admitted in the last ``seconds``; greedy, so rejected events don't count."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def start(self) -> list[float]:
        return []

    def step(self, state: list[float], now: float) -> tuple[list[float], bool]:
        kept = deque(t for t in state if t > now - self.seconds)
        admitted = len(kept) < self.most
        if admitted:
            kept.append(now)
        return list(kept), admitted


class TokenBucket:
    """Refills ``rate`` tokens a second up to ``capacity``; an event takes one or is rejected."""

    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity

    def start(self) -> list[float]:
        return [self.capacity]

    def step(self, state: list[float], now: float) -> tuple[list[float], bool]:
        tokens = min(self.capacity, state[0] + self.rate * (now - state[1])) if len(state) > 1 else state[0]
        admitted = tokens >= 1
        return [tokens - admitted, now], admitted


class CacheAge:
    """A hit while the stored result is younger than ``seconds``; age counts from storing, a miss stores."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def start(self) -> list[float]:
        return []

    def step(self, state: list[float], now: float) -> tuple[list[float], bool]:
        hit = bool(state) and now - state[0] < self.seconds
        return (state if hit else [now]), hit


def fold(events: DataFrame, rule, key: str, order: str, ts: str = "ts") -> DataFrame:
    """``order, admitted`` of every event, each key's events folded in order of time.

    The fold is sequential within a key by nature; keys are users or queries.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", order])
        state, out = rule.start(), []
        for t in g["t"]:
            state, ok = rule.step(state, t)
            out.append(ok)
        return pd.DataFrame({order: g[order], "admitted": out})

    base = events.where(F.col(ts).isNotNull()).select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return base.groupBy(key).applyInPandas(run, f"{order} {kind[order]}, admitted boolean")


def fold_stream(events: DataFrame, rule, key: str, order: str, ts: str = "ts", expire: str = "1 day") -> DataFrame:
    """The same over a stream: ``key, order, admitted``; a key's state is kept between batches, until nothing came for ``expire``.

    Events without a time are left out. Those of one batch are folded in order of
    time, batches as they come.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = list(state.get[0]) if state.exists else rule.start()
        g = pd.concat(list(batches)).sort_values(["t", order])
        out = []
        for t in g["t"]:
            now, ok = rule.step(now, float(t))
            out.append(ok)
        state.update((now,))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({key: k[0], order: g[order], "admitted": out})

    milliseconds = int(pd.Timedelta(expire).total_seconds() * 1000)
    base = events.where(F.col(ts).isNotNull()).select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return base.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}, admitted boolean", "s array<double>", "append", "ProcessingTimeTimeout")


def run_log(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Run-log records (``ts, node, latency_ms``) per node and tumbling window; works on streams and tables."""
    timed = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return timed.groupBy(F.window("ts", width), "node").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


