"""Streams of open questions: what waits for a bar of a later time.

A forecast waits for the bar it is of, a breakout for the bars of its horizons. Nothing stored is read again: what is open
lives in the state of its asset, bars answer it as they come, in any order, and event-time timers close what no
bar answered once the watermark is past its time. Watermarks bound what is held, checkpoints make restarts repeat nothing.

Bars have asset, at (timestamp of their open time), ts (that as epoch ms), open, high, low, close; rows that come after the watermark has passed them are
dropped by Spark, as late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import forecast as fc
from tidemark.schema import DAY_MS, HOUR_MS

#: The state store that timers and maps need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

RETURNS = "asset string, breakout_ts long, horizon int, target_ts long, direction int, base_close double, forward_return double, forward_direction int"


class _ForwardReturns(StatefulProcessor):
    """State of an asset: closes by bar time, and open returns by target and breakout time. A timer at a time's end forgets its bar and gives up on returns that wait for it."""

    def __init__(self, horizons: tuple[int, ...], width_ms: int, wait_ms: int) -> None:
        self.horizons, self.width, self.wait = horizons, width_ms, wait_ms
        self.keep = max(horizons) * width_ms + wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "ts long", "close double")
        self.open = handle.getMapState("open", "target_ts long, breakout_ts long", "direction int, base_close double")

    def _row(self, asset, target: int, breakout: int, direction: int, base: float, close: float | None) -> tuple:
        change = close / base - 1 if close is not None and base > 0 else None
        return asset, breakout, (target - breakout) // self.width, target, direction, base, change, None if change is None else (change > 0) - (change < 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for ts, open_, close, breakout in zip(pdf["ts"].tolist(), pdf["open"].tolist(), pdf["close"].tolist(), pdf["breakout"].tolist()):
                if self.bars.containsKey((ts,)):  # a bar that comes again says nothing new
                    continue
                self.bars.updateValue((ts,), (close,))
                self.handle.registerTimer(ts + self.keep)
                for h in self.horizons:  # what waits for this bar
                    asked = (ts, ts - h * self.width)
                    if self.open.containsKey(asked):
                        direction, base = self.open.getValue(asked)
                        self.open.removeKey(asked)
                        out.append(self._row(key[0], *asked, direction, base, close))
                if breakout:
                    direction = 1 if close >= open_ else -1
                    for h in self.horizons:
                        target = ts + h * self.width
                        if self.bars.containsKey((target,)):  # it came before
                            out.append(self._row(key[0], target, ts, direction, close, self.bars.getValue((target,))[0]))
                        else:
                            self.open.updateValue((target, ts), (direction, close))
                            self.handle.registerTimer(target + self.wait)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for h in self.horizons:
            asked = (at - self.wait, at - self.wait - h * self.width)
            if self.open.containsKey(asked):
                direction, base = self.open.getValue(asked)
                self.open.removeKey(asked)
                out.append(self._row(key[0], *asked, direction, base, None))
        if self.bars.containsKey((at - self.keep,)):
            self.bars.removeKey((at - self.keep,))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in RETURNS.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = ["object", "int64", "int32", "int64", "int32", "float64", "float64", "Int32"]
        return pd.DataFrame({n: pd.Series(list(c), dtype=k) for n, c, k in zip(names, columns, kinds)})

    def close(self) -> None:
        pass


def forward_returns(bars: DataFrame, breakout, horizons: tuple[int, ...] = (1, 2, 3), width_ms: int = HOUR_MS, wait_ms: int = 2 * HOUR_MS, delay: str = "2 hours") -> DataFrame:
    """A stream of forward returns of the bars for which `breakout` (a column) holds: one row for each of its horizons, once. A return whose bar hasn't come when the watermark
    (delay behind the newest bar) is wait_ms past its time comes with NULL."""
    if bars.isStreaming:
        bars.sparkSession.conf.set(*STORE)
    rows = bars.withWatermark("at", delay).select("asset", "at", "ts", "open", "close", F.coalesce(breakout, F.lit(False)).alias("breakout"))
    return rows.groupBy("asset").transformWithStateInPandas(_ForwardReturns(tuple(horizons), width_ms, wait_ms), RETURNS, "Append", "EventTime")


def completions(forecasts: DataFrame, bars: DataFrame, delay: str = "2 hours", times: float = 2.0) -> DataFrame:
    """A stream of completed forecasts (asset, at: the time of the bar they are of, ts, predicted_range) with the bar's range, the errors and the breakout flag: an outer join of
    two streams on asset and event time. One without its bar comes with NULL, once the watermark has passed it."""
    asked = forecasts.withWatermark("at", delay)
    answers = fc.ranges(bars.withWatermark("at", delay)).select(F.col("asset").alias("_asset"), F.col("at").alias("_at"), F.col("range").alias("actual_range"))
    both = asked.join(answers, (F.col("asset") == F.col("_asset")) & (F.col("at") == F.col("_at")), "leftOuter").drop("_asset", "_at")
    e = F.col("actual_range") - F.col("predicted_range")
    return both.withColumns({"prediction_error": e, "abs_prediction_error": F.abs(e), "breakout_flag": (F.col("actual_range") > times * F.col("predicted_range")).cast("int")})


def intervals(signals: DataFrame, max_age_ms: int, values: list[str], span_ms: int = DAY_MS) -> DataFrame:
    """Static signals (asset, ts, values) as the times they hold for: from ts to the next one's, max_age_ms at most; a row for each span of time they reach into (bounded by
    max_age_ms / span_ms + 2)."""
    until = F.least(F.coalesce(F.lead("ts").over(Window.partitionBy("asset").orderBy("ts")), F.col("ts") + max_age_ms + 1), F.col("ts") + max_age_ms + 1)
    own = signals.select("asset", F.col("ts").alias("signal_ts"), until.alias("_until"), *values)
    span = lambda c: F.floor(c / F.lit(span_ms))
    return own.withColumn("_span", F.explode(F.sequence(span(F.col("signal_ts")), span(F.col("_until") - 1))))


def signalled(bars: DataFrame, signals: DataFrame, values: list[str], max_age_ms: int, span_ms: int = DAY_MS) -> DataFrame:
    """A stream (or table) of bars with the values of the newest static signal at or before each one's time, NULL if it is older than max_age_ms: a stream-static equality
    join on asset and span of time, within which the signal's time decides."""
    held = intervals(signals, max_age_ms, values, span_ms).withColumnRenamed("asset", "_asset")
    own = bars.withColumn("_bar_span", F.floor(F.col("ts") / F.lit(span_ms)))
    on = (F.col("asset") == F.col("_asset")) & (F.col("_bar_span") == F.col("_span")) & (F.col("ts") >= F.col("signal_ts")) & (F.col("ts") < F.col("_until"))
    return own.join(held, on, "left").drop("_asset", "_bar_span", "_span", "_until")
