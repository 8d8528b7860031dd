"""The hourly cycle as a micro-batch: complete pending forecasts, forecast, log, follow up breakouts.

`cycle` is a pure function of tables and a time, so batch runs, replays and
`foreachBatch` give the same rows; repeating a cycle changes nothing. A pending
row whose bar hasn't come stays pending: that is the rule for late data.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import bars as b
from tidemark.operators import forecast as fc
from tidemark.operators import reports
from tidemark.schema import BARS, DAY_MS, FORWARD_RETURNS, HOUR_MS, PREDICTIONS
from tidemark.sources import sinks


#: What is open: a forecast's asset and time, or a return's asset, breakout time and target time.
OPEN = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "asset")] + [T.StructField(c, T.LongType()) for c in ("ts", "target_ts")])


@dataclass
class State:
    bars: sinks.Table
    predictions: sinks.Table
    returns: sinks.Table
    open: sinks.Table  # keys of pending rows alone, so that no cycle looks for them in all others


def state(spark: SparkSession, path: str) -> State:
    tables = State(sinks.Table(spark, f"{path}/bars", BARS), sinks.Table(spark, f"{path}/predictions", PREDICTIONS), sinks.Table(spark, f"{path}/returns", FORWARD_RETURNS), sinks.Table(spark, f"{path}/open", OPEN))
    for t in (tables.bars, tables.predictions, tables.returns):
        t.create()
    if not tables.open.version():  # also of a state that was made before: once
        tables.open.write(still_open(tables.predictions.read(), tables.returns.read()))
    return tables


def still_open(predictions: DataFrame, returns: DataFrame) -> DataFrame:
    """Keys of the pending rows of both."""
    a = predictions.filter("actual_range IS NULL").select(F.lit("forecast").alias("kind"), "asset", "ts", F.col("ts").alias("target_ts"))
    b = returns.filter("forward_return IS NULL").select(F.lit("return").alias("kind"), "asset", F.col("breakout_ts").alias("ts"), "target_ts")
    return a.unionByName(b)


def complete(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    actual = fc.ranges(bars).select("asset", "ts", F.col("range").alias("actual_range"))
    return sinks.completed_once(predictions, actual, ["asset", "ts"])


def predict(bars: DataFrame, timeframe: str = "1h", width_ms: int = HOUR_MS, window: int = 800) -> DataFrame:
    """One pending row for each asset: the next bar's range, or its last mean where no fit is possible."""
    r = fc.ranges(bars)
    nxt = fc.har_next(r, window=window)
    last = r.groupBy("asset").agg((F.max("ts") + width_ms).alias("ts"), F.avg("range").alias("_m"), F.percentile("range", 1 / 3).alias("_a"), F.percentile("range", 2 / 3).alias("_b"))
    value = F.coalesce(F.when(F.col("har") > 0, F.col("har")), F.col("_m"))
    rows = last.join(nxt, "asset", "left").withColumn("predicted_range", value)
    nothing = {c: F.lit(None).cast("double") for c in ("actual_range", "prediction_error", "abs_prediction_error")}
    return rows.withColumns({"timeframe": F.lit(timeframe), **nothing, "breakout_flag": F.lit(None).cast("int"), "regime": fc.tercile_regime(F.col("predicted_range"), F.col("_a"), F.col("_b"))}).select(PREDICTIONS.fieldNames())


def recent(table: sinks.Table, now_ms: int, back_ms: int) -> list[int]:
    """Partitions of a table that hold the last back_ms."""
    return list(range((now_ms - back_ms) // table.span_ms, now_ms // table.span_ms + 1))


def with_bias(forecasts: DataFrame, predictions: DataFrame, now_ms: int) -> DataFrame:
    """Forecasts plus the mean error of the completed ones of the week before (past rows only; none under 24 of them); never below 0."""
    past = predictions.filter((F.col("ts") < now_ms) & F.col("actual_range").isNotNull()).withColumn("_e", F.col("actual_range") - F.col("predicted_range"))
    found = fc.bias_correction(past, "_e").select("asset", F.col("bias").alias("_b"))
    moved = F.greatest(F.col("predicted_range") + F.coalesce("_b", F.lit(0.0)), F.lit(0.0))
    return forecasts.join(found, "asset", "left").withColumn("predicted_range", moved).select(forecasts.columns)


def calibration(s: State, reports_: sinks.Table, now_ms: int, every_ms: int = DAY_MS) -> bool:
    """The daily report: a row of live calibration of each asset, unless there is one since every_ms. Whether it was written."""
    newest = reports_.read(recent(reports_, now_ms, every_ms)).filter("kind = 'calibration'").agg(F.max("ts")).first()[0]
    if newest is not None and now_ms - newest < every_ms:
        return False
    rows = reports.live_calibration(s.predictions.read(recent(s.predictions, now_ms, 31 * DAY_MS)))
    sinks.append_report(reports_, "calibration", rows.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns)))).alias("assets")), now_ms)
    return True


def cycle(s: State, incoming: DataFrame, now_ms: int, horizons: tuple[int, ...] = (1, 2, 3), width_ms: int = HOUR_MS, bias: bool = False, context: int = 2000) -> dict[str, int]:
    """One cycle over incoming bars, as of now_ms. Partitions of the last `context` bars are read, and those of rows that are pending or new, however old,
    are rewritten. bias: correct forecasts by last week's mean error. The keys of pending rows are a table of their own: it names new rows before they
    are written and forgets completed ones after, so that a cycle that breaks off loses none."""
    fresh = b.closed(incoming, now_ms, width_ms)
    counts = sinks.insert_new(s.bars, fresh.select(BARS.fieldNames()), ["asset", "ts"], checks=sinks.valid_bar())
    # forecasts read the newest bars only: partitions before the context are never opened
    have = b.closed(s.bars.read(recent(s.bars, now_ms, context * width_ms)), now_ms, width_ms)
    open_ = s.open.read()
    pending = open_.filter("kind = 'forecast'").select("asset", "ts")
    biased = with_bias(predict(have, width_ms=width_ms), s.predictions.read(recent(s.predictions, now_ms, 8 * DAY_MS)), now_ms) if bias else predict(have, width_ms=width_ms)
    named = biased.select(F.lit("forecast").alias("kind"), "asset", "ts", F.col("ts").alias("target_ts"))
    s.open.write(open_.unionByName(named).distinct())
    parts = s.predictions.parts_of(biased.select("ts").union(pending.select("ts")))
    actual = b.closed(s.bars.read(s.bars.parts_of(pending)), now_ms, width_ms)
    old = s.predictions.read(parts)
    done = complete(old, actual)
    s.predictions.replace(done.unionByName(sinks.new_rows(done, biased, ["asset", "ts"])), parts)
    # only partitions in which rows were completed can have new breakouts
    flagged = s.predictions.read(parts).filter("breakout_flag = 1")
    hits = flagged.join(s.bars.read(s.bars.parts_of(flagged)).select("asset", "ts", "open", "close"), ["asset", "ts"])
    breakouts = hits.select(F.col("ts").alias("breakout_ts"), "asset", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("direction"), F.col("close").alias("base_close"))
    fanned = sinks.fan_out(breakouts, list(horizons), width_ms).select(FORWARD_RETURNS.fieldNames())
    waiting = s.open.read().filter("kind = 'return'")
    asked = fanned.select("asset", F.col("breakout_ts").alias("ts"), "target_ts").unionByName(waiting.select("asset", "ts", "target_ts"))
    rows = s.returns.parts_of(asked.select(F.col("ts").alias("breakout_ts")))
    if rows:
        s.open.write(s.open.read().unionByName(asked.select(F.lit("return").alias("kind"), "asset", "ts", "target_ts")).distinct())
        # the bars that returns wait for, however long ago they were due
        due = b.closed(s.bars.read(s.bars.parts_of(asked.select(F.col("target_ts").alias("ts")))), now_ms, width_ms)
        before = s.returns.read(rows)
        s.returns.replace(sinks.fill_forward_returns(before.unionByName(sinks.new_rows(before, fanned, ["asset", "breakout_ts", "horizon"])), due, now_ms), rows)
    s.open.write(still_open(s.predictions.read(parts), s.returns.read(rows)))
    return counts


def start(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, now=None, width_ms: int = HOUR_MS, bias: bool = False):
    """A query that runs a cycle for each micro-batch of a streaming DataFrame of bars; now: a function of the batch (its newest bar's end, if not given)."""
    s, daily = state(spark, path), sinks.Table(spark, f"{path}/reports", sinks.EVENTS)
    daily.create()

    def each(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is not None:
            at = now(batch) if now else newest + width_ms
            cycle(s, batch, at, width_ms=width_ms, bias=bias)
            calibration(s, daily, at)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_bars(ticks: DataFrame, watermark: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Bars of a stream of ticks (asset, at, price), final once the watermark has passed them."""
    own = ticks.withWatermark("at", watermark).groupBy("asset", F.window("at", width)).agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return own.select("asset", F.unix_millis("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def once(events: DataFrame, key: list[str], at: str = "at", within: str = "1 day") -> DataFrame:
    """Stream events without repeats of a key that come within a time."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


POSITION = "asset string, ts long, position int"


def streamed_positions(signals: DataFrame, hold_ms: int | None = None) -> DataFrame:
    """Positions of a stream of signals (asset, ts, long_entry, short_entry): the state of each asset is its position and since when."""

    def step(key, batches, memory):
        now, since = memory.get if memory.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, up, down in zip(rows["ts"], rows["long_entry"], rows["short_entry"]):
            if now:
                if (hold_ms is not None and ts - since >= hold_ms) or (now > 0 and down) or (now < 0 and up):
                    now = 0
            elif bool(up) != bool(down):
                now, since = (1 if up else -1), int(ts)
            out.append((key[0], int(ts), now))
        memory.update((int(now), int(since)))
        yield pd.DataFrame(out, columns=["asset", "ts", "position"])

    return signals.groupBy("asset").applyInPandasWithState(step, POSITION, "position int, since long", "append", "NoTimeout")
