"""Summaries of logged forecasts. Predictions have asset, ts, predicted_range, actual_range (NULL until known), regime."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import ordered
from tidemark.schema import DAY_MS, HOUR_MS


def completed(pred: DataFrame) -> DataFrame:
    """Rows that can be scored: both values finite, a positive actual; with error and abs_error."""
    ok = F.col("predicted_range").isNotNull() & F.col("actual_range").isNotNull() & ~F.isnan("predicted_range") & ~F.isnan("actual_range") & (F.col("actual_range") > 0)
    return pred.filter(ok).withColumn("error", F.col("actual_range") - F.col("predicted_range")).withColumn("abs_error", F.abs("error"))


def breakouts(pred: DataFrame, times: float = 2.0) -> DataFrame:
    """Completed rows whose actual range is `times` the forecast or more, with ratio and severity."""
    out = completed(pred).withColumn("ratio", s.rounded_ratio(F.col("actual_range"), F.col("predicted_range"))).withColumn("severity", s.severity(F.col("actual_range"), F.col("predicted_range")))
    return out.filter((F.col("predicted_range") > 0) & (F.col("actual_range") >= times * F.col("predicted_range")))


def top_breakouts(pred: DataFrame, n: int = 20) -> DataFrame:
    """The n newest breakouts of each asset."""
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    return breakouts(pred).withColumn("place", place).filter(F.col("place") <= n)


def newest(pred: DataFrame, n: int) -> DataFrame:
    """The newest n rows over all assets, oldest first."""
    return pred.orderBy(F.desc("ts"), "asset").limit(n).orderBy("ts", "asset")


def latest_each(pred: DataFrame, now_ms: int, stale_hours: float = 2.0) -> DataFrame:
    """Each asset's newest forecast, its age, and its regime (unknown if stale)."""
    out = pred.groupBy("asset").agg(F.max("ts").alias("ts"), F.max_by("predicted_range", "ts").alias("predicted_range"), F.max_by("regime", "ts").alias("regime"))
    age = (F.lit(now_ms) - F.col("ts")) / float(HOUR_MS)
    return out.withColumn("age_hours", age).withColumn("regime", F.when(age > stale_hours, "unknown").otherwise(F.coalesce("regime", F.lit("unknown"))))


def calibration(pred: DataFrame, n: int = 720, least: int = 24) -> DataFrame:
    """Over each asset's last n completed rows: errors of the model and of persistence (the forecast of the row before); NULL under `least` rows."""
    rows = completed(pred).withColumn("_r", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))).filter(F.col("_r") <= n).withColumn("prev", t.lag("predicted_range"))
    out = rows.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.avg("error").alias("bias"), F.avg(F.abs(F.col("actual_range") - F.col("prev"))).alias("persistence_mae"),
        F.avg("actual_range").alias("mean_actual"), F.avg("predicted_range").alias("mean_predicted"), F.count_if(F.col("actual_range") > 2 * F.col("predicted_range")).alias("breakouts"),
    )
    out = out.withColumn("improvement_pct", s.improvement_pct(F.col("persistence_mae"), F.col("mae")))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("mae", "bias", "persistence_mae", "improvement_pct")})


def live_calibration(pred: DataFrame, short: int = 168, long: int = 720, worse: float = 1.5, least: int = 24) -> DataFrame:
    """Mean error overall and of the last week's and month's rows (NULL under `least`), the extreme ratios of positive forecasts, and whether the last week is worse by a half."""
    rows = completed(pred).withColumn("_r", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))).withColumn("_q", F.when(F.col("predicted_range") > 0, F.try_divide("actual_range", "predicted_range")))
    out = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.when(F.count(F.lit(1)) >= least, F.avg(F.when(F.col("_r") <= short, F.col("abs_error")))).alias("mae_short"), F.when(F.count(F.lit(1)) >= least, F.avg(F.when(F.col("_r") <= long, F.col("abs_error")))).alias("mae_long"), F.max("_q").alias("worst_ratio"), F.min("_q").alias("best_ratio"))
    return out.withColumn("degrading", F.coalesce(F.col("mae_short") > worse * F.col("mae"), F.lit(False)))


def daily_mae(pred: DataFrame) -> DataFrame:
    """asset, day: mean errors of the model and of persistence (the row before, whatever its day)."""
    rows = completed(pred).withColumn("prev", t.lag("predicted_range"))
    day = (F.floor(F.col("ts") / F.lit(DAY_MS)) * DAY_MS).cast("long")
    return rows.groupBy("asset", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.avg(F.abs(F.col("actual_range") - F.col("prev"))).alias("persistence_mae"))


def improvement_band(daily: DataFrame, width: int = 7) -> DataFrame:
    """daily with the rolling mean improvement over persistence and 1.96 standard errors around it."""
    own = daily.withColumn("_i", F.col("persistence_mae") - F.col("mae"))
    w = Window.partitionBy("asset").orderBy("day").rowsBetween(-width + 1, 0)
    n = F.count("_i").over(w)
    m, se = F.avg("_i").over(w), F.try_divide(F.stddev_samp("_i").over(w), F.sqrt(n.cast("double")))
    return own.withColumns({"improvement": F.when(n >= 2, m), "low": F.when(n >= 2, m - 1.96 * se), "high": F.when(n >= 2, m + 1.96 * se)}).drop("_i")


def day_extremes(pred: DataFrame) -> DataFrame:
    """Each asset's best and worst day by mean error."""
    d = daily_mae(pred)
    return d.groupBy("asset").agg(F.count(F.lit(1)).alias("days"), F.min_by("day", F.struct("mae", "day")).alias("best_day"), F.min("mae").alias("best_mae"), F.max_by("day", F.struct("mae", "day")).alias("worst_day"), F.max("mae").alias("worst_mae"))


def weekly(pred: DataFrame, now_ms: int, hours: int = 168) -> DataFrame:
    """Errors of the rows of the last hours, profit factor of signed errors, and share of wins over persistence."""
    rows = completed(pred).filter((F.col("ts") >= now_ms - hours * HOUR_MS) & (F.col("ts") < now_ms)).withColumn("prev", t.lag("predicted_range"))
    gain, loss = F.sum(F.when(F.col("error") > 0, F.col("error"))), F.sum(F.when(F.col("error") < 0, -F.col("error")))
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.avg("error").alias("bias"), F.try_divide(gain, loss).alias("profit_factor"), F.avg((F.col("abs_error") < F.abs(F.col("actual_range") - F.col("prev"))).cast("double")).alias("win_share"))


def weeks_beating(pred: DataFrame, size: int = 168, least: int = 24) -> DataFrame:
    """asset, chunk: chunks of `size` completed rows and whether the model beat persistence (which starts anew in each)."""
    rows = completed(pred).withColumn("chunk", F.floor((F.row_number().over(t.order()) - 1) / F.lit(size)))
    rows = rows.withColumn("prev", F.lag("predicted_range").over(Window.partitionBy("asset", "chunk").orderBy("ts")))
    out = rows.groupBy("asset", "chunk").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.avg(F.abs(F.col("actual_range") - F.col("prev"))).alias("persistence_mae")).filter(F.col("n") >= least)
    return out.withColumn("beats", F.col("mae") < F.col("persistence_mae"))


def regime_distribution(pred: DataFrame) -> DataFrame:
    """Counts and shares of regimes (others and NULL: unknown)."""
    known = F.when(F.col("regime").isin("low", "medium", "high"), F.col("regime")).otherwise("unknown")
    total = F.sum("n").over(Window.partitionBy("asset"))
    return pred.groupBy("asset", known.alias("regime")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.col("n") * 100.0 / total)


def dominant_regime(pred: DataFrame) -> DataFrame:
    """The most frequent regime of each asset (of equal ones the first by name)."""
    return regime_distribution(pred).groupBy("asset").agg(F.min_by("regime", F.struct(-F.col("n"), F.col("regime"))).alias("regime"))


def accuracy_series(pred: DataFrame) -> DataFrame:
    """asset, day: mean accuracy of the model less that of persistence."""
    rows = completed(pred).withColumn("prev", t.lag("predicted_range"))
    diff = s.accuracy(F.col("abs_error"), F.col("actual_range")) - s.accuracy(F.abs(F.col("actual_range") - F.col("prev")), F.col("actual_range"))
    return rows.groupBy("asset", (F.floor(F.col("ts") / F.lit(DAY_MS)) * DAY_MS).cast("long").alias("day")).agg(F.avg(diff).alias("accuracy_gain"))


def error_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """asset, bin (from 0), n: equal bins between each asset's least and greatest error."""
    rows = completed(pred).select("asset", "error")
    span = rows.groupBy("asset").agg(F.min("error").alias("_a"), F.max("error").alias("_b"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("error") - F.col("_a")) * bins, F.col("_b") - F.col("_a")), F.lit(0.0))).cast("int"))
    return rows.join(span, "asset").groupBy("asset", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def status(pred: DataFrame) -> DataFrame:
    """Completed and pending rows of each asset, with the newest of each."""
    done = F.col("actual_range").isNotNull()
    return pred.groupBy("asset").agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"), F.max(F.when(done, F.col("ts"))).alias("last_completed"), F.max(F.when(~done, F.col("ts"))).alias("last_pending"))


def horizon_summary(returns: DataFrame, least: int = 10) -> DataFrame:
    """horizon, breakouts, filled, pending, hit_rate (NULL under `least` filled)."""
    hit = F.when(F.col("forward_direction").isNotNull(), (F.col("forward_direction") == F.col("direction")).cast("double"))
    return returns.groupBy("horizon").agg(F.count_distinct("asset", "breakout_ts").alias("breakouts"), F.count("forward_return").alias("filled"), F.count_if(F.col("forward_return").isNull()).alias("pending"), F.when(F.count(hit) >= least, F.avg(hit)).alias("hit_rate"))


def strategy_table(metrics: DataFrame, key: str, columns: list[str], names: list[str]) -> DataFrame:
    """metric by strategy: columns unpivoted, then strategies side by side."""
    return metrics.select(key, *columns).unpivot([key], columns, "metric", "value").groupBy("metric").pivot(key, names).agg(F.first("value"))


def coefficient_drift(fitted: DataFrame, names: list[str]) -> DataFrame:
    """asset, coefficient, mean, deviation (population) over time of an array column beta."""
    rows = fitted.filter(F.col("beta").isNotNull()).select("asset", F.posexplode("beta").alias("_i", "value"))
    return rows.groupBy("asset", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("_i") + 1).alias("coefficient")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def funding_stats(events: DataFrame) -> DataFrame:
    """Rows, span, 5th, 50th and 95th percentile and settlement hours of rates."""
    own = events.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set(F.hour(F.timestamp_millis("ts")))).alias("hours"))
    return ordered.with_quantiles(own, ordered.quantiles(events, F.col("rate"), ["asset"], {f"p{int(q * 100)}": q for q in (0.05, 0.5, 0.95)}), ["asset"])


def paper_pnl(positions: DataFrame) -> DataFrame:
    """Open and closed positions, realised P&L and win rate of each asset."""
    closed = F.col("status") == "closed"
    return positions.groupBy("asset").agg(F.count_if(~closed).alias("open"), F.count_if(closed).alias("closed"), F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("pnl"), F.avg(F.when(closed, (F.col("pnl") > 0).cast("double"))).alias("win_rate"))


def html(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as a page; raises if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else escape(str(x))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; raises if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
