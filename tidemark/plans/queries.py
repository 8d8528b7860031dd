"""The registered queries of the time-series engine, each beside its SQL.

A query is a function of (spark, sf_dir); floats are rounded to six digits on both
sides, since sums depend on order in their last ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import asof as aj
from tidemark.operators import bars as b
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import forecast as fc
from tidemark.operators import gates, lab, ols, quality, reports, sim, stats
from tidemark.operators import signals as sg
from tidemark.plans import views as v
from tidemark.schema import DAY_MS, HOUR_MS
from tidemark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
W = "PARTITION BY asset ORDER BY ts"


def rounded(df: DataFrame) -> DataFrame:
    """df with its doubles rounded to six digits."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes))


def query(name: str, body: str | None = None, *ctes: str, keys: str = "asset ts", floats: str = "", others: str = ""):
    """Registers a function, with SQL made of the CTEs and a body whose columns are keys, rounded floats and others."""

    def add(fn: Query) -> Query:
        columns = [*keys.split(), *floats.split(), *others.split()]
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir).select(*columns))
        if body is not None:
            out = ", ".join([*keys.split(), *(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in floats.split()), *others.split()])
            ORACLE_SQL[name] = f"WITH {', '.join(ctes)}{', ' if ctes else ''}_body AS ({body}) SELECT {out} FROM _body"
        return fn

    return add


def win(first: int | str, last: int | str = 0, by: str = "asset", at: str = "ts") -> str:
    """A row frame in SQL."""
    side = lambda n: n if isinstance(n, str) else "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"(PARTITION BY {by} ORDER BY {at} ROWS BETWEEN {side(first)} AND {side(last)})"


def roll(fn: str, c: str, width: int, shift: int = 0, least: int | None = None) -> str:
    """A rolling function with a least number of values, in SQL."""
    w = win(-width - shift + 1, -shift)
    return f"CASE WHEN count({c}) OVER {w} >= {width if least is None else least} THEN {fn.format(c)} OVER {w} END"


MEAN, SD, SDP = "avg({})", "stddev_samp({})", "stddev_pop({})"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


# Bars and audits ------------------------------------------------------------------------------


@query("bars_resample_1h", "SELECT * FROM b", v.BARS_1H, floats="open high low close volume")
def _(spark, d):
    return v.bars_1h(spark, d)


@query("bars_resample_1d", "SELECT * FROM d", v.BARS_1D, floats="open high low close volume")
def _(spark, d):
    return v.bars_1d(spark, d)


@query(
    "bars_coarsen_4h",
    "SELECT asset, ts // 14400000 * 14400000 AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, "
    "sum(volume) AS volume FROM b GROUP BY asset, b.ts // 14400000 * 14400000",
    v.BARS_1H,
    floats="open high low close volume",
)
def _(spark, d):
    return b.coarsen(v.bars_1h(spark, d), 4 * HOUR_MS)


GRID = "span AS (SELECT asset, min(ts) AS a, max(ts) AS z FROM b GROUP BY asset), grid AS (SELECT asset, unnest(range(a, z + 1, 3600000)) AS ts FROM span)"


@query(
    "bars_grid_ffill",
    f"SELECT asset, ts, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, coalesce(close, lc) AS close, coalesce(volume, 0) "
    f"AS volume, (close IS NULL)::BIGINT AS filled_gap FROM (SELECT grid.asset, grid.ts, open, high, low, close, volume, last_value(close IGNORE NULLS) "
    f"OVER (PARTITION BY grid.asset ORDER BY grid.ts ROWS UNBOUNDED PRECEDING) AS lc FROM grid LEFT JOIN b ON b.asset = grid.asset AND b.ts = grid.ts)",
    v.BARS_1H,
    GRID,
    floats="open high low close volume", others="filled_gap",
)
def _(spark, d):
    return b.dense_grid(v.bars_1h(spark, d))


@query("missing_grid_hours", "SELECT grid.asset, grid.ts FROM grid ANTI JOIN b ON b.asset = grid.asset AND b.ts = grid.ts", v.BARS_1H, GRID)
def _(spark, d):
    return quality.missing_times(v.bars_1h(spark, d))


@query(
    "gap_report",
    f"SELECT asset, ts, previous_ts, (ts - previous_ts) // 3600000 - 1 AS missing, (ts - previous_ts) % 3600000 = 0 AS aligned FROM "
    f"(SELECT asset, ts, {lag('ts')} AS previous_ts FROM b) WHERE previous_ts IS NOT NULL AND ts - previous_ts <> 3600000",
    v.BARS_1H,
    others="previous_ts missing aligned",
)
def _(spark, d):
    return quality.gaps(v.bars_1h(spark, d))


@query(
    "gap_ranges",
    f"SELECT asset, ts + 3600000 AS first_missing, n - 3600000 AS last_missing, (n - ts) // 3600000 - 1 AS missing FROM "
    f"(SELECT asset, ts, lead(ts) OVER ({W}) AS n FROM b) WHERE n - ts > 3600000",
    v.BARS_1H,
    keys="asset first_missing", others="last_missing missing",
)
def _(spark, d):
    return quality.gap_ranges(v.bars_1h(spark, d))


@query(
    "duplicate_report",
    "SELECT event_type AS asset, epoch_ms(date_trunc('minute', ts)) AS ts, count(*) AS n, count(*) - 1 AS repeats FROM events GROUP BY 1, 2 "
    "HAVING count(*) > 1",
    others="n repeats",
)
def _(spark, d):
    rows = v.table(spark, d, "events").select(F.col("event_type").alias("asset"), s.bar_open(v.ms("ts"), 60_000).alias("ts"))
    return quality.repeats(rows, ["asset", "ts"])


ISSUES = (
    "(CASE WHEN open <= 0 THEN 'open_not_positive,' ELSE '' END) || (CASE WHEN high <= 0 THEN 'high_not_positive,' ELSE '' END) || (CASE "
    "WHEN low <= 0 THEN 'low_not_positive,' ELSE '' END) || (CASE WHEN close <= 0 THEN 'close_not_positive,' ELSE '' END)"
)


@query("ohlc_issues", f"SELECT asset, ts, rtrim({ISSUES}, ',') AS issues FROM b WHERE {ISSUES} <> ''", v.BARS_1H, others="issues")
def _(spark, d):
    return quality.invalid(v.bars_1h(spark, d)).withColumn("issues", F.array_join("issues", ","))


@query(
    "series_audit",
    f"SELECT asset, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (g = 0) AS repeats, count(*) FILTER (g > 3600000) AS gaps, "
    f"coalesce(sum(g // 3600000 - 1) FILTER (g > 3600000), 0)::BIGINT AS missing, count(*) FILTER (low <= 0) AS invalid, count(*) FILTER (g = 0 OR g > "
    f"3600000 OR low <= 0) = 0 AS overall_valid FROM (SELECT *, ts - {lag('ts')} AS g FROM b) GROUP BY asset",
    v.BARS_1H,
    keys="asset", others="n first_ts last_ts repeats gaps missing invalid overall_valid",
)
def _(spark, d):
    return quality.audit(v.bars_1h(spark, d))


@query(
    "misaligned_rows",
    "SELECT event_type AS asset, count(*) AS n, min(epoch_us(ts) // 1000 % 3600000) AS least_offset, max(epoch_us(ts) // 1000 % 3600000) AS most_offset "
    "FROM events WHERE epoch_us(ts) // 1000 % 3600000 <> 0 GROUP BY 1",
    keys="asset", others="n least_offset most_offset",
)
def _(spark, d):
    rows = v.table(spark, d, "events").select(F.col("event_type").alias("asset"), v.ms("ts").alias("ts"))
    off = F.col("ts") % HOUR_MS
    return b.off_grid(rows).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min(off).alias("least_offset"), F.max(off).alias("most_offset"))


@query(
    "interval_histogram",
    f"SELECT * FROM (SELECT asset, interval_ms, count(*) AS n, row_number() OVER (PARTITION BY asset ORDER BY count(*) DESC, interval_ms) AS place FROM "
    f"(SELECT asset, ts - {lag('ts')} AS interval_ms FROM b) WHERE interval_ms IS NOT NULL GROUP BY 1, 2) WHERE place <= 5",
    v.BARS_1H,
    keys="asset interval_ms", others="n place",
)
def _(spark, d):
    return quality.interval_histogram(v.bars_1h(spark, d))


NOW = 1_705_300_000_000  # 2024-01-15 06:26:40 UTC


@query("closed_bars", f"SELECT * FROM b WHERE ts + 3600000 <= {NOW}", v.BARS_1H, floats="close")
def _(spark, d):
    return b.closed(v.bars_1h(spark, d), NOW)


@query("latest_bars", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS r FROM b) WHERE r <= 24", v.BARS_1H, floats="close")
def _(spark, d):
    return b.latest(v.bars_1h(spark, d), 24)


@query(
    "infer_width",
    f"SELECT asset, median(g) AS median_ms, CASE WHEN abs(median(g) - 3600000) <= 36000 THEN 3600000 "
    f"WHEN abs(median(g) - 14400000) <= 144000 THEN 14400000 END AS width_ms FROM (SELECT asset, ts - {lag('ts')} AS g FROM b) GROUP BY asset",
    v.BARS_1H,
    keys="asset", floats="median_ms", others="width_ms",
)
def _(spark, d):
    return b.infer_width(v.bars_1h(spark, d))


@query(
    "context_check",
    f"SELECT asset, coalesce(skip, 'ok') AS reason, count(*) AS n FROM (SELECT asset, CASE WHEN n < 12 THEN 'context_short' "
    f"WHEN z - a <> 11 * 3600000 THEN 'context_gap' WHEN ok <> 1 THEN 'context_invalid' WHEN ts - p <> 3600000 THEN 'target_gap' "
    f"WHEN low <= 0 THEN 'invalid_target' END AS skip FROM (SELECT asset, ts, low, count(*) OVER {win(-12, -1)} AS n, min(ts) OVER {win(-12, -1)} AS a, "
    f"max(ts) OVER {win(-12, -1)} AS z, min((low > 0)::INT) OVER {win(-12, -1)} AS ok, {lag('ts')} AS p FROM b)) GROUP BY 1, 2",
    v.BARS_1H,
    keys="asset reason", others="n",
)
def _(spark, d):
    rows = quality.validate_context(v.bars_1h(spark, d), 12)
    return rows.groupBy("asset", F.coalesce("skip_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_digest",
    "SELECT l_returnflag AS asset, count(*) AS n, sum(('0x' || substr(sha256(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_linestatus)), 1, "
    "8))::BIGINT)::BIGINT AS digest FROM lineitem GROUP BY 1",
    keys="asset", others="n digest",
)
def _(spark, d):
    rows = v.table(spark, d, "lineitem").withColumn("asset", F.col("l_returnflag"))
    return quality.table_digest(rows, ["l_orderkey", "l_linenumber", "l_linestatus"], ["asset"])


@query(
    "multi_timeframe_newest",
    f"SELECT asset, '1h' AS timeframe, max(ts) AS newest, count(*) AS n FROM b WHERE ts + 3600000 <= {NOW} + 3600000 GROUP BY asset UNION ALL "
    f"SELECT asset, '4h', max(ts), count(*) FROM (SELECT DISTINCT asset, ts // 14400000 * 14400000 AS ts FROM b) WHERE ts + 14400000 <= {NOW} + 3600000 "
    f"GROUP BY asset",
    v.BARS_1H,
    keys="asset timeframe", others="newest n",
)
def _(spark, d):
    one = v.bars_1h(spark, d)
    return quality.availability({"1h": (one, HOUR_MS), "4h": (b.coarsen(one, 4 * HOUR_MS), 4 * HOUR_MS)}, NOW)


# Writes, as the rows they leave ---------------------------------------------------------------


@query(
    "insert_new_only",
    "SELECT * FROM b ANTI JOIN (SELECT asset AS a, ts AS t FROM b WHERE ts % 7200000 = 0) ON asset = a AND ts = t",
    v.BARS_1H,
    floats="close",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return sinks.new_rows(rows.filter("ts % 7200000 = 0"), rows, ["asset", "ts"])


@query("upsert_rows", "SELECT asset, ts, CASE WHEN ts % 7200000 = 0 THEN close * 2 ELSE close END AS close FROM b", v.BARS_1H, floats="close")
def _(spark, d):
    rows = v.bars_1h(spark, d).select("asset", "ts", "close")
    return sinks.upserted(rows, rows.filter("ts % 7200000 = 0").withColumn("close", F.col("close") * 2), ["asset", "ts"])


@query(
    "complete_once",
    "SELECT p.asset, p.ts, coalesce(p.actual_range, r.range) AS actual_range, CASE "
    "WHEN p.actual_range IS NULL THEN r.range - p.predicted_range END AS prediction_error, CASE "
    "WHEN p.actual_range IS NULL THEN (r.range > 2 * p.predicted_range)::BIGINT END AS breakout_flag FROM p JOIN r USING (asset, ts)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="actual_range prediction_error", others="breakout_flag",
)
def _(spark, d):
    pred = v.predictions(spark, d).withColumns({"prediction_error": F.lit(None).cast("double"), "abs_prediction_error": F.lit(None).cast("double"), "breakout_flag": F.lit(None).cast("int")})
    actual = fc.ranges(v.bars_1h(spark, d)).select("asset", "ts", F.col("range").alias("actual_range"))
    return sinks.completed_once(pred, actual, ["asset", "ts"])


BREAKS = (
    "br AS (SELECT c.asset, c.ts AS breakout_ts, CASE WHEN b.close >= b.open THEN 1 ELSE -1 END AS direction, b.close AS base_close FROM c "
    "JOIN b USING (asset, ts) WHERE actual_range > 2 * predicted_range), fr AS (SELECT br.asset, breakout_ts, h AS horizon, direction, breakout_ts + h * "
    "3600000 AS target_ts, CASE WHEN base_close > 0 THEN x.close / base_close - 1 END AS forward_return FROM br CROSS JOIN (VALUES (1), (2), (3)) AS t(h) "
    "LEFT JOIN b x ON x.asset = br.asset AND x.ts = breakout_ts + h * 3600000)"
)


def _forward(spark: SparkSession, d: str) -> DataFrame:
    bars = v.bars_1h(spark, d)
    hit = reports.completed(v.predictions(spark, d)).filter("actual_range > 2 * predicted_range").select("asset", "ts").join(bars, ["asset", "ts"])
    rows = hit.select(F.col("ts").alias("breakout_ts"), "asset", s.candle_direction(F.col("open"), F.col("close")).alias("direction"), F.col("close").alias("base_close"))
    return sinks.fill_forward_returns(sinks.fan_out(rows, [1, 2, 3], HOUR_MS), bars, 2**60)


@query(
    "forward_return_fill",
    "SELECT * FROM fr",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    BREAKS,
    keys="asset breakout_ts horizon", floats="forward_return", others="target_ts direction",
)
def _(spark, d):
    return _forward(spark, d)


@query(
    "horizon_hit_rates",
    "SELECT horizon, count(DISTINCT (asset, breakout_ts)) AS breakouts, count(forward_return) AS filled, count(*) - count(forward_return) AS pending, CASE "
    "WHEN count(forward_return) >= 10 THEN avg((sign(forward_return) = direction)::INT) FILTER (forward_return IS NOT NULL) END AS hit_rate FROM fr "
    "GROUP BY horizon",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    BREAKS,
    keys="horizon", floats="hit_rate", others="breakouts filled pending",
)
def _(spark, d):
    return reports.horizon_summary(_forward(spark, d))


# Forecasts and their errors -------------------------------------------------------------------

FORECASTS = f"m AS (SELECT asset, ts, range AS actual, {lag('range')} AS prev, {roll(MEAN, 'range', 5, 1)} AS mean5, {roll(MEAN, 'range', 22, 1)} AS mean22 FROM r)"
LONG = (
    "l AS (SELECT asset, ts, actual, 'prev' AS model, prev AS forecast FROM m UNION ALL SELECT asset, ts, actual, 'mean5', mean5 FROM m UNION ALL "
    "SELECT asset, ts, actual, 'mean22', mean22 FROM m)"
)


def _models(spark: SparkSession, d: str) -> DataFrame:
    r = fc.ranges(v.bars_1h(spark, d))
    return r.select("asset", "ts", F.col("range").alias("actual"), fc.persistence().alias("prev"), t.mean("range", 5, 1).alias("mean5"), t.mean("range", 22, 1).alias("mean22"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return ev.unpivot(_models(spark, d), ["prev", "mean5", "mean22"], ["asset", "ts"])


@query(
    "improvement_pct",
    "SELECT asset, count(*) AS n, avg(abs(prev - actual)) AS prev_mae, avg(abs(mean5 - actual)) AS mean5_mae, (avg(abs(prev - actual)) - avg(abs(mean5 - "
    "actual))) / avg(abs(prev - actual)) * 100 AS improvement FROM m WHERE mean5 IS NOT NULL GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="prev_mae mean5_mae improvement", others="n",
)
def _(spark, d):
    out = _models(spark, d).filter("mean5 IS NOT NULL").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prev") - F.col("actual"))).alias("prev_mae"), F.avg(F.abs(F.col("mean5") - F.col("actual"))).alias("mean5_mae"))
    return out.withColumn("improvement", s.improvement_pct(F.col("prev_mae"), F.col("mean5_mae")))


@query("rolling_mean_forecasts", "SELECT * FROM m", v.BARS_1H, v.RANGES, FORECASTS, floats="actual prev mean5 mean22")
def _(spark, d):
    return _models(spark, d)


@query(
    "error_profile",
    "SELECT *, sd_forecast / nullif(sd_actual, 0) AS dispersion FROM (SELECT asset, model, count(*) AS n, avg(abs(forecast - actual)) AS mae, "
    "sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(forecast - actual) AS bias, stddev_samp(forecast) AS sd_forecast, stddev_samp(actual) AS sd_actual, "
    "corr(forecast, actual) AS pearson FROM l WHERE forecast IS NOT NULL GROUP BY 1, 2)",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    LONG,
    keys="asset model", floats="mae rmse bias sd_forecast sd_actual pearson dispersion", others="n",
)
def _(spark, d):
    return ev.error_profile(_long(spark, d), ["asset", "model"])


@query(
    "model_comparison",
    "SELECT l.asset, l.model, count(*) AS n, avg(abs(l.forecast - l.actual)) AS mae, avg(abs(q.forecast - l.actual)) AS primary_mae, (avg(abs(l.forecast - "
    "l.actual)) - avg(abs(q.forecast - l.actual))) / avg(abs(l.forecast - l.actual)) * 100 AS improvement_pct FROM l "
    "JOIN l q ON q.model = 'mean22' AND q.asset = l.asset AND q.ts = l.ts WHERE l.model <> 'mean22' AND l.forecast IS NOT NULL AND q.forecast IS NOT NULL "
    "GROUP BY 1, 2",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    LONG,
    keys="asset model", floats="mae primary_mae improvement_pct", others="n",
)
def _(spark, d):
    return ev.compare(_long(spark, d), "mean22", ["asset"])


@query(
    "mape",
    "SELECT asset, avg(abs((mean5 - actual) / actual)) FILTER (abs(actual) > 1e-12) * 100 AS mape FROM m WHERE mean5 IS NOT NULL GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="mape",
)
def _(spark, d):
    return _models(spark, d).filter("mean5 IS NOT NULL").groupBy("asset").agg(ev.mape("actual", "mean5").alias("mape"))


RET = (
    f"ra AS (SELECT asset, ts, close, CASE WHEN {lag('close')} <> 0 THEN close / {lag('close')} - 1 END AS ret FROM d), rp AS "
    f"(SELECT *, {lag('ret')} AS prev FROM ra)"
)


def _daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return v.bars_1d(spark, d).withColumn("ret", F.try_divide("close", t.lag("close")) - 1).withColumn("prev", t.lag("ret"))


_DIR = "CASE WHEN abs({0}) <= 0.0005 THEN 0 WHEN {0} > 0 THEN 1 ELSE -1 END"


@query(
    "direction_metrics",
    f"SELECT asset, count(*) AS n, avg(coalesce(a = q, false)::INT) FILTER (a <> 0) AS accuracy, avg(coalesce(a = q, false)::INT) FILTER (a = 1) AS "
    f"bullish_accuracy, avg(coalesce(a = q, false)::INT) FILTER (a = -1) AS bearish_accuracy, count(*) FILTER (a = 1) AS n_positive, count(*) FILTER (a = "
    f"-1) AS n_negative FROM (SELECT asset, {_DIR.format('ret')} AS a, CASE WHEN prev IS NOT NULL THEN {_DIR.format('prev')} END AS q FROM rp "
    f"WHERE ret IS NOT NULL) GROUP BY asset",
    v.BARS_1D,
    RET,
    keys="asset", floats="accuracy bullish_accuracy bearish_accuracy", others="n n_positive n_negative",
)
def _(spark, d):
    return ev.direction_metrics(_daily_returns(spark, d), "ret", "prev", ["asset"])


@query(
    "ewma_forecast",
    f"SELECT asset, ts, list_reduce(xs, lambda a, x : a + (2.0 / 23) * (x - a)) AS ewma FROM (SELECT asset, ts, list(range) OVER {win(-512, -1)} AS xs "
    f"FROM r) WHERE len(xs) > 0",
    v.BARS_1H,
    v.RANGES,
    floats="ewma",
)
def _(spark, d):
    return fc.baselines(fc.ranges(v.bars_1h(spark, d))).filter("ewma IS NOT NULL")


HAR = (
    f"h AS (SELECT asset, ts, range AS y, {roll(MEAN, 'range', 1, 1)} AS m1, {roll(MEAN, 'range', 5, 1)} AS m5, {roll(MEAN, 'range', 22, 1)} AS m22 "
    f"FROM rd), rd AS (SELECT *, greatest(high - low, 0) AS range FROM d)"
)


@query(
    "har_moments",
    f"SELECT asset, ts, count(m22) OVER {win(-250, -1)} AS n_obs, sum(CASE WHEN m22 IS NOT NULL THEN m5 END) OVER {win(-250, -1)} AS s5, sum(m1 * m22) OVER "
    f"{win(-250, -1)} AS s122 FROM h",
    v.BARS_1D,
    "rd AS (SELECT *, greatest(high - low, 0) AS range FROM d)",
    HAR.split("), rd AS")[0] + ")",
    others="n_obs", floats="s5 s122",
)
def _(spark, d):
    own = fc.har_terms(fc.ranges(v.bars_1d(spark, d)))
    w = t.frame(-250, -1)
    return own.select("asset", "ts", F.count("m22").over(w).alias("n_obs"), F.sum(F.when(F.col("m22").isNotNull(), F.col("m5"))).over(w).alias("s5"), F.sum(F.col("m1") * F.col("m22")).over(w).alias("s122"))


@query("har_forecast", floats="har", others="n_obs")
def _(spark, d):
    # four digits: two ways to solve a system agree to about 1e-9 here, so that a sixth digit may round either way
    return fc.har(v.kept(fc.ranges(v.bars_1d(spark, d))), window=512).filter("har IS NOT NULL").withColumn("har", F.round("har", 4))


@query("har_walk_expanding", floats="har", others="n_obs")
def _(spark, d):
    return fc.har(v.kept(fc.ranges(v.bars_1d(spark, d))), positive=True).filter("har IS NOT NULL").withColumn("har", F.round("har", 4))


@query("har_coefficients", keys="asset coefficient", floats="mean deviation")
def _(spark, d):
    return reports.coefficient_drift(fc.har(v.kept(fc.ranges(v.bars_1d(spark, d))), window=512), ["b0", "b1", "b2", "b3"])


def _simple(spark: SparkSession, d: str) -> DataFrame:
    own = fc.ranges(v.bars_1d(spark, d)).withColumn("x", t.lag("range"))
    return ols.walk(own, "range", ["x"], 250, 24).filter("forecast IS NOT NULL").withColumn("slope", F.element_at("beta", 2)).withColumn("intercept", F.element_at("beta", 1))


@query(
    "ols_walk_one_term",
    f"SELECT asset, ts, n AS n_obs, slope, intercept, intercept + slope * x AS forecast FROM "
    f"(SELECT asset, ts, x, regr_count(range, x) OVER {win(-250, -1)} AS n, regr_slope(range, x) OVER {win(-250, -1)} AS slope, regr_intercept(range, x) "
    f"OVER {win(-250, -1)} AS intercept FROM (SELECT *, {lag('range')} AS x FROM (SELECT *, greatest(high - low, 0) AS range FROM d))) WHERE n >= 24",
    v.BARS_1D,
    floats="slope intercept forecast", others="n_obs",
)
def _(spark, d):
    return _simple(spark, d)


@query("har_rv_daily", floats="vol", others="n_obs")
def _(spark, d):
    rows = v.bars_1h(spark, d).filter("close > 0")
    return fc.har_rv(rows, 20, 5).filter("har IS NOT NULL")


@query(
    "bias_correction",
    "SELECT asset, CASE WHEN count(error) >= 24 THEN avg(error) END AS bias, count(error) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY asset) AS z "
    "FROM c) WHERE ts > z - 604800000 GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", floats="bias", others="n",
)
def _(spark, d):
    return fc.bias_correction(reports.completed(v.predictions(spark, d)), "error")


@query(
    "stop_distance",
    "SELECT asset, ts, CASE WHEN close = 0 OR predicted_range IS NULL THEN 0.05 ELSE greatest(0.005, least(0.2, 1.5 * predicted_range / close)) END AS "
    "stop FROM p JOIN b USING (asset, ts)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="stop",
)
def _(spark, d):
    rows = v.predictions(spark, d).join(v.bars_1h(spark, d).select("asset", "ts", "close"), ["asset", "ts"])
    return rows.withColumn("stop", fc.stop_distance(F.col("predicted_range"), F.col("close"), 1.5))


# Regimes and features ----------------------------------------------------------------------------


def quant(c: str, q: float, width: int, shift: int, least: int) -> str:
    w = win(-width - shift + 1, -shift)
    return f"CASE WHEN count({c}) OVER {w} >= {least} THEN quantile_cont({c}, {q}) OVER {w} END"


@query(
    "regime_terciles",
    f"SELECT asset, ts, CASE WHEN m IS NULL OR lo IS NULL THEN 'undefined' WHEN m < lo THEN 'low' WHEN m > hi THEN 'high' ELSE 'medium' END AS regime FROM "
    f"(SELECT asset, ts, m, {quant('m', 1 / 3, 491, 0, 2)} AS lo, {quant('m', 2 / 3, 491, 0, 2)} AS hi FROM "
    f"(SELECT asset, ts, {roll(MEAN, 'range', 22, 1)} AS m FROM r))",
    v.BARS_1H,
    v.RANGES,
    others="regime",
)
def _(spark, d):
    return fc.regime_of_means(fc.ranges(v.bars_1h(spark, d)))


@query(
    "regime_of_forecast",
    f"SELECT asset, ts, CASE WHEN m IS NULL OR lo IS NULL THEN 'unknown' WHEN m < lo THEN 'low' WHEN m > hi THEN 'high' ELSE 'medium' END AS regime FROM "
    f"(SELECT asset, ts, {roll(MEAN, 'range', 5, 1)} AS m, {quant('range', 1 / 3, 720, 1, 100)} AS lo, {quant('range', 2 / 3, 720, 1, 100)} AS hi FROM r)",
    v.BARS_1H,
    v.RANGES,
    others="regime",
)
def _(spark, d):
    own = fc.ranges(v.bars_1h(spark, d)).withColumn("f", t.mean("range", 5, 1))
    return fc.regime_of_forecast(own, "f")


@query(
    "regime_rolling_quantile",
    f"SELECT asset, ts, CASE WHEN lo IS NULL THEN 'unknown' WHEN range < lo THEN 'low' WHEN range > hi THEN 'high' ELSE 'medium' END AS regime FROM "
    f"(SELECT asset, ts, range, {quant('range', 1 / 3, 120, 0, 40)} AS lo, {quant('range', 2 / 3, 120, 0, 40)} AS hi FROM r)",
    v.BARS_1H,
    v.RANGES,
    others="regime",
)
def _(spark, d):
    return fc.regime_rolling(fc.ranges(v.bars_1h(spark, d)), "range", 120, 40)


LOGRET = f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END"


@query(
    "regime_zvol",
    f"SELECT asset, ts, (vv - mm) / nullif(ss, 0) AS vol_z, CASE WHEN vv IS NULL OR ss IS NULL OR ss = 0 THEN 'unknown' WHEN (vv - mm) / ss > 1 THEN 'high' "
    f"WHEN (vv - mm) / ss < -1 THEN 'low' ELSE 'normal' END AS vol_regime, CASE WHEN fa IS NULL OR sl IS NULL THEN 'unknown' "
    f"WHEN fa > sl THEN 'up' ELSE 'down' END AS trend_regime FROM (SELECT asset, ts, vv, {roll(MEAN, 'vv', 100)} AS mm, {roll(SD, 'vv', 100)} AS ss, "
    f"{roll(MEAN, 'close', 20)} AS fa, {roll(MEAN, 'close', 50)} AS sl FROM (SELECT asset, ts, close, {roll(SD, 'x', 20)} AS vv FROM "
    f"(SELECT *, {LOGRET} AS x FROM d)))",
    v.BARS_1D,
    floats="vol_z", others="vol_regime trend_regime",
)
def _(spark, d):
    return fc.regime_zvol(v.bars_1d(spark, d), 20, 100, 20, 50)


@query(
    "regime_distribution",
    "SELECT asset, regime, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY asset) AS pct FROM p GROUP BY asset, regime",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset regime", floats="pct", others="n",
)
def _(spark, d):
    return reports.regime_distribution(v.predictions(spark, d))


@query(
    "dominant_regime",
    "SELECT asset, arg_min(regime, (-n, regime)) AS regime FROM (SELECT asset, regime, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", others="regime",
)
def _(spark, d):
    return reports.dominant_regime(v.predictions(spark, d))


@query("regime_tracking", keys="asset", floats="spread", others="regimes monotone tracks")
def _(spark, d):
    return ev.regime_tracking(reports.completed(v.predictions(spark, d)), "predicted_range", "actual_range", ["asset"])


@query(
    "parkinson_vol",
    f"SELECT asset, ts, sqrt({roll(MEAN, 'pk', 22)}) AS vol FROM (SELECT *, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ** 2 / (4 * ln(2.0)) END AS "
    f"pk FROM d)",
    v.BARS_1D,
    floats="vol",
)
def _(spark, d):
    own = v.bars_1d(spark, d).withColumn("pk", s.parkinson(F.col("high"), F.col("low")))
    return own.withColumn("vol", F.sqrt(t.mean("pk", 22)))


@query("realized_vol", f"SELECT asset, ts, {roll(SD, 'x', 22)} AS vol FROM (SELECT *, {LOGRET} AS x FROM d)", v.BARS_1D, floats="vol")
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("x", ft.log_return()).withColumn("vol", t.std("x", 22))


@query(
    "daily_realized_variance",
    f"SELECT asset, ts // 86400000 * 86400000 AS ts, sum(x * x) AS rv, count(x) AS n FROM (SELECT *, {LOGRET} AS x FROM b) GROUP BY asset, b2(ts)".replace("b2(ts)", "ts // 86400000 * 86400000"),
    v.BARS_1H,
    floats="rv", others="n",
)
def _(spark, d):
    return fc.daily_realized(v.bars_1h(spark, d))


_NR = (
    f"nr AS (SELECT *, high - low AS range, (high - low) / nullif({lag('close')}, 0) AS nr, close / nullif({lag('close')}, 0) - 1 AS x, volume / "
    f"nullif({lag('volume')}, 0) - 1 AS dv, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ** 2 / (4 * ln(2.0)) END AS pk FROM d)"
)
_LC = lag("close")
_FEATURES = f"""SELECT asset, ts, {_LC} / nullif({lag('close', 2)}, 0) - 1 AS ret_1, {_LC} / nullif({lag('close', 6)}, 0) - 1 AS ret_5, ({_LC} / nullif({lag('close', 23)}, 0) - 1) ** 2 AS sq_ret_22, {lag('nr')} AS nr_1,
{roll(MEAN, 'nr', 5, 1, 1)} AS nr_mean_5, {roll(SD, 'nr', 22, 1, 2)} AS nr_std_22, {roll(MEAN, 'range', 22, 1, 1)} AS range_mean_22, {roll(SD, 'x', 22, 1, 2)} AS rv_22, sqrt({roll(MEAN, 'pk', 22, 1, 1)}) AS park_22, {lag('dv')} AS vol_ret,
({lag('volume')} - {roll(MEAN, 'volume', 22, 1, 2)}) / nullif({roll(SD, 'volume', 22, 1, 2)}, 0) AS vol_z22, ln(1 + {roll(MEAN, 'volume', 22, 1, 2)}) AS logvol_mean22, {_LC} / nullif({roll(MEAN, 'close', 22, 1, 1)}, 0) - 1 AS dist_ma22,
({_LC} - {roll('min({})', 'close', 22, 1, 1)}) / nullif({roll('max({})', 'close', 22, 1, 1)} - {roll('min({})', 'close', 22, 1, 1)}, 0) AS pos_range22, (isodow(make_timestamp(ts * 1000)) - 1)::BIGINT AS dow FROM nr"""


@query(
    "feature_matrix",
    _FEATURES,
    v.BARS_1D,
    _NR,
    floats="ret_1 ret_5 sq_ret_22 nr_1 nr_mean_5 nr_std_22 range_mean_22 rv_22 park_22 vol_ret vol_z22 logvol_mean22 dist_ma22 pos_range22", others="dow",
)
def _(spark, d):
    return ft.technical(v.bars_1d(spark, d))


@query(
    "cross_asset_features",
    f"SELECT t.asset, t.ts, x.nr AS other_nr, x.rv22 AS other_rv22, x.ret1 AS other_ret1, x.ts IS NOT NULL AS matched FROM b t LEFT JOIN "
    f"(SELECT asset, ts + 3600000 AS ts, nr, {roll(SD, 'x', 22)} AS rv22, x AS ret1 FROM "
    f"(SELECT *, greatest(high - low, 0) / nullif(close, 0) AS nr, {LOGRET} AS x FROM b)) x ON x.asset = 'view' AND x.ts = t.ts WHERE t.asset = 'click'",
    v.BARS_1H,
    floats="other_nr other_rv22 other_ret1", others="matched",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return ft.cross_asset(rows.filter("asset = 'click'"), rows.filter("asset = 'view'"))


# As-of joins ----------------------------------------------------------------------------------------


@query(
    "funding_asof_lag",
    f"SELECT asset, ts, {lag('rate')} AS rate FROM (SELECT b.asset, b.ts, f.rate FROM b ASOF LEFT JOIN f ON b.ts >= f.ts)",
    v.BARS_1H,
    v.FUNDING,
    floats="rate",
)
def _(spark, d):
    return aj.asof_lagged(v.bars_1h(spark, d), v.funding_by_asset(spark, d), "rate")


@query(
    "funding_24h_interval",
    "SELECT b.asset, b.ts, CASE WHEN b.ts - max(f.ts) <= 28800000 THEN avg(f.rate) END AS funding_24h, CASE "
    "WHEN b.ts - max(f.ts) <= 28800000 THEN avg(abs(f.rate)) END AS abs_funding_24h, count(f.rate) AS funding_24h_n FROM b LEFT "
    "JOIN f ON f.ts > b.ts - 86400000 AND f.ts <= b.ts GROUP BY b.asset, b.ts",
    v.BARS_1H,
    v.FUNDING,
    floats="funding_24h abs_funding_24h", others="funding_24h_n",
)
def _(spark, d):
    return aj.interval_mean(v.bars_1h(spark, d), v.funding_by_asset(spark, d), "rate", 86_400_000, 8 * HOUR_MS, name="funding_24h")


@query(
    "nearest_asof",
    "SELECT asset, ts, CASE WHEN fb IS NOT NULL AND (ff IS NULL OR ts - fb <= ff - ts) THEN CASE WHEN ts - fb <= 7200000 THEN rb END ELSE CASE "
    "WHEN ff - ts <= 7200000 THEN rf END END AS rate FROM (SELECT x.asset, x.ts, x.fb, x.rb, f.ts AS ff, f.rate AS rf FROM "
    "(SELECT b.asset, b.ts, f.ts AS fb, f.rate AS rb FROM b ASOF LEFT JOIN f ON b.ts >= f.ts) x ASOF LEFT JOIN f ON x.ts <= f.ts)",
    v.BARS_1H,
    v.FUNDING,
    floats="rate",
)
def _(spark, d):
    return aj.asof(v.bars_1h(spark, d), v.funding_by_asset(spark, d), ["rate"], direction="nearest", tolerance_ms=2 * HOUR_MS, span_ms=DAY_MS)


@query(
    "daily_to_hourly",
    "SELECT asset, ts, last_value(rv IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS rv FROM (SELECT b.asset, b.ts, v.rv "
    "FROM b LEFT JOIN (SELECT asset, day, max(high) AS rv FROM (SELECT asset, ts // 86400000 * 86400000 AS day, high FROM b) WHERE day % 172800000 = 0 "
    "GROUP BY 1, 2) v ON v.asset = b.asset AND v.day = b.ts // 86400000 * 86400000)",
    v.BARS_1H,
    floats="rv",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    daily = rows.groupBy("asset", s.bar_open(F.col("ts"), 86_400_000).alias("day")).agg(F.max("high").alias("rv")).filter("day % 172800000 = 0").withColumnRenamed("day", "ts")
    return b.daily_to_hourly(rows, daily, "rv")


@query(
    "live_over_history",
    "SELECT asset, ts, coalesce(l.x, h.x) AS x FROM (SELECT asset, ts, high AS x FROM b WHERE ts % 10800000 = 0) l FULL JOIN (SELECT asset, ts, low AS x "
    "FROM b WHERE ts % 7200000 = 0) h USING (asset, ts)",
    v.BARS_1H,
    floats="x",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return aj.coalesced(rows.filter("ts % 10800000 = 0").withColumn("x", F.col("high")), rows.filter("ts % 7200000 = 0").withColumn("x", F.col("low")), "x", ["asset", "ts"])


@query(
    "pair_spread",
    f"SELECT ts, spread, (spread - {roll(MEAN, 'spread', 20, 0, 10)}) / nullif({roll(SD, 'spread', 20, 0, 10)}, 0) AS spread_z FROM "
    f"(SELECT 'A' AS asset, a.ts, CASE WHEN a.close > 0 AND r.close > 0 THEN ln(a.close / r.close) END AS spread FROM d a "
    f"JOIN d r ON a.asset = 'A' AND r.asset = 'R' AND a.ts = r.ts)",
    v.BARS_1D,
    keys="ts", floats="spread spread_z",
)
def _(spark, d):
    return sg.spread_z(sg.pair(v.bars_1d(spark, d), "A", "R"), "a_close", "b_close", 20)


@query(
    "hedge_ratio",
    f"SELECT ts, CASE WHEN count(ac * rc) OVER {win(-60, -1)} >= 60 THEN covar_samp(ac, rc) OVER {win(-60, -1)} / nullif(var_samp(rc) OVER {win(-60, -1)}, "
    f"0) END AS beta FROM (SELECT 'A' AS asset, a.ts, a.close AS ac, r.close AS rc FROM d a JOIN d r ON a.asset = 'A' AND r.asset = 'R' AND a.ts = r.ts)",
    v.BARS_1D,
    keys="ts", floats="beta",
)
def _(spark, d):
    return sg.pair(v.bars_1d(spark, d), "A", "R").withColumn("beta", ols.hedge_ratio(None, "a_close", "b_close", 60))


# Reports --------------------------------------------------------------------------------------------


@query(
    "breakout_severity",
    "SELECT asset, ts, round(actual_range / predicted_range, 2) AS ratio, CASE WHEN actual_range / predicted_range >= 5 THEN 'extreme' "
    "WHEN actual_range / predicted_range >= 3 THEN 'severe' ELSE 'moderate' END AS severity FROM c "
    "WHERE predicted_range > 0 AND actual_range >= 2 * predicted_range",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="ratio", others="severity",
)
def _(spark, d):
    return reports.breakouts(v.predictions(spark, d))


@query(
    "breakout_top",
    "SELECT * FROM (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS place FROM c "
    "WHERE predicted_range > 0 AND actual_range >= 2 * predicted_range) WHERE place <= 5",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    others="place",
)
def _(spark, d):
    return reports.top_breakouts(v.predictions(spark, d), 5)


@query("newest_predictions", "SELECT * FROM p ORDER BY ts DESC, asset LIMIT 50", v.BARS_1H, v.RANGES, v.PREDICTIONS, floats="predicted_range")
def _(spark, d):
    return reports.newest(v.predictions(spark, d), 50)


@query(
    "calibration_summary",
    f"SELECT asset, n, breakouts, CASE WHEN n >= 24 THEN mae END AS mae, CASE WHEN n >= 24 THEN bias END AS bias, CASE "
    f"WHEN n >= 24 THEN persistence_mae END AS persistence_mae, CASE WHEN n >= 24 THEN (persistence_mae - mae) / persistence_mae * 100 END AS "
    f"improvement_pct FROM (SELECT asset, count(*) AS n, avg(abs_error) AS mae, avg(error) AS bias, avg(abs(actual_range - prev)) AS persistence_mae, "
    f"count(*) FILTER (actual_range > 2 * predicted_range) AS breakouts FROM (SELECT *, {lag('predicted_range')} AS prev FROM (SELECT * FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM c) WHERE k <= 720)) GROUP BY asset)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", floats="mae bias persistence_mae improvement_pct", others="n breakouts",
)
def _(spark, d):
    return reports.calibration(v.predictions(spark, d))


@query(
    "live_calibration",
    "SELECT *, coalesce(mae_short > 1.5 * mae, false) AS degrading FROM (SELECT asset, count(*) AS n, avg(abs_error) AS mae, CASE "
    "WHEN count(*) >= 24 THEN avg(abs_error) FILTER (k <= 168) END AS mae_short, CASE "
    "WHEN count(*) >= 24 THEN avg(abs_error) FILTER (k <= 720) END AS mae_long, max(actual_range / predicted_range) FILTER (predicted_range > 0) AS "
    "worst_ratio FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM c) GROUP BY asset)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", floats="mae mae_short mae_long worst_ratio", others="n degrading",
)
def _(spark, d):
    return reports.live_calibration(v.predictions(spark, d))


DAILY = (
    f"dm AS (SELECT asset, ts // 86400000 * 86400000 AS day, count(*) AS n, avg(abs_error) AS mae, avg(abs(actual_range - prev)) AS persistence_mae FROM "
    f"(SELECT *, {lag('predicted_range')} AS prev FROM c) GROUP BY 1, 2)"
)


@query("daily_mae", "SELECT * FROM dm", v.BARS_1H, v.RANGES, v.PREDICTIONS, DAILY, keys="asset day", floats="mae persistence_mae", others="n")
def _(spark, d):
    return reports.daily_mae(v.predictions(spark, d))


@query(
    "improvement_band",
    f"SELECT asset, day, CASE WHEN k >= 2 THEN m END AS improvement, CASE WHEN k >= 2 THEN m - 1.96 * sd / sqrt(k) END AS low, CASE "
    f"WHEN k >= 2 THEN m + 1.96 * sd / sqrt(k) END AS high FROM (SELECT asset, day, count(i) OVER {win(-6, 0, at='day')} AS k, avg(i) OVER "
    f"{win(-6, 0, at='day')} AS m, stddev_samp(i) OVER {win(-6, 0, at='day')} AS sd FROM (SELECT *, persistence_mae - mae AS i FROM dm))",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    DAILY,
    keys="asset day", floats="improvement low high",
)
def _(spark, d):
    return reports.improvement_band(reports.daily_mae(v.predictions(spark, d)))


@query(
    "day_extremes",
    "SELECT asset, count(*) AS days, arg_min(day, (mae, day)) AS best_day, min(mae) AS best_mae, arg_max(day, (mae, day)) AS worst_day, max(mae) AS "
    "worst_mae FROM dm GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    DAILY,
    keys="asset", floats="best_mae worst_mae", others="days best_day worst_day",
)
def _(spark, d):
    return reports.day_extremes(v.predictions(spark, d))


@query(
    "weekly_stats",
    f"SELECT asset, count(*) AS n, avg(abs_error) AS mae, avg(error) AS bias, sum(error) FILTER (error > 0) / sum(-error) FILTER (error < 0) AS "
    f"profit_factor, avg((abs_error < abs(actual_range - prev))::INT) AS win_share FROM (SELECT *, {lag('predicted_range')} AS prev FROM (SELECT * FROM c "
    f"WHERE ts >= {NOW} - 604800000 AND ts < {NOW})) GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", floats="mae bias profit_factor win_share", others="n",
)
def _(spark, d):
    return reports.weekly(v.predictions(spark, d), NOW)


@query(
    "weeks_beating",
    "SELECT asset, chunk, count(*) AS n, avg(abs_error) AS mae, avg(abs(actual_range - prev)) AS persistence_mae, avg(abs_error) < avg(abs(actual_range - "
    "prev)) AS beats FROM (SELECT *, lag(predicted_range) OVER (PARTITION BY asset, chunk ORDER BY ts) AS prev FROM "
    "(SELECT *, (row_number() OVER (PARTITION BY asset ORDER BY ts) - 1) // 168 AS chunk FROM c)) GROUP BY 1, 2 HAVING count(*) >= 24",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset chunk", floats="mae persistence_mae", others="n beats",
)
def _(spark, d):
    return reports.weeks_beating(v.predictions(spark, d))


@query(
    "accuracy_series",
    f"SELECT asset, ts // 86400000 * 86400000 AS day, avg(greatest(-1, least(1, 1 - abs_error / actual_range)) - CASE "
    f"WHEN prev IS NOT NULL THEN greatest(-1, least(1, 1 - abs(actual_range - prev) / actual_range)) END) AS accuracy_gain FROM "
    f"(SELECT *, {lag('predicted_range')} AS prev FROM c) GROUP BY 1, 2",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset day", floats="accuracy_gain",
)
def _(spark, d):
    own = reports.completed(v.predictions(spark, d)).withColumn("prev", t.lag("predicted_range"))
    gain = s.accuracy(F.col("abs_error"), F.col("actual_range")) - F.when(F.col("prev").isNotNull(), s.accuracy(F.abs(F.col("actual_range") - F.col("prev")), F.col("actual_range")))
    return own.groupBy("asset", s.bar_open(F.col("ts"), 86_400_000).alias("day")).agg(F.avg(gain).alias("accuracy_gain"))


@query(
    "error_histogram",
    "SELECT asset, least(29, floor(coalesce((error - a) * 30 / nullif(z - a, 0), 0)))::BIGINT AS bin, count(*) AS n FROM "
    "(SELECT asset, error, min(error) OVER (PARTITION BY asset) AS a, max(error) OVER (PARTITION BY asset) AS z FROM c) GROUP BY 1, 2",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset bin", others="n",
)
def _(spark, d):
    return reports.error_histogram(v.predictions(spark, d))


@query(
    "prediction_status",
    "SELECT asset, count(actual_range) AS completed, count(*) - count(actual_range) AS pending, max(ts) FILTER (actual_range IS NOT NULL) AS "
    "last_completed, max(ts) FILTER (actual_range IS NULL) AS last_pending FROM p GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", others="completed pending last_completed last_pending",
)
def _(spark, d):
    return reports.status(v.predictions(spark, d))


@query(
    "latest_prediction",
    f"SELECT asset, max(ts) AS ts, arg_max(predicted_range, ts) AS predicted_range, ({NOW} - max(ts)) / 3600000.0 AS age_hours, CASE "
    f"WHEN ({NOW} - max(ts)) / 3600000.0 > 2 THEN 'unknown' ELSE arg_max(regime, ts) END AS regime FROM p WHERE ts <= {NOW} GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="predicted_range age_hours", others="regime",
)
def _(spark, d):
    return reports.latest_each(v.predictions(spark, d).filter(F.col("ts") <= NOW), NOW)


@query(
    "calibration_day",
    f"SELECT asset, floor(({NOW} - min(ts)) / 86400000.0)::BIGINT + 1 AS day FROM p GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", others="day",
)
def _(spark, d):
    return gates.progress(v.predictions(spark, d), NOW)


@query(
    "funding_stats",
    "SELECT 'signup' AS asset, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, quantile_cont(rate, 0.05) AS p5, quantile_cont(rate, 0.5) AS p50, "
    "quantile_cont(rate, 0.95) AS p95 FROM f",
    v.FUNDING,
    keys="asset", floats="p5 p50 p95", others="n first_ts last_ts",
)
def _(spark, d):
    return reports.funding_stats(v.funding(spark, d).withColumn("asset", F.lit("signup")))


@query(
    "strategy_table",
    "SELECT 'mae' AS metric, avg(abs(prev - actual)) AS prev, avg(abs(mean5 - actual)) AS mean5 FROM m WHERE mean5 IS NOT NULL",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="metric", floats="prev mean5",
)
def _(spark, d):
    rows = _long(spark, d).filter("model <> 'mean22'").join(_models(spark, d).filter("mean5 IS NOT NULL").select("asset", "ts"), ["asset", "ts"])
    return reports.strategy_table(rows.groupBy("model").agg(F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae")), "model", ["mae"], ["prev", "mean5"])


# Patterns and signals ---------------------------------------------------------------------------------


def _lags(n: int) -> str:
    return ", ".join(f"{lag(c, k)} AS {c[0]}{k}" for c in ("high", "low") for k in range(1, n + 1))


MOM = (
    f"mo AS (SELECT asset, ts, close, CASE WHEN high > h1 AND low > l1 AND h1 > h2 AND l1 > l2 AND h2 > h3 AND l2 > l3 THEN 1 "
    f"WHEN high < h1 AND low < l1 AND h1 < h2 AND l1 < l2 AND h2 < h3 AND l2 < l3 THEN -1 ELSE 0 END AS raw FROM (SELECT *, {_lags(3)} FROM b)), ms AS "
    f"(SELECT asset, ts, close, coalesce({lag('raw')}, 0) AS signal FROM mo)"
)


def _momentum(spark: SparkSession, d: str) -> DataFrame:
    return v.bars_1h(spark, d).withColumn("_m", sg.momentum()).withColumn("signal", sg.shift(F.col("_m")))


@query("pattern_momentum", "SELECT * FROM ms WHERE signal <> 0", v.BARS_1H, MOM, others="signal")
def _(spark, d):
    return _momentum(spark, d).filter("signal <> 0")


@query("pattern_fade", "SELECT asset, ts, -signal AS signal FROM ms WHERE signal <> 0", v.BARS_1H, MOM, others="signal")
def _(spark, d):
    return v.bars_1h(spark, d).withColumn("_m", sg.fade()).withColumn("signal", sg.shift(F.col("_m"))).filter("signal <> 0")


@query(
    "pattern_engulfing",
    f"SELECT asset, ts, CASE WHEN pc < po AND close > open AND open <= pc AND close >= po AND (open < pc OR close > po) THEN 1 "
    f"WHEN pc > po AND close < open AND open >= pc AND close <= po AND (open > pc OR close < po) THEN -1 ELSE 0 END AS signal FROM "
    f"(SELECT *, {lag('open')} AS po, {lag('close')} AS pc FROM b)",
    v.BARS_1H,
    others="signal",
)
def _(spark, d):
    return v.bars_1h(spark, d).withColumn("signal", sg.engulfing())


@query(
    "pattern_doji_hammer",
    "SELECT asset, ts, coalesce(abs(close - open) / nullif(high - low, 0) < 0.1, false)::BIGINT AS doji, (abs(close - open) > 0 AND high > low AND "
    "least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < 0.5 * abs(close - open) AND least(open, close) >= low + 0.7 * "
    "(high - low))::BIGINT AS hammer FROM b",
    v.BARS_1H,
    others="doji hammer",
)
def _(spark, d):
    return v.bars_1h(spark, d).withColumn("doji", sg.doji()).withColumn("hammer", sg.hammer())


@query(
    "volume_spike",
    f"SELECT asset, ts, volume / nullif(m, 0) AS ratio, CASE WHEN volume / nullif(m, 0) > 1.5 THEN sign(close - open) ELSE 0 END::BIGINT AS signal FROM "
    f"(SELECT *, {roll(MEAN, 'volume', 20)} AS m FROM b)",
    v.BARS_1H,
    floats="ratio", others="signal",
)
def _(spark, d):
    return v.bars_1h(spark, d).withColumn("ratio", sg.volume_ratio()).withColumn("signal", sg.volume_spike(times=1.5))


BIAS = (
    f"hb AS (SELECT asset, x.slot, avg(ret) AS mean_return, avg((ret > 0)::INT) AS win_rate, count(ret) AS n FROM (SELECT DISTINCT asset FROM b) CROSS JOIN "
    f"(SELECT unnest(range(24)) AS slot) x LEFT JOIN (SELECT asset, hour(make_timestamp(ts * 1000)) AS slot, CASE "
    f"WHEN {lag('close')} <> 0 THEN close / {lag('close')} - 1 END AS ret FROM b) y USING (asset, slot) GROUP BY 1, 2)"
)


@query("hourly_bias", "SELECT * FROM hb", v.BARS_1H, BIAS, keys="asset slot", floats="mean_return win_rate", others="n")
def _(spark, d):
    return sg.hour_bias(v.bars_1h(spark, d))


@query(
    "daily_bias",
    f"SELECT asset, x.slot, avg(ret) AS mean_return, avg((ret > 0)::INT) AS win_rate, count(ret) AS n FROM (SELECT DISTINCT asset FROM d) CROSS JOIN "
    f"(SELECT unnest(range(7)) AS slot) x LEFT JOIN (SELECT asset, isodow(make_timestamp(ts * 1000)) - 1 AS slot, close / nullif({lag('close')}, 0) - 1 AS "
    f"ret FROM d) y USING (asset, slot) GROUP BY 1, 2",
    v.BARS_1D,
    keys="asset slot", floats="mean_return win_rate", others="n",
)
def _(spark, d):
    return sg.hour_bias(v.bars_1d(spark, d), "weekday")


@query(
    "best_hours",
    f"SELECT * FROM (SELECT asset, slot, win_rate, n, row_number() OVER (PARTITION BY asset ORDER BY win_rate DESC, slot) AS place FROM "
    f"(SELECT asset, slot, avg((ret > 0)::INT) AS win_rate, count(ret) AS n FROM (SELECT asset, hour(make_timestamp(ts * 1000)) AS slot, close / "
    f"nullif({lag('close')}, 0) - 1 AS ret FROM (SELECT * FROM (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY asset) AS k FROM b) "
    f"WHERE i <= floor(k * 0.6))) WHERE ret IS NOT NULL GROUP BY 1, 2) WHERE n > 5 AND win_rate > 0.5)",
    v.BARS_1H,
    keys="asset slot", floats="win_rate", others="n place",
)
def _(spark, d):
    return sg.best_hours(v.bars_1h(spark, d), 0.5, 5)


FWD = (
    f"fw AS (SELECT asset, ts, signal, r AS forward_return, (sign(r) = signal)::BIGINT AS correct FROM "
    f"(SELECT *, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS r FROM ms) WHERE signal <> 0 AND r IS NOT NULL)"
)


@query("forward_returns", "SELECT * FROM fw", v.BARS_1H, MOM, FWD, floats="forward_return", others="signal correct")
def _(spark, d):
    return sg.forward_returns(_momentum(spark, d), "signal")


@query(
    "hit_rates",
    "SELECT asset, signal, count(*) AS n, avg(correct) AS hit_rate, avg(forward_return) AS mean_return FROM fw "
    "GROUP BY GROUPING SETS ((), (asset), (signal))",
    v.BARS_1H,
    MOM,
    FWD,
    keys="asset signal", floats="hit_rate mean_return", others="n",
)
def _(spark, d):
    return ev.hit_rates(sg.forward_returns(_momentum(spark, d), "signal"))


@query(
    "donchian_signals",
    f"SELECT asset, ts, CASE WHEN close > {roll('max({})', 'high', 20, 1)} THEN 1 WHEN close < {roll('min({})', 'low', 20, 1)} THEN -1 ELSE 0 END AS signal "
    f"FROM d",
    v.BARS_1D,
    others="signal",
)
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("signal", sg.donchian())


@query(
    "breakout_entries",
    f"SELECT asset, ts, coalesce(high - low > 1.2 * m, false) AS entry, coalesce(close < lo, false) AS exit FROM "
    f"(SELECT *, avg(high - low) OVER {win(-19)} AS m0, CASE WHEN count(*) OVER {win(-19)} >= 20 THEN avg(high - low) OVER {win(-19)} END AS m, "
    f"{roll('min({})', 'close', 10, 1)} AS lo FROM d)",
    v.BARS_1D,
    others="entry exit",
)
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("entry", sg.breakout_entry(times=1.2)).withColumn("exit", sg.channel_exit())


@query(
    "sma_cross",
    f"SELECT asset, ts, CASE WHEN f > s AND NOT was THEN 1 WHEN NOT (f > s) AND was THEN -1 ELSE 0 END AS signal FROM "
    f"(SELECT *, lag(f > s) OVER ({W}) AS was FROM (SELECT *, {roll(MEAN, 'close', 10)} AS f, {roll(MEAN, 'close', 30)} AS s FROM d))",
    v.BARS_1D,
    others="signal",
)
def _(spark, d):
    return sg.sma_cross(v.bars_1d(spark, d)).withColumnRenamed("cross", "signal")


@query("zscore_reversion", f"SELECT asset, ts, (close - {roll(MEAN, 'close', 20)}) / nullif({roll(SD, 'close', 20)}, 0) AS z FROM d", v.BARS_1D, floats="z")
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("z", sg.zscore("close", 20))


@query(
    "rsi",
    f"SELECT asset, ts, CASE WHEN n < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM "
    f"(SELECT asset, ts, count(x) OVER {win(-13)} AS n, avg(greatest(x, 0)) OVER {win(-13)} AS g, avg(greatest(-x, 0)) OVER {win(-13)} AS l FROM "
    f"(SELECT *, close - {lag('close')} AS x FROM d))",
    v.BARS_1D,
    floats="rsi",
)
def _(spark, d):
    return sg.rsi(v.bars_1d(spark, d))


@query(
    "roc_momentum",
    f"SELECT asset, ts, close / nullif({lag('close', 10)}, 0) - 1 AS roc, close / nullif({lag('close', 10)}, 0) - {lag('close', 10)} / "
    f"nullif({lag('close', 20)}, 0) AS acceleration FROM d",
    v.BARS_1D,
    floats="roc acceleration",
)
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("roc", sg.roc()).withColumn("acceleration", sg.acceleration())


@query(
    "atr",
    f"SELECT asset, ts, {roll(MEAN, 'tr', 14, 0, 2)} AS atr FROM (SELECT asset, ts, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM "
    f"(SELECT *, {lag('close')} AS pc FROM d))",
    v.BARS_1D,
    floats="atr",
)
def _(spark, d):
    return sg.atr(v.bars_1d(spark, d))


@query(
    "bollinger",
    f"SELECT asset, ts, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, coalesce(close < m - 2 * s, false) AS entry FROM "
    f"(SELECT *, {roll(MEAN, 'close', 20)} AS m, {roll(SDP, 'close', 20)} AS s FROM d)",
    v.BARS_1D,
    floats="bb_mid bb_upper bb_lower", others="entry",
)
def _(spark, d):
    return sg.band_signals(v.bars_1d(spark, d))


@query(
    "vol_sizing",
    f"SELECT asset, ts, CASE WHEN s IS NOT NULL AND s <> 0 THEN greatest(0.1, least(1.0, 0.2 / s)) END AS size FROM "
    f"(SELECT asset, ts, {roll(SD, 'ret', 24)} AS s FROM ra)",
    v.BARS_1D,
    RET,
    floats="size",
)
def _(spark, d):
    return _daily_returns(spark, d).withColumn("size", sg.size_inverse_vol(0.2))


@query("look_ahead_check", "SELECT asset, ts FROM b WHERE false", v.BARS_1H)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return sg.look_ahead_rows(rows, lambda x: x.withColumn("_m", sg.momentum()).withColumn("signal", sg.shift(F.col("_m"))), NOW, ["signal"])


# Simulation -------------------------------------------------------------------------------------------

EQUITY = (
    f"pos AS (SELECT asset, ts, close, CASE WHEN {roll(MEAN, 'close', 10)} > {roll(MEAN, 'close', 30)} THEN 1 ELSE 0 END AS position FROM d), eq AS "
    f"(SELECT *, exp(sum(ln(greatest(1 + ret, 1e-12))) OVER {win('UNBOUNDED PRECEDING')}) AS equity FROM "
    f"(SELECT *, coalesce({lag('position')}, 0) * coalesce(close / nullif({lag('close')}, 0) - 1, 0) - 0.001 * abs(position - coalesce({lag('position')}, "
    f"0)) AS ret FROM pos)), dd AS (SELECT *, equity / max(equity) OVER {win('UNBOUNDED PRECEDING')} - 1 AS drawdown FROM eq)"
)


def _trend(spark: SparkSession, d: str) -> DataFrame:
    return v.bars_1d(spark, d).withColumn("position", F.when(t.mean("close", 10) > t.mean("close", 30), 1).otherwise(0))


@query("drawdown", "SELECT * FROM dd", v.BARS_1D, EQUITY, floats="ret equity drawdown")
def _(spark, d):
    return sim.drawdown(sim.equity(_trend(spark, d)))


@query(
    "equity_metrics",
    "SELECT asset, count(*) AS n, arg_max(equity, ts) - 1 AS total_return, min(drawdown) AS max_drawdown, count(*) FILTER (ret > 0) / nullif(count(*) "
    "FILTER (ret <> 0), 0) AS win_rate, sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0) AS profit_factor, avg(ret) / nullif(stddev_pop(ret), 0) AS "
    "sharpe FROM dd GROUP BY asset",
    v.BARS_1D,
    EQUITY,
    keys="asset", floats="total_return max_drawdown win_rate profit_factor sharpe", others="n",
)
def _(spark, d):
    return sim.equity_metrics(sim.equity(_trend(spark, d)))


TRADES = (
    f"run AS (SELECT *, sum((position <> pp)::INT) OVER {win('UNBOUNDED PRECEDING')} AS trade FROM "
    f"(SELECT *, coalesce({lag('position')}, 0) AS pp, lead(ts) OVER ({W}) AS nt, lead(close) OVER ({W}) AS nc FROM pos)), tr AS (SELECT * FROM "
    f"(SELECT asset, trade, min(ts) AS entry_ts, arg_max(nt, ts) AS xt, arg_min(close, ts) AS entry_price, arg_max(nc, ts) AS exit_price, max(ts) AS "
    f"last_ts, count(*) AS bars FROM run WHERE position <> 0 GROUP BY 1, 2) q WHERE last_ts < (SELECT max(p.ts) FROM pos p WHERE p.asset = q.asset)), tp AS "
    f"(SELECT *, exit_price / entry_price - 1 - 0.002 AS pnl FROM tr WHERE exit_price IS NOT NULL)"
)


@query(
    "trades",
    "SELECT asset, entry_ts, xt AS exit_ts, bars, entry_price, exit_price, pnl FROM tp",
    v.BARS_1D,
    EQUITY,
    TRADES,
    keys="asset entry_ts exit_ts", floats="entry_price exit_price pnl", others="bars",
)
def _(spark, d):
    return sim.trades(_trend(spark, d))


@query(
    "trade_metrics",
    "SELECT asset, count(*) AS n, avg(pnl) AS mean_pnl, avg((pnl > 0)::INT) AS win_rate, sum(pnl) FILTER (pnl > 0) / sum(-pnl) FILTER (pnl < 0) AS "
    "profit_factor, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS t_stat FROM tp GROUP BY asset",
    v.BARS_1D,
    EQUITY,
    TRADES,
    keys="asset", floats="mean_pnl win_rate profit_factor t_stat", others="n",
)
def _(spark, d):
    return sim.trade_metrics(sim.trades(_trend(spark, d)))


@query(
    "concentration_topk",
    "SELECT asset, sum(pnl) AS total, sum(pnl) FILTER (k <= 1) AS top1, sum(pnl) FILTER (k <= 5) AS top5, sum(pnl) FILTER (k <= 10) AS top10, count(*) AS "
    "n FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY pnl DESC, entry_ts) AS k FROM tp) GROUP BY asset",
    v.BARS_1D,
    EQUITY,
    TRADES,
    keys="asset", floats="total top1 top5 top10", others="n",
)
def _(spark, d):
    return sim.concentration(sim.trades(_trend(spark, d)))


@query(
    "regime_returns",
    "SELECT asset, 'position' AS kind, position::VARCHAR AS label, count(*) AS n, sum(ret) AS total_return, avg(ret) / nullif(stddev_pop(ret), 0) * "
    "sqrt(365) AS sharpe FROM eq GROUP BY asset, position",
    v.BARS_1D,
    EQUITY,
    keys="asset kind label", floats="total_return sharpe", others="n",
)
def _(spark, d):
    rows = sim.equity(_trend(spark, d)).withColumn("position", F.col("position").cast("string"))
    return sim.regime_returns(rows, ["position"], 365.0)


@query("sequentialized_trades", keys="asset entry_ts", floats="pnl", others="direction bars")
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("z", sg.zscore("close", 20))
    flags = {"long_entry": F.col("z") < -1.5, "long_exit": F.col("z") > 0, "short_entry": F.col("z") > 1.5, "short_exit": F.col("z") < 0}
    return sim.trades(sim.sequentialize(rows.withColumns({k: t.true(c) for k, c in flags.items()}), 20))


@query("sim_long_flat", floats="units cash value")
def _(spark, d):
    return sim.all_in(sg.band_signals(v.bars_1d(spark, d)).select("asset", "ts", "close", "entry", "exit"))


@query("sim_two_leg", keys="entry_ts exit_ts", floats="pnl")
def _(spark, d):
    rows = sg.spread_z(sg.pair(v.bars_1d(spark, d), "A", "R"), "a_close", "b_close", 20)
    return sim.two_leg(rows.withColumns({"entry": t.true(F.col("spread_z") < -1), "exit": t.true(F.col("spread_z") > 0)}))


@query("sim_rebalanced", keys="ts", floats="equity weight")
def _(spark, d):
    smooth = v.bars_1d(spark, d).withColumn("close", t.mean("close", 50)).dropna(subset=["close"])
    return sim.rebalanced(sg.pair(smooth, "A", "R"), 0.02)


@query("stop_sweep", keys="asset multiplier", floats="mean_pnl win_rate profit_factor", others="n")
def _(spark, d):
    rows = fc.ranges(v.bars_1d(spark, d)).withColumns({"entry": sg.breakout_entry(times=1.1), "exit": sg.channel_exit(), "m5": t.mean("range", 5, 1)})
    return lab.stop_sweep(rows, [0, 0.5, 1, 1.5, 2, 3], "m5")


@query("lab_funnel", keys="genome_id asset", floats="sharpe total_return oos_sharpe", others="failed_at n_trades")
def _(spark, d):
    genomes, bars = lab.sample(24, 3), v.kept(v.bars_1d(spark, d))
    metrics, tr, pos = lab.screen(bars, lab.table(spark, genomes))
    return lab.funnel(metrics, tr, pos, lab.stability(bars, genomes, metrics))


@query("lab_stability", keys="genome_id asset", floats="stability_score")
def _(spark, d):
    genomes, bars = lab.sample(24, 3), v.kept(v.bars_1d(spark, d))
    return lab.stability(bars, genomes, lab.screen(bars, lab.table(spark, genomes))[0])


_HELD = "coalesce(lag(position) OVER (PARTITION BY asset ORDER BY ts), 0)"
_CURVE = (
    EQUITY.split(", eq AS (")[0]
    + f", moves AS (SELECT asset, ts, {_HELD} * coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS gross, abs(position - {_HELD}) AS traded FROM pos), "
    + f"eq AS (SELECT asset, ts, cost, exp(sum(ln(greatest(1 + gross - cost * traded, 1e-12))) OVER {win('UNBOUNDED PRECEDING', by='asset, cost')}) AS equity FROM moves CROSS JOIN (VALUES (0.0005), (0.002), (0.01)) AS t(cost))"
)


@query(
    "cost_curve",
    "SELECT asset, cost, arg_max(equity, ts) - 1 AS total_return FROM eq GROUP BY asset, cost",
    v.BARS_1D,
    _CURVE,
    keys="asset", floats="cost total_return",
)
def _(spark, d):
    return lab.cost_curve(_trend(spark, d), (0.0005, 0.002, 0.01), ("asset",))


@query("paper_broker", floats="cash value pnl", others="action")
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("signal", F.signum(sg.zscore("close", 20)).cast("int")).withColumn("quantity", F.lit(0.0005))
    return sim.paper_broker(rows)


@query("stop_with_roi", keys="asset entry_ts", floats="pnl", others="exit_ts reason")
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumns({"entry": sg.breakout_entry(times=1.1), "exit": sg.channel_exit(), "stop": F.lit(0.2)})
    return sim.stopped(rows, roi={0: 0.5, 3: 0.2, 10: 0.05})


@query(
    "target_metrics",
    f"SELECT asset, count(*) AS n, avg(abs(prev / sc - ret / sc)) AS mae, sqrt(avg((prev / sc - ret / sc) ** 2)) AS rmse, corr(prev / sc, ret / sc) AS "
    f"correlation FROM (SELECT *, {roll(SDP, 'ret', 20, 1)} AS sc FROM rp) WHERE ret IS NOT NULL AND prev IS NOT NULL AND sc > 1e-12 GROUP BY asset",
    v.BARS_1D,
    RET,
    keys="asset", floats="mae rmse correlation", others="n",
)
def _(spark, d):
    rows = _daily_returns(spark, d).withColumn("vol", t.std_pop("ret", 20, 1))
    return ev.target_metrics(rows, "ret", "prev", ["asset"], "vol")


@query("context_predictor", f"SELECT asset, ts, {roll(MEAN, 'close', 8, 1)} AS predicted FROM d", v.BARS_1D, floats="predicted")
def _(spark, d):
    return ev.predict_with(v.bars_1d(spark, d), ["close"], 8, lambda x: x[:, :, 0].mean(1))


@query("walk_model", floats="forecast")
def _(spark, d):
    import numpy as np

    def nearest(x, y):
        scale = x.std(0) + 1e-12
        return lambda q: np.array([y[np.argsort((((x - r) / scale) ** 2).sum(1), kind="stable")[:25]].mean() for r in q])

    own = fc.har_terms(fc.ranges(v.bars_1d(spark, d)))
    return ols.walk_model(own, ["m1", "m5", "m22"], "range", nearest, 200, 500).filter("forecast IS NOT NULL")


@query(
    "risk_checks",
    "SELECT asset, ts, CASE WHEN side = 'HOLD' THEN 'HOLD' WHEN drawdown >= 0.2 THEN 'MAX_DRAWDOWN' "
    "WHEN ret <= -0.05 THEN 'MAX_DAILY_LOSS' ELSE 'APPROVED' END AS reason FROM (SELECT asset, ts, ret, CASE "
    "WHEN ret > 0 THEN 'LONG' ELSE 'HOLD' END AS side, 0.1 AS drawdown FROM ra WHERE ret IS NOT NULL)",
    v.BARS_1D,
    RET,
    others="reason",
)
def _(spark, d):
    rows = _daily_returns(spark, d).filter("ret IS NOT NULL").withColumns({"side": F.when(F.col("ret") > 0, "LONG").otherwise("HOLD"), "equity": F.lit(1.0), "exposure": F.lit(0.0), "drawdown": F.lit(0.1), "daily_pnl": F.col("ret"), "open_positions": F.lit(0), "last_ts": F.lit(None).cast("long")})
    return gates.risk_checks(rows)


@query("sweep_gates", keys="asset multiplier", others="G1 G2 G3 G4 G5 G6 passed verdict")
def _(spark, d):
    rows = fc.ranges(v.bars_1d(spark, d)).withColumns({"entry": sg.breakout_entry(times=1.1), "exit": sg.channel_exit(), "m5": t.mean("range", 5, 1)})
    sweep = lab.stop_sweep(rows, [0, 0.5, 1, 1.5, 2, 3], "m5")
    return gates.sweep_gates(sweep, lab.best_multiplier(sweep))


# Statistics ---------------------------------------------------------------------------------------------


@query(
    "dm_coin_flip",
    "SELECT asset, n, m + 0.5 AS hit_rate, CASE WHEN vr > 1e-18 THEN m / sqrt(vr) WHEN m > 0 THEN 'inf'::DOUBLE "
    "WHEN m < 0 THEN '-inf'::DOUBLE ELSE 0 END AS dm FROM (SELECT asset, n, m, (g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / n / n AS vr FROM "
    "(SELECT asset, count(*) AS n, any_value(mu) AS m, sum(z * z) AS g0, coalesce(sum(z * l1), 0) AS g1, coalesce(sum(z * l2), 0) AS g2, coalesce(sum(z * "
    "l3), 0) AS g3 FROM (SELECT *, lag(z, 1) OVER w AS l1, lag(z, 2) OVER w AS l2, lag(z, 3) OVER w AS l3 FROM (SELECT *, x - mu AS z FROM "
    "(SELECT asset, ts, correct - 0.5 AS x, avg(correct - 0.5) OVER (PARTITION BY asset) AS mu FROM fw)) WINDOW w AS (PARTITION BY asset ORDER BY ts)) "
    "GROUP BY asset))",
    v.BARS_1H,
    MOM,
    FWD,
    keys="asset", floats="hit_rate dm", others="n",
)
def _(spark, d):
    return stats.coin_flip(sg.forward_returns(_momentum(spark, d), "signal"), "correct", ["asset"])


@query("dm_newey_west", keys="asset", floats="mean_diff dm p_value", others="n lags")
def _(spark, d):
    rows = _models(spark, d).select("asset", "ts", (F.col("mean5") - F.col("actual")).alias("a"), (F.col("prev") - F.col("actual")).alias("b"))
    return stats.diebold_mariano(rows, "a", "b", ["asset"])


@query(
    "dm_mean_difference",
    "SELECT asset, count(*) AS n, greatest(1, floor(4 * (count(*) / 100.0) ** (2.0 / 9)))::BIGINT AS lags, avg(abs(mean5 - actual) - abs(prev - actual)) "
    "AS mean_diff FROM m WHERE mean5 IS NOT NULL GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="mean_diff", others="n lags",
)
def _(spark, d):
    return QUERIES["dm_newey_west"](spark, d)


RANKS = "(rank() OVER (PARTITION BY asset ORDER BY {0}) + (count(*) OVER (PARTITION BY asset, {0}) - 1) / 2.0)"


@query(
    "wilcoxon_stat",
    f"SELECT asset, n, wp AS w_plus, wm AS w_minus, (wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48.0) AS z FROM "
    f"(SELECT asset, count(*) AS n, coalesce(sum(k) FILTER (x > 0), 0) AS wp, coalesce(sum(k) FILTER (x < 0), 0) AS wm, sum(g * g - 1) AS ties FROM "
    f"(SELECT *, {RANKS.format('ax')} AS k, count(*) OVER (PARTITION BY asset, ax) AS g FROM (SELECT asset, x, abs(x) AS ax FROM "
    f"(SELECT asset, round(abs(mean5 - actual) - abs(prev - actual), 4) AS x FROM m WHERE mean5 IS NOT NULL) WHERE x <> 0)) GROUP BY asset)",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="w_plus w_minus z", others="n",
)
def _(spark, d):
    rows = _models(spark, d).select("asset", F.round(F.abs(F.col("mean5") - F.col("actual")) - F.abs(F.col("prev") - F.col("actual")), 4).alias("x"))
    return stats.wilcoxon(rows, "x", ["asset"])


@query(
    "spearman",
    f"SELECT asset, count(*) AS n, corr(a, q) AS spearman FROM (SELECT asset, {RANKS.format('x')} AS a, {RANKS.format('y')} AS q FROM "
    f"(SELECT asset, round(mean5, 4) AS x, round(actual, 4) AS y FROM m WHERE mean5 IS NOT NULL)) GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="spearman", others="n",
)
def _(spark, d):
    rows = _models(spark, d).select("asset", F.round("mean5", 4).alias("x"), F.round("actual", 4).alias("y"))
    return stats.spearman(rows, "x", "y", ["asset"])


@query(
    "mcnemar_counts",
    f"SELECT asset, count(*) FILTER (x AND y) AS both_right, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) "
    f"FILTER (NOT x AND NOT y) AS neither FROM (SELECT asset, {_DIR.format('ret')} = {_DIR.format('prev')} AS x, {_DIR.format('ret')} = 1 AS y FROM rp "
    f"WHERE ret IS NOT NULL AND prev IS NOT NULL) GROUP BY asset",
    v.BARS_1D,
    RET,
    keys="asset", others="both_right only_a only_b neither",
)
def _(spark, d):
    rows = _daily_returns(spark, d).select("asset", s.direction(F.col("ret")).alias("r"), s.direction(F.col("prev")).alias("p"), F.when(F.col("ret").isNotNull(), 1).alias("up"))
    return stats.paired_directions(rows, "r", "p", "up", ["asset"])


@query(
    "paired_errors",
    "SELECT asset, count(*) AS n, avg(x) AS mean_diff, median(x) AS median_diff, stddev_samp(x) AS sd_diff, avg(x) / nullif(stddev_samp(x), 0) AS cohen_dz "
    "FROM (SELECT asset, abs(mean5 - actual) - abs(prev - actual) AS x FROM m WHERE mean5 IS NOT NULL) GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="mean_diff median_diff sd_diff cohen_dz", others="n",
)
def _(spark, d):
    rows = _models(spark, d).select("asset", (F.col("mean5") - F.col("actual")).alias("a"), (F.col("prev") - F.col("actual")).alias("b"))
    return stats.paired_errors(rows, "a", "b", ["asset"])


@query(
    "t_test",
    "SELECT asset, count(ret) AS n, avg(ret) AS mean, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t_stat FROM ra GROUP BY asset",
    v.BARS_1D,
    RET,
    keys="asset", floats="mean t_stat", others="n",
)
def _(spark, d):
    return stats.t_test(_daily_returns(spark, d), "ret", ["asset"])


_MIX = "((({0} * 48271 % 2147483647) * ({0} * 48271 % 2147483647) + d) % 2147483647)"
_STARTS = f"(({_MIX.format('((d * 1000003 + k * 7919 + 1) % 2147483647)')} * {_MIX.format('((d * 1000003 + k * 7919 + 1) % 2147483647)')} + k) % 2147483647) * 69621 % 2147483647"


@query(
    "bootstrap_ci",
    "SELECT asset, any_value(n) AS n, any_value(mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY asset",
    v.BARS_1D,
    "xs AS (SELECT asset, ret AS x, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM "
    f"(SELECT asset, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM d) WHERE ret IS NOT NULL)",
    "sizes AS (SELECT asset, any_value(n) AS n, avg(x) AS mean, greatest(1, round_even(any_value(n) ** (1.0 / 3), 0))::BIGINT AS size FROM xs GROUP BY asset)",
    "twice AS (SELECT asset, i, x FROM xs UNION ALL SELECT asset, i + n, x FROM xs)",
    "upto AS (SELECT asset, i, sum(x) OVER (PARTITION BY asset ORDER BY i) AS s FROM twice UNION ALL SELECT asset, -1, 0 FROM sizes)",
    "picks AS (SELECT asset, n, mean, size, d, k FROM sizes, (SELECT unnest(range(0, 2000)) AS d) dd, LATERAL (SELECT unnest(range(0, (n + size - 1) // size)) AS k) kk)",
    f"starts AS (SELECT asset, n, mean, d, ({_STARTS}) % n AS a, least(size, n - k * size) AS taken FROM picks)",
    "means AS (SELECT s.asset, s.d, any_value(n) AS n, any_value(mean) AS mean, sum(z.s - y.s) / any_value(n) AS m FROM starts s JOIN upto y ON y.asset = s.asset AND y.i = s.a - 1 JOIN upto z ON z.asset = s.asset AND z.i = s.a + s.taken - 1 GROUP BY s.asset, s.d)",
    keys="asset", floats="mean low high", others="n",
)
def _(spark, d):
    return stats.bootstrap_ci(_daily_returns(spark, d), "ret", ["asset"], 2000, block=True)


# Splits, sets and gates -----------------------------------------------------------------------------------


@query(
    "temporal_thirds",
    f"SELECT asset, block, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT asset, ts, ntile(3) OVER ({W}) AS block FROM b) GROUP BY 1, 2",
    v.BARS_1H,
    keys="asset block", others="n first_ts last_ts",
)
def _(spark, d):
    return ev.blocks(v.bars_1h(spark, d), 3).groupBy("asset", "block").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "chrono_split",
    f"SELECT asset, split, count(*) AS n, min(ts) AS first_ts FROM (SELECT asset, ts, CASE WHEN i <= floor(k * 0.6) THEN 'train' "
    f"WHEN i <= floor(k * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT asset, ts, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY "
    f"asset) AS k FROM b)) GROUP BY 1, 2",
    v.BARS_1H,
    keys="asset split", others="n first_ts",
)
def _(spark, d):
    return ev.chrono_split(v.bars_1h(spark, d)).groupBy("asset", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(
    "oos_blocks",
    f"SELECT asset, block::BIGINT AS block, count(*) AS n, min(ts) AS first_ts FROM (SELECT asset, ts, floor((i - a) / floor((k - a) / 4)) AS block, i, a "
    f"FROM (SELECT *, floor(k * 0.6) AS a FROM (SELECT asset, ts, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY asset) AS k FROM b))) "
    f"WHERE i >= a AND block < 4 GROUP BY 1, 2",
    v.BARS_1H,
    keys="asset block", others="n first_ts",
)
def _(spark, d):
    return ev.tail_blocks(v.bars_1h(spark, d)).groupBy("asset", "block").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(
    "evaluation_windows",
    f"SELECT asset, win AS window_name, count(*) AS n, min(ts) AS first_ts FROM (SELECT asset, ts, CASE WHEN i <= q THEN 'older' "
    f"WHEN i > k - q THEN 'recent' WHEN i > k // 2 - q // 2 AND i <= k // 2 - q // 2 + q THEN 'middle' END AS win FROM (SELECT *, least(100, k // 3) AS q "
    f"FROM (SELECT asset, ts, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY asset) AS k FROM b))) WHERE win IS NOT NULL GROUP BY 1, 2",
    v.BARS_1H,
    keys="asset window_name", others="n first_ts",
)
def _(spark, d):
    return ev.windows(v.bars_1h(spark, d), 100).filter("window IS NOT NULL").groupBy("asset", F.col("window").alias("window_name")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("set_intersect_ts", "SELECT ts FROM b WHERE asset = 'click' INTERSECT SELECT ts FROM b WHERE asset = 'view'", v.BARS_1H, keys="ts")
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return rows.filter("asset = 'click'").select("ts").intersect(rows.filter("asset = 'view'").select("ts"))


@query(
    "parity_check",
    "SELECT asset, ts, 'left' AS side FROM b WHERE ts % 10800000 = 0 UNION ALL SELECT asset, ts, 'right' FROM b WHERE ts % 10800000 = 0",
    v.BARS_1H,
    others="side",
)
def _(spark, d):
    rows = v.bars_1h(spark, d).select("asset", "ts", "close")
    return quality.parity(rows, rows.withColumn("close", F.when(F.col("ts") % 10800000 == 0, F.col("close") + 1).otherwise(F.col("close"))), ["asset", "ts"])


@query(
    "trim_extremes",
    "SELECT asset, count(*) AS n, sum(mean5 - actual) AS total FROM (SELECT *, quantile_cont(abs(mean5 - actual), 0.99) OVER (PARTITION BY asset) AS q "
    "FROM m WHERE mean5 IS NOT NULL) WHERE abs(mean5 - actual) <= q GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="total", others="n",
)
def _(spark, d):
    rows = _models(spark, d).filter("mean5 IS NOT NULL").withColumn("e", F.col("mean5") - F.col("actual"))
    return ev.trim_extremes(rows, "e", ["asset"]).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("total"))


@query("direction_gates", keys="study", floats="hit_rate p_value", others="G1 G2 G3 G4 G5 G6 passed verdict")
def _(spark, d):
    events = sg.forward_returns(_momentum(spark, d), "signal").withColumn("study", F.lit("momentum"))
    test = stats.coin_flip(events, "correct", ["study"], F.struct("ts", "asset"))
    thirds = ev.blocks(events, 3).groupBy("study", "block").agg(F.avg("correct").alias("h")).groupBy("study").agg(F.min("h").alias("worst_window"), F.max_by("h", -F.col("block")).alias("older"), F.max_by("h", "block").alias("recent"))
    assets = events.groupBy("study", "asset").agg(F.avg("correct").alias("h"), F.count(F.lit(1)).alias("k")).groupBy("study").agg(F.min("h").alias("worst_asset"), F.min("k").alias("least_n"))
    return gates.direction_gates(test.join(thirds, "study").join(assets, "study"))


def _study(spark: SparkSession, d: str) -> DataFrame:
    """Daily range forecasts of three models with windows, a scale (the close before) and regimes."""
    r = v.kept(fc.regime_of_means(fc.ranges(v.bars_1d(spark, d)), context=200))
    own = fc.har(r, window=512).withColumns({"actual": F.col("range"), "prev": t.lag("range"), "ewma": t.ewm("range", 22, 120, 1), "scale": t.lag("close")})
    return v.kept(ev.windows(own.filter("har IS NOT NULL"), 500).filter("window IS NOT NULL").withColumn("study", F.lit("har")))


def _study_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _study(spark, d)
    by = ["asset", "window"]
    tracks = ev.regime_tracking(rows, "har", "actual", by).select(*by, "tracks")
    records = ev.window_records(rows, "har", "prev", "ewma", "scale", by).join(tracks, by, "left").withColumn("series", F.col("asset"))
    errors = rows.select("study", F.struct("asset", "ts").alias("at"), ((F.col("har") - F.col("actual")) / F.col("scale")).alias("a"), ((F.col("prev") - F.col("actual")) / F.col("scale")).alias("b"))
    return records, stats.diebold_mariano(errors, "a", "b", ["study"], ts="at"), ev.window_records(rows, "har", "prev", "ewma", "scale", ["regime"])


@query(
    "window_records",
    keys="asset window_name", floats="mae_primary mae_base mae_second nmae_primary nmae_base", others="n low_power beats_base beats_second beats_norm",
)
def _(spark, d):
    return _study_parts(spark, d)[0].withColumnRenamed("window", "window_name")


@query("breadth_gate", keys="verdict", others="eligible c1 c2 c3 c4 c5 c6 c7 c8 passed")
def _(spark, d):
    return gates.breadth_gate(*_study_parts(spark, d))


@query("asset_gate", keys="verdict", others="eligible c1 c2 c3 c4 c5 c6 c7 passed")
def _(spark, d):
    return gates.asset_gate(*_study_parts(spark, d), assets=3)


@query(
    "lab_hypotheses",
    "SELECT asset, x.d AS direction, w.w AS width, r.r AS regime, c.c AS confirmation, n FROM (VALUES ('long'), ('short')) x(d), (VALUES (10), (20), (50)) w(w), "
    "(VALUES ('low'), ('high')) r(r), (VALUES ('none'), ('trend')) c(c), (SELECT asset, count(*) AS n FROM b GROUP BY asset) a WHERE n >= w.w",
    v.BARS_1H,
    keys="asset direction width regime confirmation", others="n",
)
def _(spark, d):
    made = lab.hypotheses(spark, ["long", "short"], [10, 20, 50], ["low", "high"], ["none", "trend"])
    return lab.testable(made, v.bars_1h(spark, d))


# Streaming, as a replay -----------------------------------------------------------------------------------


@query(
    "rank_topk_orders",
    "SELECT * FROM (SELECT asset, ts, volume, row_number() OVER (PARTITION BY asset ORDER BY volume DESC, ts) AS place FROM d) WHERE place <= 5",
    v.BARS_1D,
    floats="volume", others="place",
)
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("volume"), "ts"))
    return v.bars_1d(spark, d).withColumn("place", place).filter("place <= 5")
