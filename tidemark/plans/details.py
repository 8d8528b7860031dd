"""Queries of scalar functions, checks, joins and small aggregates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import bars as b
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import forecast as fc
from tidemark.operators import gates, quality, reports, sim
from tidemark.operators import signals as sg
from tidemark.plans import views as v
from tidemark.plans.queries import FORECASTS, MEAN, SD, W, lag, query, roll, win
from tidemark.schema import HOUR_MS

# Scalars ----------------------------------------------------------------------------------------------

_E = "e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, value, props FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").withColumn("ms", v.ms("ts"))


@query(
    "scalar_times",
    """SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, ms // 1000 * 1000 AS back, ms // 1000 * 1000 AS from_s, ms AS from_ms,
    ms // 3600000 * 3600000 AS hour_open, ms // 3600000 * 3600000 + 3600000 AS next_hour, (3600000 - ms % 3600000) / 1000.0 AS wait_s,
    hour(make_timestamp(ms * 1000)) AS hour, isodow(make_timestamp(ms * 1000)) - 1 AS weekday, quarter(make_timestamp(ms * 1000)) AS quarter,
    last_day(make_timestamp(ms * 1000)) = make_timestamp(ms * 1000)::DATE AS month_end FROM e""",
    _E, keys="event_id", floats="wait_s", others="iso back from_s from_ms hour_open next_hour hour weekday quarter month_end",
)
def _(spark, d):
    ms, at = F.col("ms"), F.timestamp_millis("ms")
    return _events(spark, d).select(
        "event_id", s.iso_utc(ms).alias("iso"), s.parse_iso(s.iso_utc(ms)).alias("back"), s.epoch_ms(F.floor(ms / F.lit(1000))).alias("from_s"), s.epoch_ms(ms).alias("from_ms"),
        s.bar_open(ms, HOUR_MS).alias("hour_open"), s.next_bar(ms, HOUR_MS).alias("next_hour"), s.seconds_to_next(ms, HOUR_MS).alias("wait_s"),
        F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), F.quarter(at).alias("quarter"), (F.last_day(at) == F.to_date(at)).alias("month_end"),
    )


@query(
    "scalar_parse_time",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ms // 1000 * 1000 WHEN 1 THEN ms WHEN 2 THEN ms // 86400000 * 86400000 WHEN 3 THEN ms // 1000 * 1000 END AS parsed FROM e""",
    _E, keys="event_id", others="parsed",
)
def _(spark, d):
    at = F.timestamp_millis("ms")
    forms = [F.floor(F.col("ms") / 1000).cast("string"), F.col("ms").cast("string"), F.date_format(at, "yyyy-MM-dd"), s.iso_utc(F.col("ms")), F.lit("never")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, d).select("event_id", s.parse_time(text).alias("parsed"))


@query(
    "scalar_labels",
    f"""SELECT asset, ts, CASE WHEN ret IS NULL THEN NULL WHEN abs(ret) <= 0.0005 THEN 0 WHEN ret > 0 THEN 1 ELSE -1 END AS direction,
    CASE WHEN close >= open THEN 1 ELSE -1 END AS candle,
    CASE WHEN f IS NULL OR f <= 0 OR a / f < 2 THEN 'none' WHEN a / f < 3 THEN 'moderate' WHEN a / f < 5 THEN 'severe' ELSE 'extreme' END AS severity,
    CASE WHEN a > f THEN 'under' WHEN a < f THEN 'over' WHEN a = f THEN 'exact' END AS kind,
    CASE WHEN abs(a - f) < abs(a - p) THEN 'mean' WHEN abs(a - p) < abs(a - f) THEN 'last' WHEN abs(a - f) = abs(a - p) THEN 'tie' END AS winner,
    greatest(-1, least(1, 1 - abs(a - f) / nullif(a, 0))) AS accuracy, CASE WHEN abs(abs(a - p)) > 1e-12 THEN (abs(a - p) - abs(a - f)) / abs(a - p) * 100 END AS improvement,
    CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ** 2 / (4 * ln(2.0)) END AS parkinson, volume * (open + high + low + close) / 4 AS amount,
    CASE WHEN ret > 0.3 THEN 1 WHEN ret < -0.3 THEN -1 ELSE 0 END AS edge, CASE WHEN ret > 0 THEN 'buy' WHEN ret < 0 THEN 'sell' END AS side,
    CASE WHEN close < 20 THEN 'low' WHEN close < 60 THEN 'usual' ELSE 'high' END AS band
    FROM (SELECT *, greatest(high - low, 0) AS a, lag(greatest(high - low, 0)) OVER ({W}) AS p, close / nullif({lag('close')}, 0) - 1 AS ret,
      CASE WHEN count(*) OVER {win(-5, -1)} >= 5 THEN avg(greatest(high - low, 0)) OVER {win(-5, -1)} END AS f FROM b)""",
    v.BARS_1H, floats="accuracy improvement parkinson amount", others="direction candle severity kind winner edge side band",
)
def _(spark, d):
    rows = fc.ranges(v.bars_1h(spark, d)).withColumns({"p": t.lag("range"), "f": t.mean("range", 5, 1), "ret": F.try_divide("close", t.lag("close")) - 1})
    a, f, p, ret = (F.col(c) for c in ("range", "f", "p", "ret"))
    return rows.select(
        "asset", "ts", s.direction(ret).alias("direction"), s.candle_direction(F.col("open"), F.col("close")).alias("candle"), s.severity(a, f).alias("severity"), s.error_kind(a, f).alias("kind"),
        s.winner(F.abs(a - f), F.abs(a - p), "mean", "last").alias("winner"), s.accuracy(F.abs(a - f), a).alias("accuracy"), s.improvement_pct(F.abs(a - p), F.abs(a - f)).alias("improvement"),
        s.parkinson(F.col("high"), F.col("low")).alias("parkinson"), s.amount_proxy(*(F.col(c) for c in ("open", "high", "low", "close", "volume"))).alias("amount"),
        s.edge_signal(ret, 0.1, 0.2).alias("edge"), s.order_side(ret).alias("side"), s.banded_label(F.col("close"), [20, 60], ["low", "usual", "high"]).alias("band"),
    )


@query(
    "scalar_sizes",
    f"""SELECT asset, ts, w AS weight, greatest(0.2, least(2.0, sd / 0.02)) AS inverse, w / nullif(sum(w) OVER (PARTITION BY ts), 0) AS share,
    CASE WHEN least(1000 * (0.01 / nullif(sd, 0)), 100) < 10 THEN 0 ELSE least(1000 * (0.01 / nullif(sd, 0)), 100) END AS usd
    FROM (SELECT *, CASE WHEN sd IS NOT NULL THEN greatest(0.2, least(2.0, 0.02 / nullif(sd, 0))) END AS w FROM (
      SELECT *, {roll(SD, 'ret', 20)} AS sd FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM d))) WHERE sd IS NOT NULL""",
    v.BARS_1D, floats="weight inverse share usd",
)
def _(spark, d):
    from pyspark.sql import Window

    rows = v.bars_1d(spark, d).withColumn("ret", F.try_divide("close", t.lag("close")) - 1).withColumn("sd", t.std("ret", 20)).filter("sd IS NOT NULL")
    sd = F.col("sd")
    rows = rows.withColumns({"weight": s.vol_target_weight(sd, 0.02, 0.2, 2.0), "inverse": s.vol_target_weight(sd, 0.02, 0.2, 2.0, inverse=True), "usd": s.position_usd(F.lit(1000.0), sd)})
    return rows.withColumn("share", s.normalised(F.col("weight"), F.sum("weight").over(Window.partitionBy("ts"))))


@query(
    "scalar_text",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '/USDT' ELSE upper(c_mktsegment) || '/USDT' END AS pair,
    md5(concat_ws('|', c_custkey::VARCHAR, c_mktsegment)) AS id, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS number,
    (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || '$' || format('{:,.2f}', abs(c_acctbal)) AS money, json_extract_string(to_json({'k': c_custkey}), '$.k')::BIGINT AS k,
    CASE WHEN abs(c_acctbal) >= 1e3 THEN printf('%.1fK', sign(c_acctbal) * floor(abs(c_acctbal) / 100 + 0.5) / 10) ELSE printf('%.2f', c_acctbal) END AS short FROM customer""",
    keys="c_custkey", others="pair id number money k short",
)
def _(spark, d):
    rows = v.table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit("usdt"))).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("/usdt ")))
    return rows.select(
        "c_custkey", s.symbol_pair(name).alias("pair"), s.canonical_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("id"), s.regex_field(F.col("c_name"), "#0*([0-9]+)$").alias("number"),
        s.money(F.col("c_acctbal")).alias("money"), F.get_json_object(F.to_json(F.struct(F.col("c_custkey").alias("k"))), "$.k").cast("long").alias("k"), s.short_number(F.col("c_acctbal")).alias("short"),
    )


@query(
    "scalar_percent",
    "SELECT asset, ts, CASE WHEN r > 0 THEN '+' ELSE '' END || printf('%.1f%%', round(r * 100, 1) + 0.0) AS change FROM (SELECT asset, ts, close / open - 1 AS r FROM d WHERE open > 0)",
    v.BARS_1D, others="change",
)
def _(spark, d):
    return v.bars_1d(spark, d).filter("open > 0").withColumn("change", s.percent(F.col("close") / F.col("open") - 1, 1))


# Checks -----------------------------------------------------------------------------------------------

NOW_MS = 1_705_000_000_000


@query(
    "out_of_order_rows",
    "SELECT * FROM (SELECT event_type AS asset, event_id, ms AS ts, max(ms) OVER (PARTITION BY event_type "
    "ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before FROM e) WHERE ts < latest_before",
    _E,
    keys="asset event_id", others="ts latest_before",
)
def _(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("asset"), "event_id", F.col("ms").alias("ts"), F.struct("value", "event_id").alias("seq"))
    return quality.out_of_order(rows)


@query("utc_text_check", "SELECT event_id, event_id % 3 = 0 AS same FROM e", _E, keys="event_id", others="same")
def _(spark, d):
    ms = F.floor(F.col("ms") / 1000) * 1000
    text = F.element_at(F.array(s.iso_utc(ms), F.regexp_replace(s.iso_utc(ms), "Z", ""), s.iso_utc(ms + 1000)), (F.col("event_id") % 3 + 1).cast("int"))
    return _events(spark, d).select("event_id", quality.utc_text_matches(ms, text).alias("same"))


@query(
    "leakage_check",
    f"SELECT (SELECT max(ts) FROM b WHERE ts <= {NOW_MS}) AS last_input, (SELECT min(ts) FROM b WHERE ts > {NOW_MS}) AS first_target, 0 AS shared, "
    f"(SELECT max(ts) FROM b WHERE ts <= {NOW_MS}) <= {NOW_MS} AND (SELECT min(ts) FROM b WHERE ts > {NOW_MS}) > {NOW_MS} AS ok",
    v.BARS_1H,
    keys="last_input", others="first_target shared ok",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return quality.leakage(rows.filter(F.col("ts") <= NOW_MS), rows.filter(F.col("ts") > NOW_MS), NOW_MS)


_RUNS = (
    "rn AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - row_number() OVER (PARTITION BY asset, bad ORDER BY ts) AS run FROM "
    "(SELECT asset, ts, ts % 172800000 AS off, ts % 172800000 <> 0 AS bad FROM d))"
)


@query(
    "misaligned_runs",
    "SELECT asset, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, array_to_string(list_sort(list(DISTINCT off)), ',') AS offsets FROM rn "
    "WHERE bad GROUP BY asset, run",
    v.BARS_1D,
    _RUNS,
    keys="asset first_ts", others="last_ts n offsets",
)
def _(spark, d):
    return quality.misaligned_runs(v.bars_1d(spark, d), 172_800_000).withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query(
    "time_and_asset_filters",
    f"SELECT asset, ts, close FROM b WHERE ts >= {NOW_MS - 86_400_000 * 5} AND ts < {NOW_MS} AND asset IN ('click', 'view')",
    v.BARS_1H,
    floats="close",
)
def _(spark, d):
    return b.time_range(v.bars_1h(spark, d), NOW_MS - 86_400_000 * 5, NOW_MS).filter(F.col("asset").isin("click", "view"))


@query(
    "relative_units",
    "SELECT asset, ts, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume FROM "
    "(SELECT *, first_value(close) OVER (PARTITION BY asset ORDER BY ts) AS f FROM d)",
    v.BARS_1D,
    floats="open high low close volume",
)
def _(spark, d):
    return b.relative(v.bars_1d(spark, d))


@query("future_times", "SELECT asset, m + k * 3600000 AS ts FROM (SELECT asset, max(ts) AS m FROM b GROUP BY asset), range(1, 6) AS r(k)", v.BARS_1H)
def _(spark, d):
    return b.future_times(v.bars_1h(spark, d), 5)


@query("clean_ranges", "SELECT asset, ts, greatest(high - low - 5, 0) AS range FROM b", v.BARS_1H, floats="range")
def _(spark, d):
    return fc.ranges(v.bars_1h(spark, d).withColumn("low", F.col("low") + 5))


@query(
    "stale_regimes",
    "SELECT asset, ts, CASE WHEN age IS NULL OR age > 2 THEN 'unknown' ELSE 'calm' END AS regime FROM "
    "(SELECT asset, ts, (ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts)) / 3600000.0 AS age FROM b)",
    v.BARS_1H,
    others="regime",
)
def _(spark, d):
    age = (F.col("ts") - t.lag("ts")) / 3_600_000
    return v.bars_1h(spark, d).withColumn("regime", fc.stale_regime(F.lit("calm"), age))


@query("point_lookup", "SELECT asset, ts, open, close FROM b WHERE ts = (SELECT max(ts) FROM b)", v.BARS_1H, floats="open close")
def _(spark, d):
    rows = v.bars_1h(spark, d)
    newest = rows.agg(F.max("ts").alias("ts"))
    return rows.join(F.broadcast(newest), "ts")  # one row


@query("timeframe_history", f"""SELECT '1h' AS timeframe, asset, ts FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM b WHERE ts + 3600000 <= {NOW_MS + HOUR_MS}) WHERE k <= 30
UNION ALL SELECT '4h', asset, ts FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM (SELECT DISTINCT asset, ts // 14400000 * 14400000 AS ts FROM b) WHERE ts + 14400000 <= {NOW_MS + HOUR_MS}) WHERE k <= 10""", v.BARS_1H, keys="timeframe asset ts")
def _(spark, d):
    rows = v.bars_1h(spark, d)
    return quality.aligned_history({"1h": (rows, HOUR_MS, 30), "4h": (b.coarsen(rows, 4 * HOUR_MS), 4 * HOUR_MS, 10)}, NOW_MS)


# Aggregates, forecasts and signals ----------------------------------------------------------------------


@query(
    "forecast_quality",
    "SELECT asset, count(*) AS n, count(mean22) AS valid, count(*) FILTER (mean22 IS NULL) / count(*) AS null_rate, avg(mean22) AS mean, median(mean22) AS "
    "median, min(mean22) AS least, max(mean22) AS most, count(*) FILTER (mean22 < 0) AS negative FROM m GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    keys="asset", floats="null_rate mean median least most", others="n valid negative",
)
def _(spark, d):
    return fc.forecast_quality(fc.ranges(v.bars_1h(spark, d)).withColumn("f", t.mean("range", 22, 1)), "f")


_CLOSED = "po AS (SELECT asset, 1 AS direction, open AS entry, CASE WHEN ts % 172800000 = 0 THEN close END AS leave FROM d)"


@query(
    "paper_positions",
    "SELECT asset, count(*) FILTER (leave IS NULL) AS open, count(leave) AS closed, coalesce(sum(2 * (leave - entry)), 0) AS pnl, avg((leave > "
    "entry)::INT) AS win_rate FROM po GROUP BY asset",
    v.BARS_1D,
    _CLOSED,
    keys="asset", floats="pnl win_rate", others="open closed",
)
def _(spark, d):
    from tidemark.sources import sinks

    rows = v.bars_1d(spark, d).select(F.concat("asset", F.col("ts").cast("string")).alias("position_id"), "asset", F.lit(1).alias("direction"), F.col("open").alias("entry_price"), F.lit(2.0).alias("size"), F.lit("open").alias("status"), F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("double").alias("pnl"), "ts", "close")
    exits = rows.filter("ts % 172800000 = 0").select("position_id", F.col("close").alias("price"))
    return reports.paper_pnl(sinks.closed(rows, exits))


@query(
    "close_baselines",
    f"SELECT asset, ts, {lag('close')} AS persistence_close, {lag('close')} / nullif({lag('close', 4)}, 0) - 1 AS previous_return, lead(close, 2) OVER "
    f"({W}) / nullif({lag('close')}, 0) - 1 AS actual_return, 2 * {lag('close')} - {lag('close', 2)} AS straight FROM d",
    v.BARS_1D,
    floats="persistence_close previous_return actual_return straight",
)
def _(spark, d):
    return fc.close_baselines(v.bars_1d(spark, d), 3).withColumn("straight", fc.extrapolation())


@query(
    "context_volatility",
    f"SELECT asset, ts, CASE WHEN count(ret) OVER {win(-19, -1)} >= 19 THEN stddev_pop(ret) OVER {win(-19, -1)} END AS vol FROM "
    f"(SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM d)",
    v.BARS_1D,
    floats="vol",
)
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("ret", F.try_divide("close", t.lag("close")) - 1).withColumn("vol", ft.context_volatility(20))


@query(
    "funding_event_mean",
    f"SELECT asset, ts, avg(rate) OVER {win(-2)} AS rate_ma FROM (SELECT 'all' AS asset, ts, rate FROM f QUALIFY row_number() OVER (PARTITION BY ts "
    f"ORDER BY rate) = 1)",
    v.FUNDING,
    floats="rate_ma",
)
def _(spark, d):
    return ft.event_mean(v.funding(spark, d).groupBy("ts").agg(F.min("rate").alias("rate")).withColumn("asset", F.lit("all")), 3)


@query("rsi_trend_signals", f"""SELECT asset, ts, coalesce(rsi < 40 AND close > ma, false) AS entry, coalesce(rsi > 60, false) AS exit FROM (
  SELECT *, CASE WHEN n < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM (
    SELECT *, count(x) OVER {win(-13)} AS n, avg(greatest(x, 0)) OVER {win(-13)} AS g, avg(greatest(-x, 0)) OVER {win(-13)} AS l FROM (SELECT *, close - {lag('close')} AS x, {roll(MEAN, 'close', 50)} AS ma FROM d)))""", v.BARS_1D, others="entry exit")
def _(spark, d):
    return sg.rsi_signals(v.bars_1d(spark, d).withColumn("ma", t.mean("close", 50)), 40, 60, trend="ma")


@query("expansion_signals", f"""SELECT asset, ts, coalesce(high - low > 1.5 * m AND close > open AND volume > 0, false) AS entry, coalesce(close < lo, false) AS exit FROM (
  SELECT *, {roll(MEAN, 'range', 20)} AS m, min(low) OVER {win(-10, -1)} AS lo FROM (SELECT *, high - low AS range FROM d))""", v.BARS_1D, others="entry exit")
def _(spark, d):
    return sg.expansion_signals(v.bars_1d(spark, d), 1.5)


@query(
    "timed_exits",
    f"SELECT asset, ts, coalesce({lag('e', 5)}, false) AS exit FROM (SELECT asset, ts, coalesce(high - low > 1.2 * {roll(MEAN, 'high - low', 20)}, false) "
    f"AS e FROM d)",
    v.BARS_1D,
    others="exit",
)
def _(spark, d):
    return v.bars_1d(spark, d).withColumn("e", sg.breakout_entry(times=1.2)).withColumn("exit", sg.held("e", 5))


@query(
    "horizon_returns",
    f"SELECT asset, ts, h AS horizon, CASE h WHEN 1 THEN close WHEN 3 THEN c3 WHEN 5 THEN c5 END / nullif(p, 0) - 1 AS horizon_return FROM "
    f"(SELECT asset, ts, close, lead(close, 2) OVER ({W}) AS c3, lead(close, 4) OVER ({W}) AS c5, {lag('close')} AS p "
    f"FROM d), (VALUES (1), (3), (5)) AS x(h)",
    v.BARS_1D,
    keys="asset ts horizon", floats="horizon_return",
)
def _(spark, d):
    return ev.horizon_returns(v.bars_1d(spark, d), [1, 3, 5])


@query("portfolio_gates", f"""SELECT asset, a.sh > p.sh AS G1, abs(a.dd) < abs(p.dd) AS G2, a.tr > 0 AS G3, coalesce(a.wr >= p.wr, false) AS G4, coalesce(a.pf > 1, false) AS G5, a.n >= 30 AS G6 FROM me a JOIN me p USING (asset) WHERE a.k = 1 AND p.k = 0""",
    v.BARS_1D, f"ps AS (SELECT k, asset || '' AS asset, ts, close, CASE WHEN k = 0 OR {roll(MEAN, 'close', 10)} > {roll(MEAN, 'close', 30)} THEN 1 ELSE 0 END AS position FROM d, (VALUES (0), (1)) AS x(k) WHERE k = 0 UNION ALL SELECT 1, asset, ts, close, CASE WHEN {roll(MEAN, 'close', 10)} > {roll(MEAN, 'close', 30)} THEN 1 ELSE 0 END FROM d)",
    "rt AS (SELECT *, coalesce(lag(position) OVER w, 0) * coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) - 0.001 * abs(position - coalesce(lag(position) OVER w, 0)) AS ret FROM ps WINDOW w AS (PARTITION BY k, asset ORDER BY ts))",
    "eq AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-12))) OVER (PARTITION BY k, asset ORDER BY ts)) AS equity FROM rt)",
    "dr AS (SELECT *, equity / max(equity) OVER (PARTITION BY k, asset ORDER BY ts) - 1 AS drawdown FROM eq)",
    "me AS (SELECT k, asset, count(*) AS n, arg_max(equity, ts) - 1 AS tr, min(drawdown) AS dd, count(*) FILTER (ret > 0) / nullif(count(*) FILTER (ret <> 0), 0) AS wr, sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0) AS pf, avg(ret) / nullif(stddev_pop(ret), 0) AS sh FROM dr GROUP BY k, asset)",
    keys="asset", others="G1 G2 G3 G4 G5 G6",
)
def _(spark, d):
    rows = v.bars_1d(spark, d)
    trend = rows.withColumn("position", F.when(t.mean("close", 10) > t.mean("close", 30), 1).otherwise(0))
    both = [sim.equity_metrics(sim.equity(x)) for x in (trend, rows.withColumn("position", F.lit(1)))]
    return gates.portfolio_gates(both[0], both[1], ["asset"])


@query(
    "calibration_progress",
    f"SELECT asset, (floor(({NOW_MS} - min(ts)) / 86400000.0) + 1)::BIGINT AS day, least(100, (floor(({NOW_MS} - min(ts)) / 86400000.0) + 1) * 100.0 / 30) "
    f"AS progress_pct FROM p GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="asset", floats="progress_pct", others="day",
)
def _(spark, d):
    return gates.progress(v.predictions(spark, d), NOW_MS)
