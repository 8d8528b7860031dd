"""Queries of strategy families, robustness and forecast studies, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ts as t
from tidemark.operators import evaluate as ev
from tidemark.operators import families as fam
from tidemark.operators import forecast as fc
from tidemark.operators import lab, ols, robustness, sim, stats, trees
from tidemark.operators import signals as sg
from tidemark.plans import replays as rp
from tidemark.plans import views as v
from tidemark.plans.queries import EQUITY, FORECASTS, MEAN, SD, W, lag, query, roll, win

ON = "coalesce({}, false)".format
SIDES = "long_entry long_exit short_entry short_exit"

# Families ---------------------------------------------------------------------------------------------

_HF = "hf AS (SELECT b.asset, b.ts, b.close, q.rate FROM b LEFT JOIN (SELECT ts // 3600000 * 3600000 AS ts, avg(rate) AS rate FROM f GROUP BY 1) q USING (ts))"


def _hourly_funding(spark: SparkSession, d: str) -> DataFrame:
    rates = v.funding(spark, d).groupBy((F.floor(F.col("ts") / 3_600_000) * 3_600_000).cast("long").alias("ts")).agg(F.avg("rate").alias("rate"))
    return v.bars_1h(spark, d).join(rates, "ts", "left")


_SEEN = f"max({{}}) OVER {win('UNBOUNDED PRECEDING')}"


@query(
    "funding_contrarian",
    f"SELECT asset, ts, lo AS long_entry, {ON('rate > 0 AND ' + _SEEN.format('lo'))} AS long_exit, hi AS short_entry, "
    f"{ON('rate < 0 AND ' + _SEEN.format('hi'))} AS short_exit FROM (SELECT *, {ON('rate < 0.02')} AS lo, {ON('rate > 0.04')} AS hi FROM hf)",
    v.BARS_1H,
    v.FUNDING,
    _HF,
    others=SIDES,
)
def _(spark, d):
    return fam.funding_contrarian(_hourly_funding(spark, d), "rate", 0.02, 0.04, flip=True)


@query(
    "funding_trend",
    f"SELECT asset, ts, {ON('m > 0.03 AND close > ma')} AS long_entry, {ON('m < -0.03 AND close < ma')} AS short_entry FROM "
    f"(SELECT *, {roll(MEAN, 'rate', 6, 0, 1)} AS m, {roll(MEAN, 'close', 24, 0, 2)} AS ma FROM hf)",
    v.BARS_1H,
    v.FUNDING,
    _HF,
    others="long_entry short_entry",
)
def _(spark, d):
    return fam.funding_trend(_hourly_funding(spark, d).withColumn("m", t.mean("rate", 6, 0, 1)), "m", 0.03, 24)


@query("sized_moves", f"""SELECT asset, ts, {ON("close - c1 > 0.5 * f AND regime <> 'low'")} AS long_entry, {ON("close - c1 < -0.5 * f AND regime <> 'low'")} AS short_entry,
  coalesce(CASE WHEN f <> 0 AND md IS NOT NULL THEN greatest(0.1, least(1, md / f)) END, 0.5) AS size FROM (
  SELECT *, CASE WHEN count(f) OVER {win(-59)} >= 20 THEN quantile_cont(f, 0.5) OVER {win(-59)} END AS md FROM (
    SELECT *, {lag('close')} AS c1, {roll(MEAN, 'range', 5, 1)} AS f, CASE WHEN close < 60000 THEN 'low' ELSE 'high' END AS regime FROM (SELECT *, greatest(high - low, 0) AS range FROM d)))""", v.BARS_1D, floats="size", others="long_entry short_entry")
def _(spark, d):
    rows = fc.ranges(v.bars_1d(spark, d)).withColumn("f", t.mean("range", 5, 1)).withColumn("regime", F.when(F.col("close") < 60_000, "low").otherwise("high"))
    return fam.sized_moves(rows, "f", "regime", ["high"], 0.5).withColumn("size", fam.size_by_forecast("f", 60, 20))


_PAIRS = "pr AS (SELECT 'A/R' AS asset, a.ts, a.close AS ac, r.close AS rc FROM d a JOIN d r ON a.asset = 'A' AND r.asset = 'R' AND a.ts = r.ts)"


@query(
    "paired_momentum",
    f"SELECT asset, ts, {ON('a > 0.1 AND r > 0')} AS long_entry, {ON('a < -0.1 AND r < 0')} AS short_entry FROM "
    f"(SELECT asset, ts, ac / nullif({lag('ac', 5)}, 0) - 1 AS a, rc / nullif({lag('rc', 5)}, 0) - 1 AS r FROM pr)",
    v.BARS_1D,
    _PAIRS,
    others="long_entry short_entry",
)
def _(spark, d):
    return fam.paired_momentum(sg.pair(v.bars_1d(spark, d), "A", "R"), 5, 0.1)


@query(
    "volatility_regime_entries",
    f"SELECT asset, ts, {ON('q < s AND close < m * 0.9')} AS long_entry FROM (SELECT *, {roll(SD, 'r', 10)} AS q, {roll(SD, 'r', 40)} AS s, "
    f"{roll(MEAN, 'close', 20)} AS m FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r FROM d))",
    v.BARS_1D,
    others="long_entry",
)
def _(spark, d):
    return fam.volatility_regime(v.bars_1d(spark, d), 10, 40, 20, 0.1)


@query(
    "interest_proxy",
    f"SELECT asset, ts, {ON('i / nullif(i6, 0) - 1 > 0.1 AND c > 0')} AS long_entry FROM "
    f"(SELECT asset, ts, i, {lag('i', 6)} AS i6, close / nullif({lag('close', 6)}, 0) - 1 AS c FROM (SELECT *, {roll('sum({})', 'volume', 24)} AS i FROM b))",
    v.BARS_1H,
    others="long_entry",
)
def _(spark, d):
    return fam.interest_proxy(v.bars_1h(spark, d), 24, 6, 0.1, 0.0)


@query(
    "liquidation_bounce",
    f"SELECT asset, ts, {ON(lag('f', 2))} AS long_entry FROM (SELECT asset, ts, {ON('r < -0.2 AND volume / nullif(m, 0) > 1.2')} AS f FROM "
    f"(SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, {roll(MEAN, 'volume', 24)} AS m FROM b))",
    v.BARS_1H,
    others="long_entry",
)
def _(spark, d):
    return fam.liquidation_bounce(v.bars_1h(spark, d), 24, 1.2, 0.2, 2)


@query("confirmed_entries", f"""SELECT asset, ts, {ON('e AND close > m200')} AS trend, {ON('e AND vv > vm')} AS volatile, {ON('e AND close > m40')} AS coarse FROM (SELECT *, {roll(MEAN, 'vv', 60)} AS vm FROM (
  SELECT *, {ON(f"high - low > 1.2 * {roll(MEAN, 'high - low', 20)}")} AS e, {roll(MEAN, 'close', 200)} AS m200, {roll(MEAN, 'close', 40)} AS m40, {roll(MEAN, '(high - low) / nullif(close, 0)', 10)} AS vv FROM d))""", v.BARS_1D, others="trend volatile coarse")
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("entry", sg.breakout_entry(times=1.2))
    both = rows.withColumns({"trend": fam.trend_confirmed("entry", 200), "coarse": fam.coarse_trend("entry", 4, 10), "volatile": F.col("entry")})
    return fam.volatility_confirmed(both, "volatile", 10, 60)


# Robustness -------------------------------------------------------------------------------------------

_WINDOWS = f"""fw0 AS (SELECT asset, ts, ret, position > coalesce({lag('position')}, 0) AS entry, (row_number() OVER ({W}) - 1 - 300) // 100 AS test, row_number() OVER ({W}) - 1 - 300 AS p FROM eq),
fw1 AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-12))) OVER (PARTITION BY asset, test ORDER BY ts)) AS e FROM fw0 WHERE p >= 0),
fw2 AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY asset, test ORDER BY ts), 1) - 1 AS dd FROM fw1),
fw AS (SELECT asset, test, count(*) FILTER (entry) AS entries, CASE WHEN count(*) FILTER (entry) > 0 THEN arg_max(e, ts) - 1 ELSE 0 END AS total_return,
  CASE WHEN count(*) FILTER (entry) > 0 THEN coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(365), 0) ELSE 0 END AS sharpe, CASE WHEN count(*) FILTER (entry) > 0 THEN min(dd) ELSE 0 END AS max_drawdown FROM fw2 GROUP BY asset, test)"""


def _trend(spark: SparkSession, d: str) -> DataFrame:
    rows = v.bars_1d(spark, d).withColumn("position", F.when(t.mean("close", 10) > t.mean("close", 30), 1).otherwise(0))
    return sim.equity(rows).withColumn("entry", F.col("position") > F.coalesce(t.lag("position"), F.lit(0)))


@query("walk_forward_windows", "SELECT * FROM fw", v.BARS_1D, EQUITY, _WINDOWS, keys="asset test", floats="total_return sharpe max_drawdown", others="entries")
def _(spark, d):
    return robustness.forward_windows(_trend(spark, d), 300, 100, periods=365.0)


@query("walk_forward_quality", """SELECT *, quality >= 3 AND win_rate >= 0.4 AS passed FROM (SELECT *, greatest(0, least(3, greatest(0, (win_rate - 0.3) * 6)) + least(3, greatest(0, mean_return / 5)) + least(2, greatest(0, s))
  + least(2, greatest(0, (20 + worst_drawdown) / 10)) - CASE WHEN worst_return < -25 THEN 5 ELSE 0 END) AS quality FROM (
  SELECT asset, count(*) AS windows, avg((total_return > 0)::INT) AS win_rate, avg(total_return * 100) AS mean_return, median(total_return * 100) AS median_return, min(total_return * 100) AS worst_return,
    min(max_drawdown * 100) AS worst_drawdown, coalesce(avg(total_return * 100) / nullif(stddev_pop(total_return * 100), 0), 0) AS oos_sharpe, avg(sharpe) AS s FROM fw GROUP BY asset))""",
    v.BARS_1D, EQUITY, _WINDOWS, keys="asset", floats="win_rate mean_return median_return worst_return worst_drawdown oos_sharpe quality", others="windows passed")
def _(spark, d):
    return robustness.forward_quality(robustness.forward_windows(_trend(spark, d), 300, 100, periods=365.0))


_COSTS = ", ".join(f"({c})" for c in robustness.COSTS)
_MOVES = (
    f"mv AS (SELECT asset, ts, coalesce({lag('position')}, 0) * coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS gross, abs(position - "
    f"coalesce({lag('position')}, 0)) AS traded FROM pos)"
)
_SURVIVES = (
    f"cv AS (SELECT asset, k, exp(sum(ln(greatest(1 + gross - 0.002 * k * traded, 1e-12)))) - 1 AS total_return FROM mv CROSS "
    f"JOIN (VALUES {_COSTS}) AS t(k) GROUP BY asset, k)"
)


@query(
    "cost_survival",
    "SELECT asset, coalesce(max(k) FILTER (total_return > 0), 0) AS survival, coalesce(max(k) FILTER (total_return > 0), 0) >= 1.5 AS passed FROM cv "
    "GROUP BY asset",
    v.BARS_1D,
    EQUITY,
    _MOVES,
    _SURVIVES,
    keys="asset", floats="survival", others="passed",
)
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("position", F.when(t.mean("close", 10) > t.mean("close", 30), 1).otherwise(0))
    curve = lab.cost_curve(rows, tuple(0.002 * k for k in robustness.COSTS), ("asset",)).withColumn("multiplier", F.round(F.col("cost") / 0.002, 6))
    return robustness.cost_survival(curve)


_VARIANTS = [(name, p["fast"], p["slow"]) for name, p in robustness.one_at_a_time({"fast": 10, "slow": 30})]
_VARIED = "vp AS (" + " UNION ALL ".join(f"SELECT asset, ts, close, {i} AS run, CASE WHEN {roll(MEAN, 'close', a)} > {roll(MEAN, 'close', z)} THEN 1 ELSE 0 END AS position FROM d" for i, (_, a, z) in enumerate(_VARIANTS)) + ")"
_RUN_RETURNS = (
    "vr AS (SELECT *, coalesce(lag(position) OVER w, 0) * coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) - 0.001 * abs(position - "
    "coalesce(lag(position) OVER w, 0)) AS ret FROM vp WINDOW w AS (PARTITION BY asset, run ORDER BY ts)), vs AS (SELECT asset, run, CASE "
    "WHEN max(position) > 0 THEN avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(365) END AS sharpe FROM vr GROUP BY asset, run)"
)


@query(
    "parameter_stability",
    "SELECT *, flag <> 'FRAGILE' AS passed FROM (SELECT *, CASE WHEN score < 4 OR mean_sharpe < 0 THEN 'FRAGILE' "
    "WHEN score < 7 THEN 'MODERATELY_STABLE' ELSE 'STABLE' END AS flag FROM (SELECT asset, count(*) AS runs, avg(sharpe) AS mean_sharpe, greatest(0, "
    "least(10, 10 - 5 * stddev_pop(sharpe))) AS score FROM vs WHERE sharpe IS NOT NULL GROUP BY asset))",
    v.BARS_1D,
    _VARIED,
    _RUN_RETURNS,
    keys="asset", floats="mean_sharpe score", others="runs flag passed",
)
def _(spark, d):
    cross = F.array(*(F.struct(F.lit(i).alias("run"), F.when(t.mean("close", a) > t.mean("close", z), 1).otherwise(0).alias("position")) for i, (_, a, z) in enumerate(_VARIANTS)))
    rows = v.bars_1d(spark, d).withColumn("x", cross).select("asset", "ts", "close", F.explode("x").alias("x")).select("asset", "ts", "close", "x.*")
    runs = sim.equity_metrics(sim.equity(rows, by=["asset", "run"]), ["asset", "run"], 365.0)
    traded = rows.groupBy("asset", "run").agg(F.max("position").alias("traded"))
    return robustness.parameter_stability(runs.join(traded, ["asset", "run"]).withColumn("sharpe", F.when(F.col("traded") > 0, F.col("sharpe"))))


_ALL_STOPS = rp._SWEEP[2].replace("(0.0::DOUBLE), (0.5), (1), (1.5), (2), (3)", ", ".join(f"({x}::DOUBLE)" for x in (0.0, *robustness.STOPS)))


def _sweep_rows(spark: SparkSession, d: str) -> DataFrame:
    return fc.ranges(v.bars_1d(spark, d)).withColumns({"entry": sg.breakout_entry(times=1.1), "exit": sg.channel_exit(), "m5": t.mean("range", 5, 1)})


@query("stop_sweep_full", keys="asset multiplier", floats="mean_pnl win_rate sharpe", others="n")
def _(spark, d):
    return lab.stop_sweep(_sweep_rows(spark, d), [0, *robustness.STOPS], "m5")


rp.oracle("stop_sweep_full", "SELECT * FROM sweep", rp._SWEEP[0], rp._SWEEP[1], _ALL_STOPS, *rp._SWEEP[3:], keys="asset multiplier", floats="mean_pnl win_rate sharpe", others="n")

_PERIODS = (
    "parts AS (SELECT *, ntile(3) OVER (PARTITION BY asset ORDER BY ts) AS period FROM entries), stops AS (SELECT *, CASE "
    "WHEN m5 / nullif(close, 0) IS NULL THEN 0.05 ELSE greatest(0.005, least(0.2, m5 / nullif(close, 0))) END AS stop FROM parts)"
)


@query("stop_periods", keys="asset period", floats="total_return", others="n")
def _(spark, d):
    rows = ev.blocks(_sweep_rows(spark, d), 3, name="period").withColumn("stop", fc.stop_distance(F.col("m5"), F.col("close"), 1.0))
    tr = sim.stopped(rows.select("asset", "period", "ts", "open", "low", "close", "entry", "exit", "stop"), 0.001, ["asset", "period"])
    return tr.groupBy("asset", "period").agg(F.sum("pnl").alias("total_return"), F.count(F.lit(1)).alias("n"))


rp.oracle("stop_periods", "SELECT asset, period, sum(pnl) AS total_return, count(*) AS n FROM closed GROUP BY 1, 2", rp._SWEEP[0], rp._SWEEP[1], _PERIODS, rp.numbered("stops", "asset, period"), rp._stopped("asset, period"), keys="asset period", floats="total_return", others="n")

# Forecasts and trades ---------------------------------------------------------------------------------

_NEXT = f"""fm AS (SELECT asset, ts, o1 AS po, h1 AS ph, l1 AS pl, c1 AS pc, v1 AS pv, open AS ao, high AS ah, low AS al, close AS ac, volume AS av, c1 / nullif(c2, 0) - 1 AS pr, close / nullif(c1, 0) - 1 AS ar FROM (
  SELECT *, {lag('open')} AS o1, {lag('high')} AS h1, {lag('low')} AS l1, {lag('close')} AS c1, {lag('close', 2)} AS c2, {lag('volume')} AS v1 FROM d) WHERE c2 IS NOT NULL),
fd AS (SELECT *, CASE WHEN abs(ar) <= 0.0005 THEN 0 WHEN ar > 0 THEN 1 ELSE -1 END AS u, CASE WHEN abs(pr) <= 0.0005 THEN 0 WHEN pr > 0 THEN 1 ELSE -1 END AS g FROM fm)"""
_FIGURES = (
    "mae_open mae_high mae_low mae_close mae_volume rmse_close mape_close directional_accuracy bullish_accuracy bearish_accuracy mean_predicted_return "
    "mean_actual_return return_mae return_rmse return_correlation"
)


@query("forecast_metrics", """SELECT asset, count(*) AS predictions, avg(abs(po - ao)) AS mae_open, avg(abs(ph - ah)) AS mae_high, avg(abs(pl - al)) AS mae_low, avg(abs(pc - ac)) AS mae_close, avg(abs(pv - av)) AS mae_volume,
  sqrt(avg((pc - ac) ** 2)) AS rmse_close, avg(abs(pc - ac) / abs(ac)) AS mape_close, count(*) AS mape_close_valid_count, avg((u = g)::INT) FILTER (u <> 0) AS directional_accuracy, avg((g = 1)::INT) FILTER (u = 1) AS bullish_accuracy,
  avg((g = -1)::INT) FILTER (u = -1) AS bearish_accuracy, count(*) FILTER (u = 1) AS n_positive_actual, count(*) FILTER (u = -1) AS n_negative_actual, count(*) FILTER (u = 0) AS n_near_zero_actual,
  count(*) FILTER (u <> 0 AND u = g) AS n_directional_correct, count(*) FILTER (u <> 0 AND u <> g) AS n_directional_incorrect, avg(pr) AS mean_predicted_return, avg(ar) AS mean_actual_return,
  avg(abs(pr - ar)) AS return_mae, sqrt(avg((pr - ar) ** 2)) AS return_rmse, corr(pr, ar) AS return_correlation FROM fd GROUP BY asset""", v.BARS_1D, _NEXT, keys="asset", floats=_FIGURES,
    others="predictions mape_close_valid_count n_positive_actual n_negative_actual n_near_zero_actual n_directional_correct n_directional_incorrect")
def _(spark, d):
    cols = ("open", "high", "low", "close", "volume")
    rows = v.bars_1d(spark, d).withColumns({f"predicted_{c}": t.lag(c) for c in cols} | {f"actual_{c}": F.col(c) for c in cols} | {"_c2": t.lag("close", 2)})
    rows = rows.filter("_c2 IS NOT NULL").withColumns({"predicted_return": F.col("predicted_close") / F.col("_c2") - 1, "actual_return": F.col("close") / F.col("predicted_close") - 1})
    return ev.forecast_metrics(rows, ["asset"])


@query(
    "sortino_ratio",
    "SELECT asset, avg(ret) / nullif(sqrt(avg(least(ret, 0) ** 2)), 0) * sqrt(365) AS sortino, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(365) AS sharpe "
    "FROM dd GROUP BY asset",
    v.BARS_1D,
    EQUITY,
    keys="asset", floats="sortino sharpe",
)
def _(spark, d):
    return sim.equity_metrics(_trend(spark, d), periods=365.0)


def _best(span: str) -> str:
    return f"SELECT asset, max(s) AS best FROM (SELECT asset, date_trunc('{span}', make_timestamp(entry_ts * 1000)) AS m, sum(pnl) AS s FROM tp GROUP BY 1, 2) GROUP BY asset"


def _trades_sql() -> str:
    from tidemark.plans.queries import TRADES

    return TRADES


@query(
    "concentration_spans",
    f"SELECT m.asset, m.best AS best_month, q.best AS best_quarter FROM ({_best('month')}) m JOIN ({_best('quarter')}) q USING (asset)",
    v.BARS_1D,
    EQUITY,
    _trades_sql(),
    keys="asset", floats="best_month best_quarter",
)
def _(spark, d):
    return sim.concentration(sim.trades(_trend(spark, d)))


_DM = """dz AS (SELECT asset, ts, x, x - avg(x) OVER (PARTITION BY asset) AS z, count(*) OVER (PARTITION BY asset) AS n FROM (SELECT asset, ts, abs(mean5 - actual) - abs(prev - actual) AS x FROM m WHERE mean5 IS NOT NULL)),
dn AS (SELECT *, greatest(1, floor(4 * (n / 100.0) ** (2.0 / 9)))::BIGINT AS lags, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM dz),
dg AS (SELECT a.asset, b.i - a.i AS k, sum(a.z * b.z * (1 - (b.i - a.i) / (a.lags + 1.0))) AS g FROM dn a JOIN dn b ON a.asset = b.asset AND b.i > a.i AND b.i <= a.i + a.lags GROUP BY 1, 2)"""


@query(
    "dm_statistic",
    "SELECT asset, any_value(n) AS n, any_value(lags) AS lags, avg(x) AS mean_diff, avg(x) / sqrt((sum(z * z) + 2 * any_value(w)) / any_value(n) / "
    "any_value(n)) AS dm FROM dn JOIN (SELECT asset, sum(g) AS w FROM dg GROUP BY asset) USING (asset) GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    FORECASTS,
    _DM,
    keys="asset", floats="mean_diff dm", others="n lags",
)
def _(spark, d):
    r = fc.ranges(v.bars_1h(spark, d)).select("asset", "ts", (t.mean("range", 5, 1) - F.col("range")).alias("a"), (fc.persistence() - F.col("range")).alias("b"))
    return stats.diebold_mariano(r, "a", "b", ["asset"])


@query("lab_baselines", keys="name asset", floats="sharpe total_return", others="n_trades")
def _(spark, d):
    metrics, _, _ = lab.screen(v.bars_1d(spark, d), lab.table(spark, robustness.BASELINES))
    names = spark.createDataFrame([(lab.genome_id(g), g["name"]) for g in robustness.BASELINES], "genome_id string, name string")
    return metrics.join(F.broadcast(names), "genome_id")  # a fixed list


def _entries_sql(g: dict) -> tuple[str, str]:
    """Long and short entries of a baseline."""
    fast, slow, limit = g["fast"], g["slow"], g["threshold"]
    if g["family"] == "trend":
        a, z = roll(MEAN, "close", fast), roll(MEAN, "close", slow)
        return f"{a} > {z}", f"{a} < {z}"
    if g["family"] == "breakout":
        return f"close > {roll('max({})', 'high', slow, 1)}", f"close < {roll('min({})', 'low', slow, 1)}"
    if g["family"] == "reversion":
        z = f"(close - {roll(MEAN, 'close', slow)}) / nullif({roll(SD, 'close', slow)}, 0)"
        return f"{z} < -{limit}", f"{z} > {limit}"
    if g["family"] == "rsi":
        gain, loss = (f"avg(greatest({sign}chg, 0)) OVER {win(-slow + 1)}" for sign in ("", "-"))
        strength = f"CASE WHEN count(chg) OVER {win(-slow + 1)} < {slow} THEN NULL WHEN {loss} = 0 THEN 100 ELSE 100 - 100 / (1 + {gain} / {loss}) END"
        return f"{strength} < {limit}", f"{strength} > {100 - limit}"
    rate = f"close / nullif({lag('close', fast)}, 0) - 1"
    return f"{rate} > {limit / 100}", f"{rate} < -{limit / 100}"


_FLAGGED = " UNION ALL ".join(f"SELECT '{g['name']}' AS name, asset, ts, close, {ON(a)} AS le, {ON(z)} AS se FROM (SELECT *, close - {lag('close')} AS chg FROM d)" for g in robustness.BASELINES for a, z in [_entries_sql(g)])
_OPENED = "CASE WHEN x.le <> x.se THEN CASE WHEN x.le THEN 1 ELSE -1 END ELSE 0 END"
_HELD = f"""s AS (
  SELECT name, asset, i, {_OPENED} AS now, i AS since FROM x WHERE i = 1
  UNION ALL
  SELECT x.name, x.asset, x.i, CASE WHEN s.now = 0 THEN {_OPENED} WHEN x.i - s.since >= 24 OR (s.now > 0 AND x.se) OR (s.now < 0 AND x.le) THEN 0 ELSE s.now END, CASE WHEN s.now = 0 THEN x.i ELSE s.since END
  FROM s JOIN x ON x.name = s.name AND x.asset = s.asset AND x.i = s.i + 1)"""
_OVER = "OVER (PARTITION BY name, asset ORDER BY ts)"
_HELD_RETURNS = f"""ps AS (SELECT x.name, x.asset, x.ts, x.close, s.now AS position FROM x JOIN s USING (name, asset, i)),
rt AS (SELECT *, before * coalesce(close / nullif(last, 0) - 1, 0) - 0.0015 * abs(position - before) AS ret FROM (SELECT *, coalesce(lag(position) {_OVER}, 0) AS before, lag(close) {_OVER} AS last, lead(ts) {_OVER} AS nt FROM ps)),
tc AS (SELECT name, asset, count(*) FILTER (position <> 0 AND position <> before) - count(*) FILTER (position <> 0 AND nt IS NULL) AS n_trades FROM rt GROUP BY 1, 2)"""
rp.oracle(
    "lab_baselines",
    "SELECT name, asset, avg(ret) / nullif(stddev_pop(ret), 0) AS sharpe, exp(sum(ln(greatest(1 + ret, 1e-12)))) - 1 AS total_return, any_value(n_trades) AS n_trades FROM rt JOIN tc USING (name, asset) GROUP BY name, asset",
    v.BARS_1D, f"flagged AS ({_FLAGGED})", rp.numbered("flagged", "name, asset"), _HELD, _HELD_RETURNS, keys="name asset", floats="sharpe total_return", others="n_trades",
)


@query(
    "paired_blocks",
    """SELECT asset, count(*) AS n, avg(e) AS mean_diff, median(e) AS median_diff, avg(e) / nullif(stddev_samp(e), 0) AS cohen_dz, avg((sign(a) = sign(y))::INT) - avg((sign(p) = sign(y))::INT) AS delta, true AS inside
    FROM (SELECT asset, y, a, p, abs(a - y) - abs(p - y) AS e FROM (
      SELECT asset, ret AS y, (r1 + r2) / 2 AS a, r1 AS p FROM (SELECT asset, ret, lag(ret) OVER w AS r1, lag(ret, 2) OVER w AS r2 FROM (
        SELECT asset, ts, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM d) WINDOW w AS (PARTITION BY asset ORDER BY ts))) WHERE y IS NOT NULL AND a IS NOT NULL) GROUP BY asset""",
    v.BARS_1D, keys="asset", floats="mean_diff median_diff cohen_dz delta", others="n inside",
)
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("y", F.try_divide("close", t.lag("close")) - 1).withColumn("p", t.lag("y")).withColumn("a", (F.col("p") + t.lag("y", 2)) / 2).filter("y IS NOT NULL AND a IS NOT NULL")
    out = stats.both_blocks(rows, "y", "a", ["p"], ["asset"], draws=1000)
    return out.withColumn("inside", F.col("mean_diff").between(F.col("low"), F.col("high")) & F.col("delta").between(F.col("delta_low"), F.col("delta_high")))


_FEATURES = ["m1", "m5", "m22"]


@query(
    "walk_trees",
    f"SELECT asset, ts, count(m22) OVER {win('UNBOUNDED PRECEDING')} > 0 AS ready, true AS sane FROM "
    f"(SELECT *, {roll(MEAN, 'range', 22, 1)} AS m22, row_number() OVER ({W}) AS i FROM (SELECT *, greatest(high - low, 0) AS range FROM d)) WHERE i > 500",
    v.BARS_1D,
    others="ready sane",
)
def _(spark, d):
    """Forecasts of boosted trees, refitted every 400 rows: where they are, and that they lie within what was seen (trees can't leave it)."""
    own = fc.har_terms(fc.ranges(v.bars_1d(spark, d)))
    rows = ols.walk_model(own, _FEATURES, "range", trees.booster(trees=20), 400, 500)
    seen = F.max("range").over(t.past(last=-1))
    return rows.withColumn("_m", seen).filter("forecast IS NOT NULL").select("asset", "ts", F.lit(True).alias("ready"), (F.col("forecast").between(0, 1.5 * F.col("_m"))).alias("sane"))


@query(
    "tree_importances",
    "SELECT asset, count(*) > 0 AS found, 1.0::DOUBLE AS total, (max(i) - 500 + 399) // 400 AS refits FROM "
    "(SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM d) GROUP BY asset",
    v.BARS_1D,
    keys="asset", floats="total", others="found refits",
)
def _(spark, d):
    rows = trees.importances(fc.har_terms(fc.ranges(v.bars_1d(spark, d))), _FEATURES, "range", 400, 500, trees=20)
    return rows.groupBy("asset").agg(F.sum("importance").alias("total"), F.max("refits").alias("refits"), (F.count(F.lit(1)) > 0).alias("found"))
