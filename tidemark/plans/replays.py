"""SQL of the sequential queries: recursive CTEs that step through a series bar by bar.

Each rule keeps its state in a row: the next row of a series is joined by its number. The
Spark side runs the same rule as one function for each series; nothing is shared but the rule.
"""

from __future__ import annotations

from tidemark.plans import views as v
from tidemark.plans.queries import FWD, MEAN, MOM, ORACLE_SQL, QUERIES, SD, SDP, W, lag, roll, win


def oracle(name: str, body: str, *ctes: str, keys: str = "asset ts", floats: str = "", others: str = "") -> None:
    """Adds SQL for a registered query; CTEs may be recursive."""
    out = ", ".join([*keys.split(), *(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in floats.split()), *others.split()])
    ORACLE_SQL[name] = f"WITH RECURSIVE {', '.join([*ctes, f'_body AS ({body})'])} SELECT {out} FROM _body"


def numbered(source: str, by: str = "asset") -> str:
    return f"x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source})"


def true(condition: str) -> str:
    return f"coalesce({condition}, false)"


# Positions ------------------------------------------------------------------------------------------

_Z = f"(close - {roll(MEAN, 'close', 20)}) / nullif({roll(SD, 'close', 20)}, 0)"
_FLAGS = f"flags AS (SELECT asset, ts, close, {true('z < -1.5')} AS le, {true('z > 0')} AS lx, {true('z > 1.5')} AS se, {true('z < 0')} AS sx FROM (SELECT *, {_Z} AS z FROM d))"
_OPEN = "CASE WHEN x.le <> x.se THEN CASE WHEN x.le THEN 1 ELSE -1 END ELSE 0 END"
_CLOSES = "(x.i - s.since >= 20 OR (s.now > 0 AND (x.lx OR x.se)) OR (s.now < 0 AND (x.sx OR x.le)))"
_POSITIONS = f"""s AS (
  SELECT asset, i, {_OPEN} AS now, i AS since FROM x WHERE i = 1
  UNION ALL
  SELECT x.asset, x.i, CASE WHEN s.now = 0 THEN {_OPEN} WHEN {_CLOSES} THEN 0 ELSE s.now END,
    CASE WHEN s.now = 0 THEN x.i ELSE s.since END
  FROM s JOIN x ON x.asset = s.asset AND x.i = s.i + 1)"""
_RUNS = f"""held AS (SELECT x.*, s.now AS position FROM x JOIN s USING (asset, i)),
runs AS (
  SELECT *, sum((position <> before)::INT) OVER {win('UNBOUNDED PRECEDING')} AS trade
  FROM (SELECT *, coalesce({lag('position')}, 0) AS before, lead(ts) OVER ({W}) AS nt, lead(close) OVER ({W}) AS nc FROM held))"""
oracle(
    "sequentialized_trades",
    "SELECT asset, min(ts) AS entry_ts, any_value(position) AS direction, count(*) AS bars, any_value(position) * (arg_max(nc, ts) / arg_min(close, ts) - 1) - 0.002 AS pnl FROM runs WHERE position <> 0 GROUP BY asset, trade HAVING arg_max(coalesce(nt, -1), ts) > 0",
    v.BARS_1D, _FLAGS, numbered("flags"), _POSITIONS, _RUNS, keys="asset entry_ts", floats="pnl", others="direction bars",
)

# Accounts -------------------------------------------------------------------------------------------

_BANDS = f"bands AS (SELECT asset, ts, close, {true('close < m - 2 * sd')} AS e, {true('close > m')} AS o FROM (SELECT *, {roll(MEAN, 'close', 20)} AS m, {roll(SDP, 'close', 20)} AS sd FROM d))"
_BUYS = "s.units = 0 AND x.e AND NOT x.o AND x.close > 0"
_SELLS = "s.units <> 0 AND x.o"
oracle(
    "sim_long_flat",
    "SELECT asset, ts, units, cash, cash + units * close AS value FROM s JOIN x USING (asset, i)",
    v.BARS_1D, _BANDS, numbered("bands"),
    f"""s AS (
  SELECT asset, 0::BIGINT AS i, 0.0::DOUBLE AS units, 10000.0::DOUBLE AS cash FROM x WHERE i = 1
  UNION ALL
  SELECT x.asset, x.i, CASE WHEN {_SELLS} THEN 0 WHEN {_BUYS} THEN s.cash * (1 - 0.001) / (x.close * (1 + 0.0005)) ELSE s.units END,
    CASE WHEN {_SELLS} THEN s.units * x.close * (1 - 0.0005) * (1 - 0.001) WHEN {_BUYS} THEN 0 ELSE s.cash END
  FROM s JOIN x ON x.asset = s.asset AND x.i = s.i + 1)""",
    floats="units cash value",
)

_FILL = "(x.close * (1 + 0.001 * x.signal))"
_SIGNALS = f"signals AS (SELECT asset, ts, close, coalesce(sign({_Z}), 0)::INT AS signal, 0.0005::DOUBLE AS q FROM d)"
_PAID = "(s.held * 0.001)"
oracle(
    "paper_broker",
    "SELECT asset, ts, action, pnl, cash, CASE side WHEN 0 THEN cash WHEN 1 THEN cash + q0 * close ELSE cash + held + (entry - close) * q0 END AS value FROM s JOIN x USING (asset, i)",
    v.BARS_1D, _SIGNALS, numbered("signals"),
    f"""s AS (
  SELECT asset, 0::BIGINT AS i, 100.0::DOUBLE AS cash, 0 AS side, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS held, ''::VARCHAR AS action, NULL::DOUBLE AS pnl FROM x WHERE i = 1
  UNION ALL
  SELECT asset, i,
    CASE does WHEN 'OPEN' THEN cash - cost * 0.001 - CASE WHEN signal > 0 THEN cost ELSE 0 END
      WHEN 'CLOSE' THEN cash + CASE WHEN side > 0 THEN close_cost * (1 - 0.001) ELSE held + gain END ELSE cash END,
    CASE does WHEN 'OPEN' THEN signal WHEN 'CLOSE' THEN 0 ELSE side END,
    CASE does WHEN 'OPEN' THEN q ELSE q0 END, CASE does WHEN 'OPEN' THEN fill ELSE entry END, CASE does WHEN 'OPEN' THEN cost ELSE held END,
    does, CASE does WHEN 'CLOSE' THEN gain END
  FROM (
    SELECT x.asset, x.i, x.signal, x.q, s.cash, s.side, s.q0, s.entry, s.held, {_FILL} AS fill, {_FILL} * x.q AS cost, {_FILL} * s.q0 AS close_cost,
      ({_FILL} - s.entry) * s.q0 * s.side - {_FILL} * s.q0 * 0.001 - {_PAID} AS gain,
      CASE WHEN x.signal = 0 THEN '' WHEN s.side <> 0 THEN 'CLOSE' WHEN {_FILL} * x.q * 1.001 > s.cash THEN 'REJECTED' ELSE 'OPEN' END AS does
    FROM s JOIN x ON x.asset = s.asset AND x.i = s.i + 1))""",
    floats="cash value pnl", others="action",
)

# Two legs -------------------------------------------------------------------------------------------

_PAIR = "pair AS (SELECT 'A/R' AS asset, a.ts, a.close AS ac, r.close AS rc FROM {0} a JOIN {0} r ON a.asset = 'A' AND r.asset = 'R' AND a.ts = r.ts)"
_SPREAD = f"""spread AS (
  SELECT asset, ts, ac, rc, {true('z < -1')} AS e, {true('z > 0')} AS o
  FROM (SELECT *, (w - {roll(MEAN, 'w', 20, 0, 10)}) / nullif({roll(SD, 'w', 20, 0, 10)}, 0) AS z FROM (SELECT *, CASE WHEN ac > 0 AND rc > 0 THEN ln(ac / rc) END AS w FROM pair)))"""
oracle(
    "sim_two_leg",
    "SELECT a.ts AS entry_ts, b.ts AS exit_ts, (b.ac / a.ac - 1) - (b.rc / a.rc - 1) - 0.006 AS pnl FROM s JOIN x a ON a.i = s.left_ JOIN x b ON b.i = s.i",
    v.BARS_1D, _PAIR.format("d"), _SPREAD, numbered("spread"),
    """s AS (
  SELECT 1::BIGINT AS i, 0::BIGINT AS since, 0::BIGINT AS left_
  UNION ALL
  SELECT x.i, CASE WHEN s.since > 0 AND p.o THEN 0 WHEN s.since = 0 AND p.e THEN x.i ELSE s.since END, CASE WHEN s.since > 0 AND p.o THEN s.since ELSE 0 END
  FROM s JOIN x ON x.i = s.i + 1 JOIN x p ON p.i = s.i)""",
    keys="entry_ts exit_ts", floats="pnl",
)

_SMOOTH = f"smooth AS (SELECT asset, ts, close FROM (SELECT asset, ts, {roll(MEAN, 'close', 50)} AS close FROM d) WHERE close IS NOT NULL)"
oracle(
    "sim_rebalanced",
    "SELECT ts, va + vb AS equity, va / (va + vb) AS weight FROM s JOIN x USING (i)",
    v.BARS_1D, _SMOOTH, _PAIR.format("smooth"), numbered("pair"),
    """s AS (
  SELECT 1::BIGINT AS i, 0.5::DOUBLE AS va, 0.5::DOUBLE AS vb
  UNION ALL
  SELECT i, CASE WHEN moves THEN after / 2 ELSE a END, CASE WHEN moves THEN after / 2 ELSE b END
  FROM (
    SELECT *, a + b - abs(a - (a + b) * 0.5) * 2 * 10.0 / 1e4 AS after, ts % 86400000 = 0 AND abs(a / (a + b) - 0.5) > 0.02 AS moves
    FROM (SELECT x.i, x.ts, s.va * x.ac / p.ac AS a, s.vb * x.rc / p.rc AS b FROM s JOIN x ON x.i = s.i + 1 JOIN x p ON p.i = s.i)))""",
    keys="ts", floats="equity weight",
)

# Stops ----------------------------------------------------------------------------------------------

_ENTRIES = f"""entries AS (
  SELECT asset, ts, open, low, close, {true('range > 1.1 * m')} AS e, {true('close < lo')} AS o, m5
  FROM (SELECT *, {roll(MEAN, 'range', 20)} AS m, {roll('min({})', 'close', 10, 1)} AS lo, {roll(MEAN, 'range', 5, 1)} AS m5 FROM (SELECT *, high - low AS range FROM d)))"""


def _stopped(by: str, roi: str = "NULL::DOUBLE") -> str:
    """Steps through series of columns open, low, close, e, o, stop. roi: the least profit at the number of bars held (x.i - s.since)."""
    same = " AND ".join(f"x.{k} = s.{k}" for k in by.split(", "))
    keys = ", ".join(f"x.{k}" for k in by.split(", "))
    why = f"CASE WHEN s.since = 0 THEN '' WHEN x.low <= s.price * (1 - s.share) THEN 'stop' WHEN x.close / s.price - 1 >= {roi} THEN 'roi' WHEN x.o THEN 'exit' WHEN x.i = x.n THEN 'end' ELSE '' END"
    return f"""s AS (
  SELECT {by}, 0::BIGINT AS i, 0::BIGINT AS since, 0.0::DOUBLE AS price, 0.0::DOUBLE AS share, ''::VARCHAR AS reason, NULL::DOUBLE AS fill, 0::BIGINT AS left_, 0.0::DOUBLE AS paid FROM x WHERE i = 1
  UNION ALL
  SELECT {by}, i, CASE WHEN why <> '' THEN 0 WHEN opens THEN i ELSE since END, CASE WHEN opens THEN close ELSE price END, CASE WHEN opens THEN stop ELSE share END,
    why, CASE WHEN why = 'stop' THEN least(price * (1 - share), open) WHEN why <> '' THEN close END, since, price
  FROM (SELECT {keys}, x.i, x.open, x.close, x.stop, s.since, s.price, s.share, {why} AS why, s.since = 0 AND x.e AND x.i < x.n AND x.close > 0 AS opens FROM s JOIN x ON {same} AND x.i = s.i + 1)),
closed AS (SELECT {", ".join(f"s.{k}" for k in by.split(", "))}, a.ts AS entry_ts, b.ts AS exit_ts, s.reason, s.fill * (1 - 0.001) / (s.paid * (1 + 0.001)) - 1 AS pnl
  FROM s JOIN x a ON {same.replace("x.", "a.")} AND a.i = s.left_ JOIN x b ON {same.replace("x.", "b.")} AND b.i = s.i WHERE s.reason <> '')"""


oracle(
    "stop_with_roi", "SELECT * FROM closed",
    v.BARS_1D, _ENTRIES, "stops AS (SELECT *, 0.2::DOUBLE AS stop FROM entries)", numbered("stops"),
    _stopped("asset", "CASE WHEN x.i - s.since >= 10 THEN 0.05 WHEN x.i - s.since >= 3 THEN 0.2 ELSE 0.5 END"),
    keys="asset entry_ts", floats="pnl", others="exit_ts reason",
)

_SHARE = "multiplier * m5 / nullif(close, 0)"
_SWEEP = [
    v.BARS_1D, _ENTRIES,
    f"stops AS (SELECT *, CASE WHEN multiplier = 0 OR {_SHARE} IS NULL THEN 0.05 ELSE greatest(0.005, least(0.2, {_SHARE})) END AS stop FROM entries CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1), (1.5), (2), (3)) AS t(multiplier))",
    numbered("stops", "asset, multiplier"), _stopped("asset, multiplier"),
    """sweep AS (SELECT asset, multiplier, count(*) AS n, avg(pnl) AS mean_pnl, avg((pnl > 0)::INT) AS win_rate, sum(pnl) FILTER (pnl > 0) / nullif(sum(-pnl) FILTER (pnl < 0), 0) AS profit_factor,
  avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0) AS t_stat, avg(pnl) / nullif(stddev_pop(pnl), 0) AS sharpe FROM closed GROUP BY asset, multiplier)""",
]
oracle("stop_sweep", "SELECT * FROM sweep", *_SWEEP, keys="asset multiplier", floats="mean_pnl win_rate profit_factor", others="n")
oracle(
    "sweep_gates",
    "SELECT *, (G1::INT + G2::INT + G3::INT + G4::INT + G5::INT + G6::INT)::BIGINT AS passed, CASE WHEN G1 AND G2 AND G3 AND G4 AND G5 AND G6 THEN 'pass' ELSE 'fail' END AS verdict FROM judged",
    *_SWEEP,
    "best AS (SELECT asset, coalesce(-max(CASE WHEN multiplier > 0 AND n >= 30 AND sharpe > 0 THEN (sharpe, -multiplier) END)[2], 0.0) AS multiplier FROM sweep GROUP BY asset)",
    f"""judged AS (SELECT s.asset, s.multiplier, {true('s.sharpe > b.sharpe')} AS G1, {true('s.mean_pnl > b.mean_pnl')} AS G2, {true('s.win_rate >= b.win_rate')} AS G3, s.n >= 30 AS G4,
  {true('s.profit_factor > 1')} AS G5, {true('s.t_stat > 1.959963984540054')} AS G6 FROM sweep s JOIN best USING (asset, multiplier) JOIN sweep b ON b.asset = s.asset AND b.multiplier = 0)""",
    keys="asset multiplier", others="G1 G2 G3 G4 G5 G6 passed verdict",
)

# Regimes and neighbours -------------------------------------------------------------------------------

oracle(
    "regime_tracking",
    """SELECT asset, count(*) AS regimes, bool_and(coalesce(up, true)) AS monotone, (max(f) - min(f)) / nullif(avg(f), 0) AS spread,
  count(*) >= 2 AND bool_and(coalesce(up, true)) AND (max(f) - min(f)) / nullif(avg(f), 0) >= 0.1 AS tracks
FROM (SELECT *, (f >= lag(f) OVER w) = (a >= lag(a) OVER w) AS up FROM (
  SELECT asset, CASE regime WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r, count(*) AS n, avg(predicted_range) AS f, avg(actual_range) AS a FROM c GROUP BY 1, 2)
  WHERE n >= 5 WINDOW w AS (PARTITION BY asset ORDER BY r)) GROUP BY asset""",
    v.BARS_1H, v.RANGES, v.PREDICTIONS, keys="asset", floats="spread", others="regimes monotone tracks",
)

_TERMS = f"""hr AS (SELECT asset, ts, range AS y, {lag('range')} AS m1, {roll(MEAN, 'range', 5, 1)} AS m5, {roll(MEAN, 'range', 22, 1)} AS m22, row_number() OVER ({W}) - 1 AS i
  FROM (SELECT *, greatest(high - low, 0) AS range FROM d)),
asked AS (SELECT *, 500 + (i - 500) // 200 * 200 AS a FROM hr WHERE i >= 500 AND m22 IS NOT NULL AND m5 IS NOT NULL AND m1 IS NOT NULL),
past AS (SELECT * FROM hr WHERE m22 IS NOT NULL AND m5 IS NOT NULL AND m1 IS NOT NULL),
scale AS (SELECT k.asset, k.a, stddev_pop(p.m1) + 1e-12 AS s1, stddev_pop(p.m5) + 1e-12 AS s5, stddev_pop(p.m22) + 1e-12 AS s22
  FROM (SELECT DISTINCT asset, a FROM asked) k JOIN past p ON p.asset = k.asset AND p.i < k.a GROUP BY 1, 2),
near AS (SELECT q.asset, q.ts, p.y, row_number() OVER (PARTITION BY q.asset, q.ts ORDER BY ((p.m1 - q.m1) / s1) ** 2 + ((p.m5 - q.m5) / s5) ** 2 + ((p.m22 - q.m22) / s22) ** 2, p.i) AS k
  FROM asked q JOIN scale USING (asset, a) JOIN past p ON p.asset = q.asset AND p.i < q.a)"""
oracle("walk_model", "SELECT asset, ts, avg(y) AS forecast FROM near WHERE k <= 25 GROUP BY asset, ts", v.BARS_1D, _TERMS, floats="forecast")

# Autoregressions, by Cramer's rule on moving covariances ----------------------------------------------

#: Terms by their names in the sums below; 4 is what is forecast.
_NAMES = {1: "m1", 2: "m5", 3: "m22", 4: "y"}


def _fits(source: str, value: str, window: int | None, by: str = "asset") -> str:
    """CTEs: `fit` with n_obs and coefficients b0 to b3 of each row of a source, on the rows before it."""
    frame = f"(PARTITION BY {by} ORDER BY ts ROWS BETWEEN {'UNBOUNDED' if window is None else window} PRECEDING AND 1 PRECEDING)"
    mean = lambda w: f"CASE WHEN count({value}) OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) >= {w} THEN avg({value}) OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END"
    sums = ", ".join(f"covar_pop(c{a}, c{z}) OVER f AS s{a}{z}" for a in range(1, 5) for z in range(a, 5) if a < 4)
    means = ", ".join(f"avg(c{k}) OVER f AS a{k}" for k in range(1, 5))
    whole = " AND ".join(f"{x} IS NOT NULL" for x in _NAMES.values())
    kept = ", ".join(f"CASE WHEN {whole} THEN {x} END AS c{k}" for k, x in _NAMES.items())
    det = lambda p, q, r, t, u, x: f"({p} * ({t} * {x} - {u} * {u}) - {q} * ({q} * {x} - {u} * {r}) + {r} * ({q} * {u} - {t} * {r}))"
    b1 = "(s14 * (s22 * s33 - s23 * s23) - s12 * (s24 * s33 - s23 * s34) + s13 * (s24 * s23 - s22 * s34))"
    b2 = "(s11 * (s24 * s33 - s34 * s23) - s14 * (s12 * s33 - s23 * s13) + s13 * (s12 * s34 - s24 * s13))"
    b3 = "(s11 * (s22 * s34 - s23 * s24) - s12 * (s12 * s34 - s24 * s13) + s14 * (s12 * s23 - s22 * s13))"
    return f"""terms AS (SELECT {by}, ts, {value} AS y, {mean(1)} AS m1, {mean(5)} AS m5, {mean(22)} AS m22 FROM {source}),
used AS (SELECT *, {kept} FROM terms),
cov AS (SELECT {by}, ts, y, m1, m5, m22, count(c4) OVER f AS n_obs, {sums}, {means} FROM used WINDOW f AS {frame}),
slopes AS (SELECT *, {b1} / d AS b1, {b2} / d AS b2, {b3} / d AS b3 FROM (SELECT *, {det('s11', 's12', 's13', 's22', 's23', 's33')} AS d FROM cov WHERE n_obs >= 24)),
fit AS (SELECT *, a4 - b1 * a1 - b2 * a2 - b3 * a3 AS b0 FROM slopes),
forecasts AS (SELECT *, b0 + b1 * m1 + b2 * m5 + b3 * m22 AS har FROM fit)"""


_DAILY = [v.BARS_1D, "ranges AS (SELECT *, greatest(high - low, 0) AS range FROM d)"]
oracle("har_coefficients", "SELECT asset, coefficient, avg(x) AS mean, stddev_pop(x) AS deviation FROM (UNPIVOT (SELECT asset, b0, b1, b2, b3 FROM fit) ON b0, b1, b2, b3 INTO NAME coefficient VALUE x) GROUP BY 1, 2", *_DAILY, _fits("ranges", "range", 512), keys="asset coefficient", floats="mean deviation")
oracle("har_forecast", "SELECT asset, ts, round(har, 4) AS har, n_obs FROM forecasts", *_DAILY, _fits("ranges", "range", 512), floats="har", others="n_obs")
oracle("har_walk_expanding", "SELECT asset, ts, round(har, 4) AS har, n_obs FROM forecasts WHERE har > 0", *_DAILY, _fits("ranges", "range", None), floats="har", others="n_obs")

_VARIANCE = f"""moves AS (SELECT asset, ts // 86400000 * 86400000 AS ts, CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END AS x FROM (SELECT * FROM b WHERE close > 0)),
variance AS (SELECT asset, ts, sum(x * x) AS rv FROM moves GROUP BY 1, 2)"""
oracle("har_rv_daily", "SELECT asset, ts, sqrt(greatest(har, 1e-12)) AS vol, n_obs FROM forecasts", v.BARS_1H, _VARIANCE, _fits("variance", "rv", 20).replace(">= 24", ">= 5"), floats="vol", others="n_obs")

# Studies and their gates --------------------------------------------------------------------------------

_TERCILE = lambda q: f"CASE WHEN count(m) OVER {win(-199)} >= 2 THEN quantile_cont(m, {q}) OVER {win(-199)} END"
_STUDY = [
    *_DAILY, _fits("ranges", "range", 512),
    f"""states AS (SELECT asset, ts, range, prev, scale, xs, CASE WHEN m IS NULL OR lo IS NULL THEN 'undefined' WHEN m < lo THEN 'low' WHEN m > hi THEN 'high' ELSE 'medium' END AS regime
  FROM (SELECT *, {_TERCILE('1 / 3.0::DOUBLE')} AS lo, {_TERCILE('2 / 3.0::DOUBLE')} AS hi FROM (
    SELECT *, {roll(MEAN, 'range', 22, 1)} AS m, {lag('range')} AS prev, {lag('close')} AS scale, list(range) OVER {win(-120, -1)} AS xs FROM ranges)))""",
    """joined AS (SELECT s.asset, s.ts, s.range AS actual, f.har, s.prev, s.scale, s.regime, list_reduce(s.xs, lambda a, x: a + (2.0 / 23) * (x - a)) AS ewma
  FROM states s JOIN forecasts f ON f.asset = s.asset AND f.ts = s.ts WHERE f.har IS NOT NULL)""",
    """dealt AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS p, count(*) OVER (PARTITION BY asset) AS n FROM joined),
framed AS (SELECT *, least(500, n // 3) AS k FROM dealt),
study AS (SELECT * FROM (SELECT *, CASE WHEN p <= k THEN 'older' WHEN p > n - k THEN 'recent' WHEN p > n // 2 - k // 2 AND p <= n // 2 - k // 2 + k THEN 'middle' END AS win FROM framed) WHERE win IS NOT NULL),
valid AS (SELECT * FROM study WHERE actual IS NOT NULL AND har IS NOT NULL AND prev IS NOT NULL AND ewma IS NOT NULL AND scale > 0)""",
]


def _records(by: str) -> str:
    return f"""SELECT *, n < 100 AS low_power, mae_primary < mae_base AS beats_base, mae_primary < mae_second AS beats_second, nmae_primary < nmae_base AS beats_norm, nr_primary < nr_base AS beats_norm_rmse FROM (
  SELECT {by}, count(*) AS n, avg(abs(har - actual)) AS mae_primary, avg(abs(prev - actual)) AS mae_base, avg(abs(ewma - actual)) AS mae_second, avg(abs(har - actual) / scale) AS nmae_primary, avg(abs(prev - actual) / scale) AS nmae_base,
    sqrt(avg((abs(har - actual) / scale) ** 2)) AS nr_primary, sqrt(avg((abs(prev - actual) / scale) ** 2)) AS nr_base FROM valid GROUP BY {by})"""


oracle(
    "window_records", f"SELECT *, win AS window_name FROM ({_records('asset, win')})", *_STUDY,
    keys="asset window_name", floats="mae_primary mae_base mae_second nmae_primary nmae_base", others="n low_power beats_base beats_second beats_norm",
)

#: Two-sided critical values of the normal distribution at 0.0125 and 0.05, one-sided at 0.05.
_Z_0125, _Z_05, _Z_ONE = 2.497705474412477, 1.959963984540054, 1.6448536269514722
_GATES = [
    *_STUDY,
    f"records AS ({_records('asset, win')}), regimes AS ({_records('regime')})",
    """steps AS (SELECT *, (f >= lag(f) OVER w) = (a >= lag(a) OVER w) AS up FROM (
  SELECT asset, win, CASE regime WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r, count(*) AS n, avg(har) AS f, avg(actual) AS a FROM study WHERE regime <> 'undefined' AND har IS NOT NULL AND actual IS NOT NULL GROUP BY 1, 2, 3)
  WHERE n >= 5 WINDOW w AS (PARTITION BY asset, win ORDER BY r)),
tracking AS (SELECT asset, win, count(*) >= 2 AND bool_and(coalesce(up, true)) AND (max(f) - min(f)) / nullif(avg(f), 0) >= 0.1 AS tracks FROM steps GROUP BY 1, 2)""",
    """diffs AS (SELECT x, x - avg(x) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY asset, ts) AS i FROM (SELECT asset, ts, abs((har - actual) / scale) - abs((prev - actual) / scale) AS x FROM study WHERE har IS NOT NULL AND prev IS NOT NULL AND scale <> 0)),
lagged AS (SELECT *, greatest(1, floor(4 * (n / 100.0) ** (2.0 / 9)))::BIGINT AS lags FROM diffs),
weighted AS (SELECT sum(a.z * b.z * (1 - (b.i - a.i) / (a.lags + 1.0))) AS w FROM lagged a JOIN lagged b ON b.i > a.i AND b.i <= a.i + a.lags),
pooled AS (SELECT avg(x) AS mean_diff, avg(x) / sqrt((sum(z * z) + 2 * any_value(w)) / any_value(n) / any_value(n)) AS dm FROM lagged, weighted)""",
    "counted AS (SELECT r.*, coalesce(t.tracks, false) AS tracks FROM records r LEFT JOIN tracking t USING (asset, win) WHERE NOT low_power)",
    "better AS (SELECT count(*) FILTER (beats_base) AS regimes FROM regimes)",
]


def _verdict(checks: int, best: str) -> str:
    names = [f"c{i}" for i in range(1, checks + 1)]
    passed = " + ".join(f"{c}::INT" for c in names)
    return f"SELECT *, ({passed})::BIGINT AS passed, CASE WHEN eligible = 0 THEN 'pending' WHEN {' AND '.join(names)} THEN '{best}' WHEN c1 THEN 'B' ELSE 'C' END AS verdict FROM judged"


oracle(
    "breadth_gate", _verdict(8, "A"), *_GATES,
    f"""judged AS (SELECT count(*) AS eligible, count(*) FILTER (beats_base) * 2 > count(*) AS c1, count(*) FILTER (beats_second) * 2 > count(*) AS c2,
  (SELECT count(*) FROM (SELECT 1 FROM counted GROUP BY asset HAVING count(*) FILTER (beats_base) >= 2)) >= 2 AS c3, (SELECT count(*) FROM (SELECT 1 FROM counted GROUP BY win HAVING count(*) FILTER (beats_base) >= 2)) >= 2 AS c4,
  count(*) FILTER (beats_norm) * 2 > count(*) AS c5, (SELECT abs(dm) > {_Z_0125} AND mean_diff < 0 FROM pooled) AS c6, count(*) FILTER (tracks) * 2 > count(*) AS c7, (SELECT regimes >= 2 FROM better) AS c8 FROM counted)""",
    keys="verdict", others="eligible c1 c2 c3 c4 c5 c6 c7 c8 passed",
)
oracle(
    "asset_gate", _verdict(7, "PASS"), *_GATES,
    f"""each AS (SELECT asset, count(*) >= 3 AND count(*) FILTER (beats_norm) >= 2 AS m, count(*) >= 3 AND count(*) FILTER (beats_norm_rmse) >= 2 AS r FROM counted GROUP BY asset),
judged AS (SELECT count(*) AS eligible, (SELECT count(*) FILTER (m) >= 1 FROM each) AS c1, (SELECT count(*) FILTER (m) >= 3 FROM each) AS c2, (SELECT count(*) FILTER (r) >= 3 FROM each) AS c3,
  count(*) FILTER (beats_base) * 2 > count(*) AS c4, (SELECT abs(dm) > {_Z_05} AND mean_diff < 0 FROM pooled) AS c5, (SELECT regimes >= 2 FROM better) AS c6, true AS c7 FROM counted)""",
    keys="verdict", others="eligible c1 c2 c3 c4 c5 c6 c7 passed",
)

# Directions ---------------------------------------------------------------------------------------------

_EVENTS = f"""ev AS (SELECT *, ntile(3) OVER (PARTITION BY asset ORDER BY ts) AS block FROM fw),
zs AS (SELECT *, x - avg(x) OVER () AS z, avg(x) OVER () AS mu, count(*) OVER () AS n FROM (SELECT asset, ts, correct - 0.5 AS x FROM fw)),
ls AS (SELECT *, lag(z, 1) OVER w AS l1, lag(z, 2) OVER w AS l2, lag(z, 3) OVER w AS l3 FROM zs WINDOW w AS (ORDER BY ts, asset)),
flip AS (SELECT any_value(mu) + 0.5 AS hit_rate, any_value(mu) / sqrt((sum(z * z) + 2 * (0.75 * coalesce(sum(z * l1), 0) + 0.5 * coalesce(sum(z * l2), 0) + 0.25 * coalesce(sum(z * l3), 0))) / any_value(n) / any_value(n)) AS dm FROM ls),
thirds AS (SELECT min(h) AS worst_window, arg_min(h, block) AS older, arg_max(h, block) AS recent FROM (SELECT block, avg(correct) AS h FROM ev GROUP BY block)),
sides AS (SELECT min(h) AS worst_asset, min(k) AS least_n FROM (SELECT asset, avg(correct) AS h, count(*) AS k FROM fw GROUP BY asset)),
judged AS (SELECT hit_rate, hit_rate > 0.55 AND worst_asset > 0.55 AS G1, dm > {_Z_ONE} AS G2, worst_asset > 0.5 AS G3, worst_window > 0.5 AS G4, recent >= older - 0.1 AS G5, least_n >= 30 AS G6 FROM flip, thirds, sides)"""

# the gates alone: the p-value needs an error function, its comparison a critical value only
QUERIES["direction_gates_verdict"] = lambda spark, d: QUERIES["direction_gates"](spark, d).drop("p_value")
oracle(
    "direction_gates_verdict",
    "SELECT 'momentum' AS study, *, (G1::INT + G2::INT + G3::INT + G4::INT + G5::INT + G6::INT)::BIGINT AS passed, CASE WHEN G1 AND G2 AND G3 AND G4 AND G5 AND G6 THEN 'SIGNAL FOUND' ELSE 'CLOSED' END AS verdict FROM judged",
    v.BARS_1H, MOM, FWD, _EVENTS, keys="study", floats="hit_rate", others="G1 G2 G3 G4 G5 G6 passed verdict",
)
