"""Queries of forecasts to come, their summaries, memberships and snapshots, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.operators import bars as b
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import forecast as fc
from tidemark.operators import gates, lab, reports
from tidemark.operators import signals as sg
from tidemark.plans import views as v
from tidemark.plans.queries import LOGRET, MEAN, SD, query, roll
from tidemark.plans.replays import _fits, oracle
from tidemark.plans.storage import scratch
from tidemark.schema import DAY_MS, FORWARD_RETURNS, HOUR_MS, PREDICTIONS, evolve
from tidemark.sources import readers, sinks

_MORE = "rows AS (SELECT asset, ts, greatest(high - low, 0) AS range FROM d UNION ALL SELECT asset, max(ts) + 1, NULL FROM d GROUP BY asset)"


@query("har_next", keys="asset", floats="har", others="n_obs")
def _(spark, d):
    return fc.har_next(v.kept(fc.ranges(v.bars_1d(spark, d))), window=512).withColumn("har", F.round("har", 4))


oracle("har_next", "SELECT asset, round(har, 4) AS har, n_obs FROM forecasts WHERE y IS NULL", v.BARS_1D, _MORE, _fits("rows", "range", 512), keys="asset", floats="har", others="n_obs")


@query("coefficient_series", keys="asset ts", floats="slope_1 slope_22")
def _(spark, d):
    rows = fc.har(v.kept(fc.ranges(v.bars_1d(spark, d))), window=512).filter("beta IS NOT NULL")
    return rows.select("asset", "ts", *(F.round(F.element_at("beta", k), 4).alias(name) for k, name in ((2, "slope_1"), (4, "slope_22"))))


oracle(
    "coefficient_series",
    "SELECT asset, ts, round(b1, 4) AS slope_1, round(b3, 4) AS slope_22 FROM fit",
    v.BARS_1D, "ranges AS (SELECT *, greatest(high - low, 0) AS range FROM d)", _fits("ranges", "range", 512), floats="slope_1 slope_22",
)


@query(
    "settlement_features",
    f"SELECT x.asset, x.ts, nr, m1, m5, m22, CASE WHEN x.ts - max(f.ts) <= {8 * HOUR_MS} THEN avg(f.rate) END AS funding_24h FROM "
    f"(SELECT asset, ts, nr, {roll(MEAN, 'nr', 1, 1)} AS m1, {roll(MEAN, 'nr', 5, 1)} AS m5, {roll(MEAN, 'nr', 22, 1)} AS m22 FROM (SELECT *, greatest(high - low, 0) / nullif(close, 0) AS nr FROM b)) x "
    f"LEFT JOIN f ON f.ts > x.ts - {DAY_MS} AND f.ts <= x.ts GROUP BY x.asset, x.ts, nr, m1, m5, m22",
    v.BARS_1H,
    v.FUNDING,
    floats="nr m1 m5 m22 funding_24h",
)
def _(spark, d):
    return ft.settlement(v.bars_1h(spark, d), v.funding_by_asset(spark, d), ["asset"])


@query(
    "scored_rows",
    "SELECT asset, ts, actual_range - predicted_range AS error, abs(actual_range - predicted_range) AS abs_error FROM p WHERE actual_range > 0 AND isfinite(actual_range) AND isfinite(predicted_range)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="error abs_error",
)
def _(spark, d):
    return reports.completed(v.predictions(spark, d))


@query(
    "breakout_rows",
    "SELECT asset, ts, round(actual_range / predicted_range, 2) AS ratio FROM p WHERE actual_range > 0 AND predicted_range > 0 AND actual_range >= 1.5 * predicted_range",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="ratio",
)
def _(spark, d):
    return reports.breakouts(v.predictions(spark, d), 1.5)


@query(
    "finite_pairs",
    "SELECT asset, count(*) AS n, avg(abs(prev - range)) AS mae FROM (SELECT asset, range, lag(range) OVER (PARTITION BY asset ORDER BY ts) AS prev FROM r) WHERE prev IS NOT NULL AND range IS NOT NULL GROUP BY asset",
    v.BARS_1H,
    v.RANGES,
    keys="asset", floats="mae", others="n",
)
def _(spark, d):
    rows = blocks.bounded(fc.ranges(v.bars_1h(spark, d)), lambda x: x.withColumn("prev", fc.persistence()), 1)
    return ev.error_profile(rows, ["asset"], "range", "prev")


@query(
    "last_closed_bar",
    f"SELECT asset, max(ts) AS ts, arg_max(open, ts) AS open, arg_max(close, ts) AS close FROM b WHERE ts + {HOUR_MS} <= 1705500000000 GROUP BY asset",
    v.BARS_1H,
    floats="open close",
)
def _(spark, d):
    rows = b.closed(v.bars_1h(spark, d), 1705500000000, HOUR_MS)
    return rows.groupBy("asset").agg(F.max("ts").alias("ts"), F.max_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))


@query(
    "hour_membership",
    "SELECT b.asset, b.ts, (h.slot IS NOT NULL)::BIGINT AS signal FROM b LEFT JOIN (SELECT asset, slot FROM (SELECT asset, hour(make_timestamp(ts * 1000)) AS slot, row_number() OVER (PARTITION BY asset ORDER BY count(*) DESC, hour(make_timestamp(ts * 1000))) AS r "
    "FROM b GROUP BY 1, 2) WHERE r <= 3) h ON h.asset = b.asset AND h.slot = hour(make_timestamp(b.ts * 1000))",
    v.BARS_1H,
    others="signal",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    counts = rows.groupBy("asset", F.hour(F.timestamp_millis("ts")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "slot"))
    return sg.hour_signal(rows, counts.withColumn("r", place).filter("r <= 3"))


@query(
    "src_premium_basis",
    "SELECT asset, ts, close / nullif(open, 0) - 1 AS basis FROM b",
    v.BARS_1H,
    floats="basis",
)
def _(spark, d):
    path = scratch(spark)
    v.bars_1h(spark, d).select("asset", "ts", F.col("close").alias("mark"), F.col("open").alias("index")).write.json(path)
    return readers.premium_json(spark, path)


@query(
    "stored_returns",
    "SELECT asset, breakout_ts, horizon, forward_return FROM (SELECT asset, ts AS breakout_ts, unnest([1, 2]) AS horizon, close FROM b WHERE volume > 2) x JOIN (SELECT asset AS a, ts AS t, close AS c FROM b) y ON y.a = x.asset AND y.t = breakout_ts + horizon * 3600000, LATERAL (SELECT c / close - 1 AS forward_return) z WHERE close > 0",
    v.BARS_1H,
    keys="asset breakout_ts horizon", floats="forward_return",
)
def _(spark, d):
    rows, table = v.bars_1h(spark, d), sinks.Table(spark, scratch(spark), FORWARD_RETURNS)
    table.create()
    empty = table.read().filter("forward_return IS NOT NULL")  # typed and empty before anything is stored
    made = sinks.fan_out(rows.filter("volume > 2").select(F.col("ts").alias("breakout_ts"), "asset", F.lit(1).alias("direction"), F.col("close").alias("base_close")), [1, 2], HOUR_MS)
    table.write(sinks.fill_forward_returns(made.select(FORWARD_RETURNS.fieldNames()), rows, 4_102_444_800_000).unionByName(empty))
    return table.read().filter("forward_return IS NOT NULL")


@query(
    "stored_predictions",
    "SELECT asset, ts, predicted_range FROM p WHERE actual_range IS NULL",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    floats="predicted_range",
)
def _(spark, d):
    table = sinks.Table(spark, scratch(spark), PREDICTIONS)
    table.write(evolve(v.predictions(spark, d), PREDICTIONS).select(PREDICTIONS.fieldNames()))
    return table.read().filter("actual_range IS NULL")


@query(
    "report_envelope",
    "SELECT 'all' AS part, count(*) AS n, true AS locked FROM (SELECT asset FROM c GROUP BY asset)",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    keys="part", others="n locked",
)
def _(spark, d):
    config = {"n": 720, "least": 24}
    out = gates.envelope(reports.calibration(v.predictions(spark, d)), config)
    return out.select(F.lit("all").alias("part"), F.size("rows").cast("long").alias("n"), (F.col("config_hash") == gates.lock(dict(reversed(config.items())))).alias("locked"))


@query(
    "family_counts",
    "SELECT family, count(*) AS n, count(*) FILTER (x > 0.9) AS survivors FROM (SELECT l_linestatus AS family, l_discount * 10 AS x FROM lineitem) GROUP BY family",
    keys="family", others="n survivors",
)
def _(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.monotonically_increasing_id().cast("string").alias("genome_id"), F.col("l_linestatus").alias("family"), F.when(F.col("l_discount") * 10 <= 0.9, "screening").alias("failed_at"), F.col("l_tax").cast("double").alias("sharpe"))
    return lab.summary(rows)


@query(
    "rolling_cross_features",
    f"SELECT asset, ts, nr, {roll(SD, 'x', 22)} AS rv22, x AS ret1 FROM (SELECT *, greatest(high - low, 0) / nullif(close, 0) AS nr, {LOGRET} AS x FROM b)",
    v.BARS_1H,
    floats="nr rv22 ret1",
)
def _(spark, d):
    return blocks.bounded(v.bars_1h(spark, d), _cross, 23)


def _cross(rows):
    own = ft.normalized_range(rows).withColumn("ret1", ft.log_return())
    return own.withColumn("rv22", t.std("ret1", 22))
