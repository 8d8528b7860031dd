"""Operators against pandas, numpy and golden values."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import BASE, frame, pandas, walk
from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import asof, bars, evaluate, features, forecast, gates, lab, ols, quality, reports, signals, sim, stats
from tidemark.plans import queries as engine
from tidemark.schema import HOUR_MS, nan_to_null, require_columns

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def close_to(a, b, tol=1e-9):
    a, b = np.array(a, float), np.array(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tol, atol=tol)


def test_rolling_frames_equal_pandas(spark):
    pdf = pd.concat([walk(120, "x"), walk(90, "y", 8)])
    df = frame(spark, pdf).withColumns({"m": t.mean("close", 10), "s": t.std("close", 10, 1), "p": t.std_pop("close", 5), "lo": t.low("low", 7, 1, 2), "q": t.quantile("close", 0.3, 20, 0, 5), "e": t.ewm("close", 9, 500)})
    got = pandas(df)
    for asset, g in got.groupby("asset"):
        c = g["close"]
        close_to(g["m"], c.rolling(10).mean())
        close_to(g["s"], c.shift(1).rolling(10).std())
        close_to(g["p"], c.rolling(5).std(ddof=0), 1e-7)
        close_to(g["lo"], g["low"].shift(1).rolling(7, min_periods=2).min())
        close_to(g["q"], c.rolling(20, min_periods=5).quantile(0.3))
        close_to(g["e"], c.ewm(span=9, adjust=False).mean())


def test_nan_becomes_null_and_columns_are_required(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "a double")
    assert nan_to_null(df).filter("a IS NULL").count() == 1
    with pytest.raises(ValueError, match="b"):
        require_columns(df, ["a", "b"])


def test_resample_takes_first_and_last_by_time(spark):
    rows = [("x", 10, 5.0), ("x", 30, 1.0), ("x", 20, 9.0), ("x", HOUR_MS + 1, 2.0)]
    df = spark.createDataFrame(rows, "a string, m long, p double")
    got = pandas(bars.resample(df, F.col("a"), F.col("m"), F.col("p")))
    assert got.drop(columns="asset").values.tolist() == [[0, 5.0, 9.0, 1.0, 1.0, 3.0], [HOUR_MS, 2.0, 2.0, 2.0, 2.0, 1.0]]


def test_grid_fills_gaps_and_flags_them(spark):
    pdf = walk(20, gaps=(5, 6, 11))
    got = pandas(bars.dense_grid(frame(spark, pdf)))
    assert len(got) == 20 and got["filled_gap"].sum() == 3
    assert got["close"][6] == got["close"][4] == got["open"][5] and got["volume"][5] == 0
    assert [r["missing"] for r in quality.gaps(frame(spark, pdf)).orderBy("ts").collect()] == [2, 1]
    assert quality.missing_times(frame(spark, pdf)).count() == 3
    assert quality.gap_ranges(frame(spark, pdf)).agg(F.sum("missing")).first()[0] == 3
    audit = quality.audit(frame(spark, pdf)).first()
    assert (audit["gaps"], audit["missing"], audit["overall_valid"]) == (2, 3, False)


def test_invalid_bars_are_named(spark):
    pdf = walk(5)
    pdf.loc[2, "low"] = pdf.loc[2, "high"] + 1
    pdf.loc[3, "volume"] = -1
    got = {r["ts"]: set(r["issues"]) for r in quality.invalid(frame(spark, pdf)).collect()}
    assert "high_under_low" in got[pdf["ts"][2]] and got[pdf["ts"][3]] == {"volume_negative"}


def test_dedup_keeps_the_side_asked_for(spark):
    df = spark.createDataFrame([("x", 1, 1, "a"), ("x", 1, 2, "b")], "asset string, ts long, seq long, v string")
    assert bars.dedup(df, ["asset", "ts"], "seq", "first").first()["v"] == "a"
    assert bars.dedup(df, ["asset", "ts"], "seq", "last").first()["v"] == "b"


def test_order_and_runs(spark):
    df = spark.createDataFrame([("x", 3, 0), ("x", 1, 1), ("x", 5, 2)], "asset string, ts long, seq long")
    assert [r["ts"] for r in quality.out_of_order(df).collect()] == [1]
    pdf = walk(6)
    pdf.loc[[2, 3], "ts"] += 60_000
    run = quality.misaligned_runs(frame(spark, pdf)).collect()
    assert len(run) == 1 and run[0]["n"] == 2 and run[0]["offsets"] == [60_000]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_equals_pandas(spark, direction):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"asset": rng.choice(["x", "y"], 60), "ts": rng.choice(1000, 60, replace=False)})
    right = pd.DataFrame({"asset": rng.choice(["x", "y"], 25), "ts": rng.choice(1000, 25, replace=False), "v": rng.normal(size=25)})
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="asset", direction=direction, tolerance=40).sort_values(["asset", "ts"])
    got = pandas(asof.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], direction=direction, tolerance_ms=40))
    close_to(got["v"], want["v"])


def test_interval_mean_is_open_at_the_left_and_goes_stale(spark):
    left = spark.createDataFrame([("x", 100), ("x", 150), ("x", 400)], "asset string, ts long")
    right = spark.createDataFrame([("x", 50, 1.0), ("x", 100, 3.0)], "asset string, ts long, rate double")
    got = asof.interval_mean(left, right, "rate", 50, 60).orderBy("ts").collect()
    assert [(r["rate_mean"], r["rate_mean_n"]) for r in got] == [(3.0, 1), (None, 0), (None, 0)]
    assert asof.asof_lagged(left, right, "rate").orderBy("ts").collect()[1]["rate"] == 3.0


def test_moving_least_squares_equals_lstsq(spark):
    pdf = pd.concat([walk(150, "x"), walk(120, "y", 9)])
    own = forecast.har_terms(forecast.ranges(frame(spark, pdf)))
    for window in (None, 60, 90):
        a = pandas(ols.walk(own, "range", ["m1", "m5", "m22"], window))
        b = pandas(ols.walk_exact(own, "range", ["m1", "m5", "m22"], window))
        close_to(a["forecast"], b["forecast"], 1e-6)
        assert a["forecast"].notna().sum() > 150


def test_least_squares_of_constant_ranges_is_finite(spark):
    pdf = walk(60)
    pdf["high"], pdf["low"] = 11.0, 10.0
    got = pandas(forecast.har(forecast.ranges(frame(spark, pdf))))
    close_to(got["har"].dropna(), np.ones(got["har"].notna().sum()))


def test_forecasts_use_the_past_only(spark):
    pdf = walk(80)
    def make(x):
        return forecast.har(forecast.ranges(x)).select("asset", "ts", F.round("har", 6).alias("har"))
    cut = int(pdf["ts"][60])
    assert signals.look_ahead_rows(frame(spark, pdf), make, cut - HOUR_MS, ["har"]).count() == 0


def test_next_bar_forecast(spark):
    got = forecast.har_next(forecast.ranges(frame(spark, walk(100)))).first()
    assert got["n_obs"] == 78 and len(got["beta"]) == 4 and got["har"] > 0


def test_features_have_all_names_and_stated_lags(spark):
    pdf = walk(80)
    got = pandas(features.technical(frame(spark, pdf)))
    assert set(features.TECHNICAL) <= set(got.columns) and len(features.TECHNICAL) == 33
    r = got["close"].pct_change()
    close_to(got["ret_1"], r.shift(1))
    close_to(got["rv_22"], r.rolling(22, min_periods=2).std().shift(1))
    close_to(got["nr_std_5"], ((got["high"] - got["low"]) / got["close"].shift(1)).rolling(5, min_periods=2).std().shift(1))


def test_patterns(spark):
    rows = [(1, 1, 3, 1, 2), (2, 2, 4, 2, 3), (3, 3, 5, 3, 4), (4, 4, 6, 4, 5), (5, 5, 5.5, 2, 3)]
    pdf = pd.DataFrame([("x", BASE + i * HOUR_MS, o, h, lo, c, 1.0) for i, o, h, lo, c in rows], columns=["asset", "ts", "open", "high", "low", "close", "volume"])
    df = frame(spark, pdf.astype({"open": float, "high": float, "low": float, "close": float}))
    got = pandas(df.withColumn("_m", signals.momentum(2)).withColumn("s", signals.shift(F.col("_m"))))
    assert got["s"].tolist() == [0, 0, 0, 1, 1]


def test_forward_returns_and_hit_rates(spark):
    df = frame(spark, walk(40)).withColumn("sig", F.when(F.col("ts") % (2 * HOUR_MS) == 0, 1).otherwise(-1))
    events = signals.forward_returns(df, "sig")
    rows = {(r["asset"], r["signal"]): r["n"] for r in evaluate.hit_rates(events).collect()}
    assert rows[(None, None)] == rows[("x", None)] == 39 and rows[(None, 1)] + rows[(None, -1)] == 39


def test_hour_bias_covers_every_hour(spark):
    got = signals.hour_bias(frame(spark, walk(30)))
    assert got.count() == 24 and got.agg(F.sum("n")).first()[0] == 29
    assert signals.hour_signal(frame(spark, walk(30)), signals.best_hours(frame(spark, walk(30)), 0.0, 0)).filter("signal = 1").count() > 0


def test_positions():
    e, n = np.array([1, 0, 0, 0, 0, 0], bool), np.zeros(6, bool)
    assert sim.positions(e, n, n, n, 3).tolist() == [1, 1, 1, 0, 0, 0]
    assert sim.positions(e, np.array([0, 0, 1, 0, 0, 0], bool), n, n).tolist() == [1, 1, 0, 0, 0, 0]
    assert sim.positions(np.ones(6, bool), n, np.ones(6, bool), n).tolist() == [0] * 6
    flip = np.array([0, 0, 1, 1, 0, 0], bool)
    assert sim.positions(e, n, flip, n).tolist() == [1, 1, 0, -1, -1, -1]


@pytest.mark.parametrize(("b", "want"), [((110.0, 105.0), 0.044), ((97.0, 104.0), -0.076), ((105.0, 105.0), -0.006)])
def test_two_leg_golden_values(spark, b, want):
    rows = [("p", 0, 100.0, 100.0, True, False), ("p", 1, 100.0, 100.0, False, True), ("p", 2, b[0], b[1], False, False)]
    df = spark.createDataFrame(rows, "asset string, ts long, a_close double, b_close double, entry boolean, exit boolean")
    assert sim.two_leg(df).first()["pnl"] == pytest.approx(want)


def test_equity_is_the_product_of_returns(spark):
    df = frame(spark, walk(50)).withColumn("position", F.when(F.col("ts") % (7 * HOUR_MS) < 3 * HOUR_MS, 1).otherwise(0))
    got = pandas(sim.drawdown(sim.equity(df)))
    close_to(got["equity"], (1 + got["ret"]).cumprod())
    assert (got["drawdown"] <= 1e-12).all()
    close_to(got["drawdown"], got["equity"] / got["equity"].cummax() - 1)


def test_trades_and_stops(spark):
    pdf = walk(12)
    pdf["close"] = [100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111]
    pdf["open"], pdf["high"], pdf["low"] = pdf["close"], pdf["close"], pdf["close"] - 0.5
    df = frame(spark, pdf.astype({"close": float, "open": float, "high": float})).withColumn("position", F.when((F.col("close") >= 102) & (F.col("close") < 106), 1).otherwise(0))
    tr = sim.trades(df, cost=0.0).first()
    assert (tr["entry_price"], tr["exit_price"], tr["bars"]) == (102.0, 106.0, 4)
    flags = frame(spark, pdf.astype({"close": float, "open": float, "high": float})).withColumns({"entry": F.col("close") == 101, "exit": F.col("close") == 108, "stop": F.lit(0.05)})
    out = sim.stopped(flags, 0.0).first()
    assert (out["reason"], out["exit_price"]) == ("exit", 108.0)
    pdf.loc[4, "low"] = 90.0
    flags = frame(spark, pdf.astype({"close": float, "open": float, "high": float})).withColumns({"entry": F.col("close") == 101, "exit": F.col("close") == 108, "stop": F.lit(0.05)})
    out = sim.stopped(flags, 0.0).first()
    assert out["reason"] == "stop" and out["exit_price"] == pytest.approx(101 * 0.95)


def test_all_in_account(spark):
    df = frame(spark, walk(5)).withColumns({"close": F.lit(100.0), "entry": F.col("ts") == BASE + HOUR_MS, "exit": F.col("ts") == BASE + 3 * HOUR_MS})
    got = pandas(sim.all_in(df.select("asset", "ts", "close", "entry", "exit"), 1000.0, 0.01, 0.0))
    assert got["value"].tolist() == pytest.approx([1000, 990, 990, 980.1, 980.1])


def test_statistics_against_direct_formulas(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"g": "a", "ts": range(n), "a": rng.normal(0, 1, n).round(1), "b": rng.normal(0, 1.3, n).round(1)})
    df = spark.createDataFrame(pdf)
    d = (pdf["a"].abs() - pdf["b"].abs()).to_numpy()
    z, lag = d - d.mean(), max(1, int(4 * (n / 100) ** (2 / 9)))
    var = ((z * z).sum() + 2 * sum((1 - k / (lag + 1)) * (z[k:] * z[:-k]).sum() for k in range(1, lag + 1))) / n / n
    r = stats.diebold_mariano(df, "a", "b", ["g"]).first()
    assert r["lags"] == lag and r["dm"] == pytest.approx(d.mean() / math.sqrt(var)) and r["p_value"] == pytest.approx(math.erfc(abs(r["dm"]) / math.sqrt(2)))
    sp = stats.spearman(df, "a", "b", ["g"]).first()["spearman"]
    assert sp == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    w = stats.wilcoxon(df.withColumn("x", F.col("a") - F.col("b")), "x", ["g"]).first()
    x = (pdf["a"] - pdf["b"]).round(10)
    x = x[x.abs() > 1e-9]
    assert w["w_plus"] == pytest.approx(x.abs().rank()[x > 0].sum(), rel=0.01)
    m = stats.mcnemar(spark.createDataFrame([("g", 1, 0)] * 8 + [("g", 0, 1)] * 2, "g string, a int, b int"), "a", "b", ["g"]).first()
    assert m["p_value"] == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 2**10)


def test_newey_west_lags_of_a_long_series(spark):
    n = 3_600_000
    d = np.abs((np.arange(n) * 7919 % 1009) / 1009) - 0.5
    z, lag = d - d.mean(), int(4 * (n / 100) ** (2 / 9))
    var = ((z * z).sum() + 2 * sum((1 - k / (lag + 1)) * (z[k:] * z[:-k]).sum() for k in range(1, lag + 1))) / n / n
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("ts"), (F.col("id") * 7919 % 1009 / 1009).alias("a"), F.lit(0.5).alias("b"))
    r = stats.diebold_mariano(df, "a", "b", ["g"]).first()
    assert r["lags"] == lag == 41 and r["dm"] == pytest.approx(d.mean() / math.sqrt(var), rel=1e-6)


def test_special_functions():
    assert stats.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert stats.student_two_sided(2.228138851964939, 10) == pytest.approx(0.05)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.chi2_one_sf(3.841458820694124) == pytest.approx(0.05)
    assert stats.balanced_flips(10, 0).sum() == 0


def test_coin_flip_degenerates(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(20)] + [("b", i, i % 2) for i in range(20)], "g string, ts long, c int")
    got = {r["g"]: r for r in stats.coin_flip(df, "c", ["g"]).collect()}
    assert got["a"]["dm"] == float("inf") and got["a"]["p_value"] == 0 and got["b"]["hit_rate"] == 0.5


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(98)], "g string, ts long, x double")
    a, b = (stats.bootstrap_ci(df, "x", ["g"], 500, block=k).first() for k in (False, True))
    assert a["low"] < 3 < a["high"] and b["low"] < b["mean"] < b["high"]
    assert tuple(a) == tuple(stats.bootstrap_ci(df, "x", ["g"], 500).first())


def test_splits(spark):
    df = frame(spark, walk(11))
    assert [r["count"] for r in evaluate.blocks(df, 3).groupBy("block").count().orderBy("block").collect()] == [4, 4, 3]
    got = {r["split"]: r["count"] for r in evaluate.chrono_split(df).groupBy("split").count().collect()}
    assert got == {"train": 6, "validation": 2, "test": 3}


def test_gates_count_null_as_failing(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    got = [r["verdict"] for r in gates.gate(df, {"x": F.col("a") == 1, "y": F.col("b") == 2}).collect()]
    assert sorted(got) == ["fail", "pass"]


def test_lab_runs_and_ids_are_stable(spark):
    genomes = lab.sample(6, 1)
    assert lab.sample(6, 1) == genomes and lab.genome_id(genomes[0]) == lab.genome_id(dict(reversed(genomes[0].items())))
    child = lab.crossover(lab.mutate(genomes[0], 2), genomes[1], 3)
    assert child["fast"] <= child["slow"] and len(lab.perturb(genomes[0])) == 6 and lab.complexity(genomes[0]) == 5
    metrics, tr, pos = lab.screen(frame(spark, walk(300)), lab.table(spark, genomes))
    out = lab.funnel(metrics, tr, pos, lab.stability(frame(spark, walk(300)), genomes, metrics), least_trades=1)
    assert out.count() == len({lab.genome_id(g) for g in genomes})
    assert lab.family_summary(out, lab.table(spark, genomes)).agg(F.sum("n")).first()[0] == out.count()


def test_lab_reads_the_windows_of_a_genomes_own_widths(spark):
    pdf = walk(200)
    genomes = [{"family": f, "fast": fast, "slow": slow, "threshold": 1.1, "hold": 6} for f in lab.FAMILIES for fast, slow in ((4, 9), (6, 22), (6, 9), (18, 90))]
    got = lab.signals(frame(spark, pdf), lab.table(spark, genomes)).toPandas()
    c = pdf["close"]
    for g in genomes:
        fast, slow = g["fast"], g["slow"]
        z = (c - c.rolling(slow).mean()) / c.rolling(slow).std()
        long, short = {
            "trend": (c.rolling(fast).mean() > c.rolling(slow).mean(), c.rolling(fast).mean() < c.rolling(slow).mean()),
            "breakout": (c > pdf["high"].shift(1).rolling(slow).max(), c < pdf["low"].shift(1).rolling(slow).min()),
            "reversion": (z < -1.1, z > 1.1),
            "momentum": (c / c.shift(fast) - 1 > 0.011, c / c.shift(fast) - 1 < -0.011),
        }[g["family"]]
        own = got[got["genome_id"] == lab.genome_id(g)].sort_values("ts")
        assert own["long_entry"].tolist() == long.tolist() and own["short_entry"].tolist() == short.tolist() and (long | short).any(), g


def test_a_genome_without_a_stability_score_is_no_survivor(spark):
    pdf = walk(300)
    pdf["close"] = 100 * 1.01 ** np.arange(300)
    genome = {"family": "trend", "fast": 5, "slow": 10, "threshold": 1.0, "hold": 6}
    made = lab.screen(frame(spark, pdf), lab.table(spark, [genome]))
    limits = {"least_trades": 1, "least_profit_factor": 0.0, "most_single": 1.0, "most_top5": 1.0}
    made = (made[0].withColumn("trade_profit_factor", F.lit(2.0)), *made[1:])  # without a loss there is none

    def failed(stable):
        return lab.funnel(*made, stable, **limits).first()["failed_at"]

    score = lambda x: spark.createDataFrame([(lab.genome_id(genome), "x", x)], "genome_id string, asset string, stability_score double")
    assert [failed(None), failed(score(0.5)), failed(score(0.6))] == ["stability", "stability", None]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_gates_get_stability_scores_and_best_multipliers(spark, monkeypatch):
    given = []
    monkeypatch.setattr(lab, "funnel", lambda metrics, tr, pos, stable=None: given.append(stable) or metrics.withColumns({"oos_sharpe": F.lit(0.0), "failed_at": F.lit("")}))
    engine.QUERIES["lab_funnel"](spark, DATA)
    assert {"genome_id", "asset", "stability_score"} <= set(given[0].columns)
    monkeypatch.setattr(lab, "best_multiplier", lambda sweep: sweep.select("asset").distinct().withColumn("multiplier", F.lit(2.0)))
    assert {r["multiplier"] for r in engine.QUERIES["sweep_gates"](spark, DATA).collect()} == {2.0}


def test_best_multiplier_has_a_default(spark):
    sweep = spark.createDataFrame([("x", 1.0, 40, 1.5), ("x", 2.0, 40, 1.5), ("y", 1.0, 3, 9.0)], "asset string, multiplier double, n long, sharpe double")
    assert {r["asset"]: r["multiplier"] for r in lab.best_multiplier(sweep).collect()} == {"x": 1.0, "y": 0.0}


def test_scalars(spark):
    df = spark.createDataFrame([(1_704_067_200_000, 1_704_067_200.0, "btc", 0.0004, 5.0, 2.0, None)], "ms long, sec double, sym string, r double, a double, p double, n double")
    got = df.select(
        s.iso_utc(F.col("ms")).alias("iso"), s.epoch_ms(F.col("sec")).alias("e"), s.symbol_pair(F.col("sym")).alias("sym"), s.direction(F.col("r")).alias("d"), s.severity(F.col("a"), F.col("p")).alias("sev"),
        s.improvement_pct(F.col("a"), F.col("p")).alias("imp"), s.accuracy(F.col("a"), F.col("p")).alias("acc"), s.short_number(F.lit(1234.0)).alias("k"), s.clip(F.col("n"), 0, 1).alias("c"),
        s.first_failing([("x", F.lit(True)), ("y", F.col("n") > 1)]).alias("f"), s.edge_signal(F.lit(0.01), 0.002).alias("edge"), s.position_usd(F.lit(1000.0), F.lit(0.5)).alias("usd"), s.parse_iso(F.lit("2024-01-01T00:00:00Z")).alias("pi"),
    ).first()
    assert tuple(got) == ("2024-01-01T00:00:00Z", 1_704_067_200_000, "BTC/USDT", 0, "moderate", 60.0, -1.0, "1.2K", None, "y", 1, 20.0, 1_704_067_200_000)


PRED = T.StructType([T.StructField("asset", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("predicted_range", T.DoubleType()), T.StructField("actual_range", T.DoubleType()), T.StructField("regime", T.StringType())])


def test_reports(spark):
    rows = [("x", BASE + i * HOUR_MS, 1.0, 1.0 + (i % 3), "low" if i % 2 else None) for i in range(48)] + [("x", BASE + 48 * HOUR_MS, 1.0, None, "high")]
    p = spark.createDataFrame(rows, PRED)
    assert reports.breakouts(p).count() == 32 and reports.status(p).first()["pending"] == 1
    assert reports.calibration(p).first()["mae"] == pytest.approx(1.0) and reports.calibration(p).first()["persistence_mae"] == pytest.approx(48 / 47)
    assert {r["regime"]: r["n"] for r in reports.regime_distribution(p).collect()} == {"low": 24, "unknown": 24, "high": 1}
    assert reports.weeks_beating(p, 24).count() == 2 and reports.error_histogram(p).agg(F.sum("n")).first()[0] == 48
    assert reports.latest_each(p, BASE + 60 * HOUR_MS).first()["regime"] == "unknown"
    assert reports.markdown(reports.status(p)).count("\n") == 2


def test_paper_broker_books_both_sides(spark):
    rows = [("x", 0, 10.0, 1), ("x", 1, 12.0, 1), ("x", 2, 12.0, -1), ("x", 3, 9.0, -1), ("x", 4, 1e9, 1)]
    df = spark.createDataFrame(rows, "asset string, ts long, close double, signal int").withColumn("quantity", F.lit(1.0))
    got = pandas(sim.paper_broker(df, 100.0, 0.0, 0.0))
    assert got["action"].tolist() == ["OPEN", "CLOSE", "OPEN", "CLOSE", "REJECTED"] and got["value"][1] == 102.0


def test_roi_exits_and_risk(spark):
    pdf = walk(8)
    pdf["close"] = [100.0, 101, 103, 108, 109, 110, 111, 112]
    pdf["open"], pdf["high"], pdf["low"] = pdf["close"], pdf["close"], pdf["close"]
    df = frame(spark, pdf).withColumns({"entry": F.col("close") == 101, "exit": F.lit(False), "stop": F.lit(0.5)})
    assert sim.stopped(df, 0.0, roi={0: 0.5, 2: 0.05}).first()["reason"] == "roi"
    row = spark.createDataFrame([("LONG", 10, 1.0, 0.0, 0.0, 0.0, 0, 9)], "side string, ts long, equity double, exposure double, drawdown double, daily_pnl double, open_positions int, last_ts long")
    assert gates.risk_checks(row).first()["reason"] == "COOLDOWN"
    assert gates.lock({"a": 1, "b": 2}) == gates.lock({"b": 2, "a": 1})
    assert len(gates.envelope(row, {}).first()["rows"]) == 1


def test_targets_and_config(spark):
    df = frame(spark, walk(30))
    assert evaluate.targets(df, evaluate.Config(context=10, most=5)).count() == 5
    assert evaluate.targets(df, evaluate.Config(context=10, end_ms=BASE + 12 * HOUR_MS)).count() == 3
    with pytest.raises(ValueError):
        evaluate.Config(horizon=0)


RECORD = "asset string, series string, window string, low_power boolean, beats_base boolean, beats_second boolean, beats_norm boolean, beats_norm_rmse boolean, tracks boolean, leaks int"


@pytest.mark.parametrize(("lose", "p", "diff", "regimes", "breadth", "asset"), [(0, 0.001, -1.0, 2, "A", "PASS"), (0, 0.001, 1.0, 2, "B", "B"), (0, 0.001, -1.0, 1, "B", "B"), (6, 0.001, -1.0, 2, "C", "C"), (2, 0.03, -1.0, 2, "B", "B")])
def test_study_gates(spark, lose, p, diff, regimes, breadth, asset):
    rows = [(a, f"{a}/{f}", w, False, *[i >= lose] * 5, 0) for i, (a, f, w) in enumerate((a, f, w) for a in "xy" for f in ("1h",) for w in ("older", "middle", "recent"))]
    rec = spark.createDataFrame(rows + [("x", "x/1d", "recent", True, *[False] * 5, 9)], RECORD)
    dm = spark.createDataFrame([(p, diff)], "p_value double, mean_diff double")
    reg = spark.createDataFrame([(i < regimes,) for i in range(3)], "beats_base boolean")
    assert gates.breadth_gate(rec, dm, reg).first()["verdict"] == breadth
    assert gates.asset_gate(rec, dm, reg).first()["verdict"] == asset
    assert gates.breadth_gate(rec.limit(0), dm, reg).first()["verdict"] == "pending" == gates.asset_gate(rec.limit(0), dm, reg).first()["verdict"]


# Missing values, ties and bookkeeping ---------------------------------------------------------------


def test_one_nan_rate_stays_in_its_interval(spark):
    rates = pd.DataFrame({"asset": "x", "ts": BASE + np.arange(40) * 8 * HOUR_MS, "rate": np.arange(40) / 100.0})
    rates.loc[5, "rate"] = np.nan
    rates.loc[9, "rate"] = np.inf
    left = frame(spark, walk(320)).select("asset", "ts")
    got = pandas(asof.interval_mean(left, spark.createDataFrame(rates), "rate", 24 * HOUR_MS))
    for ts, value, n in zip(got["ts"], got["rate_mean"], got["rate_mean_n"]):
        own = rates["rate"][(rates["ts"] > ts - 24 * HOUR_MS) & (rates["ts"] <= ts) & np.isfinite(rates["rate"])]
        assert n == len(own) and (value == pytest.approx(own.mean()) if len(own) else pd.isna(value))


@pytest.mark.parametrize("window", [30, 80, None])
def test_walk_with_nan_equals_the_exact_one(spark, window):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"asset": "x", "ts": BASE + np.arange(400) * HOUR_MS, "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = pdf["a"] - 2 * pdf["b"] + rng.normal(size=400) / 10
    pdf.loc[[50, 210], "y"] = np.nan
    pdf.loc[[60, 300], "a"] = np.nan
    df = spark.createDataFrame(pdf)
    got, want = pandas(ols.walk(df, "y", ["a", "b"], window)), pandas(ols.walk_exact(df, "y", ["a", "b"], window))
    assert got["forecast"].notna().sum() > 300
    np.testing.assert_allclose(got["forecast"].astype(float), want["forecast"].astype(float), rtol=1e-6, equal_nan=True)


def test_paper_broker_closes_what_it_holds(spark):
    rows = [("x", 0, 10.0, 1, 1.0), ("x", 1, 10.0, -1, 5.0), ("x", 2, 10.0, -1, 2.0), ("x", 3, 8.0, 1, 9.0)]
    got = pandas(sim.paper_broker(spark.createDataFrame(rows, "asset string, ts long, close double, signal int, quantity double"), 100.0, 0.0, 0.0))
    assert got["action"].tolist() == ["OPEN", "CLOSE", "OPEN", "CLOSE"] and got["cash"].tolist() == [90.0, 100.0, 100.0, 124.0]  # a sale's proceeds of 20 come in with its profit of 4
    assert got["pnl"].tolist()[1::2] == [0.0, 4.0]


def test_significance_of_sweeps_has_a_sign(spark):
    rows = [("x", 0.0, 1.0, 0.1, 0.5, 50, 1.0, 0.0), ("x", 1.0, 2.0, 0.2, 0.6, 50, 1.5, 2.2), ("y", 0.0, 1.0, 0.1, 0.5, 50, 1.0, 0.0), ("y", 1.0, 2.0, 0.2, 0.6, 50, 1.5, -9.0)]
    sweep = spark.createDataFrame(rows, "asset string, multiplier double, sharpe double, mean_pnl double, win_rate double, n long, profit_factor double, t_stat double")
    best = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "asset string, multiplier double")
    six = lambda alpha: {r["asset"]: r["G6"] for r in gates.sweep_gates(sweep, best, alpha).collect()}
    assert six(0.05) == {"x": True, "y": False} and six(0.01) == {"x": False, "y": False} and six(0.1)["x"]


def test_both_blocks_against_baselines(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=400)
    pdf = pd.DataFrame({"asset": "x", "ts": np.arange(400), "y": y, "m": y + rng.normal(size=400) / 2, "a": y + rng.normal(size=400), "b": rng.normal(size=400)})
    got = pandas(stats.both_blocks(spark.createDataFrame(pdf), "y", "m", ["a", "b"], ["asset"], draws=500), "baseline")
    for name, r in zip(("a", "b"), got.itertuples()):
        d = (pdf["m"] - y).abs() - (pdf[name] - y).abs()
        assert r.mean_diff == pytest.approx(d.mean()) and r.low < d.mean() < r.high < 0 and r.p_value < 0.01 and r.winner == "a"
        assert r.delta == pytest.approx(((pdf["m"] > 0) == (y > 0)).mean() - ((pdf[name] > 0) == (y > 0)).mean()) and r.delta_low <= r.delta <= r.delta_high


def test_next_batches_are_new_and_have_parents():
    first = lab.sample(6, 1)
    tried = {lab.genome_id(g) for g in first}
    batch = lab.next_batch(first, 20, 3, tried)
    ids = [lab.genome_id({k: v for k, v in g.items() if k != "parents"}) for g in batch]
    assert len(set(ids)) == 20 and not tried & set(ids) and batch == lab.next_batch(first, 20, 3, tried)
    assert {len(g["parents"]) for g in batch} == {0, 1, 2} and len(lab.next_batch([], 5)) == 5
    assert lab.twist(first[0], 1)["family"] != first[0]["family"] and {g["family"] for g in lab.focused(["trend"], 4)} == {"trend"}


def test_one_parameter_at_a_time():
    from tidemark.operators import robustness

    runs = robustness.one_at_a_time({"fast": 2, "rate": 0.5, "name": "x"})
    assert [r[0] for r in runs] == ["rate"] * 4 and all(p["fast"] == 2 for _, p in runs)


def test_html_report(spark):
    page = reports.html(spark.createDataFrame([("<a>", 1.5), (None, None)], "k string, v double"), "A & B")
    assert "<td>&lt;a&gt;</td><td>1.5</td>" in page and "<title>A &amp; B</title>" in page
    with pytest.raises(ValueError):
        reports.html(spark.range(5), "x", most=3)


def test_trees_learn_steps_and_name_their_feature(spark):
    from tidemark.operators import trees

    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    y = np.where(x[:, 1] > 0.4, 3.0, -1.0) * (1 + (x[:, 2] > 0)) + rng.normal(size=1500) / 20
    model = trees.Trees(trees=120, rate=0.2).fit(x[:1000], y[:1000])
    assert np.abs(model.predict(x[1000:]) - y[1000:]).mean() < 0.1 * y.std() and model.gains.argmax() == 1 and model.gains[0] < 0.01 * model.gains.sum()
    assert np.allclose(trees.booster(trees=3)(x[:50], np.ones(50))(x), 1.0)
    pdf = pd.DataFrame({"asset": "x", "ts": np.arange(1500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    got = pandas(trees.importances(spark.createDataFrame(pdf), ["a", "b", "c"], "y", 500, 500, trees=20), "feature")
    assert got["importance"].argmax() == 1 and got["importance"].sum() == pytest.approx(1) and got["refits"].tolist() == [2, 2, 2]
