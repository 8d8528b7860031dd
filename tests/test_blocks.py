"""Windows, scans, as-of joins and order statistics in blocks of a few rows against plain ones over whole series."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import BASE, frame, pandas, walk
from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.operators import asof, features, forecast, ols
from tidemark.schema import DAY_MS, HOUR_MS

SPAN = 7 * HOUR_MS


@pytest.fixture(scope="module")
def bars(spark):
    gaps = tuple(range(40, 90)) + (100, 101, 150)
    own = frame(spark, pd.concat([walk(200, "a", 1, gaps), walk(90, "b", 2), walk(1, "c", 3)]))
    return own.unionByName(own.filter("asset = 'b'").withColumn("asset", F.lit(None).cast("string"))).withColumn("x", F.when(F.col("ts") % 5 != 0, F.col("close"))).repartition(3).cache()


def same(got, want, by=("asset", "ts"), names=None):
    a, b = pandas(got, *by), pandas(want, *by)
    names = names or list(want.columns)
    pd.testing.assert_frame_equal(a[names], b[names], check_dtype=False, rtol=1e-9, atol=1e-12)


def test_places_and_sizes(bars):
    placed = blocks.placed(bars, span_ms=SPAN)
    same(placed.select("asset", "ts", blocks.AT), bars.select("asset", "ts", (F.row_number().over(t.order()) - 1).alias(blocks.AT)))
    assert blocks.placed(placed) is placed
    sizes = blocks.copies(placed, 4, 3, 10).groupBy("asset", blocks.BLOCK).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 17 and sizes[1] > 30  # no task holds more than a block and its halo


@pytest.mark.parametrize("rows", [2, 10, 1000])
def test_bounded_frames(bars, rows):
    def fn(df):
        return df.withColumns({"m": t.mean("x", 6, 1, 2), "l": t.lag("close", 3), "n": t.lead("close", 2), "hi": t.high("x", 4)})

    same(blocks.bounded(bars, fn, 7, 2, rows=rows, span_ms=SPAN), fn(bars))
    assert blocks.bounded(bars.limit(0), fn, 7, 2).count() == 0


def test_features_in_blocks(bars):
    same(features.technical(bars.drop("x"), rows=5), features._technical(bars.drop("x")))


def test_running_scans(bars):
    kinds = {k: (k, F.col("x")) for k in ("sum", "count", "max", "min", "last", "first")}
    want = bars.withColumns({k: fn(F.col("x")).over(t.past()) for k, fn in (("sum", F.sum), ("count", F.count), ("max", F.max), ("min", F.min))})
    want = want.withColumns({"last": F.last("x", True).over(t.past()), "first": F.first("x", True).over(t.past())})
    same(blocks.running(bars, kinds, span_ms=SPAN), want)


def test_least_squares_in_spans(bars, monkeypatch):
    monkeypatch.setattr(blocks, "SPAN_MS", SPAN)
    own = forecast.har_terms(forecast.ranges(bars))
    for window in (None, 40, 80):
        same(ols.walk(own, "range", ["m1", "m5", "m22"], window), ols.walk_exact(own.filter("asset IS NOT NULL"), "range", ["m1", "m5", "m22"], window).unionByName(ols.walk_exact(own.filter("asset IS NULL").withColumn("asset", F.lit("z")), "range", ["m1", "m5", "m22"], window).withColumn("asset", F.lit(None).cast("string"))), names=["asset", "ts", "n_obs", "forecast"])


def plain_asof(left, right, direction, tolerance):
    out = []
    for asset, ts in left:
        own = [(at, rate) for who, at, rate in right if who == asset]
        back = max(((at, r) for at, r in own if at <= ts), default=None)
        ahead = min(((at, r) for at, r in own if at >= ts), default=None)
        if direction == "nearest":
            hit = ahead if back is None or (ahead and ahead[0] - ts < ts - back[0]) else back
        else:
            hit = back if direction == "backward" else ahead
        out.append((str(asset), ts, hit[1] if hit and (tolerance is None or abs(hit[0] - ts) <= tolerance) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3 * HOUR_MS])
def test_asof_over_many_spans(spark, bars, direction, tolerance):
    rng = np.random.default_rng(3)
    # spans without right rows, several in a row, in the middle, before and after all of them
    right = [(a, int(BASE + h * HOUR_MS + rng.integers(-2, 3) * 600_000), float(k)) for k, (a, h) in enumerate([(a, h) for a in ("a", "b", None) for h in (20, 21, 22, 30, 31, 95, 96, 160)])]
    right += [("a", BASE + 22 * HOUR_MS, 90.0), ("a", BASE + 22 * HOUR_MS, 91.0), ("none", BASE, 1.0)]
    df = spark.createDataFrame(right, "asset string, ts long, rate double").repartition(2)
    got = asof.asof(bars.select("asset", "ts"), df, ["rate"], direction=direction, tolerance_ms=tolerance, span_ms=SPAN)
    assert sorted(((str(r["asset"]), r["ts"], r["rate"]) for r in got.collect()), key=str) == plain_asof([(r["asset"], r["ts"]) for r in bars.collect()], right, direction, tolerance)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_has_no_frame_that_is_recomputed_for_each_row(bars, direction):
    # a frame from a row to its partition's end is quadratic in Spark
    plan = asof.asof(bars.select("asset", "ts"), bars.select("asset", "ts", "x"), ["x"], direction=direction)._jdf.queryExecution().toString()
    assert "unboundedpreceding" in plan.lower() and "unboundedfollowing" not in plan.lower()


def test_interval_means_and_lags_over_many_spans(spark, bars):
    right = spark.createDataFrame([(a, BASE + h * HOUR_MS, float(h % 7) - 3) for a in ("a", "b", None) for h in (0, 1, 1, 20, 21, 40, 90, 91, 130)] + [("a", BASE, float("nan"))], "asset string, ts long, rate double")
    small, whole = (asof.interval_mean(bars, right, "rate", 24 * HOUR_MS, 8 * HOUR_MS, span_ms=s) for s in (SPAN, 10_000 * DAY_MS))
    same(small, whole)
    known = {(r["asset"], r["ts"]): r["rate_mean_n"] for r in small.collect()}
    rows = [(r["asset"], r["ts"], r["rate"]) for r in right.collect()]
    assert all(n == sum(a == who and ts - DAY_MS < at <= ts and not np.isnan(x) for who, at, x in rows) for (a, ts), n in known.items() if a is not None)
    same(asof.asof_lagged(bars, right.dropDuplicates(["asset", "ts"]), "rate", span_ms=SPAN, rows=3), asof.asof_lagged(bars, right.dropDuplicates(["asset", "ts"]), "rate"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), max_size=60), st.integers(1, 12), st.integers(0, 3))
def test_moving_quantiles_equal_sorted_windows(values, width, shift):
    raw, known = np.array([x or 0.0 for x in values]), np.array([x is not None for x in values], bool)
    for q, (found, ok) in zip((0.0, 1 / 3, 1.0), blocks.moving_quantiles(raw, known, [0.0, 1 / 3, 1.0], width, shift, 2)):
        for i in range(len(values)):
            end = i - shift + 1
            own = [x for x in values[max(0, end - width) : max(0, end)] if x is not None]
            assert ok[i] == (len(own) >= 2) and (not ok[i] or found[i] == pytest.approx(np.quantile(own, q)))


def test_moving_quantiles_in_blocks(bars):
    got = blocks.quantiles(bars, "x", {"lo": 1 / 3, "mid": 0.5}, 20, 1, 3, rows=8, span_ms=SPAN)
    same(got, bars.withColumns({"lo": t.quantile("x", 1 / 3, 20, 1, 3), "mid": t.quantile("x", 0.5, 20, 1, 3)}))
    assert blocks.quantiles(bars.limit(0), "x", {"lo": 0.3}, 5).count() == 0


def test_moving_quantiles_of_any_width_cost_the_same():
    x, took = np.random.default_rng(0).normal(size=200_000), []
    known = np.ones(len(x), bool)
    for width in (100, 2160):
        best = []
        for _ in range(3):
            at = time.process_time()
            blocks.moving_quantiles(x, known, [1 / 3, 2 / 3], width, 0, 2)
            best.append(time.process_time() - at)
        took.append(min(best))
    assert took[1] < 2 * took[0]


def test_exponential_means_over_spans(bars):
    got = pandas(blocks.ema(bars, "x", 22, "e", span_ms=SPAN))
    want = pandas(bars)
    want["e"] = want.groupby("asset", dropna=False)["x"].transform(lambda x: x.ewm(span=22, adjust=False, ignore_na=True).mean())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    assert blocks.ema(bars.limit(0), "x", 22, "e").count() == 0
    none = pandas(blocks.ema(bars.withColumn("x", F.lit(None).cast("double")), "x", 22, "e"))
    assert none["e"].isna().all()


def test_contexts_of_exponential_means(bars):
    got = pandas(forecast.baselines(bars.filter("asset = 'a'"), "close", 5, 12))
    close = got["close"].to_numpy()
    for i in range(len(got)):
        own = close[max(0, i - 12) : i]
        want = pd.Series(own).ewm(span=5, adjust=False).mean().iloc[-1] if len(own) else np.nan
        assert got["ewma"][i] == pytest.approx(want, rel=1e-9, nan_ok=True)
