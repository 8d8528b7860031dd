"""Paired statistics: Diebold-Mariano, Wilcoxon, McNemar, rank correlation, bootstrap, t-tests.

Statistics are aggregates and windows over all rows; only the last step from an
aggregated statistic to a p-value is scalar Python. Undefined results are NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered


def _scalar(fn):
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")

    return of


def _one(fn):
    @F.pandas_udf("double")
    def of(a: pd.Series) -> pd.Series:
        return _scalar(fn)(a)

    return of


def _two(fn):
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return _scalar(fn)(a, b)

    return of


def normal_sf(x: float) -> float:
    """Upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(stat: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + stat * stat)) if df > 0 else math.nan


def binomial_two_sided(b: int, c: int) -> float:
    """Exact two-sided p of b successes among b + c fair trials."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def chi2_one_sf(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def mcnemar_p(b: float, c: float) -> float:
    """Exact under 25 discordant pairs, else chi-square with continuity correction."""
    b, c = int(b), int(c)
    return binomial_two_sided(b, c) if b + c < 25 else chi2_one_sf((abs(b - c) - 1) ** 2 / (b + c))


def pearson(x: str, y: str, least: float = 0.0) -> Column:
    """Correlation over rows with both; NULL without variance."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.when((F.stddev_pop(a) > least) & (F.stddev_pop(b) > least), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, spearman: correlation of average ranks."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ordered.average_ranks(ordered.average_ranks(rows, x, by, "_a"), y, by, "_b")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("_a", "_b").alias("spearman"))


def diebold_mariano(df: DataFrame, a: str, b: str, by: list[str], loss: str = "absolute", ts: str = "ts") -> DataFrame:
    """by, n, lags, mean_diff, dm, p_value: two-sided test of equal losses of two error columns.

    The variance is of the Newey-West kind with Bartlett weights and max(1, int(4 (n / 100) ** (2 / 9))) lags.
    All lagged products are window sums in one pass, as many as the largest group needs (counted first)."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    max_lag = int(4 * (most / 100) ** (2 / 9)) + 1  # one more, should the engines' powers differ
    own = (lambda c: F.abs(c)) if loss == "absolute" else (lambda c: F.col(c) * F.col(c))
    whole = Window.partitionBy(*by)
    d = rows.withColumn("_d", own(a) - own(b)).withColumn("_z", F.col("_d") - F.avg("_d").over(whole))
    w = whole.orderBy(ts)
    products = [F.sum(F.col("_z") * F.col(f"_l{k}")) for k in range(1, max_lag + 1)]
    lagged = d.withColumns({f"_l{k}": F.lag("_z", k).over(w) for k in range(1, max_lag + 1)})
    sums = lagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.sum(F.col("_z") * F.col("_z")).alias("_g0"), F.array(*(F.coalesce(p, F.lit(0.0)) for p in products)).alias("_g"))
    lags = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100.0, 2.0 / 9)).cast("int"))
    out = sums.withColumn("lags", lags.cast("int"))
    weighted = F.aggregate(F.sequence(F.lit(1), F.col("lags")), F.lit(0.0), lambda acc, k: acc + (1 - k / (F.col("lags") + 1.0)) * F.element_at("_g", k))
    variance = (F.col("_g0") + 2 * weighted) / F.col("n") / F.col("n")
    out = out.withColumn("dm", F.when(variance > 0, F.try_divide("mean_diff", F.sqrt(variance))))
    return out.withColumn("p_value", _one(lambda z: 2 * normal_sf(abs(z)))(F.col("dm"))).select(*by, "n", "lags", "mean_diff", "dm", "p_value")


def coin_flip(df: DataFrame, correct: str, by: list[str], ts: str | Column = "ts", lags: int = 3) -> DataFrame:
    """by, n, hit_rate, dm, p_value: one-sided test that a 0/1 column beats a fair coin, with a fixed number of lags.

    Without variance dm is infinite with the sign of the difference (0 for none)."""
    whole = Window.partitionBy(*by)
    rows = df.filter(F.col(correct).isNotNull()).withColumn("_d", F.col(correct).cast("double") - 0.5).withColumn("_z", F.col("_d") - F.avg("_d").over(whole))
    lagged = rows.withColumns({f"_l{k}": F.lag("_z", k).over(whole.orderBy(ts)) for k in range(1, lags + 1)})
    sums = lagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("_m"), F.sum(F.col("_z") * F.col("_z")).alias("_g0"), *(F.coalesce(F.sum(F.col("_z") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)))
    total = F.col("_g0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1.0)) * F.col(f"_g{k}")
    variance = total / F.col("n") / F.col("n")
    dm = F.when(variance > 1e-18, F.try_divide("_m", F.sqrt(variance))).when(F.col("_m") > 0, float("inf")).when(F.col("_m") < 0, float("-inf")).otherwise(0.0)
    out = sums.withColumn("dm", dm)
    return out.withColumn("p_value", _one(normal_sf)(F.col("dm"))).select(*by, "n", (F.col("_m") + 0.5).alias("hit_rate"), "dm", "p_value")


def wilcoxon(df: DataFrame, diff: str, by: list[str]) -> DataFrame:
    """by, n, w_plus, w_minus, z, p_value: signed ranks without zeros, normal approximation corrected for ties."""
    rows = df.filter(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(diff))
    ranked = ordered.average_ranks(rows, "_a", by, "_r", "_g")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col(diff) > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col(diff) < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"), F.sum((F.col("_g") * F.col("_g") - 1.0)).alias("_ties"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = sums.withColumn("z", F.when(variance > 0, F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(variance))))
    return out.withColumn("p_value", _one(lambda z: 2 * normal_sf(abs(z)))(F.col("z"))).drop("_ties")


def mcnemar(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, both_right, only_a, only_b, neither, p_value of two 0/1 columns."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a) == 1, F.col(b) == 1
    out = rows.groupBy(*by).agg(F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    return out.withColumn("p_value", _two(mcnemar_p)(F.col("only_a").cast("double"), F.col("only_b").cast("double")))


def t_test(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, mean, t_stat, p_two_sided, p_greater: one-sample test against 0; NULL under two rows or without variance."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    out = out.withColumn("t_stat", F.try_divide("mean", F.col("_s") / F.sqrt(F.col("n").cast("double"))))
    out = out.withColumn("p_two_sided", _two(student_two_sided)(F.col("t_stat"), F.col("n") - F.lit(1.0))).drop("_s")
    return out.withColumn("p_greater", F.when(F.col("t_stat") > 0, F.col("p_two_sided") / 2).otherwise(1 - F.col("p_two_sided") / 2))


#: Modulus of the numbers that choose what a draw takes: they follow from draw, place and seed alone, so that any task can make any of them.
PRIME = 2_147_483_647


def drawn(draw: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A number under PRIME for each draw and place (64-bit products only, so that SQL can do the same)."""
    x = (draw * 1_000_003 + place * 7919 + seed + 1) % PRIME
    x = x * 48_271 % PRIME
    x = (x * x + draw) % PRIME
    x = (x * x + place) % PRIME
    return x * 69_621 % PRIME


def bootstrap_ci(df: DataFrame, value: str, by: list[str], draws: int = 10_000, level: float = 0.95, seed: int = 0, block: bool = False, ts: str = "ts", chunk: int = 500) -> DataFrame:
    """by, n, mean, low, high: percentile interval of the mean; block: circular blocks of n ** (1/3) rows.

    Draws are dealt over tasks in chunks. A task gets the values of one group (8 bytes each) and makes its draws' means: of single rows by looking them up, of blocks
    by differences of prefix sums, a step for each block."""
    rows = df.filter(F.col(value).isNotNull())
    values = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(value).cast("double").alias("_v")))), lambda x: x["_v"]).alias("_x"))
    parts = values.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))))
    parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_from")

    def run(frames):
        for frame in frames:
            for at in range(len(frame)):
                x, first = np.asarray(frame["_x"].iloc[at], float), int(frame["_from"].iloc[at])
                n, own = len(x), np.arange(first, min(first + chunk, draws), dtype=np.int64)
                size = max(1, int(round(n ** (1 / 3)))) if block else 1
                k = -(-n // size)
                sums, step = np.zeros(len(own)), max(1, 2_000_000 // len(own))
                upto = np.concatenate([[0.0], np.cumsum(np.concatenate([x, x[: size - 1]]))])
                for a in range(0, k, step):
                    place = np.arange(a, min(a + step, k), dtype=np.int64)
                    start = drawn(own[:, None], place[None, :], seed) % n
                    taken = np.minimum(size, n - place * size)[None, :]  # the last block ends with the n-th value
                    sums += (x[start] if size == 1 else upto[start + taken] - upto[start]).sum(1)
                out = {c: frame[c].iloc[at] for c in by}
                yield pd.DataFrame({**{c: [v] * len(own) for c, v in out.items()}, "_m": sums / n})

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    means = parts.mapInPandas(run, f"{keys}, _m double").groupBy(*by).agg(*(F.percentile("_m", q).alias(name) for name, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(means, by)


def paired_errors(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, mean_diff, median_diff, sd_diff, cohen_dz, mae_a, mae_b, winner of two error columns on rows with both."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.abs(a) - F.abs(b))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd_diff"), F.avg(F.abs(a)).alias("mae_a"), F.avg(F.abs(b)).alias("mae_b"))
    out = ordered.with_quantiles(out, ordered.quantiles(rows, F.col("_d"), by, {"median_diff": 0.5}), by)
    return out.withColumn("cohen_dz", F.try_divide("mean_diff", "sd_diff")).withColumn("winner", F.when(F.col("mean_diff") < 0, "a").when(F.col("mean_diff") > 0, "b").otherwise("tie"))


def paired_directions(df: DataFrame, actual: str, a: str, b: str, by: list[str]) -> DataFrame:
    """McNemar block of two direction forecasts: accuracies, their difference and the test."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_a", (F.col(a) == F.col(actual)).cast("int")).withColumn("_b", (F.col(b) == F.col(actual)).cast("int"))
    rates = rows.groupBy(*by).agg(F.avg("_a").alias("accuracy_a"), F.avg("_b").alias("accuracy_b"))
    return mcnemar(rows, "_a", "_b", by).join(rates, by).withColumn("delta", F.col("accuracy_a") - F.col("accuracy_b"))


def error_block(df: DataFrame, a: str, b: str, by: list[str], draws: int = 10_000, seed: int = 0, ts: str = "ts") -> DataFrame:
    """paired_errors with the interval of the mean difference (low, high), and z and p_value of the signed-rank test."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.abs(a) - F.abs(b))
    interval = bootstrap_ci(rows, "_d", by, draws, seed=seed, ts=ts).select(*by, "low", "high")
    return paired_errors(df, a, b, by).join(interval, by).join(wilcoxon(rows, "_d", by).select(*by, "z", "p_value"), by, "left")


def direction_block(df: DataFrame, actual: str, a: str, b: str, by: list[str], draws: int = 10_000, seed: int = 0, ts: str = "ts") -> DataFrame:
    """paired_directions with the interval (low, high) of the difference of accuracies."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumn("_d", (F.col(a) == F.col(actual)).cast("double") - (F.col(b) == F.col(actual)).cast("double"))
    return paired_directions(df, actual, a, b, by).join(bootstrap_ci(rows, "_d", by, draws, seed=seed, ts=ts).select(*by, "low", "high"), by)


def both_blocks(df: DataFrame, actual: str, model: str, baselines: list[str], by: list[str], flat: float = 0.0, **settings) -> DataFrame:
    """by, baseline and the columns of both blocks of a model against each baseline. Forecasts and actuals are signed values, whose sign is the
    direction (at most `flat` in size: none)."""
    out = None
    side = lambda c: F.when(F.abs(c) <= flat, 0).otherwise(F.signum(c))
    for name in baselines:
        own = df.withColumns({"_ea": F.col(model) - F.col(actual), "_eb": F.col(name) - F.col(actual), "_sy": side(actual), "_sa": side(model), "_sb": side(name)})
        directions = direction_block(own, "_sy", "_sa", "_sb", by, **settings)
        directions = directions.select(*by, "accuracy_a", "accuracy_b", "delta", F.col("low").alias("delta_low"), F.col("high").alias("delta_high"), F.col("p_value").alias("p_directions"))
        part = error_block(own, "_ea", "_eb", by, **settings).join(directions, by).withColumn("baseline", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def balanced_flips(n: int, seed: int = 0) -> np.ndarray:
    """n shuffled signs, half of each (a benchmark without skill)."""
    out = np.array([1, -1] * (n // 2) + [1] * (n % 2))
    np.random.default_rng(seed).shuffle(out)
    return out
