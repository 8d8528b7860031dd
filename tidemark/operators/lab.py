"""Strategy lab: genomes as rows, evaluated together through a funnel of gates.

A genome is a row of parameters. Signals of all genomes come from one join of bars
with the (small, bounded) parameter table, so a batch is one plan, not a driver loop;
each gate keeps survivors and the first failing gate names the reason.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import sim

#: Genomes of one batch at most: what the parameter table may hold when it is joined with bars.
MOST_GENOMES = 10_000
FAMILIES = ("trend", "breakout", "reversion", "momentum")
#: A family that stated genomes may have, but no random one: entries by the relative strength index of `slow` bars under `threshold`, or over 100 less it.
STRENGTH = "rsi"
WIDTHS = (5, 10, 20, 50, 100)


def genome_id(genome: dict) -> str:
    """MD5 of the genome's JSON with sorted keys."""
    return hashlib.md5(json.dumps(genome, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def sample(n: int, seed: int = 0) -> list[dict]:
    """Random genomes."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        fast, slow = sorted(rng.choice(WIDTHS, 2, replace=False).tolist())
        out.append({"family": FAMILIES[int(rng.integers(len(FAMILIES)))], "fast": int(fast), "slow": int(slow), "threshold": round(float(rng.uniform(0.5, 2.5)), 3), "hold": int(rng.choice([6, 12, 24, 48]))})
    return out


def mutate(genome: dict, seed: int, rate: float = 0.3) -> dict:
    """The genome with some numbers changed by a fifth; widths stay 2 or more and in order."""
    rng = np.random.default_rng(seed)
    out = dict(genome)
    for k, v in genome.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool) and rng.random() < rate:
            x = v * (1 + rng.choice([-0.2, 0.2]))
            out[k] = max(2, int(round(x))) if isinstance(v, int) else round(float(x), 3)
    out["fast"], out["slow"] = sorted((out["fast"], out["slow"]))
    return out


def crossover(a: dict, b: dict, seed: int) -> dict:
    """Each field of one parent or the other."""
    rng = np.random.default_rng(seed)
    out = {k: (a if rng.random() < 0.5 else b)[k] for k in a}
    out["fast"], out["slow"] = sorted((out["fast"], out["slow"]))
    return out


def twist(genome: dict, seed: int) -> dict:
    """The genome's numbers under another family."""
    others = [f for f in FAMILIES if f != genome["family"]]
    return genome | {"family": others[int(np.random.default_rng(seed).integers(len(others)))]}


def focused(families: list[str], n: int, seed: int = 0) -> list[dict]:
    """n random genomes of some families only."""
    out, at = [], seed
    while len(out) < n:
        out += [g for g in sample(4 * n, at) if g["family"] in families][: n - len(out)]
        at += 1
    return out


def next_batch(survivors: list[dict], n: int, seed: int = 0, tried: set[str] = frozenset()) -> list[dict]:
    """n genomes not tried yet, in turn: children by mutation, by crossover (of one family), twists, and fresh ones of the survivors' families; each
    with its parents' ids. Without survivors all are random."""
    rng, out, seen, k = np.random.default_rng(seed), [], set(tried), 0
    families = sorted({g["family"] for g in survivors})
    while len(out) < n:
        k += 1
        own = int(rng.integers(1 << 30))
        if not survivors:
            child, parents = sample(1, own)[0], []
        else:
            a = survivors[int(rng.integers(len(survivors)))]
            mates = [g for g in survivors if g["family"] == a["family"]]
            b = mates[int(rng.integers(len(mates)))]
            child, parents = ((mutate(a, own), [a]), (crossover(a, b, own), [a, b]), (twist(a, own), [a]), (focused(families, 1, own)[0], []))[k % 4]
        if genome_id(child) not in seen:
            seen.add(genome_id(child))
            out.append(child | {"parents": [genome_id(p) for p in parents]})
    return out


def perturb(genome: dict, levels: tuple[float, ...] = (0.1, 0.2), runs: int = 3, seed: int = 0) -> list[dict]:
    """Variants with every number moved up or down by each level."""
    rng = np.random.default_rng(seed)
    out = []
    for level in levels:
        for run in range(runs):
            v = {k: (max(2, int(round(x * (1 + level * rng.choice([-1, 1]))))) if isinstance(x, int) else round(float(x * (1 + level * rng.choice([-1, 1]))), 4)) if isinstance(x, (int, float)) else x for k, x in genome.items()}
            v["fast"], v["slow"] = sorted((v["fast"], v["slow"]))
            out.append(v | {"level": level, "run": run})
    return out


def complexity(genome: dict) -> int:
    """Number of leaves of a nested genome."""
    return sum(complexity(v) if isinstance(v, dict) else 1 for v in genome.values())


def table(spark: SparkSession, genomes: list[dict]) -> DataFrame:
    """genome_id and typed parameters, one row each, duplicates dropped."""
    if len(genomes) > MOST_GENOMES:
        raise ValueError(f"more than {MOST_GENOMES} genomes in a batch")
    rows = [(genome_id(g), g["family"], g["fast"], g["slow"], float(g["threshold"]), g["hold"]) for g in genomes]
    return spark.createDataFrame(rows, "genome_id string, family string, fast int, slow int, threshold double, hold int").dropDuplicates(["genome_id"])


def hypotheses(spark: SparkSession, directions: list[str], widths: list[int], regimes: list[str], confirmations: list[str]) -> DataFrame:
    """All combinations of four short lists, with ids."""
    out = spark.createDataFrame([(x,) for x in directions], "direction string")
    for name, values, kind in (("width", widths, "int"), ("regime", regimes, "string"), ("confirmation", confirmations, "string")):
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return out.withColumn("hypothesis_id", s.canonical_id(F.col("direction"), F.col("width"), F.col("regime"), F.col("confirmation")))


def testable(made: DataFrame, bars: DataFrame) -> DataFrame:
    """Hypotheses for every asset that has as many bars as their width, with n, the number of bars. Hypotheses are short lists' combinations
    and travel as an array with each asset's row."""
    every = made.agg(F.collect_list(F.struct(*made.columns)).alias("_h")).first()["_h"]
    if len(every) > MOST_GENOMES:
        raise ValueError(f"more than {MOST_GENOMES} hypotheses")
    rows = made.sparkSession.createDataFrame(every, made.schema).withColumn("_one", F.lit(1))
    counts = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return counts.join(F.broadcast(rows), "_one").filter(F.col("n") >= F.col("width")).drop("_one")


def _strength(width: int):
    """Relative strength index of the changes _d, by plain means (100 without losses)."""
    up, down = t.mean(F.greatest(F.col("_d"), F.lit(0.0)), width), t.mean(F.greatest(-F.col("_d"), F.lit(0.0)), width)
    return F.when(t.rolling(F.count, "_d", width).isNotNull(), F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(up, down))))


def signals(bars: DataFrame, genomes: DataFrame) -> DataFrame:
    """bars x genomes with long and short entries and exits. Window values are computed once a bar for each width that the genomes read, then picked by a genome."""
    used = genomes.select("family", "fast", "slow").distinct().collect()  # at most MOST_GENOMES rows
    known = (*FAMILIES[:3], STRENGTH)  # any other family reads what momentum does
    slow = {f: {r["slow"] for r in used if r["family"] == f} for f in known}
    widths = {
        "m": slow["trend"] | slow["reversion"] | {r["fast"] for r in used if r["family"] == "trend"}, "s": slow["reversion"],
        "h": slow["breakout"], "l": slow["breakout"], "r": {r["fast"] for r in used if r["family"] not in known}, "i": slow[STRENGTH],
    }
    value = {"m": lambda w: t.mean("close", w), "s": lambda w: t.std("close", w), "h": lambda w: t.high("high", w, 1), "l": lambda w: t.low("low", w, 1), "r": lambda w: F.try_divide(F.col("close"), t.lag("close", w)) - 1, "i": _strength}
    own = bars.withColumn("_d", F.col("close") - t.lag("close")) if slow[STRENGTH] else bars
    own = own.withColumns({f"_{kind}{w}": value[kind](w) for kind in widths for w in sorted(widths[kind])})
    both = own.join(F.broadcast(genomes))  # at most MOST_GENOMES rows

    def pick(kind: str, width: str):
        out = F.lit(None).cast("double")
        for w in sorted(widths[kind], reverse=True):
            out = F.when(F.col(width) == w, F.col(f"_{kind}{w}")).otherwise(out)
        return out

    c, z = F.col("close"), F.try_divide(F.col("close") - pick("m", "slow"), pick("s", "slow"))
    family = F.col("family")
    long = F.when(family == "trend", pick("m", "fast") > pick("m", "slow")).when(family == "breakout", c > pick("h", "slow")).when(family == "reversion", z < -F.col("threshold")).when(family == STRENGTH, pick("i", "slow") < F.col("threshold")).otherwise(pick("r", "fast") > F.col("threshold") / 100)
    short = F.when(family == "trend", pick("m", "fast") < pick("m", "slow")).when(family == "breakout", c < pick("l", "slow")).when(family == "reversion", z > F.col("threshold")).when(family == STRENGTH, pick("i", "slow") > 100 - F.col("threshold")).otherwise(pick("r", "fast") < -F.col("threshold") / 100)
    return both.select("genome_id", "family", "hold", "asset", "ts", "close", t.true(long).alias("long_entry"), t.true(short).alias("short_entry"), F.lit(False).alias("long_exit"), F.lit(False).alias("short_exit"))


def run_positions(signal_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """signal rows with position; each series (of a genome and asset) holds for its own number of bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        flags = [pdf[c].to_numpy(bool) for c in ("long_entry", "long_exit", "short_entry", "short_exit")]
        return pdf.assign(position=sim.positions(*flags, int(pdf["hold"].iloc[0])).astype(np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signal_rows.schema.fields)
    return signal_rows.groupBy(*(by or ["genome_id", "asset"])).applyInPandas(run, f"{schema}, position int")


#: Thresholds of the five gates (fixed values). Costs are a share of the price for each side, fee and slippage together.
GATES = {
    "least_trades": 50, "least_profit_factor": 1.05, "deepest": -0.5, "cost": 0.0015, "oos_share": 0.4, "oos_blocks": 3, "oos_positive": 2, "oos_sharpe": 0.0,
    "most_single": 0.2, "most_top5": 0.6, "stress": (0.0015, 0.003, 0.005), "levels": (0.1, 0.2), "runs": 5, "most_degradation": 0.3,
}


def screen(bars: DataFrame, genomes: DataFrame, cost: float = GATES["cost"]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, trades, positions) of each genome and asset. Positions are kept, since every gate reads them; unpersist() them when done."""
    by = ["genome_id", "asset"]
    pos = run_positions(signals(bars, genomes)).persist()
    tr = sim.trades(pos, by, cost)
    of_trades = tr.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))).alias("trade_profit_factor"))
    metrics = sim.equity_metrics(sim.equity(pos, cost, by), by).join(of_trades, by, "left")
    return metrics.withColumn("n_trades", F.coalesce("n_trades", F.lit(0))), tr, pos


def out_of_sample(pos: DataFrame, share: float = GATES["oos_share"], n: int = GATES["oos_blocks"], cost: float = GATES["cost"]) -> DataFrame:
    """genome_id, asset, oos_sharpe (mean over blocks of the last share of bars) and positive_blocks; each block starts flat."""
    from tidemark.operators.evaluate import tail_blocks

    by = ["genome_id", "asset", "block"]
    cut = tail_blocks(pos.drop("position"), share, n, ("genome_id", "asset")).withColumn("block", F.col("block").cast("int"))
    m = sim.equity_metrics(sim.equity(run_positions(cut, by), cost, by), by)
    sharpe = F.coalesce("sharpe", F.lit(0.0))
    return m.groupBy("genome_id", "asset").agg(F.avg(sharpe).alias("oos_sharpe"), F.count_if(sharpe > 0).alias("positive_blocks"))


def cost_curve(pos: DataFrame, costs: tuple[float, ...] = GATES["stress"], by: tuple[str, ...] = ("genome_id", "asset")) -> DataFrame:
    """by, cost, total_return: the same positions under each cost a side, in one pass."""
    rows = pos.withColumn("cost", F.explode(F.array(*(F.lit(float(c)) for c in costs))))
    keys = [*by, "cost"]
    return sim.equity_metrics(sim.equity(rows, F.col("cost"), keys), keys).select(*keys, "total_return")


def stability(bars: DataFrame, genomes: list[dict], metrics: DataFrame, seed: int = 0, cost: float = GATES["cost"]) -> DataFrame:
    """genome_id, asset, stability_score: the share of perturbed variants whose Sharpe ratio falls by at most the allowed share."""
    spark = bars.sparkSession
    variants = [(genome_id(g), v) for g in genomes for v in perturb(g, GATES["levels"], GATES["runs"], seed)]
    family = spark.createDataFrame([(parent, genome_id({k: x for k, x in v.items() if k not in ("level", "run")}), i) for i, (parent, v) in enumerate(variants)], "parent string, variant string, n int")
    tried, _, _ = screen(bars, table(spark, [{k: x for k, x in v.items() if k not in ("level", "run")} for _, v in variants]), cost)
    rows = family.join(tried.select(F.col("genome_id").alias("variant"), "asset", F.col("sharpe").alias("_s"), "n_trades"), "variant").join(metrics.select(F.col("genome_id").alias("parent"), "asset", F.coalesce("sharpe", F.lit(0.0)).alias("_b")), ["parent", "asset"])
    ok = (F.col("n_trades") > 0) & F.when(F.col("_b") <= 0, F.col("_s") > F.col("_b")).otherwise((F.col("_b") - F.col("_s")) / F.abs("_b") <= GATES["most_degradation"])
    return rows.groupBy(F.col("parent").alias("genome_id"), "asset").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("stability_score"))


def funnel(metrics: DataFrame, trades: DataFrame, pos: DataFrame, stable: DataFrame | None = None, **limits) -> DataFrame:
    """metrics with failed_at: the first of the gates (screening, walk_forward, concentration, cost_stress, stability) that a genome fails, NULL for survivors.

    stable is what stability() gives; a genome without a score fails the last gate."""
    g, by = GATES | limits, ["genome_id", "asset"]
    conc = sim.concentration(trades, by).select(*by, "total", "top1_share", "top5_share")
    costs = cost_curve(pos, g["stress"]).groupBy(*by).agg(F.count_if(F.col("total_return") > 0).alias("costs_survived"))
    rows = metrics.join(out_of_sample(pos, g["oos_share"], g["oos_blocks"], g["cost"]), by, "left").join(conc, by, "left").join(costs, by, "left")
    rows = rows.join(stable, by, "left") if stable is not None else rows.withColumn("stability_score", F.lit(None).cast("double"))
    return rows.withColumn("failed_at", s.first_failing([
        ("screening", (F.col("n_trades") >= g["least_trades"]) & (F.col("trade_profit_factor") >= g["least_profit_factor"]) & (F.col("max_drawdown") >= g["deepest"])),
        ("walk_forward", (F.col("oos_sharpe") > g["oos_sharpe"]) & (F.col("positive_blocks") >= g["oos_positive"])),
        ("concentration", (F.col("total") > 0) & (F.col("top1_share") <= g["most_single"]) & (F.col("top5_share") <= g["most_top5"])),
        ("cost_stress", F.col("costs_survived") > len(g["stress"]) // 2), ("stability", F.col("stability_score") > 0.5),
    ]))


def family_summary(funnelled: DataFrame, genomes: DataFrame) -> DataFrame:
    """Genomes, survivors, best Sharpe ratio and most frequent reason of each family."""
    return summary(funnelled.join(genomes.select("genome_id", "family"), "genome_id"))


def summary(rows: DataFrame) -> DataFrame:
    """The same of rows with family, failed_at (NULL: survived) and sharpe."""
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed_at").isNull()).alias("survivors"), F.max("sharpe").alias("best_sharpe"), F.mode(F.coalesce("failed_at", F.lit("none")), True).alias("top_reason"))


def stop_sweep(signal_rows: DataFrame, multipliers: list[float], prediction: str, fee: float = 0.001) -> DataFrame:
    """Metrics of each asset and stop multiplier (0: the fixed stop): all of them in one pass over (asset, multiplier) series."""
    m = F.explode(F.array(*(F.lit(float(x)) for x in multipliers)))
    rows = signal_rows.withColumn("multiplier", m)
    d = F.try_divide(F.col("multiplier") * F.col(prediction), F.col("close"))
    stop = F.when((F.col("multiplier") == 0) | d.isNull(), 0.05).otherwise(F.greatest(F.lit(0.005), F.least(F.lit(0.2), d)))
    tr = sim.stopped(rows.withColumn("stop", stop).select("asset", "multiplier", "ts", "open", "low", "close", "entry", "exit", "stop"), fee, ["asset", "multiplier"])
    return sim.trade_metrics(tr, ["asset", "multiplier"])


def best_multiplier(sweep: DataFrame, least_trades: int = 30) -> DataFrame:
    """asset, multiplier: the best positive Sharpe ratio among multipliers with enough trades (the least of equal ones), 0.0 without any."""
    ok = F.when((F.col("multiplier") > 0) & (F.col("n") >= least_trades) & (F.col("sharpe") > 0), F.struct("sharpe", -F.col("multiplier")))
    return sweep.groupBy("asset").agg(F.max(ok).alias("_b")).select("asset", F.coalesce(-F.col("_b.col2"), F.lit(0.0)).alias("multiplier"))
