"""Simulators and trade statistics.

Position rules are sequential: a bar's position rests on the one before. They run as
one grouped function for each series (and parameter row), over Arrow batches; what
follows from positions (equity, drawdowns, trades) is windows and sums again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import ts as t


def positions(le: np.ndarray, lx: np.ndarray, se: np.ndarray, sx: np.ndarray, hold: int | None = None) -> np.ndarray:
    """Positions after each bar: entries only from flat, both at once ignored; exit on its condition, on the opposite entry or after `hold` bars."""
    out, now, since = np.zeros(len(le), np.int8), 0, 0
    for i in range(len(le)):
        if now:
            over = hold is not None and i - since >= hold
            if over or (now > 0 and (lx[i] or se[i])) or (now < 0 and (sx[i] or le[i])):
                now = 0
                out[i] = 0
                continue
        elif le[i] != se[i]:
            now, since = (1 if le[i] else -1), i
        out[i] = now
    return out


def _grouped(df: DataFrame, by: list[str], fn, added: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*by).applyInPandas(lambda pdf: fn(pdf.sort_values("ts").reset_index(drop=True)), f"{schema}, {added}")


def sequentialize(df: DataFrame, hold: int | None = None, by: list[str] | None = None) -> DataFrame:
    """df (long_entry, long_exit, short_entry, short_exit) with position after each bar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = [pdf[c].fillna(False).to_numpy(bool) for c in ("long_entry", "long_exit", "short_entry", "short_exit")]
        return pdf.assign(position=positions(*flags, hold).astype(np.int32))

    return _grouped(df, by or ["asset"], run, "position int")


def long_only(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df (entry, exit) with position 0 or 1 after each bar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, x = pdf["entry"].fillna(False).to_numpy(bool), pdf["exit"].fillna(False).to_numpy(bool)
        out, now = np.zeros(len(pdf), np.int32), 0
        for i in range(len(pdf)):
            now = (0 if x[i] else 1) if now else int(e[i] and not x[i])
            out[i] = now
        return pdf.assign(position=out)

    return _grouped(df, by or ["asset"], run, "position int")


def trades(df: DataFrame, by: list[str] | None = None, cost: float = 0.001) -> DataFrame:
    """Trades of a position column: times, direction, prices, bars held, pnl (net return with costs on both legs). Open trades are left out.

    Windows only: a trade is a run of equal positions, ended by the next row."""
    by = by or ["asset"]
    w = Window.partitionBy(*by).orderBy("ts")
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    rows = df.withColumn("_n", (F.col("position") != before).cast("int")).withColumn("trade", F.sum("_n").over(w)).withColumn("_nt", F.lead("ts").over(w)).withColumn("_nc", F.lead("close").over(w))
    runs = rows.filter("position <> 0").groupBy(*by, "trade").agg(F.min("ts").alias("entry_ts"), F.max_by("_nt", "ts").alias("exit_ts"), F.first("position").alias("direction"), F.min_by("close", "ts").alias("entry_price"), F.max_by("_nc", "ts").alias("exit_price"), F.count(F.lit(1)).alias("bars"))
    gross = F.col("direction") * (F.try_divide("exit_price", "entry_price") - 1)
    return runs.filter(F.col("exit_ts").isNotNull()).withColumn("pnl", gross - 2 * cost)


def equity(df: DataFrame, cost: float | Column = 0.001, by: list[str] | None = None) -> DataFrame:
    """df (position, close) with ret (net return of each bar) and equity (its product), by windows alone."""
    by = tuple(by or ["asset"])
    w = Window.partitionBy(*by).orderBy("ts")
    held = F.coalesce(F.lag("position").over(w), F.lit(0))
    move = F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1, F.lit(0.0))
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    own = blocks.bounded(df, lambda x: x.withColumn("ret", held * move - cost * F.abs(F.col("position") - held)), 1, by=by)
    grown = blocks.running(own, {"equity": ("sum", F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12))))}, by)
    return grown.withColumn("equity", F.exp("equity"))


def drawdown(df: DataFrame, c: str = "equity", by: list[str] | None = None) -> DataFrame:
    """df with drawdown: c over its running maximum less 1, never above 0."""
    top = blocks.running(df, {"drawdown": ("max", F.col(c))}, tuple(by or ["asset"]))
    return top.withColumn("drawdown", F.try_divide(F.col(c), "drawdown") - 1)


def equity_metrics(df: DataFrame, by: list[str] | None = None, periods: float | None = None) -> DataFrame:
    """Total return, deepest drawdown, win rate, profit factor, Sharpe ratio (population deviation) and Sortino ratio (root of the mean squared
    loss; both annualised if periods is given) of ret and equity."""
    by = by or ["asset"]
    rows = drawdown(df, by=by)
    gain, loss = F.sum(F.when(F.col("ret") > 0, F.col("ret"))), F.sum(F.when(F.col("ret") < 0, -F.col("ret")))
    year = math.sqrt(periods) if periods else 1.0
    sharpe = F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * year
    sortino = F.try_divide(F.avg("ret"), F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))) * year
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", "ts") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
        F.try_divide(F.count_if(F.col("ret") > 0).cast("double"), F.count_if(F.col("ret") != 0)).alias("win_rate"), F.try_divide(gain, loss).alias("profit_factor"), sharpe.alias("sharpe"), sortino.alias("sortino"),
    )


def trade_metrics(tr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean, win rate, profit factor, t-statistic and Sharpe ratio (not annualised) of trades' pnl."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))
    t_stat = F.try_divide(F.avg("pnl"), F.stddev_samp("pnl") / F.sqrt(F.count("pnl").cast("double")))
    return tr.groupBy(*(by or ["asset"])).agg(F.count("pnl").alias("n"), F.avg("pnl").alias("mean_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.try_divide(gain, loss).alias("profit_factor"), t_stat.alias("t_stat"), F.try_divide(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"))


def concentration(tr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of the total profit that the best 1, 5 and 10 trades make, and the best month's and quarter's."""
    by = by or ["asset"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pnl"), "entry_ts"))
    ranked = tr.withColumn("_p", place)
    best = ranked.groupBy(*by).agg(F.sum("pnl").alias("total"), *(F.sum(F.when(F.col("_p") <= k, F.col("pnl"))).alias(f"top{k}") for k in (1, 5, 10)), F.count(F.lit(1)).alias("n"))
    spans = best
    for span in ("month", "quarter"):
        start = F.date_trunc(span, F.timestamp_millis("entry_ts"))
        spans = spans.join(tr.groupBy(*by, start.alias("_m")).agg(F.sum("pnl").alias("_s")).groupBy(*by).agg(F.max("_s").alias(f"best_{span}")), by)
    return spans.withColumns({f"{c}_share": F.when(F.col("total") > 0, F.try_divide(c, "total")) for c in ("top1", "top5", "top10", "best_month", "best_quarter")})


def regime_returns(df: DataFrame, regimes: list[str], periods: float = 8760.0, by: list[str] | None = None) -> DataFrame:
    """Sum and annualised Sharpe ratio of ret in each label of each regime column."""
    by = by or ["asset"]
    long = df.select(*by, "ret", F.explode(F.array(*(F.struct(F.lit(r).alias("kind"), F.col(r).alias("label")) for r in regimes))).alias("_x")).select(*by, "ret", "_x.kind", "_x.label")
    return long.groupBy(*by, "kind", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total_return"), (F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * math.sqrt(periods)).alias("sharpe"))


def all_in(df: DataFrame, cash: float = 10_000.0, fee: float = 0.001, slippage: float = 0.0005, by: list[str] | None = None) -> DataFrame:
    """df (close, entry, exit) with units, cash and value of an account that buys all it can on entry and sells all on exit, at the bar's close."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, x, p = pdf["entry"].fillna(False).to_numpy(bool), pdf["exit"].fillna(False).to_numpy(bool), pdf["close"].to_numpy(float)
        units, money, out = 0.0, cash, np.zeros((len(pdf), 3))
        for i in range(len(pdf)):
            if units and x[i]:
                money, units = units * p[i] * (1 - slippage) * (1 - fee), 0.0
            elif not units and e[i] and not x[i] and p[i] > 0:
                units, money = money * (1 - fee) / (p[i] * (1 + slippage)), 0.0
            out[i] = units, money, money + units * p[i]
        return pdf.assign(units=out[:, 0], cash=out[:, 1], value=out[:, 2])

    return _grouped(df, by or ["asset"], run, "units double, cash double, value double")


def stopped(df: DataFrame, fee: float = 0.001, by: list[str] | None = None, roi: dict[int, float] | None = None) -> DataFrame:
    """Trades of entry and exit signals with a stop of `stop` (share of the entry price) for each bar.

    Fills are at the close of the signal's bar; a low under the stop fills at the stop (or the open, if that is lower). An opposite
    or repeated entry is ignored; the last open trade is closed at the last bar. roi: the least profit at which a trade
    is taken at the close, by the bars that it has been held (the latest entry that applies counts)."""
    by = by or ["asset"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        o, lo, c, ts = (pdf[k].to_numpy() for k in ("open", "low", "close", "ts"))
        e, x, stop = pdf["entry"].fillna(False).to_numpy(bool), pdf["exit"].fillna(False).to_numpy(bool), pdf["stop"].fillna(np.inf).to_numpy(float)
        rows, at = [], -1
        for i in range(len(pdf)):
            if at >= 0:
                limit = c[at] * (1 - stop[at])
                enough = next((v for k, v in sorted((roi or {}).items(), reverse=True) if i - at >= k), None)
                price, why = (min(limit, o[i]), "stop") if lo[i] <= limit else (c[i], "roi") if enough is not None and c[i] / c[at] - 1 >= enough else (c[i], "exit") if x[i] else (c[i], "end") if i == len(pdf) - 1 else (None, "")
                if price is not None:
                    rows.append((int(ts[at]), int(ts[i]), float(c[at]), float(price), why, float(price * (1 - fee) / (c[at] * (1 + fee)) - 1)))
                    at = -1
            elif e[i] and i < len(pdf) - 1 and c[i] > 0:
                at = i
        out = pd.DataFrame(rows, columns=["entry_ts", "exit_ts", "entry_price", "exit_price", "reason", "pnl"])
        for k in reversed(by):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    return df.groupBy(*by).applyInPandas(run, f"{keys}, entry_ts long, exit_ts long, entry_price double, exit_price double, reason string, pnl double")


def paper_broker(df: DataFrame, capital: float = 100.0, fee: float = 0.001, slippage: float = 0.001, by: list[str] | None = None) -> DataFrame:
    """df (close, signal: 1, -1 or 0, quantity) with action, pnl, cash and value of an account that needs the full notional for either side.

    A signal opens a position where there is none and closes it where there is one, at the close and with slippage against the
    side; what is closed is the held quantity, whatever the closing row says. Proceeds of a sale stay collateral, count in the value and are
    paid out on closing, as the rule has it that this follows. A position that the cash can't cover is rejected."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, rows = capital, None, []
        for p, s, q in zip(pdf["close"].to_numpy(float), pdf["signal"].fillna(0).to_numpy(int), pdf["quantity"].to_numpy(float)):
            action, pnl = "", None
            if s:
                fill = p * (1 + slippage * s)
                if held is None:
                    cost = fill * q
                    if cost * (1 + fee) > cash:
                        action = "REJECTED"
                    else:
                        cash -= cost * fee + (cost if s > 0 else 0)
                        held, action = (s, q, fill, cost * fee, cost), "OPEN"
                else:
                    # what is closed is what is held, whatever quantity the closing row has
                    side, size, entry, paid, collateral = held
                    cost = fill * size
                    pnl = (fill - entry) * size * side - cost * fee - paid
                    cash += cost * (1 - fee) if side > 0 else collateral + pnl
                    held, action = None, "CLOSE"
            value = cash if held is None else cash + (held[1] * p if held[0] > 0 else held[4] + (held[2] - p) * held[1])
            rows.append((action, pnl, cash, value))
        return pdf.assign(**dict(zip(("action", "pnl", "cash", "value"), map(list, zip(*rows))))) if rows else pdf

    return _grouped(df, by or ["asset"], run, "action string, pnl double, cash double, value double")


def two_leg(df: DataFrame, cost: float = 0.0015, by: list[str] | None = None) -> DataFrame:
    """Trades of a spread (long a_close, short b_close): signals act one bar later; a trade pays cost on four legs."""
    by = by or ["asset"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        e, x = pdf["entry"].fillna(False).to_numpy(bool), pdf["exit"].fillna(False).to_numpy(bool)
        a, b, ts = pdf["a_close"].to_numpy(float), pdf["b_close"].to_numpy(float), pdf["ts"].to_numpy()
        rows, at = [], -1
        for i in range(1, len(pdf)):
            if at >= 0 and x[i - 1]:
                rows.append((int(ts[at]), int(ts[i]), float((a[i] / a[at] - 1) - (b[i] / b[at] - 1) - 4 * cost)))
                at = -1
            elif at < 0 and e[i - 1]:
                at = i
        out = pd.DataFrame(rows, columns=["entry_ts", "exit_ts", "pnl"])
        for k in reversed(by):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    return df.groupBy(*by).applyInPandas(run, f"{keys}, entry_ts long, exit_ts long, pnl double")


def rebalanced(df: DataFrame, drift: float = 0.05, fee_bps: float = 10.0, every_ms: int = 86_400_000, target: str | None = None) -> DataFrame:
    """Value of a portfolio over columns a_close and b_close (one row a time): equal weights, or `target` for a's weight,
    restored at each multiple of every_ms where the drift is over the limit, at a cost on what is traded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        a, b, ts = pdf["a_close"].to_numpy(float), pdf["b_close"].to_numpy(float), pdf["ts"].to_numpy()
        want = pdf[target].fillna(0.5).to_numpy(float) if target else np.full(len(pdf), 0.5)
        wa = want[0]
        value, va, vb = 1.0, wa, 1 - wa
        out = np.zeros((len(pdf), 2))
        for i in range(len(pdf)):
            if i:
                va, vb = va * a[i] / a[i - 1], vb * b[i] / b[i - 1]
            value = va + vb
            if ts[i] % every_ms == 0 and abs(va / value - want[i]) > drift:
                value -= abs(va - value * want[i]) * 2 * fee_bps / 1e4
                va, vb = value * want[i], value * (1 - want[i])
            out[i] = value, va / value
        return pdf.assign(equity=out[:, 0], weight=out[:, 1])

    return _grouped(df, ["asset"], run, "equity double, weight double")


def returns_of(c: str = "equity", by: tuple[str, ...] = ("asset",)) -> Column:
    """Per-row returns of a value column."""
    return F.coalesce(F.try_divide(F.col(c), t.lag(c, by=by)) - 1, F.lit(0.0))
