"""Streams with state and timers, database scans, the streamed paged source, lineage, parity and statistics of large groups, on small data."""

from __future__ import annotations

import json
import random
import sqlite3
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

from tests.helpers import BASE, frame, walk
from tidemark.operators import lineage, ordered, parity, stats
from tidemark.schema import BARS, DAY_MS, HOUR_MS
from tidemark.sources import database, readers, rest
from tidemark.streaming import live, pending

# Streams ---------------------------------------------------------------------------------------------------------


def replay(spark, path, parts, build, schema):
    """The rows after each part, each a run of its own over the same checkpoint."""
    out = []
    for part in parts:
        if part is not None:
            part.withColumn("at", F.timestamp_millis("ts")).write.mode("append").parquet(f"{path}/in")
        made = build(spark.readStream.schema(f"{schema}, at timestamp").parquet(f"{path}/in"))
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted((tuple(r) for r in spark.read.schema(made.schema).parquet(f"{path}/out").collect()), key=str))
    return out


SCHEMA = "asset string, ts long, open double, high double, low double, close double, volume double"


def bar(hour, close, asset="x", open_=1.0):
    return asset, BASE + hour * HOUR_MS, open_, max(open_, close), min(open_, close), close, 1.0


def test_forward_returns_of_a_stream(spark, tmp_path):
    def part(*rows):
        return spark.createDataFrame(list(rows), SCHEMA).coalesce(1)

    parts = [
        part(bar(0, 2.0), bar(1, 3.0), bar(0, 5.0, "y")),  # two breakouts; x's first has its first return at once
        part(bar(3, 4.0), bar(2, 1.0), bar(2, 1.0)),  # out of order, and one twice
        None,  # a restart without anything new
        part(bar(40, 1.0), bar(2, 9.0, "y"), bar(3, 1.5, "x")),  # far ahead; y's bar is still in time, x's comes again
        part(bar(1, 7.0, "y"), bar(80, 1.0)),  # too late by now
    ]
    got = replay(spark, str(tmp_path), parts, lambda s: pending.forward_returns(s, F.col("close") > F.col("open") + 0.5, (1, 2, 3)), SCHEMA)
    short = [[(r[0], (r[1] - BASE) // HOUR_MS, r[2], r[4], r[6]) for r in rows] for rows in got]
    assert short[0] == [("x", 0, 1, 1, 0.5)]
    both = [("x", 0, 1, 1, 0.5), ("x", 0, 2, 1, -0.5), ("x", 0, 3, 1, 1.0), ("x", 1, 1, 1, 1 / 3 - 1), ("x", 1, 2, 1, 4 / 3 - 1)]
    assert [x[:4] for x in sorted(short[1])] == [x[:4] for x in both] and [x[4] for x in sorted(short[1])] == pytest.approx([x[4] for x in both])
    assert short[2] == short[1]  # a restart repeats nothing
    last = {r[:3]: r[4] for r in short[4]}
    assert len(short[4]) == len(last)  # each once
    assert last[("x", 1, 3)] is None and last[("y", 0, 1)] is None and last[("y", 0, 2)] == pytest.approx(0.8) and last[("y", 0, 3)] is None
    assert last[("x", 3, 1)] is None and last[("x", 3, 3)] is None


def test_completions_of_a_stream(spark, tmp_path):
    bars = [bar(k, 1.0 + k % 3) for k in range(6) if k != 3]
    made = [("x", BASE + k * HOUR_MS, 0.5) for k in range(1, 5)]
    for name, rows, schema in (("bars", bars, SCHEMA), ("forecasts", made, "asset string, ts long, predicted_range double")):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ts")).write.parquet(f"{tmp_path}/{name}")

    def run():
        streams = {n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in ("bars", "forecasts")}
        out = pending.completions(streams["forecasts"], streams["bars"])
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {(r["ts"] - BASE) // HOUR_MS: (r["actual_range"], r["breakout_flag"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}

    first = run()
    assert first == {1: (1.0, 0), 2: (2.0, 1), 4: (1.0, 0)}  # the missing bar's forecast waits
    spark.createDataFrame([bar(60, 1.0)], SCHEMA).withColumn("at", F.timestamp_millis("ts")).write.mode("append").parquet(f"{tmp_path}/bars")
    spark.createDataFrame([("x", BASE + 60 * HOUR_MS, 9.0)], "asset string, ts long, predicted_range double").withColumn("at", F.timestamp_millis("ts")).write.mode("append").parquet(f"{tmp_path}/forecasts")
    assert run() == first | {3: (None, None), 60: (0.0, 0)}


def test_signals_hold_until_the_next_or_too_old(spark):
    signals = spark.createDataFrame([("x", BASE, 1.0), ("x", BASE + 5 * HOUR_MS, 2.0), ("x", BASE + 90 * HOUR_MS, 3.0), ("y", BASE, 9.0)], "asset string, ts long, vol double")
    bars = spark.createDataFrame([bar(k, 1.0) for k in range(-2, 100)], SCHEMA)
    got = {(r["ts"] - BASE) // HOUR_MS: r["vol"] for r in pending.signalled(bars, signals, ["vol"], 30 * HOUR_MS, 7 * HOUR_MS).collect()}
    assert len(got) == 102 and all(got[k] == (None if k < 0 else 1.0 if k < 5 else 2.0 if k <= 35 else None if k < 90 else 3.0) for k in got)


def test_pending_rows_of_any_age_are_completed(spark, tmp_path):
    s = live.state(spark, str(tmp_path / "live"))
    pdf = walk(400)
    hole = pdf.iloc[60]
    early, late = pdf.iloc[:60], pdf.iloc[61:]
    at = int(hole["ts"])
    live.cycle(s, frame(spark, early), at)
    assert s.open.read().count() == 1  # the forecast of the bar that is missing
    now = int(pdf["ts"].iloc[-1]) + HOUR_MS
    live.cycle(s, frame(spark, late), now, context=50)
    assert s.predictions.read().filter(F.col("ts") == at).first()["actual_range"] is None and s.open.read().count() == 2
    live.cycle(s, frame(spark, pdf.iloc[60:61]), now, context=50)  # it comes long after the context has gone by
    done = s.predictions.read().filter(F.col("ts") == at).first()
    assert done["actual_range"] == pytest.approx(max(0, hole["high"] - hole["low"])) and s.open.read().filter(F.col("ts") == at).count() == 0


def test_returns_that_wait_longer_than_the_context(spark, tmp_path):
    s = live.state(spark, str(tmp_path / "live"))
    pdf = walk(200)
    at = int(pdf["ts"].iloc[20])
    rows = [(at, "x", 1, 1, at + HOUR_MS, 100.0, None, None)]
    s.returns.write(spark.createDataFrame(rows, s.returns.schema))
    s.open.write(live.still_open(s.predictions.read(), s.returns.read()))
    live.cycle(s, frame(spark, pdf), int(pdf["ts"].iloc[-1]) + HOUR_MS, context=10)
    got = s.returns.read().filter(F.col("breakout_ts") == at).first()
    assert got["forward_return"] == pytest.approx(pdf["close"].iloc[21] / 100 - 1) and s.open.read().filter("kind = 'return' AND ts = %d" % at).count() == 0


# Databases -------------------------------------------------------------------------------------------------------------


def test_database_scans_and_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "b.db")
    rows = frame(spark, pd.concat([walk(300, "a"), walk(50, "b", 2)])).repartition(4)
    database.insert(rows, path, "bars", ["asset", "ts"])
    database.insert(rows.limit(100).withColumn("close", F.lit(0.0)), path, "bars", ["asset", "ts"])  # stored rows stay
    got = database.scan(spark, path, "bars", BARS, partitions=5)
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    some = got.filter((F.col("asset") == "a") & (F.col("ts") >= BASE + 10 * HOUR_MS) & F.col("asset").isin("a", "b") & (F.length("asset") == 1))
    assert some.count() == 290 and database.scan(spark, path, "bars", BARS).filter("ts < 0").count() == 0
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE odd (k INTEGER, name TEXT)")
        db.executemany("INSERT INTO odd VALUES (?, ?)", [(None, "none"), (1, None), (1, "x' OR 1=1"), (9, "y")])
    odd = database.scan(spark, path, "odd", "k long, name string", key="k", partitions=3)
    assert odd.count() == 4 and odd.filter(F.col("name") == "x' OR 1=1").count() == 1 and odd.filter("k IS NULL").first()["name"] == "none" and odd.filter("name IS NULL").count() == 1


def test_which_filters_are_pushed(tmp_path):
    path = str(tmp_path / "b.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE bars (asset TEXT, ts INTEGER)")
        db.executemany("INSERT INTO bars VALUES (?, ?)", [("a", k) for k in range(100)])
    reader = database.Reader({"path": path, "table": "bars", "key": "ts", "partitions": "4"}, BARS)
    kept = list(reader.pushFilters([EqualTo(("asset",), "a"), GreaterThanOrEqual(("ts",), 20), LessThan(("ts",), 60), In(("asset",), ("a", "b")), IsNotNull(("ts",)), StringContains(("asset",), "a"), EqualTo(("x", "y"), 1)]))
    assert [type(f).__name__ for f in kept] == ["StringContains", "EqualTo"]
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(20, 30), (30, 40), (40, 50), (50, 60)]  # ranges of what the filters leave only
    sql, values = reader.statement(parts[0])
    assert sql.endswith('WHERE "asset" = ? AND "ts" >= ? AND "ts" < ? AND "asset" IN (?, ?) AND "ts" IS NOT NULL AND "ts" >= ? AND "ts" < ?') and values == ["a", 20, 60, "a", "b", 20, 30]


def test_replay_to_a_second_database(spark, tmp_path):
    rows = frame(spark, pd.concat([walk(30, "a"), walk(20, "b", 2)]))
    a, b = str(tmp_path / "a.db"), str(tmp_path / "b.db")
    database.insert(rows, a, "bars", ["asset", "ts"])
    database.insert(rows.filter("asset = 'b'"), b, "bars", ["asset", "ts"])
    got = {r["asset"]: (r["n_source"], r["n_target"], r["equal"]) for r in database.replayed(spark, a, b, "bars", BARS, ["asset", "ts"], "asset").collect()}
    assert got == {"a": (30, 30, True), "b": (20, 20, True)}


# The paged source ------------------------------------------------------------------------------------------------------------


def capped(symbol, timeframe, since, limit):
    """A server that answers with three bars at most, whatever is asked, and has a hole."""
    first = max(0, -(-(since - BASE) // HOUR_MS))
    hours = [i for i in range(first, 40) if i not in (11, 12)][: min(limit, 3)]
    return [[BASE + i * HOUR_MS, 1.0, 2.0, 0.5, 1.5, float(i)] for i in hours]


def test_short_pages_of_bars_lose_nothing(spark):
    got = rest.read_pages(spark, "candles", "tests.test_pending:capped", "x", BASE, BASE + 40 * HOUR_MS, limit=25)
    assert sorted(r["volume"] for r in got.collect()) == [float(i) for i in range(40) if i not in (11, 12)]
    assert rest.missing_ranges(got, BASE, BASE + 45 * HOUR_MS, HOUR_MS) == [(BASE + 11 * HOUR_MS, BASE + 13 * HOUR_MS), (BASE + 40 * HOUR_MS, BASE + 45 * HOUR_MS)]
    assert rest.budget(0, 100, 1, 10, 4) == (40, (40, 100)) and rest.budget(0, 30, 1, 10, 4) == (30, None)


def test_paged_stream_goes_on_from_its_offset(spark, tmp_path):
    def run(hours):
        stream = rest.stream_pages(spark, "tests.test_pending:capped", ["x", "y"], BASE, limit=7, clock_ms=BASE + hours * HOUR_MS + 5)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["asset"], int(r["volume"])) for r in spark.read.schema(BARS).parquet(f"{tmp_path}/rows").collect())

    for hours in (10, 25, 25, 40):
        assert run(hours) == [(s, i) for s in "xy" for i in range(hours) if i not in (11, 12)]


# Files in parts ---------------------------------------------------------------------------------------------------------------------


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    import pyarrow as pa

    pdf = walk(100)
    table = pa.table({"Date": pd.to_datetime(pdf["ts"], unit="ms", utc=True), **{c: pdf[c] for c in ("open", "high", "low", "close", "volume")}})
    with pa.ipc.new_file(f"{tmp_path}/a.feather", table.schema) as f:
        for batch in table.to_batches(max_chunksize=7):
            f.write_batch(batch)
    own = readers.bars_feather(spark, [f"{tmp_path}/a.feather"], "x")
    assert sorted((r["ts"], r["close"]) for r in own.collect()) == sorted(zip(pdf["ts"], pdf["close"]))
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(20):
            z.writestr(f"run{k}.json", json.dumps({"strategy": {f"s{k}": {"trades": [{"pair": "p", "profit_ratio": k / 2, "close_timestamp": k}] * 3}}}))
        z.writestr("notes.txt", "x")
    trades = readers.trades_zip(spark, f"{tmp_path}/t.zip")
    assert sorted(r["profit_ratio"] for r in trades.collect()) == sorted(k / 2 for k in range(20) for _ in range(3))
    assert trades.select(F.spark_partition_id().alias("p")).distinct().count() > 1


# Lineage ------------------------------------------------------------------------------------------------------------------------------------


def test_ancestors_by_doubling(spark, tmp_path):
    edges = [(f"n{k}", f"n{k - 1}") for k in range(1, 40)] + [("n0", None), ("m", "n10"), ("m", "n3"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self")]
    got = {(r["node"], r["ancestor"]): r["distance"] for r in lineage.ancestors(spark.createDataFrame(edges, "node string, parent string"), str(tmp_path)).collect()}
    assert got[("n39", "n0")] == 39 and got[("m", "n0")] == 4 and got[("m", "n10")] == 1 and got[("a", "a")] == 3 and got[("self", "self")] == 1 and ("n0", "n1") not in got
    assert sum(1 for node, _ in got if node.startswith("n")) == 39 * 40 // 2
    assert lineage.ancestors(spark.createDataFrame([], "node string, parent string"), str(tmp_path / "none")).count() == 0


def test_generations_and_their_rejections(spark, tmp_path):
    rows = [("a", None, "1", 1), ("b", "a", "2", 2), ("c", "b", "3", 3), ("b", "c", "4", 4), ("d", "a", "2", 5), ("e", "d", "5", 6), ("f", "gone", "6", 7), ("g", "f", "7", 8), ("h", "i", "8", 9), ("i", "h", "9", 10), ("j", "i", "10", 11), ("k", None, None, 12), ("l", "l", "12", 13)]
    got = {(r["id"], r["seq"]): (r["stage"], r["root"], r["generation"]) for r in lineage.generations(spark.createDataFrame(rows, "id string, parent string, body string, seq long"), str(tmp_path)).collect()}
    assert got[("a", 1)] == (None, "a", 0) and got[("b", 2)] == (None, "a", 1) and got[("c", 3)] == (None, "a", 2) and got[("k", 12)] == (None, "k", 0)
    assert got[("b", 4)][0] == got[("d", 5)][0] == "repeated" and got[("e", 6)][0] == got[("f", 7)][0] == got[("g", 8)][0] == "no parent"
    assert {got[k][0] for k in (("h", 9), ("i", 10), ("j", 11), ("l", 13))} == {"cycle"} and len(got) == len(rows)


def test_long_lines_take_one_row_a_node_in_each_round(spark, tmp_path):
    import glob

    rows = [(f"n{k}", f"n{k - 1}" if k else None, str(k), k) for k in range(300)]
    rows += [(f"c{k}", f"c{(k + 1) % 7}", f"c{k}", 300 + k) for k in range(7)] + [(f"t{k}", f"t{k - 1}" if k else "c3", f"t{k}", 400 + k) for k in range(30)]
    got = {r["id"]: (r["stage"], r["root"], r["generation"]) for r in lineage.generations(spark.createDataFrame(rows, "id string, parent string, body string, seq long"), str(tmp_path)).collect()}
    assert got == {i: (None, "n0", int(i[1:])) if i[0] == "n" else ("cycle", None, None) for i, *_ in rows}
    written = {f.rsplit("/", 1)[0] for f in glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)}
    assert written and max(spark.read.parquet(folder).count() for folder in written) <= len(rows)


def test_stages_and_funnel(spark):
    rows = lineage.staged(spark.createDataFrame([(k, None if k == 4 else k * 1.0) for k in range(10)], "k long, x double"), {"few": F.col("x") > 2, "odd": F.col("k") % 2 == 1})
    assert [r["stage"] for r in rows.orderBy("k").collect()] == ["few", "few", "few", None, "few", None, "odd", None, "odd", None]
    again = lineage.staged(rows, {"more": F.col("k") > 5})
    assert [r["stage"] for r in again.orderBy("k").collect()][3:6] == ["more", "few", "more"]
    assert sorted(map(tuple, lineage.funnel(rows, ["few", "odd", "none"]).collect())) == [("few", 10, 4, 6), ("none", 4, 0, 4), ("odd", 6, 2, 4)]


# Parity -------------------------------------------------------------------------------------------------------------------------------------------


COLUMNS = ["open", "high", "low", "close", "volume"]


@pytest.fixture(scope="module")
def table():
    return pd.concat([walk(300, "a"), walk(120, "b", 2), walk(5, None, 3)])


def first(spark, a, b, **more):
    return [tuple(r) for r in parity.first_mismatch(frame(spark, a), frame(spark, b), COLUMNS, DAY_MS, **more).collect()]


def test_parity_of_equal_tables(spark, table):
    assert first(spark, table, table.sample(frac=1, random_state=1)) == []
    assert first(spark, table[:0], table[:0]) == []


def test_first_mismatch_is_named(spark, table):
    other = table.copy()
    other.iloc[[150, 201, 310], other.columns.get_loc("low")] = 0.25
    assert first(spark, table, other) == [("a", int(table["ts"].iloc[150]), "low", str(table["low"].iloc[150]), "0.25")]
    gone = table.drop(table.index[50]) if table.index.is_unique else table[~((table["asset"] == "a") & (table["ts"] == BASE + 50 * HOUR_MS))]
    assert first(spark, table, gone)[0][:3] == ("a", BASE + 50 * HOUR_MS, "row")
    assert first(spark, table[table["asset"] == "b"], table)[0][:3] == (None, BASE, "row")


def test_swapped_rows_and_columns_are_seen(spark, table):
    other = table.copy()
    a, b = other.columns.get_loc("high"), other.columns.get_loc("close")
    other.iloc[20, [a, b]] = other.iloc[20, [b, a]].to_numpy()
    assert first(spark, table, other)[0][1:3] == (BASE + 20 * HOUR_MS, "high")
    swapped = table.copy()
    values = swapped[COLUMNS].to_numpy()
    values[[30, 31]] = values[[31, 30]]
    swapped[COLUMNS] = values
    assert first(spark, table, swapped)[0][1:3] == (BASE + 30 * HOUR_MS, "open")


def test_trees_compare_without_their_tables(spark, table):
    trees = tuple(parity.tree(frame(spark, x), COLUMNS, DAY_MS) for x in (table, table[table["ts"] != BASE + 99 * HOUR_MS]))
    assert parity.first_leaf(*trees) == ("a", (BASE + 99 * HOUR_MS) // DAY_MS) and parity.first_leaf(trees[0], trees[0]) is None
    levels = {r["level"]: r["count"] for r in trees[0].groupBy("level").count().collect()}
    assert levels[3] == 3 and levels[0] == 13 + 5 + 1


# Statistics of large groups ---------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(4)
    rows = [("hot", rng.choice((0.0, -0.0, 1.5, rng.random() * 100))) for _ in range(800)] + [("ties", 7.0)] * 60 + [(None, float(k % 4)) for k in range(30)] + [("one", 3.0), ("none", None), ("hot", None), ("inf", float("inf")), ("inf", -1.0), ("inf", 4.0)]
    rng.shuffle(rows)
    return pd.DataFrame({"g": [g for g, _ in rows], "x": [x for _, x in rows]}).astype({"g": object})


def rows_of(spark, pdf):
    return spark.createDataFrame([(g, None if pd.isna(x) else float(x)) for g, x in zip(pdf["g"], pdf["x"])], "g string, x double").repartition(4)


@pytest.mark.parametrize("ranges", [2, 16, 64])
def test_ranks_and_quantiles_over_ranges(spark, groups, ranges):
    df = rows_of(spark, groups)
    want = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.col("x").asc_nulls_last())))
    counts = {(r["g"], r["x"]): (r["r"], r["n"]) for r in want.groupBy("g", "x", "r").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = ordered.average_ranks(df, "x", ["g"], "rank", "n", ranges).collect()
    assert len(got) == len(groups)
    for r in got:
        place, n = counts[(r["g"], r["x"])]
        assert (r["rank"], r["n"]) == ((None, None) if r["x"] is None else (place + (n - 1) / 2, n))
    found = {r["g"]: (r["a"], r["b"], r["c"]) for r in ordered.quantiles(df, F.col("x"), ["g"], {"a": 0.0, "b": 0.37, "c": 0.99}, ranges).collect()}
    exact = {r["g"]: tuple(r)[1:] for r in df.filter("x IS NOT NULL").groupBy("g").agg(*(F.percentile("x", q) for q in (0.0, 0.37, 0.99))).collect()}
    assert found.keys() == exact.keys()
    for g in found:
        assert found[g] == pytest.approx(exact[g]) or g == "inf"


def test_one_group_is_many_tasks_and_ties_cross_no_border(spark, groups):
    counts = ordered.value_counts(rows_of(spark, groups), F.col("x"), ["g"], 16).filter(F.col(f"{ordered.KEY}.g") == "hot")
    distinct = groups[groups["g"] == "hot"]["x"].dropna().nunique()
    assert counts.count() == distinct
    with_zero = counts.filter("value = 0").collect()
    assert len(with_zero) == 1 and with_zero[0]["before"] == 0


def test_signed_ranks_of_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, 300).astype(float)
    got = stats.wilcoxon(spark.createDataFrame([("g", float(v)) for v in x], "g string, d double"), "d", ["g"]).first()
    kept = x[x != 0]
    ranks = pd.Series(np.abs(kept)).rank().to_numpy()
    assert got["n"] == len(kept) and got["w_plus"] == ranks[kept > 0].sum() and got["w_minus"] == ranks[kept < 0].sum()
