"""Sources, sinks and the live cycle."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, frame, pandas, walk
from tidemark.operators import forecast
from tidemark.schema import BARS, HOUR_MS, POSITIONS
from tidemark.sources import readers, rest, sinks
from tidemark.streaming import live


def test_csv_gzip_and_cascade(spark, tmp_path):
    pdf = walk(10)
    text = "timestamp,open,high,low,close,volume\n" + "".join(f"{r.ts // 1000},{r.open},{r.high},{r.low},{r.close},{r.volume}\n" for r in pdf.itertuples()) + f"{BASE // 1000},1,1,1,1,1\nbad,1,1,1,1,1\n"
    path = tmp_path / "x.csv.gz"
    path.write_bytes(gzip.compress(text.encode()))
    got = pandas(readers.bars_csv(spark, str(path), "x"))
    assert len(got) == 10 and got["close"][0] == 1.0 and got["close"][1] == pytest.approx(pdf["close"][1])
    frame(spark, pdf).write.parquet(str(tmp_path / "cache"))
    assert readers.bars_cascade(spark, "x", cache=str(tmp_path / "cache")).count() == 10
    assert readers.bars_cascade(spark, "x", cache=str(tmp_path / "none"), fallback=lambda: frame(spark, pdf)).count() == 10
    (tmp_path / "y.csv").write_text("timestamp,open\n1,2\n")
    with pytest.raises(ValueError):
        readers.bars_csv(spark, str(tmp_path / "y.csv"), "x")


def test_last_row_of_a_time_over_several_files(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    rest = "".join(f"{BASE // 1000 + 3600 * i},1,1,1,1,1\n" for i in range(1, 3000))
    (tmp_path / "a.csv").write_text(head + f"{BASE // 1000},1,1,1,1,1\n" + rest)  # the larger file is read first
    (tmp_path / "b.csv").write_text(head + f"{BASE // 1000},2,2,2,2,2\n")
    got = readers.bars_csv(spark, str(tmp_path), "x")
    assert got.count() == 3000 and got.orderBy("ts").first()["close"] == 2.0
    (tmp_path / "f").mkdir()
    for name, rate in (("a", 0.1), ("b", 0.2)):
        (tmp_path / "f" / f"{name}.csv").write_text(f"ts,rate\n5,{rate}\n" + "".join(f"{i},0.3\n" for i in range(10, 500 if name == "a" else 11)))
    assert readers.funding_csv(spark, str(tmp_path / "f"), "x").filter("ts = 5").first()["rate"] == 0.2


def test_of_repeated_incoming_keys_the_last_stays(spark):
    have = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "y")], "k string, v double, w string")
    new = spark.createDataFrame([("a", 5.0, "p", 2), ("a", 9.0, "q", 1), ("c", 3.0, "r", 1)], "k string, v double, w string, at int")
    assert sorted(map(tuple, sinks.upserted(have, new, ["k"], "at").collect())) == [("a", 5.0, "p"), ("b", 1.0, "y"), ("c", 3.0, "r")]
    assert sinks.upserted(have, new.drop("at"), ["k"]).filter("k = 'a'").first()["v"] == 9.0


def test_feather_json_zip_and_logs(spark, tmp_path):
    import pandas as pd
    import pyarrow.feather as feather

    pdf = walk(5).rename(columns={"ts": "Date", "close": "Close"}).drop(columns="asset")
    pdf["Date"] = pd.to_datetime(pdf["Date"], unit="ms", utc=True)
    feather.write_feather(pdf, str(tmp_path / "a.feather"))
    assert readers.bars_feather(spark, [str(tmp_path / "a.feather")], "x").agg(F.min("ts")).first()[0] == BASE
    (tmp_path / "f.json").write_text(json.dumps({"asset": "x", "events": [{"ts": 1, "rate": 0.1}, {"ts": 1, "rate": 0.1}, {"ts": 2, "rate": 0.2}]}))
    assert readers.funding_json(spark, str(tmp_path / "f.json")).count() == 2
    body = json.dumps({"strategy": {"s": {"trades": [{"pair": "p", "profit_ratio": 0.5, "close_timestamp": 3}]}}})
    (tmp_path / "t.json").write_text(body)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.json", body)
    assert readers.trades_json(spark, str(tmp_path / "t.json")).first()["profit_ratio"] == 0.5
    assert readers.trades_zip(spark, str(tmp_path / "t.zip")).first()["profit_ratio"] == 0.5
    (tmp_path / "run.log").write_text("x\nSharpe: 1.25\n")
    assert readers.log_metrics(spark, str(tmp_path / "run.log"), {"sharpe": r"Sharpe: ([-\d.]+)", "none": r"No: (\d+)"}).select("sharpe", "none").first() == (1.25, None)
    assert readers.context_rows(spark, {"a": lambda: 1, "b": lambda: 1 / 0}).first() == (1.0, None)
    assert readers.synthetic_bars(spark, ["a", "b"], 20).count() == 40


CALLS: list[int] = []


def client(symbol, timeframe, since, limit):
    """Bars on every hour from BASE on, 30 of them."""
    first = max(0, -(-(since - BASE) // HOUR_MS))
    return [[BASE + i * HOUR_MS, 1.0, 2.0, 0.5, 1.5, 10.0] for i in range(first, min(30, first + limit))]


def events(symbol, timeframe, since, limit):
    return [[ts, 0.1] for ts in range(BASE, BASE + 40 * HOUR_MS, 8 * HOUR_MS) if ts >= since][:limit]


def test_paged_sources(spark):
    got = rest.read_pages(spark, "candles", "tests.test_storage:client", "x", BASE, BASE + 100 * HOUR_MS, limit=7, now=BASE + 20 * HOUR_MS)
    assert got.count() == 20 and got.agg(F.max("ts")).first()[0] == BASE + 19 * HOUR_MS
    assert rest.read_pages(spark, "funding", "tests.test_storage:events", "x", BASE, BASE + 24 * HOUR_MS, limit=2).count() == 3
    assert rest.missing_ranges(got, BASE - 5, BASE + 30 * HOUR_MS, HOUR_MS) == [(BASE - 5, BASE), (BASE + 20 * HOUR_MS, BASE + 30 * HOUR_MS)]


def few_events(symbol, timeframe, since, limit):
    return events(symbol, timeframe, since, 2)


def test_short_pages_do_not_end_the_events(spark):
    assert rest.read_pages(spark, "funding", "tests.test_storage:few_events", "x", BASE, BASE + 40 * HOUR_MS, limit=1000).count() == 5


def overlapping(symbol, timeframe, since, limit):
    """An event each minute for two hours, then one a day later; answers begin an hour early."""
    return [[ts, 0.1] for ts in (*range(BASE, BASE + 2 * HOUR_MS, 60_000), BASE + 26 * HOUR_MS) if ts >= since - HOUR_MS][:limit]


def overlapping_few(symbol, timeframe, since, limit):
    return overlapping(symbol, timeframe, since, min(limit, 30))


@pytest.mark.parametrize("options", [{}, {"range_ms": HOUR_MS}])
def test_pages_of_earlier_rows_only_do_not_end_the_events(spark, options):
    got = rest.read_pages(spark, "funding", "tests.test_storage:overlapping", "x", BASE, BASE + 30 * HOUR_MS, limit=10, **options)
    assert got.count() == 121 and got.agg(F.max("ts")).first()[0] == BASE + 26 * HOUR_MS


def test_servers_that_never_come_to_later_events_are_an_error(spark):
    with pytest.raises(Exception, match="hold earlier rows only"):
        rest.read_pages(spark, "funding", "tests.test_storage:overlapping_few", "x", BASE, BASE + 30 * HOUR_MS, limit=10).count()


def test_requests_are_bounded_and_upgrades_keep_rows(spark, tmp_path):
    from pyspark.sql import types as T

    until, left = rest.budget(BASE, BASE + 30 * HOUR_MS, HOUR_MS, 7, 2)
    got = rest.read_pages(spark, "candles", "tests.test_storage:client", "x", BASE, until, limit=7, max_requests=2)
    assert got.count() == 14 and left == (BASE + 14 * HOUR_MS, BASE + 30 * HOUR_MS)
    with pytest.raises(Exception, match="more than 2 requests"):
        rest.read_pages(spark, "candles", "tests.test_storage:client", "x", BASE, BASE + 30 * HOUR_MS, limit=7, max_requests=2).count()
    table = sinks.Table(spark, str(tmp_path / "t"), BARS)
    table.write(frame(spark, walk(5)))
    more = T.StructType([*BARS.fields, T.StructField("note", T.StringType())])
    assert sinks.upgraded(table, more).read().filter("note IS NULL").count() == 5
    with pytest.raises(ValueError):
        sinks.upgraded(table, T.StructType(BARS.fields[:-1]))
    holes = frame(spark, walk(5)).withColumn("close", F.when(F.col("ts") > BASE + HOUR_MS, F.col("close")))
    assert sinks.fillable(holes, frame(spark, walk(3)), ["asset", "ts"], ["close"]).first()["close"] == 2


def test_retries():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert rest.with_retries(flaky, sleep=lambda _: None) == 7
    with pytest.raises(rest.Fatal):
        rest.with_retries(lambda: (_ for _ in ()).throw(rest.Fatal()), sleep=lambda _: None)


def test_inserts_are_idempotent(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "bars"), BARS)
    table.create()
    pdf = walk(10)
    pdf.loc[3, "high"] = 0.0
    for want in ({"inserted": 9, "skipped": 0, "quarantined": 1}, {"inserted": 0, "skipped": 9, "quarantined": 1}):
        assert sinks.insert_new(table, frame(spark, pdf), ["asset", "ts"], checks=sinks.valid_bar()) == want
    assert table.read().count() == 9 and sinks.quarantine(frame(spark, pdf)).count() == 1
    assert sinks.upserted(table.read(), frame(spark, pdf.assign(close=1.0)), ["asset", "ts"]).filter("close = 1").count() == 10


def test_appends_leave_other_files_alone(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "bars"), BARS, span_ms=24 * HOUR_MS, most_folders=3)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars" / "data").rglob("*.parquet")}
    table.append(frame(spark, walk(48)))
    before = files()
    sinks.insert_new(table, frame(spark, walk(60)), ["asset", "ts"])  # two days are known, the third is new
    after = files()
    assert before.items() <= after.items() and table.read().count() == 60
    third = BASE // (24 * HOUR_MS) + 2
    assert table.parts_of(frame(spark, walk(60))) == [third - 2, third - 1, third] and table.read([third]).count() == 12
    sinks.update(table, frame(spark, walk(60)).filter(F.col("ts") >= BASE + 48 * HOUR_MS), lambda old: old.withColumn("close", F.lit(1.0)))
    assert table.read().filter("close = 1").count() == 12 and before.items() <= files().items()
    for n in (61, 62, 63, 64):
        sinks.insert_new(table, frame(spark, walk(n)), ["asset", "ts"])
    assert table.read().count() == 64 and len(table._state()[third]) <= 3
    with pytest.raises(Exception, match="already exists"):
        stale = sinks.Table(spark, str(tmp_path / "bars"), BARS)
        stale._versions = lambda: [table.version() - 1]
        stale.append(frame(spark, walk(1)))
    assert table.read().count() == 64


def test_cycle_with_bias_and_daily_report(spark, tmp_path):
    s = live.state(spark, str(tmp_path / "live"))
    pdf = walk(60)
    at = int(pdf["ts"][59]) + HOUR_MS
    past = spark.createDataFrame([("x", "1h", int(t), 1.0, 3.0, 2.0, 2.0, 1, "low") for t in pdf["ts"][20:58]], s.predictions.schema)
    s.predictions.append(past)
    live.cycle(s, frame(spark, pdf), at, bias=True)
    plain = live.predict(frame(spark, pdf)).first()["predicted_range"]
    assert s.predictions.read().filter(F.col("ts") == at).first()["predicted_range"] == pytest.approx(plain + 2.0)
    daily = sinks.Table(spark, str(tmp_path / "reports"), sinks.EVENTS)
    daily.create()
    assert [live.calibration(s, daily, at + k * HOUR_MS) for k in (0, 1, 23, 24)] == [True, False, False, True] and daily.read().count() == 2


def test_positions_exports_and_reports(spark, tmp_path):
    empty = spark.createDataFrame([], POSITIONS)
    orders = spark.createDataFrame([("x", -1, 100.0, 2.0)], "asset string, direction int, entry_price double, size double")
    book = sinks.opened(empty, orders)
    assert sinks.opened(book, orders).count() == 1
    done = sinks.closed(book, book.select("position_id", F.lit(90.0).alias("price"))).first()
    assert (done["status"], done["pnl"]) == ("closed", 20.0)
    sinks.export_csv(frame(spark, walk(4)), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4
    table = sinks.Table(spark, str(tmp_path / "events"), sinks.EVENTS)
    table.create()
    for _ in range(2):
        sinks.append_report(table, "daily", spark.createDataFrame([(1,)], "a int"), 5)
    assert table.read().count() == 1
    assert sinks.manifest(spark, str(tmp_path / "out")).filter("length(sha256) = 64").count() >= 1


def test_cycle_repeats_without_change(spark, tmp_path):
    s = live.state(spark, str(tmp_path / "live"))
    pdf = walk(60)
    pdf.loc[50, "high"] = pdf.loc[50, "high"] * 1.5
    for n in (50, 50, 55, 60):
        live.cycle(s, frame(spark, pdf[:n]), int(pdf["ts"][n - 1]) + HOUR_MS)
    pred = s.predictions.read()
    assert pred.count() == 3 and pred.filter("actual_range IS NULL").count() == 1
    first = pred.orderBy("ts").first()
    assert first["breakout_flag"] == 1 and first["prediction_error"] == pytest.approx(pdf["high"][50] - pdf["low"][50] - first["predicted_range"])
    returns = s.returns.read()
    assert returns.count() == 3 * pred.filter('breakout_flag = 1').count() and returns.filter('breakout_ts + horizon * 3600000 <= ' + str(int(pdf['ts'][59]))).filter("forward_return IS NULL").count() == 0
    before = sorted(map(tuple, pred.collect()), key=str)
    live.cycle(s, frame(spark, pdf), int(pdf["ts"][59]) + HOUR_MS)
    assert sorted(map(tuple, s.predictions.read().collect()), key=str) == before


def test_streams(spark, tmp_path):
    frame(spark, walk(50)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(BARS).parquet(str(tmp_path / "in"))
    q = live.start(spark, source, str(tmp_path / "state"), str(tmp_path / "check"))
    q.awaitTermination(90)
    assert live.state(spark, str(tmp_path / "state")).bars.read().count() == 50
    ticks = spark.range(300).select(F.lit("x").alias("asset"), F.timestamp_millis(F.lit(BASE) + F.col("id") * 60_000).alias("at"), F.col("id").cast("double").alias("price"))
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = live.streamed_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("SELECT max(high) - min(low) AS d FROM bars_out").first()[0] is not None
    sig = frame(spark, walk(6)).select("asset", "ts", (F.col("ts") == BASE).alias("long_entry"), (F.col("ts") == BASE + 3 * HOUR_MS).alias("short_entry"))
    sig.repartition(1).write.parquet(str(tmp_path / "sig"))
    q = live.streamed_positions(spark.readStream.schema(sig.schema).parquet(str(tmp_path / "sig"))).writeStream.format("memory").queryName("pos_out").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [r["position"] for r in spark.sql("SELECT * FROM pos_out ORDER BY ts").collect()] == [1, 1, 1, 0, 0, 0]


def test_pending_forecast_is_positive(spark):
    assert live.predict(frame(spark, walk(40))).first()["predicted_range"] > 0
    assert forecast.bias_correction(frame(spark, walk(40)).withColumn("e", F.lit(1.0)), "e").first()["bias"] == 1.0
