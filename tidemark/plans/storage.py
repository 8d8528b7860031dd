"""Queries that write tables, files and streams to a scratch folder and read them back, each beside its SQL."""

from __future__ import annotations

import os
from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as b
from tidemark.operators import reports
from tidemark.plans import views as v
from tidemark.plans.queries import BREAKS, query
from tidemark.plans.views import scratch
from tidemark.plans.queries import _forward as forward_returns
from tidemark.schema import BARS, DAY_MS, FORWARD_RETURNS, HOUR_MS
from tidemark.sources import readers, rest, sinks
from tidemark.streaming import live

PRICES = "open high low close volume"


def _raw(rows: DataFrame) -> DataFrame:
    """Bars as a source's text: epoch seconds, ms or ISO by row, and a spoiled copy of each first bar."""
    ts = F.when(F.col("ts") % 3 == 0, (F.col("ts") / 1000).cast("long").cast("string")).when(F.col("ts") % 3 == 1, F.col("ts").cast("string")).otherwise(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.select(ts.alias("timestamp"), *(F.col(c).cast("string") for c in PRICES.split()))


# Sources ----------------------------------------------------------------------------------------------


@query("src_bars_csv_gzip", "SELECT * FROM d", v.BARS_1D, floats=PRICES)
def _(spark, d):
    path, rows = scratch(spark), v.bars_1d(spark, d)
    assets = [r[0] for r in rows.select("asset").distinct().collect()]
    for asset in assets:  # a folder of files for each asset, as sources have them
        own = rows.filter(F.col("asset") == asset)
        bad = own.limit(1).select(F.lit("no time").alias("timestamp"), *(F.lit("1").alias(c) for c in PRICES.split()))
        _raw(own).unionByName(bad).write.option("header", True).option("compression", "gzip").csv(f"{path}/{asset}")
    return reduce(DataFrame.unionByName, [readers.bars_csv(spark, f"{path}/{asset}", asset) for asset in assets])


@query(
    "src_bars_parquet",
    f"SELECT * FROM b WHERE ts >= 1704500000000 AND ts < {1704500000000 + 10 * DAY_MS} AND asset IN ('click', 'view')",
    v.BARS_1H,
    floats=PRICES,
)
def _(spark, d):
    path = scratch(spark)
    v.bars_1h(spark, d).write.parquet(path)
    return readers.bars_parquet(spark, path, 1704500000000, 1704500000000 + 10 * DAY_MS, ["click", "view"])


@query(
    "src_bars_cascade",
    "SELECT 'cache' AS source, asset, ts, close FROM b WHERE asset = 'click' UNION ALL SELECT 'fallback', asset, ts, close FROM b WHERE asset = 'view'",
    v.BARS_1H,
    keys="source asset ts", floats="close",
)
def _(spark, d):
    path, rows = scratch(spark), v.bars_1h(spark, d)
    rows.write.parquet(path)
    cached = readers.bars_cascade(spark, "click", cache=path).withColumn("source", F.lit("cache"))
    other = readers.bars_cascade(spark, "view", cache=f"{path}/none", fallback=lambda: rows.filter("asset = 'view'")).withColumn("source", F.lit("fallback"))
    return cached.unionByName(other)


_RATES = "SELECT 'click' AS asset, ts, min(rate) AS rate FROM f GROUP BY ts"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return v.funding(spark, d).groupBy("ts").agg(F.min("rate").alias("rate"))


@query("src_funding_csv", _RATES, v.FUNDING, floats="rate")
def _(spark, d):
    path = scratch(spark)
    _events(spark, d).select("ts", "rate").write.option("header", True).csv(path)
    return readers.funding_csv(spark, path, "click")


@query("src_funding_json", _RATES, v.FUNDING, floats="rate")
def _(spark, d):
    path = scratch(spark)
    one = _events(spark, d).agg(F.collect_list(F.struct("ts", "rate")).alias("events"))  # the format: one object a file
    one.select(F.lit("click").alias("asset"), "events").write.json(path)
    return readers.funding_json(spark, path)


@query(
    "src_forward_returns_csv",
    "SELECT * FROM fr",
    v.BARS_1H,
    v.RANGES,
    v.PREDICTIONS,
    BREAKS,
    keys="asset breakout_ts horizon", floats="forward_return", others="target_ts direction",
)
def _(spark, d):
    path = scratch(spark)
    forward_returns(spark, d).select(FORWARD_RETURNS.fieldNames()).write.option("header", True).csv(path)
    return readers.forward_returns_csv(spark, path)


@query(
    "src_trades_json",
    "SELECT 's' AS strategy, asset AS pair, ts AS close_timestamp, close / open - 1 AS profit_ratio FROM d",
    v.BARS_1D,
    keys="strategy pair close_timestamp", floats="profit_ratio",
)
def _(spark, d):
    path = scratch(spark)
    rows = v.bars_1d(spark, d).select(F.col("asset").alias("pair"), (F.col("close") / F.col("open") - 1).alias("profit_ratio"), F.col("ts").alias("close_timestamp"))
    # a result file is one object: one of each pair's trades of a year
    year = F.year(F.timestamp_millis("close_timestamp"))
    runs = rows.groupBy(F.concat_ws("-", "pair", year.cast("string")).alias("run")).agg(F.collect_list(F.struct("pair", "profit_ratio", "close_timestamp")).alias("trades"))
    runs.select("run", F.create_map(F.lit("s"), F.struct("trades")).alias("strategy")).write.partitionBy("run").json(path)
    return readers.trades_json(spark, path)


@query("src_log_metrics", "SELECT count(*)::DOUBLE AS bars, NULL::DOUBLE AS absent FROM d GROUP BY asset", v.BARS_1D, keys="", floats="bars absent")
def _(spark, d):
    path = scratch(spark)
    lines = v.bars_1d(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).select("asset", F.format_string("run of %s\nBars: %d\n", "asset", "n").alias("value"))
    lines.write.partitionBy("asset").text(path)
    return readers.log_metrics(spark, path, {"bars": r"Bars: (\d+)", "absent": r"None: (\d+)"})


@query(
    "src_event_store",
    "SELECT event_id, event_type AS kind, epoch_us(ts) // 1000 AS ts, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'click'",
    keys="event_id", others="kind ts k",
)
def _(spark, d):
    path = scratch(spark)
    rows = v.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), v.ms("ts").alias("ts"), F.col("props").alias("payload"))
    rows.write.parquet(path)
    found = readers.event_store(spark, path, "click", "k bigint")
    return found.select(F.col("id").cast("long").alias("event_id"), "kind", "ts", F.col("payload.k").alias("k"))


@query("src_previous_results", "SELECT asset, count(*) AS n, true AS first_time FROM d GROUP BY asset", v.BARS_1D, keys="asset", others="n first_time")
def _(spark, d):
    path = scratch(spark)
    none = readers.previous_results(spark, path) is None
    v.bars_1d(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return readers.previous_results(spark, path).withColumn("first_time", F.lit(none))


@query("src_catalog_probe", "SELECT 'asset,ts,close' AS columns, count(*) AS rows, true AS absent FROM d", v.BARS_1D, keys="columns", others="rows absent")
def _(spark, d):
    v.bars_1d(spark, d).select("asset", "ts", "close").createOrReplaceTempView("tidemark_probe")
    found, absent = readers.catalog(spark, "tidemark_probe"), readers.catalog(spark, "tidemark_no_such_table") is None
    return spark.createDataFrame([(",".join(found["columns"]), found["rows"], absent)], "columns string, rows long, absent boolean")


@query("src_canonical_rows", "SELECT asset, ts, close * 2 AS close FROM d", v.BARS_1D, floats="close")
def _(spark, d):
    rows = v.bars_1d(spark, d).withColumn("seq", F.lit(1))
    text = rows.select("asset", *(F.col(c).cast("string").alias(c) for c in ("ts", *PRICES.split())), "seq")
    later = text.withColumn("close", (F.col("close").cast("double") * 2).cast("string")).withColumn("seq", F.lit(2))
    broken = text.limit(50).withColumn("close", F.lit("n/a")).withColumn("seq", F.lit(3))
    return b.canonical(text.unionByName(later).unionByName(broken))


def stored_client(symbol: str, timeframe: str, since: int, limit: int) -> list[list]:
    """An exchange over stored bars: symbol is `asset@folder` (partitioned by asset); a page never holds more than 50 rows, whatever is asked for."""
    return _page(symbol, PRICES.split(), since, min(limit, 50))


def funding_client(symbol: str, timeframe: str, since: int, limit: int) -> list[list]:
    """Stored settlements; pages overlap by an hour."""
    return _page(symbol, ["rate"], since - HOUR_MS, limit)


def _page(symbol: str, values: list[str], since: int, limit: int) -> list[list]:
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    asset, _, folder = symbol.partition("@")
    own, got = f"{folder}/asset={asset}", []
    firsts = sorted(int(name.removeprefix("first=")) for name in os.listdir(own) if name.startswith("first="))
    for first in firsts[max(bisect_right(firsts, since) - 1, 0) :]:  # only the spans that the page needs
        rows = ds.dataset(f"{own}/first={first}", format="parquet").to_table(columns=["ts", *values], filter=pc.field("ts") >= since).sort_by("ts").slice(0, limit - len(got))
        got += zip(*(c.to_pylist() for c in rows.columns))
        if len(got) >= limit:
            break
    return [list(r) for r in got]


def stored(spark: SparkSession, rows: DataFrame, span_ms: int = 64 * DAY_MS) -> tuple[str, list[str], int, int]:
    """Folder, assets, first time and end of rows stored for the clients (a folder that executors mount), one file for each asset and span of time."""
    folder = scratch(spark)
    spans = rows.withColumn("first", F.floor(F.col("ts") / F.lit(span_ms)) * span_ms)
    spans.repartition("asset", "first").write.partitionBy("asset", "first").parquet(folder)
    lim = rows.agg(F.min("ts"), F.max("ts")).first()
    return folder.replace("file://", ""), sorted(r[0] for r in rows.select("asset").distinct().collect()), lim[0], lim[1] + HOUR_MS


@query("src_rest_candles", f"SELECT * FROM b WHERE asset = 'click' AND ts + {HOUR_MS} <= (SELECT max(ts) FROM b) - 50 * {HOUR_MS} // 1", v.BARS_1H, floats=PRICES)
def _(spark, d):
    folder, _, since, until = stored(spark, v.bars_1h(spark, d))
    got = rest.read_pages(spark, "candles", f"{__name__}:stored_client", f"click@{folder}", since, until, limit=37, now=until - 51 * HOUR_MS)  # closed bars only
    return got.withColumn("asset", F.lit("click"))


@query("src_rest_funding", "SELECT 'click' AS asset, ts, min(rate) AS rate FROM f GROUP BY ts", v.FUNDING, floats="rate")
def _(spark, d):
    folder, _, since, until = stored(spark, _events(spark, d).select(F.lit("click").alias("asset"), "ts", "rate"), DAY_MS)
    return rest.read_pages(spark, "funding", f"{__name__}:funding_client", f"click@{folder}", since, until, limit=110, range_ms=DAY_MS).withColumn("asset", F.lit("click"))


# Sinks ------------------------------------------------------------------------------------------------


@query("snk_insert_checked", "SELECT asset, ts, open, high, low, close, volume FROM b WHERE open > 0 AND low > 0 AND high >= low", v.BARS_1H, floats=PRICES)
def _(spark, d):
    table, rows = sinks.Table(spark, scratch(spark), BARS), v.bars_1h(spark, d)
    table.create()
    for part in (rows.filter("ts % 7200000 = 0"), rows, rows):  # the second holds the first's rows, the third nothing new
        sinks.insert_new(table, part, ["asset", "ts"], checks=sinks.valid_bar())
    return table.read()


@query(
    "snk_update_partitions",
    "SELECT asset, ts, CASE WHEN asset = 'click' AND ts % 7200000 = 0 THEN close * 2 ELSE close END AS close FROM b",
    v.BARS_1H,
    floats="close",
)
def _(spark, d):
    table, rows = sinks.Table(spark, scratch(spark), BARS, span_ms=7 * DAY_MS), v.bars_1h(spark, d)
    table.write(rows)
    changed = rows.filter("asset = 'click' AND ts % 7200000 = 0").withColumn("close", F.col("close") * 2)
    sinks.update(table, changed, lambda old: sinks.upserted(old, changed, ["asset", "ts"]))
    return table.read()


@query("snk_backfill", "SELECT asset, ts, CASE WHEN ts % 7200000 = 0 THEN open ELSE close END AS close FROM b", v.BARS_1H, floats="close")
def _(spark, d):
    rows = v.bars_1h(spark, d).select("asset", "ts", "open", "close")
    holes = rows.withColumn("close", F.when(F.col("ts") % 7_200_000 != 0, F.col("close")))
    return sinks.backfilled(holes, rows.select("asset", "ts", F.col("open").alias("close")), ["asset", "ts"], ["close"])


@query(
    "snk_reports_once",
    "SELECT kind, ts, count(*) AS n FROM (VALUES ('daily', 5), ('daily', 6), ('weekly', 5)) AS x(kind, ts) GROUP BY kind, ts",
    keys="kind ts", others="n",
)
def _(spark, d):
    table, rows = sinks.Table(spark, scratch(spark), sinks.EVENTS), reports.status(v.predictions(spark, d)).agg(F.sum("completed").alias("completed"))
    table.create()
    for kind, ts in (("daily", 5), ("daily", 5), ("daily", 6), ("weekly", 5), ("weekly", 5)):
        sinks.append_report(table, kind, rows, ts)
    return table.read().groupBy("kind", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("snk_export_and_manifest", "SELECT 'all' AS part, count(*) AS n, true AS hashed FROM d", v.BARS_1D, keys="part", others="n hashed")
def _(spark, d):
    path = scratch(spark)
    sinks.export_csv(v.bars_1d(spark, d), path)
    files = sinks.manifest(spark, path).filter("file LIKE '%.csv'").agg(F.bool_and(F.length("sha256") == 64).alias("hashed"))
    return spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("n")).join(files).withColumn("part", F.lit("all"))  # one row each


@query(
    "snk_schema_upgrade",
    "SELECT asset, ts, close, NULL::DOUBLE AS volume FROM d WHERE ts % 172800000 = 0 UNION ALL SELECT asset, ts, close, volume FROM d "
    "WHERE ts % 172800000 <> 0",
    v.BARS_1D,
    floats="close volume",
)
def _(spark, d):
    path, rows = scratch(spark), v.bars_1d(spark, d)
    sinks.Table(spark, path, rows.select("asset", "ts", "close").schema).write(rows.filter("ts % 172800000 = 0").select("asset", "ts", "close"))
    table = sinks.Table(spark, path, rows.select("asset", "ts", "close", "volume").schema)
    table.append(rows.filter("ts % 172800000 <> 0").select("asset", "ts", "close", "volume"))
    return table.read()


# The live cycle and streams ---------------------------------------------------------------------------

_NOW = 1_705_000_000_000 // HOUR_MS * HOUR_MS


@query("live_cycle_state", f"""SELECT asset, ts, ts < n AS completed FROM (
  SELECT asset, max(ts) FILTER (ts + 3600000 <= {_NOW}) + 3600000 AS a, max(ts) FILTER (ts + 3600000 <= {_NOW + 6 * HOUR_MS}) + 3600000 AS z FROM b GROUP BY asset) m,
  LATERAL (SELECT DISTINCT unnest([a, z]) AS ts) x, LATERAL (SELECT coalesce(max(q.ts), 0) + 1 AS n FROM b q WHERE q.asset = m.asset AND q.ts = x.ts AND q.ts + 3600000 <= {_NOW + 6 * HOUR_MS}) y""", v.BARS_1H, others="completed")
def _(spark, d):
    s, rows = live.state(spark, scratch(spark)), v.bars_1h(spark, d).withColumn("low", F.greatest("low", F.lit(1e-6)))
    for now in (_NOW, _NOW + 6 * HOUR_MS, _NOW + 6 * HOUR_MS):  # the last changes nothing
        live.cycle(s, rows.filter(F.col("ts") < now).withColumns({c: F.greatest(c, F.lit(1e-6)) for c in ("open", "high", "close")}), now)
    return s.predictions.read().select("asset", "ts", F.col("actual_range").isNotNull().alias("completed"))


@query(
    "stream_bars",
    f"SELECT asset, ts, open, high, low, close, volume FROM b WHERE ts + {HOUR_MS} <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - {2 * HOUR_MS}",
    v.BARS_1H,
    floats=PRICES,
)
def _(spark, d):
    path = scratch(spark)
    v.table(spark, d, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price")).write.parquet(f"{path}/in")
    ticks = spark.readStream.schema("asset string, at timestamp, price double").parquet(f"{path}/in")
    out = live.streamed_bars(ticks).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(BARS).parquet(f"{path}/out")


@query(
    "stream_without_repeats",
    "SELECT event_id, event_type, min(value) AS value FROM events GROUP BY 1, 2",
    keys="event_id", floats="value", others="event_type",
)
def _(spark, d):
    path, rows = scratch(spark), v.table(spark, d, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    rows.union(rows.filter("event_id % 3 = 0")).write.parquet(f"{path}/in")
    stream = live.once(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), ["event_id"], within="30 days")
    out = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")
