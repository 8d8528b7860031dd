"""Queries of streams with state, databases, the streamed paged source, lineage, parity and long series, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import blocks
from tidemark.operators import forecast as fc
from tidemark.operators import lineage, ordered, parity
from tidemark.plans import views as v
from tidemark.plans.queries import query
from tidemark.plans.storage import scratch, stored
from tidemark.schema import BARS, DAY_MS, HOUR_MS
from tidemark.sources import database, rest
from tidemark.streaming import pending

PRICES = "open high low close volume"

# Streams --------------------------------------------------------------------------------------------------
# Bars come in three parts of time. Of the first two, every seventh hour comes a part late: within two hours of the watermark in time, else too late. A bar
# of an asset of its own, far ahead, ends the last waits.

FAR, LATE = 4_102_444_800_000, "ts // 3600000 % 7 = 3"
ARRIVALS = (
    f"lim AS (SELECT min(ts) AS t0, max(ts) - min(ts) + 1 AS width FROM b), cut AS (SELECT b.*, least(2, (ts - t0) * 3 // width) AS part FROM b, lim), "
    f"come AS (SELECT *, CASE WHEN {LATE} AND part < 2 THEN part + 1 ELSE part END AS arrival FROM cut), "
    "marks AS (SELECT a.arrival, max(c.ts) - 7200000 AS mark FROM (SELECT DISTINCT arrival FROM come) a JOIN come c ON c.arrival < a.arrival GROUP BY 1), "
    "seen AS (SELECT come.* FROM come LEFT JOIN marks USING (arrival) WHERE mark IS NULL OR ts > mark)"
)


def _arrivals(bars: DataFrame) -> DataFrame:
    """bars with part and arrival."""
    lim = bars.agg(F.min("ts").alias("t0"), (F.max("ts") - F.min("ts") + 1).alias("width")).first()
    part = F.least(F.lit(2), F.floor((F.col("ts") - F.lit(lim["t0"])) * 3 / F.lit(lim["width"]))).cast("int")
    late = F.floor(F.col("ts") / HOUR_MS) % 7 == 3
    return bars.withColumn("part", part).withColumn("arrival", F.when(late & (F.col("part") < 2), F.col("part") + 1).otherwise(F.col("part")))


def _replay(spark: SparkSession, inputs: dict[str, DataFrame], build) -> DataFrame:
    """What build(streams) writes, its inputs (with a column arrival) coming part by part; each part is a run of its own that goes on from the checkpoint."""
    path, schema = scratch(spark), None
    for k in range(3):
        for name, rows in inputs.items():
            rows.filter(F.col("arrival") == k).drop("arrival", "part").write.mode("append").parquet(f"{path}/{name}")
        streams = {name: spark.readStream.schema(rows.drop("arrival", "part").schema).parquet(f"{path}/{name}") for name, rows in inputs.items()}
        made = build(streams)
        schema = made.schema
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("ts"))


def _with_end(bars: DataFrame) -> DataFrame:
    end = bars.limit(1).withColumns({"asset": F.lit("~"), "ts": F.lit(FAR), "part": F.lit(2), "arrival": F.lit(2)})
    return _timed(bars.unionByName(end))


@query(
    "stream_forward_returns",
    "SELECT s.asset, s.ts AS breakout_ts, h AS horizon, s.ts + h * 3600000 AS target_ts, CASE WHEN s.close >= s.open THEN 1 ELSE -1 END AS direction, "
    "CASE WHEN s.close > 0 THEN x.close / s.close - 1 END AS forward_return FROM (SELECT * FROM seen WHERE volume > 2) s, (SELECT unnest([1, 2, 3]) AS h) k "
    "LEFT JOIN seen x ON x.asset = s.asset AND x.ts = s.ts + h * 3600000",
    v.BARS_1H,
    ARRIVALS,
    keys="asset breakout_ts horizon", floats="forward_return", others="target_ts direction",
)
def _(spark, d):
    bars = _with_end(_arrivals(v.bars_1h(spark, d))).withColumn("volume", F.when(F.col("asset") == "~", 0.0).otherwise(F.col("volume")))
    return _replay(spark, {"bars": bars}, lambda s: pending.forward_returns(s["bars"], F.col("volume") > 2))


@query(
    "stream_completions",
    "SELECT f.asset, f.ts + 3600000 AS ts, f.range AS predicted_range, x.range AS actual_range, x.range - f.range AS prediction_error, "
    "(x.range > 2 * f.range)::BIGINT AS breakout_flag FROM (SELECT *, greatest(high - low, 0) AS range FROM cut) f LEFT JOIN "
    "(SELECT *, greatest(high - low, 0) AS range FROM seen) x ON x.asset = f.asset AND x.ts = f.ts + 3600000",
    v.BARS_1H,
    ARRIVALS,
    floats="predicted_range actual_range prediction_error", others="breakout_flag",
)
def _(spark, d):
    bars = _with_end(_arrivals(v.bars_1h(spark, d)))
    made = fc.ranges(bars).select("asset", F.when(F.col("ts") == FAR, F.col("ts")).otherwise(F.col("ts") + HOUR_MS).alias("ts"), F.col("range").alias("predicted_range"), F.col("part").alias("arrival"))
    return _replay(spark, {"forecasts": _timed(made), "bars": bars}, lambda s: pending.completions(s["forecasts"], s["bars"])).filter("asset <> '~'")


@query(
    "stream_signalled",
    f"SELECT b.asset, b.ts, CASE WHEN b.ts - g.ts <= {30 * HOUR_MS} THEN g.vol END AS vol FROM b ASOF LEFT JOIN g ON b.asset = g.asset AND b.ts >= g.ts",
    v.BARS_1H,
    "g AS (SELECT asset, ts, high - low AS vol FROM b WHERE ts % 259200000 < 36000000)",
    floats="vol",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    signals = rows.filter(F.col("ts") % (3 * DAY_MS) < 10 * HOUR_MS).select("asset", "ts", (F.col("high") - F.col("low")).alias("vol"))
    return _replay(spark, {"bars": _arrivals(rows)}, lambda s: pending.signalled(s["bars"], signals, ["vol"], 30 * HOUR_MS))


# Databases and the paged source ---------------------------------------------------------------------------------


def _database(spark: SparkSession) -> str:
    """A file for a database in the shared folder, which must be one that every executor mounts."""
    path = scratch(spark)
    if not path.startswith(("file:", "/")):
        raise ValueError("a database file needs a folder that executors mount")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    return f"{path}/bars.db".replace("file://", "")


CANDLES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("timestamp_ms", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in PRICES.split())])


@query("src_database_bars", f"SELECT * FROM b WHERE asset = 'click' AND ts >= 1704500000000 AND ts <= {1704500000000 + 10 * DAY_MS}", v.BARS_1H, floats=PRICES)
def _(spark, d):
    path = _database(spark)
    rows = v.bars_1h(spark, d).select(F.col("asset").alias("symbol"), F.lit("1h").alias("timeframe"), F.col("ts").alias("timestamp_ms"), *PRICES.split())
    database.insert(rows, path, "candles", ["symbol", "timeframe", "timestamp_ms"])
    return database.bars(spark, path, "candles", CANDLES, "click", "1h", 1704500000000, 1704500000000 + 10 * DAY_MS)


@query("src_database_all", "SELECT * FROM b", v.BARS_1H, floats=PRICES)
def _(spark, d):
    path, rows = _database(spark), v.bars_1h(spark, d)
    for part in (rows.filter("ts % 7200000 = 0"), rows):  # the second holds the first's rows
        database.insert(part, path, "bars", ["asset", "ts"])
    return database.scan(spark, path, "bars", BARS)


@query("snk_database_replay", "SELECT asset, count(*) AS n_source, count(*) AS n_target, true AS equal FROM b GROUP BY asset", v.BARS_1H, keys="asset", others="n_source n_target equal")
def _(spark, d):
    source, target = _database(spark), _database(spark)
    database.insert(v.bars_1h(spark, d), source, "bars", ["asset", "ts"])
    return database.replayed(spark, source, target, "bars", BARS, ["asset", "ts"], "asset")


CLIENT = "tidemark.plans.storage:stored_client"


@query("src_paged_bars", "SELECT * FROM b WHERE asset = 'click'", v.BARS_1H, floats=PRICES)
def _(spark, d):
    folder, _, since, until = stored(spark, v.bars_1h(spark, d))
    got = rest.read_pages(spark, "candles", CLIENT, f"click@{folder}", since, until, limit=200)  # answers are shorter than asked for
    return got.withColumn("asset", F.lit("click"))


@query("src_paged_stream", "SELECT * FROM b", v.BARS_1H, floats=PRICES)
def _(spark, d):
    folder, assets, since, until = stored(spark, v.bars_1h(spark, d))
    out = scratch(spark)
    for now in (since + (until - since) // 3, since + (until - since) // 2, until, until):  # the last brings nothing
        rest_rows = rest.stream_pages(spark, CLIENT, [f"{a}@{folder}" for a in assets], since, limit=200, clock_ms=now)
        rest_rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(BARS).parquet(f"{out}/rows").withColumn("asset", F.substring_index("asset", "@", 1))


@query(
    "missing_ranges",
    "SELECT asset, p + 3600000 AS first, ts AS end_ts FROM (SELECT asset, ts, lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS p FROM (SELECT asset, ts FROM b UNION SELECT DISTINCT asset, 1703999600000 - 3600000 FROM b UNION "
    "SELECT DISTINCT asset, 1706400000000 FROM b) WHERE ts <= 1706400000000 AND ts >= 1703999600000 - 3600000) WHERE ts - p > 3600000",
    v.BARS_1H,
    keys="asset first", others="end_ts",
)
def _(spark, d):
    return rest.missing(v.bars_1h(spark, d), 1703999600000, 1706400000000, HOUR_MS).withColumnRenamed("end", "end_ts")


# Lineage and parity -----------------------------------------------------------------------------------------------

# A hypothesis for each order; its parent is an order before it, none, one that isn't there, or (of some) one that it is an ancestor of.
HYPOTHESES = (
    "RECURSIVE hyp AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 5 THEN 'gone' WHEN o_orderkey % 89 = 1 THEN (o_orderkey + 1)::VARCHAR WHEN o_orderkey % 89 = 2 THEN (o_orderkey - 1)::VARCHAR "
    "ELSE (o_orderkey - 1 - o_orderkey % 5)::VARCHAR END AS parent, o_custkey::VARCHAR || '|' || (o_orderkey % 50)::VARCHAR AS body, o_orderkey AS seq FROM orders), "
    "one AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY seq) > 1 AS again FROM hyp), kept AS (SELECT * FROM one WHERE NOT again)"
)


# Steps up from each kept hypothesis, until a root, a parent that isn't there, or itself or more steps than there are hypotheses.
_UP = (
    "up AS (SELECT id, parent AS at, 1 AS depth FROM kept WHERE parent IS NOT NULL UNION ALL SELECT u.id, k.parent, u.depth + 1 FROM up u JOIN kept k ON k.id = u.at WHERE k.parent IS NOT NULL AND u.depth < 400), "
    "ends AS (SELECT u.id, max(u.depth) AS depth, max(u.depth) >= 400 AS looped, max(u.depth) < 400 AND bool_or(NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = u.at)) AS orphan FROM up u GROUP BY u.id)"
)


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    parent = F.when(k % 97 == 0, None).when(k % 101 == 5, "gone").when(k % 89 == 1, (k + 1).cast("string")).when(k % 89 == 2, (k - 1).cast("string")).otherwise((k - 1 - k % 5).cast("string"))
    return v.table(spark, d, "orders").select(k.cast("string").alias("id"), parent.alias("parent"), F.concat_ws("|", F.col("o_custkey").cast("string"), (k % 50).cast("string")).alias("body"), k.alias("seq"))


@query(
    "lineage_stages",
    "SELECT o.id, CASE WHEN o.again THEN 'repeated' WHEN o.parent IS NULL THEN NULL WHEN u.looped THEN 'cycle' WHEN u.orphan THEN 'no parent' END AS stage, "
    "CASE WHEN NOT o.again AND (o.parent IS NULL OR (NOT u.looped AND NOT u.orphan)) THEN coalesce(u.depth, 0) END AS generation FROM one o LEFT JOIN ends u ON u.id = o.id AND NOT o.again",
    HYPOTHESES,
    _UP,
    keys="id", others="stage generation",
)
def _(spark, d):
    return lineage.generations(_hypotheses(spark, d), scratch(spark))


@query(
    "lineage_funnel",
    "SELECT stage, entered, rejected, entered - rejected AS remaining FROM (SELECT 'size' AS stage, count(*) AS entered, count(*) FILTER (o_totalprice <= 50000) AS rejected FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_totalprice > 50000), "
    "count(*) FILTER (o_totalprice > 50000 AND o_orderstatus = 'F') FROM orders UNION ALL SELECT 'priority', count(*) FILTER (o_totalprice > 50000 AND o_orderstatus <> 'F'), count(*) FILTER (o_totalprice > 50000 AND o_orderstatus <> 'F' AND o_orderkey % 3 = 0) FROM orders)",
    keys="stage", others="entered rejected remaining",
)
def _(spark, d):
    rows = v.table(spark, d, "orders")
    stages = {"size": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus") != "F", "priority": F.col("o_orderkey") % 3 != 0}
    return lineage.funnel(lineage.staged(rows, stages), list(stages))


@query(
    "parity_first_mismatch",
    "SELECT asset, ts, 'volume' AS field, volume AS left_value, volume + 1 AS right_value FROM b WHERE ts > 1704800000000 AND ts % 10800000 = 0 ORDER BY asset, ts LIMIT 1",
    v.BARS_1H,
    floats="left_value right_value", others="field",
)
def _(spark, d):
    rows = v.bars_1h(spark, d)
    other = rows.withColumn("volume", F.when((F.col("ts") > 1704800000000) & (F.col("ts") % 10800000 == 0), F.col("volume") + 1).otherwise(F.col("volume")))
    return parity.first_mismatch(rows, other, PRICES.split()).withColumns({c: F.col(c).cast("double") for c in ("left_value", "right_value")})


# Long series and large groups ------------------------------------------------------------------------------------------


@query(
    "ema_200",
    "SELECT asset, ts, list_reduce(list(close) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, x : a + (2.0 / 201) * (x - a)) AS ema FROM b",
    v.BARS_1H,
    floats="ema",
)
def _(spark, d):
    return blocks.ema(v.bars_1h(spark, d), "close", 200, "ema")


@query(
    "average_ranks",
    "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS place FROM lineitem",
    keys="l_orderkey l_linenumber", floats="place",
)
def _(spark, d):
    rows = v.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return ordered.average_ranks(rows, "q", ["l_returnflag"], "place")


@query(
    "group_quantiles",
    "SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, 0.05) AS p5, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS p50, quantile_cont(l_extendedprice::DOUBLE, 0.999) AS p999 FROM lineitem GROUP BY l_returnflag",
    keys="l_returnflag", floats="p5 p50 p999",
)
def _(spark, d):
    return ordered.quantiles(v.table(spark, d, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"], {"p5": 0.05, "p50": 0.5, "p999": 0.999})
