"""Views over the driver's tables that the registered queries start from, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ts as t
from tidemark.operators import bars as b
from tidemark.operators import forecast as fc
from tidemark.schema import DAY_MS, HOUR_MS


#: Event types up to which settlements are repeated for each.
MOST_ASSETS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to a scratch table and read again: for what several parts of one query read, and as the end of a long plan (each scan over
    blocks reads its input twice)."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events' values, one asset for each event type."""
    return b.resample(table(spark, sf_dir, "events"), F.col("event_type"), ms("ts"), F.col("value"), F.col("ts"), width_ms=HOUR_MS)


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line item prices, one asset for each return flag."""
    return b.resample(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), ms("l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice"), width_ms=DAY_MS)


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from sign-ups."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return rows.select(ms("ts").alias("ts"), (F.log1p("value") / 100).alias("rate"))


def funding_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rates for each of the other assets."""
    assets = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().limit(MOST_ASSETS + 1).collect()]
    if len(assets) > MOST_ASSETS:
        raise ValueError(f"more than {MOST_ASSETS} assets")
    return funding(spark, sf_dir).withColumn("asset", F.explode(F.array(*(F.lit(a) for a in sorted(assets)))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-bar mean forecasts of hourly ranges; the newest of each asset is pending."""
    r = fc.ranges(bars_1h(spark, sf_dir)).withColumn("predicted_range", t.mean("range", 5, 1)).withColumn("_n", t.lead("ts"))
    regime = F.when(F.col("predicted_range") < 40, "low").when(F.col("predicted_range") < 60, "medium").otherwise("high")
    return r.filter("predicted_range IS NOT NULL").select("asset", F.lit("1h").alias("timeframe"), "ts", "predicted_range", F.when(F.col("_n").isNotNull(), F.col("range")).alias("actual_range"), regime.alias("regime"))


# The same views in SQL; names are given to WITH.
BARS_1H = (
    "bars_1h AS (SELECT event_type AS asset, epoch_ms(date_trunc('hour', ts)) AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, "
    "arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2), b AS (SELECT asset, bar AS ts, open, high, low, close, volume "
    "FROM bars_1h)"
)
BARS_1D = (
    "bars_1d AS (SELECT l_returnflag AS asset, epoch_ms(date_trunc('day', l_shipdate)) AS ts, (list(l_extendedprice "
    "ORDER BY l_orderkey, l_linenumber, l_extendedprice))[1] AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, (list(l_extendedprice "
    "ORDER BY l_orderkey, l_linenumber, l_extendedprice))[-1] AS close, count(*)::DOUBLE AS volume FROM lineitem GROUP BY 1, 2), d AS (SELECT * "
    "FROM bars_1d)"
)
FUNDING = "f AS (SELECT epoch_us(ts) // 1000 AS ts, ln(1 + value) / 100 AS rate FROM events WHERE event_type = 'signup')"
RANGES = "r AS (SELECT *, greatest(high - low, 0) AS range FROM b)"
PREDICTIONS = (
    "p0 AS (SELECT *, CASE WHEN count(range) OVER w5 >= 5 THEN avg(range) OVER w5 END AS predicted_range, lead(ts) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY asset ORDER BY ts), w5 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), "
    "p AS (SELECT asset, '1h' AS timeframe, ts, predicted_range, CASE WHEN nxt IS NOT NULL THEN range END AS actual_range, CASE WHEN predicted_range < 40 THEN 'low' WHEN predicted_range < 60 THEN 'medium' ELSE 'high' END AS regime FROM p0 WHERE predicted_range IS NOT NULL), "
    "c AS (SELECT *, actual_range - predicted_range AS error, abs(actual_range - predicted_range) AS abs_error FROM p WHERE actual_range > 0)"
)
