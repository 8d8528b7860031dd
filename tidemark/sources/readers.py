"""Readers of bars and logs. Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import canonical, dedup, time_range
from tidemark.schema import FORWARD_RETURNS, HOUR_MS, require_columns



def place() -> Column:
    """Where a row of a file stands: the file's name, its block's start, and the order within that (ids grow within a task)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


RAW_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("timestamp", "open", "high", "low", "close", "volume")])


def bars_csv(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Bars of a CSV with a header (gzip included): `timestamp` as ISO text, epoch s or ms. The last row of a time stays (of several files, by their names)."""
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    require_columns(spark.createDataFrame([], T.StructType([T.StructField(c.strip().lower(), T.StringType()) for c in header])), RAW_CSV.fieldNames())
    schema = T.StructType([T.StructField(c.strip().lower(), T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    number = F.col("timestamp").try_cast("double")
    ms = F.when(number.isNotNull(), F.when(F.abs(number) >= 1e12, number).otherwise(number * 1000).cast("long")).otherwise(F.unix_millis(F.try_to_timestamp("timestamp")))
    rows = raw.withColumns({"asset": F.lit(asset), "ts": ms, "seq": place()})
    return canonical(rows.select("asset", "ts", "open", "high", "low", "close", "volume", "seq"))


def bars_parquet(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, assets: list[str] | None = None) -> DataFrame:
    """Bars of Parquet, with bounds and assets pushed to the scan."""
    rows = require_columns(spark.read.parquet(path), ["asset", "ts", "open", "high", "low", "close", "volume"])
    rows = time_range(rows, start, end)
    return rows if assets is None else rows.filter(F.col("asset").isin(assets))


def bars_jdbc(spark: SparkSession, url: str, table: str, symbol: str, timeframe: str, since: int | None = None, until: int | None = None, fetch: int = 1000) -> DataFrame:
    """Bars of a database table; the filters run in the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch).load().filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    if since is not None:
        rows = rows.filter(F.col("timestamp_ms") >= since)
    if until is not None:
        rows = rows.filter(F.col("timestamp_ms") <= until)
    return rows.select(F.col("symbol").alias("asset"), F.col("timestamp_ms").alias("ts"), "open", "high", "low", "close", "volume")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, by Hadoop's file systems."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return p
    return None


def bars_cascade(spark: SparkSession, asset: str, csv: str | None = None, cache: str | None = None, fallback=None) -> DataFrame:
    """Bars of an explicit CSV, else of a Parquet cache, else of what fallback() returns."""
    if csv:
        return bars_csv(spark, csv, asset)
    if cache and first_existing(spark, [cache]):
        return bars_parquet(spark, cache, assets=[asset])
    if fallback is None:
        raise FileNotFoundError(f"no source of bars of {asset}")
    return fallback()


def _tasks(spark: SparkSession) -> int:
    """Partitions for rows that stand for parts of files: a stated number, since adaptive plans would join rows that are this small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ipc(path: str):
    """An Arrow IPC file, of which only the footer is read yet."""
    import pyarrow as pa

    return pa.ipc.open_file(pa.memory_map(path.removeprefix("file://"), "r"))


def bars_feather(spark: SparkSession, paths: list[str], asset: str) -> DataFrame:
    """Bars of Arrow IPC (feather) files on a shared file system; the first column named like a date is the time. Footers say which record
    batches a file has; each batch is read by itself, so that one large file is many tasks."""
    import pandas as pd

    def footers(frames):
        for frame in frames:
            for file, path in zip(frame["file"], frame["path"]):
                n = _ipc(path).num_record_batches
                yield pd.DataFrame({"file": file, "path": path, "batch": range(n)})

    def load(frames):
        for frame in frames:
            for file, path, k in zip(frame["file"], frame["path"], frame["batch"]):
                pdf = _ipc(path).get_batch(k).to_pandas()
                pdf.columns = [c.lower() for c in pdf.columns]
                at = pd.to_datetime(pdf[next(c for c in ("date", "timestamp", "ts") if c in pdf.columns)], utc=True)
                yield pd.DataFrame({"asset": asset, "ts": at.astype("datetime64[ms, UTC]").astype("int64"), **{c: pdf[c].astype(float) for c in ("open", "high", "low", "close", "volume")}, "file": file, "batch": k, "row": range(len(pdf))})

    files = spark.createDataFrame(list(enumerate(paths)), "file long, path string").repartition(max(1, len(paths)))
    batches = files.mapInPandas(footers, "file long, path string, batch long").repartition(_tasks(spark), "file", "batch")
    rows = batches.mapInPandas(load, "asset string, ts long, open double, high double, low double, close double, volume double, file long, batch long, row long")
    return dedup(rows.withColumn("seq", F.struct("file", "batch", "row")), ["asset", "ts"], "seq").drop("seq", "file", "batch", "row")


def funding_json(spark: SparkSession, path: str) -> DataFrame:
    """Settlement events of JSON: one object a file, with asset and events (ts, rate)."""
    kind = "asset string, events array<struct<ts: bigint, rate: double>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select("asset", F.explode("events").alias("e")).select("asset", "e.ts", "e.rate").dropDuplicates(["asset", "ts"])


def funding_csv(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Settlement events of a CSV with ts (epoch ms) and rate; the last row of a time stays."""
    rows = spark.read.schema("ts string, rate string").option("header", True).csv(path).select(F.lit(asset).alias("asset"), F.col("ts").try_cast("long").alias("ts"), F.col("rate").try_cast("double").alias("rate"), place().alias("seq"))
    return dedup(rows.dropna(subset=["ts", "rate"]), ["asset", "ts"], "seq").drop("seq")


def basis(premium: DataFrame) -> DataFrame:
    """Snapshots (mark, index) with basis: mark / index - 1."""
    return premium.withColumn("basis", F.try_divide("mark", "index") - 1)


def premium_json(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots (asset, ts, mark, index) of JSON lines, with basis."""
    return basis(spark.read.schema("asset string, ts long, mark double, index double").json(path))


def previous_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a JSON-lines result, None where there is none yet."""
    return spark.read.json(path) if first_existing(spark, [path]) else None


def catalog(spark: SparkSession, table: str) -> dict | None:
    """Columns, schema text and rows of a catalog table, None if it doesn't exist."""
    if not spark.catalog.tableExists(table):
        return None
    df = spark.table(table)
    return {"columns": df.columns, "schema": df.schema.simpleString(), "rows": df.count()}


def forward_returns_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORWARD_RETURNS).option("header", True).csv(path)


def trades_json(spark: SparkSession, path: str) -> DataFrame:
    """Profits of backtest results: strategy -> trades with profit_ratio."""
    kind = "strategy map<string, struct<trades: array<struct<pair: string, profit_ratio: double, close_timestamp: bigint>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    return rows.select(F.explode("strategy").alias("strategy", "_v")).select("strategy", F.explode("_v.trades").alias("t")).select("strategy", "t.*")


def trades_zip(spark: SparkSession, path: str) -> DataFrame:
    """As trades_json, of zipped result files on a shared file system. Central directories say which members an archive has; each member is read by
    itself, at its place in the file."""
    import pandas as pd

    def members(frames):
        import zipfile

        for frame in frames:
            for file in frame["path"]:
                with zipfile.ZipFile(file) as z:
                    yield pd.DataFrame({"path": file, "member": [n for n in z.namelist() if n.endswith(".json")]}, dtype=object)

    def load(frames):
        import json
        import zipfile

        for frame in frames:
            for file, member in zip(frame["path"], frame["member"]):
                with zipfile.ZipFile(file) as z, z.open(member) as f:
                    body = json.load(f)
                rows = [(k, x.get("pair"), x.get("profit_ratio"), x.get("close_timestamp")) for k, v in (body.get("strategy") or {}).items() for x in v.get("trades", [])]
                yield pd.DataFrame(rows, columns=["strategy", "pair", "profit_ratio", "close_timestamp"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"))
    parts = files.mapInPandas(members, "path string, member string").repartition(_tasks(spark), "path", "member")
    return parts.mapInPandas(load, "strategy string, pair string, profit_ratio double, close_timestamp long")


def log_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """file and one number for each pattern's first group, from whole text logs."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", *(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)).try_cast("double").alias(k) for k, p in patterns.items()))


def event_store(spark: SparkSession, path: str, kind: str | None = None, payload: str | None = None) -> DataFrame:
    """Events (id, kind, ts, payload), of one kind if given, with the payload parsed if a schema is."""
    rows = spark.read.parquet(path)
    rows = rows if kind is None else rows.filter(F.col("kind") == kind)
    return rows if payload is None else rows.withColumn("payload", F.from_json("payload", payload))


def context_rows(spark: SparkSession, sources: dict[str, object]) -> DataFrame:
    """One row of point values (fear index, dominance and so on); a source that fails gives NULL."""
    values = {}
    for name, call in sources.items():
        try:
            values[name] = float(call())
        except Exception:  # noqa: BLE001  a missing side value never stops a cycle
            values[name] = None
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` double" for k in values))


def synthetic_bars(spark: SparkSession, assets: list[str], n: int, seed: int = 7, start: float = 30_000.0, vol: float = 0.004, first_ts: int = 1_704_067_200_000, width_ms: int = HOUR_MS) -> DataFrame:
    """Geometric walks, one for each asset, each made in one task by a seeded generator."""
    import numpy as np
    import pandas as pd

    def make(batches):
        for batch in batches:
            for i, asset in zip(batch["i"], batch["asset"]):
                rng = np.random.default_rng([seed, int(i)])
                close = start * np.exp(np.cumsum(rng.normal(0, vol, n)))
                open_ = np.concatenate([[start], close[:-1]])
                wick = np.abs(rng.normal(0, vol / 2, (2, n)))
                yield pd.DataFrame({"asset": asset, "ts": first_ts + np.arange(n) * width_ms, "open": open_, "high": np.maximum(open_, close) * (1 + wick[0]), "low": np.minimum(open_, close) * (1 - wick[1]), "close": close, "volume": rng.lognormal(3.0, 0.6, n)})

    rows = spark.createDataFrame(list(enumerate(assets)), "i long, asset string").repartition(max(1, len(assets)))
    return rows.mapInPandas(make, "asset string, ts long, open double, high double, low double, close double, volume double")
