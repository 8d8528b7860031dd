"""Idempotent writes over tables of immutable files.

A table is a folder of Parquet data and a log: each version of the log names the folders that hold each
partition (a span of time). An append writes new files only; an update rewrites the partitions that
it touches and no others; readers follow the newest log, so that a failed or repeated job leaves the table
as it was. Log files are never overwritten: of two writers at once, one fails.
"""

from __future__ import annotations

import json
import uuid
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import issues
from tidemark.schema import DAY_MS, evolve

#: Columns whose time deals a table's rows over partitions: the first that a table has.
TIMES = ("ts", "breakout_ts", "timestamp_ms")


class Table:
    """keep: versions whose files stay. most_folders: appends to one partition until compact() joins them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, span_ms: int = 30 * DAY_MS, keep: int = 2, most_folders: int = 32) -> None:
        self.spark, self.path, self.schema, self.span_ms, self.keep, self.most_folders = spark, path.rstrip("/"), schema, span_ms, keep, most_folders
        self.time = next((c for c in TIMES if c in schema.fieldNames()), None)

    # The log: {partition: [folders]} of each version, as JSON.

    def _hadoop(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where, fs = self._hadoop("_log")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(where)) if fs.exists(where) else []

    def version(self) -> int:
        """The newest version, 0 without any."""
        return max(self._versions(), default=0)

    def _state(self, version: int | None = None) -> dict[int, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        where, fs = self._hadoop(f"_log/{version:010d}.json")
        stream = fs.open(where)
        try:
            return {int(k): v for k, v in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def _commit(self, state: dict[int, list[str]]) -> int:
        versions = self._versions()
        version = max(versions, default=0) + 1
        # written under another name first: a reader sees a whole log file or none, and a file that is there is never replaced
        where, fs = self._hadoop(f"_log/{version:010d}.json")
        draft, _ = self._hadoop(f"_draft/{uuid.uuid4().hex}.json")
        fs.mkdirs(where.getParent())
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, where, none)
        old = versions[: len(versions) + 1 - self.keep] if self.keep <= len(versions) else []
        used = {x for v in [*versions[len(old) :], version] for x in chain(*self._state(v).values())}
        for v in old:
            for folder in {x for x in chain(*self._state(v).values())} - used:
                gone, fs = self._hadoop(folder)
                fs.delete(gone, True)
            gone, fs = self._hadoop(f"_log/{v:010d}.json")
            fs.delete(gone, False)
        return version

    # Data

    def part(self) -> Column:
        """The partition of a row."""
        return (F.floor(F.coalesce(F.col(self.time), F.lit(0)) / F.lit(self.span_ms)) if self.time else F.lit(0)).cast("long")

    def _put(self, rows: DataFrame) -> dict[int, str]:
        """Writes rows as new files; the folder of each partition."""
        name = f"data/{uuid.uuid4().hex}"
        own = evolve(rows, self.schema).select(self.schema.fieldNames()).withColumn("_part", self.part())
        own.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{name}")
        where, fs = self._hadoop(name)
        found = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory() and "=" in x.getPath().getName()]
        return {int(x.split("=")[1]): f"{name}/{x}" for x in found}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows (of some partitions), with columns added since as NULL."""
        folders = [f"{self.path}/{x}" for k, v in self._state().items() if parts is None or k in set(parts) for x in v]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def count_of(self, folders: list[str]) -> int:
        """Rows of some folders, from their files' footers."""
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{x}" for x in folders)).count() if folders else 0

    def create(self) -> None:
        """An empty first version, if there is none."""
        if not self.version():
            self._commit({})

    def write(self, rows: DataFrame) -> int:
        """A version of these rows alone."""
        return self._commit({k: [x] for k, x in self._put(rows).items()})

    def append(self, rows: DataFrame) -> int:
        """A version with these rows added: their files are new, no other is touched."""
        state, added = self._state(), self._put(rows)
        for k, x in added.items():
            state[k] = [*state.get(k, []), x]
        return self._commit(state)

    def compact(self) -> int:
        """Joins the folders of each partition that has more than most_folders."""
        many = [k for k, v in self._state().items() if len(v) > self.most_folders]
        return self.replace(self.read(many), many) if many else self.version()

    def replace(self, rows: DataFrame, parts: list[int]) -> int:
        """A version in which rows stand for all that some partitions held."""
        state = {k: v for k, v in self._state().items() if k not in set(parts)}
        for k, x in self._put(rows).items():
            state[k] = [*state.get(k, []), x]
        return self._commit(state)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """Partitions that rows fall in (one narrow aggregate)."""
        return sorted(r[0] for r in rows.select(self.part().alias("_part")).distinct().collect())


def new_rows(existing: DataFrame, incoming: DataFrame, key: list[str], arrival: str | None = None) -> DataFrame:
    """Incoming rows whose key isn't stored; of repeated ones the first to arrive."""
    rows = incoming
    if arrival:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(arrival))).filter("_r = 1").drop("_r")
    return rows.join(existing.select(*key), key, "left_anti")


def insert_new(table: Table, incoming: DataFrame, key: list[str], arrival: str | None = None, checks: Column | None = None) -> dict[str, int]:
    """Insert rows whose key is new and which pass the checks (of equal keys the first to arrive, or the least by all columns); counts of
    inserted, skipped and quarantined rows. Only partitions that incoming rows fall in are read; what was inserted is counted from the new files' footers."""
    # read once: what is counted is what is written
    staged = f"{table.path}/incoming/{uuid.uuid4().hex}"
    incoming.write.parquet(staged)
    incoming = table.spark.read.schema(incoming.schema).parquet(staged)
    rest = [c for c in incoming.columns if c not in key]
    have = table.read(table.parts_of(incoming)).select(*key).distinct().withColumn("_have", F.lit(True))
    rows = incoming.withColumn("_ok", F.lit(True) if checks is None else F.coalesce(checks, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*key, "_ok").orderBy(*([arrival] if arrival else []), *rest))
    rows = rows.withColumn("_r", place).join(have, key, "left").withColumn("_new", F.col("_ok") & (F.col("_r") == 1) & F.col("_have").isNull())
    n = incoming.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if checks is None else F.coalesce(checks, F.lit(False))).alias("ok")).first()
    before = {x for v in table._state().values() for x in v}
    table.append(rows.filter("_new").drop("_ok", "_r", "_have", "_new"))
    inserted = table.count_of([x for v in table._state().values() for x in v if x not in before])
    table.compact()
    gone, fs = table._hadoop(staged.removeprefix(f"{table.path}/"))
    fs.delete(gone, True)
    return {"inserted": inserted, "skipped": n["ok"] - inserted, "quarantined": n["n"] - n["ok"]}


def update(table: Table, incoming: DataFrame, change) -> int:
    """A version in which change(rows of the partitions that incoming falls in) stands for those rows."""
    parts = table.parts_of(incoming)
    return table.replace(change(table.read(parts)), parts) if parts else table.version()


def valid_bar() -> Column:
    return F.size(issues()) == 0


def quarantine(incoming: DataFrame) -> DataFrame:
    """Rows that the checks keep out, with their issues."""
    return incoming.withColumn("issues", issues()).filter(F.size("issues") > 0)


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str], arrival: str | None = None) -> DataFrame:
    """Existing rows, replaced by and completed with the incoming ones. Of incoming rows with one key the last by `arrival` (a column
    of incoming only) stays, or without it the greatest by their other columns."""
    rest = [c for c in existing.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*([arrival] if arrival else []), *rest)).alias("_v")
    incoming = incoming.groupBy(*key).agg(last).select(*key, "_v.*").select(existing.columns)
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))).filter("_r = 1").drop("_r", "_new")


def completed_once(pred: DataFrame, actuals: DataFrame, key: list[str], times: float = 2.0) -> DataFrame:
    """Predictions with actual_range filled where it was NULL, and errors and breakout flag (over `times` the forecast) of those rows."""
    rows = pred.join(actuals.select(*key, F.col("actual_range").alias("_a")), key, "left").withColumn("_fill", F.col("actual_range").isNull() & F.col("_a").isNotNull())
    fill = lambda name, value: F.when(F.col("_fill"), value).otherwise(F.col(name)).alias(name)
    e = F.col("_a") - F.col("predicted_range")
    made = {"actual_range": F.col("_a"), "prediction_error": e, "abs_prediction_error": F.abs(e), "breakout_flag": (F.col("_a") > times * F.col("predicted_range")).cast("int")}
    return rows.select(*(fill(c, made[c]) if c in made else F.col(c) for c in pred.columns))


def fan_out(breakouts: DataFrame, horizons: list[int], width_ms: int) -> DataFrame:
    """A pending forward-return row for each breakout (breakout_ts, asset, direction, base_close) and horizon."""
    return breakouts.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons)))).withColumn("target_ts", F.col("breakout_ts") + F.col("horizon") * width_ms).withColumns({"forward_return": F.lit(None).cast("double"), "forward_direction": F.lit(None).cast("int")})


def fill_forward_returns(pending: DataFrame, bars: DataFrame, now_ms: int) -> DataFrame:
    """Forward returns of rows that are due and whose bar is there; the others stay pending."""
    close = bars.select("asset", F.col("ts").alias("target_ts"), F.col("close").alias("_c"))
    due = F.col("forward_return").isNull() & (F.col("target_ts") <= now_ms) & (F.col("base_close") > 0) & F.col("_c").isNotNull()
    r = F.try_divide("_c", "base_close") - 1
    rows = pending.join(close, ["asset", "target_ts"], "left")
    return rows.withColumn("forward_direction", F.when(due, F.signum(r).cast("int")).otherwise(F.col("forward_direction"))).withColumn("forward_return", F.when(due, r).otherwise(F.col("forward_return"))).select(pending.columns)


def fillable(rows: DataFrame, found: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """What backfilled() would fill, without doing so: one row with a count for each column."""
    own = found.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(own, key).agg(*(F.count_if(F.col(c).isNull() & F.col(f"_{c}").isNotNull()).alias(c) for c in columns))


def upgraded(table: Table, schema: T.StructType) -> Table:
    """The table read by a schema with more columns (NULL in older rows); raises if a column went or changed, or the number of rows would."""
    if [f for f in table.schema if f not in schema.fields]:
        raise ValueError("only columns can be added")
    new = Table(table.spark, table.path, schema, table.span_ms, table.keep, table.most_folders)
    if new.time != table.time or new.read().count() != table.read().count():
        raise ValueError("an upgrade keeps all rows and their partitions")
    return new


def backfilled(rows: DataFrame, found: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns filled from found, only where they are NULL."""
    own = found.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(own, key, "left").select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def opened(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """positions with orders (asset, direction, entry_price, size) as open ones."""
    new = orders.withColumns({"position_id": F.md5(F.concat_ws("|", "asset", "direction", "entry_price", "size")), "status": F.lit("open"), "exit_price": F.lit(None).cast("double"), "pnl": F.lit(None).cast("double")})
    return positions.unionByName(new_rows(positions, new, ["position_id"]).select(positions.columns))


def closed(positions: DataFrame, exits: DataFrame) -> DataFrame:
    """positions with those of exits (position_id, price) closed; P&L is direction * (exit - entry) * size."""
    rows = positions.join(exits.select("position_id", F.col("price").alias("_p")), "position_id", "left")
    hit = (F.col("status") == "open") & F.col("_p").isNotNull()
    return rows.withColumn("pnl", F.when(hit, F.col("direction") * (F.col("_p") - F.col("entry_price")) * F.col("size")).otherwise(F.col("pnl"))).withColumn("exit_price", F.when(hit, F.col("_p")).otherwise(F.col("exit_price"))).withColumn("status", F.when(hit, "closed").otherwise(F.col("status"))).select(positions.columns)


def export_csv(bars: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV files with a header, in the order of asset and time over all files (range partitioned; as many as the rows need)."""
    columns = columns or ["asset", "ts", "open", "high", "low", "close", "volume"]
    bars.select(columns).orderBy("asset", "ts").write.mode("overwrite").option("header", True).csv(path)


def append_report(table: Table, kind: str, payload: DataFrame, ts: int) -> int:
    """A row (id, kind, ts, payload) with a one-row DataFrame as JSON; the same report is stored once."""
    row = payload.select(F.to_json(F.struct(*payload.columns)).alias("payload")).withColumns({"kind": F.lit(kind), "ts": F.lit(ts)}).withColumn("id", F.sha2(F.concat_ws("|", "kind", F.col("ts").cast("string"), "payload"), 256))
    return table.append(new_rows(table.read(table.parts_of(row)), row, ["id"]))


EVENTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("payload", T.StringType())])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and SHA-256 of each file of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def run_id() -> str:
    """An id for a run, made before its rows are written."""
    return uuid.uuid4().hex
