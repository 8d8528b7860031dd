"""Schemas of the tables, and checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_MS, DAY_MS = 3_600_000, 86_400_000

#: Bars: `asset` and `ts` (open time, epoch ms UTC) are the key.
BARS = T.StructType([T.StructField("asset", T.StringType()), T.StructField("ts", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
#: Raw candles as stored.
OHLCV = T.StructType([T.StructField(c, T.StringType()) for c in ("exchange", "symbol", "timeframe")] + [T.StructField("timestamp_ms", T.LongType()), T.StructField("timestamp_utc", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")] + [T.StructField("source", T.StringType())])
#: Logged forecasts.
PREDICTIONS = T.StructType([T.StructField("asset", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("ts", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("predicted_range", "actual_range", "prediction_error", "abs_prediction_error")), T.StructField("breakout_flag", T.IntegerType()), T.StructField("regime", T.StringType())])
#: Forward returns of breakouts.
FORWARD_RETURNS = T.StructType([T.StructField("breakout_ts", T.LongType()), T.StructField("asset", T.StringType()), T.StructField("direction", T.IntegerType()), T.StructField("horizon", T.IntegerType()), T.StructField("target_ts", T.LongType()), T.StructField("base_close", T.DoubleType()), T.StructField("forward_return", T.DoubleType()), T.StructField("forward_direction", T.IntegerType())])
#: Paper positions.
POSITIONS = T.StructType([T.StructField("position_id", T.StringType()), T.StructField("asset", T.StringType()), T.StructField("direction", T.IntegerType()), T.StructField("entry_price", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("exit_price", T.DoubleType()), T.StructField("pnl", T.DoubleType())])
#: Settlement events.
FUNDING = T.StructType([T.StructField("asset", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("rate", T.DoubleType())])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; else ValueError naming those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """df with NaN as NULL in all floating columns, the one form of missing values here."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns that it lacks added as NULL (additive evolution)."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})
