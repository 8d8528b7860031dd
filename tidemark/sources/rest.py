"""Paged candle and settlement sources as Spark data sources.

A scan is planned as page ranges, one input partition each, so pages are fetched in
parallel and Spark repeats a page whose task is lost. A page is fetched by a
`client` (an importable "module:function") called as client(symbol, timeframe, since_ms,
limit) and retried with exponential backoff; tests give a client over files. A server may answer with fewer rows than
asked for, so only an empty answer ends a range.

The same pages are a stream, whose offsets are the next bar's time of each symbol: every micro-batch plans the page ranges from there
to the last closed bar, and a restart goes on from the offset that was committed.
"""

from __future__ import annotations

import importlib
import json
import random
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.schema import BARS, FUNDING

TIMEFRAMES = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


#: Rows that one request asks for at most, where answers repeat earlier rows.
MOST_ROWS = 1 << 20


class Fatal(Exception):
    """An error that no retry mends."""


def load(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def with_retries(call, attempts: int = 5, base_s: float = 0.5, sleep=time.sleep):
    """call(), again after growing, jittered waits; Fatal and ValueError are raised at once."""
    for i in range(attempts):
        try:
            return call()
        except (Fatal, ValueError):
            raise
        except Exception:
            if i == attempts - 1:
                raise
            sleep(base_s * 2**i * (1 + random.random() / 4))


class Page(InputPartition):
    def __init__(self, since: int, until: int, symbol: str | None = None) -> None:
        self.since, self.until, self.symbol = since, until, symbol


def page_ranges(since: int, until: int, step: int, limit: int, symbol: str | None = None) -> list[Page]:
    """Pages of `limit` steps, from since to until."""
    width = step * limit
    return [Page(a, min(a + width, until), symbol) for a in range(since, until, width)]


def budget(since: int, until: int, step: int, limit: int, max_requests: int) -> tuple[int, tuple[int, int] | None]:
    """The end of what max_requests pages cover, and the range that is left after it (None if nothing is)."""
    end = min(until, since + step * limit * max_requests)
    return end, ((end, until) if end < until else None)


def fetched(options: dict, page: Page, step: int, limit: int, events: bool) -> Iterator[tuple]:
    """The rows of a page range, by as many requests as the server's answers need. Answers may begin before the time that is asked for; where
    such rows fill half of an answer or more, the next requests ask for twice as many rows (up to `most_limit`)."""
    client, symbol, at, ask, stuck = load(options["client"]), page.symbol or options["symbol"], page.since, limit, None
    most = int(options.get("most_limit", MOST_ROWS))

    def request(since: int) -> list:
        return with_retries(lambda: client(symbol, options.get("timeframe", "1h"), since, ask), int(options.get("attempts", 5)), float(options.get("backoff", 0.5)))

    while at < page.until:
        answer = request(at)
        rows = [r for r in answer if at <= r[0] < page.until]
        for r in rows:
            yield (symbol, int(r[0]), *(float(x) for x in r[1:]))
        if not answer or max(r[0] for r in answer) >= page.until:
            return
        if rows:
            at, stuck = int(max(r[0] for r in rows)) + (1 if events else step), None
        elif len(answer) == stuck or ask >= most:
            # no more rows for a larger request: either there are none from here on, or the server doesn't give so many; then later requests show some
            if any(r[0] >= at for k in range((page.until - at).bit_length()) for r in request(at + (1 << k))):
                raise Fatal(f"{symbol}: answers from {at} on hold earlier rows only, though there are later ones")
            return
        else:
            stuck = len(answer)
        if 2 * len(rows) <= len(answer):
            ask = max(ask, min(2 * ask, most))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, events: bool) -> None:
        self.o, self.events = options, events
        self.step = 8 * 3_600_000 if events else TIMEFRAMES[options.get("timeframe", "1h")]
        self.limit = int(options.get("limit", 1000))

    def partitions(self) -> list[Page]:
        since, until = int(self.o["since"]), int(self.o["until"])
        if not self.events:
            now = self.o.get("now")
            until = min(until, int(now) - self.step + 1) if now else until  # closed bars only
        # events come in any number a time: range_ms says what time one range covers
        pages = page_ranges(since, until, int(self.o["range_ms"]), 1) if "range_ms" in self.o else page_ranges(since, until, self.step, self.limit)
        if "max_requests" in self.o and len(pages) > int(self.o["max_requests"]):
            # nothing is left out unseen: budget() says what a number of requests covers and what is left
            raise Fatal(f"{len(pages)} page ranges are more than {self.o['max_requests']} requests")
        return pages

    def read(self, page: Page) -> Iterator[tuple]:
        yield from fetched(self.o, page, self.step, self.limit, self.events)


class PagedStream(DataSourceStreamReader):
    """Offsets: the next bar's time of each symbol. The time is the machine's, or `clock_ms`."""

    def __init__(self, options: dict) -> None:
        self.o, self.step, self.limit = options, TIMEFRAMES[options.get("timeframe", "1h")], int(options.get("limit", 1000))
        self.symbols = sorted(s for s in options["symbols"].split(",") if s)

    def initialOffset(self) -> dict:
        return {s: int(self.o["since"]) for s in self.symbols}

    def latestOffset(self) -> dict:
        now = int(self.o["clock_ms"]) if "clock_ms" in self.o else int(time.time() * 1000)
        since = int(self.o["since"])
        closed = max(since, since + (now - since) // self.step * self.step)  # a bar is closed once the next one opens
        return {s: closed for s in self.symbols}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [p for s in sorted(end) for p in page_ranges(int(start.get(s, self.o["since"])), int(end[s]), self.step, self.limit, s)]

    def read(self, page: Page) -> Iterator[tuple]:
        seen = set()  # an answer may repeat rows
        for row in fetched(self.o, page, self.step, self.limit, False):
            if row[1] not in seen:
                seen.add(row[1])
                yield row

    def commit(self, end: dict) -> None:
        """Where `progress` is given, the committed offset is written there, for people to look at."""
        if "progress" in self.o:
            with open(self.o["progress"], "w") as f:
                json.dump(end, f)


class Candles(DataSource):
    """Bars in [since, until); with `now`, those closed by then."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> StructType:
        return BARS

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), False)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(dict(self.options))


class Funding(DataSource):
    """Settlement events in [since, until)."""

    @classmethod
    def name(cls) -> str:
        return "funding"

    def schema(self) -> StructType:
        return FUNDING

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), True)


def read_pages(spark: SparkSession, kind: str, client: str, symbol: str, since: int, until: int, **options) -> DataFrame:
    """Rows of a registered paged source, without repeats."""
    spark.dataSource.register(Candles if kind == "candles" else Funding)
    reader = spark.read.format(kind).options(client=client, symbol=symbol, since=str(since), until=str(until), **{k: str(v) for k, v in options.items()})
    return reader.load().dropDuplicates(["asset", "ts"])


def stream_pages(spark: SparkSession, client: str, symbols: list[str], since: int, **options) -> DataFrame:
    """A stream of the closed bars of symbols from a time on."""
    spark.dataSource.register(Candles)
    return spark.readStream.format("candles").options(client=client, symbols=",".join(symbols), since=str(since), **{k: str(v) for k, v in options.items()}).load()


def missing(have: DataFrame, since: int, until: int, step: int) -> DataFrame:
    """asset, first, end: every range of an asset's bars that isn't stored within [since, until): before its first bar, in holes and after its last."""
    edges = have.select("asset").distinct().select("asset", F.explode(F.array(F.lit(since - step), F.lit(until))).alias("ts"))
    rows = have.filter((F.col("ts") >= since) & (F.col("ts") < until)).select("asset", "ts").unionByName(edges).distinct()
    own = blocks.bounded(rows, lambda x: x.withColumn("end", t.lead("ts")), 0, 1)
    return own.filter(F.col("end") - F.col("ts") > step).select("asset", (F.col("ts") + step).alias("first"), "end")


def missing_ranges(have: DataFrame, since: int, until: int, step: int) -> list[tuple[int, int]]:
    """Ranges still to fetch of one asset, in order (as many as there are holes)."""
    if have.isEmpty():
        return [(since, until)] if since < until else []
    return sorted((r["first"], r["end"]) for r in missing(have.withColumn("asset", F.lit("")), since, until, step).collect())
