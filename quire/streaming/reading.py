"""Streams: files as they arrive, and reading states kept from a log of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire import config as C
from quire.config import Options
from quire.sources.epub import read_books


def arriving_books(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Books parsed as their files arrive. What is judged over a whole book needs no watermark, as a file is a book."""
    return read_books(spark, path, strict=options.strict, streaming=True)


def ingest(spark: SparkSession, path: str, folder: str, checkpoint: str, options: Options = Options()):
    """A query that adds arriving books to `folder`/parsed, from where plans.library goes on."""
    return arriving_books(spark, path, options).writeStream.format("parquet").option("path", f"{folder}/parsed").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "last_page bigint, last_ts timestamp, bookmarks array<bigint>"
OUTPUT = "book_id bigint, last_page bigint, bookmarks array<bigint>"


def _replay(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    page, ts, marks = state.get if state.exists else (1, pd.Timestamp(0), [])
    marks, ts = list(marks), pd.Timestamp(ts)
    for batch in batches:
        for row in batch.sort_values(["ts", "event_id"], kind="stable").itertuples():
            if row.action == "toggle":
                if row.page in marks:
                    marks.remove(row.page)
                elif len(marks) < C.MAX_BOOKMARKS:
                    marks.append(row.page)
            elif row.ts >= ts:
                page, ts = row.page, row.ts
    state.update((int(page), ts.to_pydatetime(), [int(m) for m in marks]))
    yield pd.DataFrame({"book_id": [key[0]], "last_page": [int(page)], "bookmarks": [[int(m) for m in marks]]})


def replay(events: DataFrame) -> DataFrame:
    """States after each batch of events(book_id, page, action 'move' or 'toggle', ts, event_id): the last page by time, and bookmarks in the order they were set."""
    return events.select("book_id", "page", "action", F.col("ts").cast("timestamp").alias("ts"), "event_id").groupBy("book_id").applyInPandasWithState(_replay, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
