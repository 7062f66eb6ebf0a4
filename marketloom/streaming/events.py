"""Structured Streaming over the event log, and the crawl cursor as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FAILURES = 3


def event_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling counts; rows later than the watermark are dropped with their window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once_per_user(events: DataFrame, within: str = "20 hours") -> DataFrame:
    """The first event of a user and type within the watermark: the stop against double notices."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def next_cursor(state: dict, run: dict) -> dict:
    """Where a page walk goes next.

    A failed run stays, unless it is the third in a row, which skips ahead. A finished catalogue, or a step beyond the
    declared or learned number of pages, begins the next cycle at page 1.
    """
    if run["failed"]:
        failures = state["failures"] + 1
        if failures < MOST_FAILURES:
            return state | {"failures": failures}
        return state | {"failures": 0, "next_page": max(state["next_page"], run["last_page"]) + 1}
    known = max(1, run["last_page"]) if run["end"] else state["max_known"]
    bound = state["page_space"] or known
    wrapped = run["end"] or bool(bound and run["last_page"] + 1 > bound)
    return state | {"failures": 0, "max_known": known, "next_page": 1 if wrapped else run["last_page"] + 1, "cycle": state["cycle"] + wrapped}


CURSOR = "source string, next_page int, page_space int, max_known int, cycle int, failures int"


def replay_cursors(runs: DataFrame, page_space: int) -> DataFrame:
    """Cursors after a log of runs (source, run_id, last_page, end, failed), in order of run_id.

    A source's log is read as a sorted stream of rows of one partition; only the cursor is held.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, dict] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                start = {"next_page": 1, "page_space": page_space, "max_known": None, "cycle": 0, "failures": 0}
                states[r.source] = next_cursor(states.get(r.source, start), {"failed": bool(r.failed), "end": bool(r.end), "last_page": int(r.last_page)})
        yield pd.DataFrame([{"source": k, **v} for k, v in states.items()], columns=[c.split()[0] for c in CURSOR.split(", ")]).astype({"max_known": "Int32"})

    return runs.repartition("source").sortWithinPartitions("source", "run_id").select("source", "last_page", "end", "failed").mapInPandas(walk, CURSOR)


STATE = "next_page int, max_known int, cycle int, failures int"
FIELDS = [c.split()[0] for c in CURSOR.split(", ")]


def cursor_stream(runs: DataFrame, page_space: int) -> DataFrame:
    """The cursor of each source after each micro-batch of a stream of runs (source, run_id, last_page, end, failed), kept as state.

    A batch's runs of a source apply in order of run_id, batches in the order they come. A source's state is four numbers;
    it lives in the query's checkpoint, so a restarted query goes on where the last finished batch ended.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATE.split(", ")]
        held = dict(zip(names, state.get, strict=True)) if state.exists else {"next_page": 1, "max_known": None, "cycle": 0, "failures": 0}
        cursor = held | {"page_space": page_space}
        for r in pd.concat(list(frames)).sort_values("run_id").itertuples(index=False):
            cursor = next_cursor(cursor, {"failed": bool(r.failed), "end": bool(r.end), "last_page": int(r.last_page)})
        state.update(tuple(None if cursor[c] is None else int(cursor[c]) for c in names))
        yield pd.DataFrame([{"source": key[0], **cursor}], columns=FIELDS).astype({"max_known": "Int32"})

    return runs.groupBy("source").applyInPandasWithState(step, CURSOR, STATE, "update", "NoTimeout")
