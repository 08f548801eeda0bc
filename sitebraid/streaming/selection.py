"""Selections and caches over time: change detection, rising edges, answers kept for a while; in batch and as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before(value: Column, by: tuple[str, ...], order: str) -> Column:
    return F.lag(value).over(W.partitionBy(*by).orderBy(order))


def changes(df: DataFrame, by: tuple[str, ...], value: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before (null counts as a value); the first of each key."""
    return df.withColumn("_b", _before(F.col(value), by, order)).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def rising(df: DataFrame, by: tuple[str, ...], flag: str, order: str) -> DataFrame:
    """Rows where a flag turns true."""
    return df.withColumn("_b", F.coalesce(_before(F.col(flag), by, order), F.lit(False))).where(F.col(flag) & ~F.col("_b")).drop("_b")


def _answers(stored: float | None, at: float, failed: bool, fresh: float, stale: float) -> tuple[str, float | None]:
    if stored is not None and at - stored <= fresh:
        return "hit", stored
    if not failed:
        return "store", at
    return ("stale", stored) if stored is not None and at - stored <= stale else ("error", stored)


def cache_answers(requests: DataFrame, fresh: float, stale: float) -> DataFrame:
    """key, event_id, answer of requests (key, event_id, at in seconds, failed), in the order of at and event_id.

    'hit' within fresh of the last store; else 'store', or on a failure 'stale' within stale and 'error'
    beyond. A fold a key: only a store renews the age, which no window frame says. Keys come sorted, and from
    batch to batch only the last key and its store are kept, so a key of any size streams through its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = object(), None
        for batch in batches:
            out = []
            for key, at, failed in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "failed")), strict=True):
                if key != last:
                    last, stored = key, None
                answer, stored = _answers(stored, math.nan if at is None else at, failed, fresh, stale)
                out.append(answer)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(out, pa.string())], ["key", "event_id", "answer"])

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"), "failed")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("at"), F.asc_nulls_last("event_id"))
    return dealt.mapInArrow(run, "key string, event_id long, answer string")


def changes_stream(selections: DataFrame, key: str = "key", value: str = "selection") -> DataFrame:
    """The same change detection on a stream of (key, seq, selection): state keeps the last selection of a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, selection in zip(rows["seq"], rows[value], strict=True):
            if selection is not None and selection != last:
                out.append((k[0], seq, selection))
                last = selection
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", value])

    return selections.groupBy(key).applyInPandasWithState(run, f"{key} string, seq long, {value} string", "last string", "append", "NoTimeout")
