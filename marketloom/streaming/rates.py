"""Rate limits whose window starts at a key's first hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICT = "allowed boolean, remaining int, window_start timestamp_ntz"


def first_hit_verdicts(hits: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """``hits`` (``key``, ``at`` as timestamp_ntz, ``tie`` and others) with allowed, remaining and window_start.

    A key's window opens at its first hit and ends ``seconds`` later; the first hit at or after its end opens the next. Of a
    window's hits, in order of time and ``tie``, the first ``limit`` are allowed. Null keys share one window, hits without
    time are refused and have no window.

    Hits of a key come to one task in order and stream through it, which holds the current window and nothing else; between
    hits further apart than a window nothing is carried over, so windows are found by jumps over sorted times, not hit by hit.
    """
    if limit < 1:
        raise ValueError("limit is 1 or more")
    width = int(seconds * 1_000_000)
    schema = hits.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, used = object(), None, 0
        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            times = batch.column(names.index(at)).cast(pa.int64())
            known = times.is_valid().to_numpy(zero_copy_only=False)
            t = times.fill_null(0).to_numpy()
            start, turn = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                if keys[a] != current:
                    current, opened, used = keys[a], None, 0
                i = a + int((~known[a:b]).sum())
                while i < b:
                    if opened is None or t[i] >= opened + width:
                        opened, used = int(t[i]), 0
                    end = i + int(np.searchsorted(t[i:b], opened + width))
                    start[i:end], turn[i:end] = opened, used + np.arange(end - i)
                    used += end - i
                    i = end
            out = [*batch.columns, pa.array(known & (turn < limit)), pa.array(np.where(known, np.maximum(limit - 1 - turn, 0), 0).astype(np.int32)), pa.array(start, mask=~known).cast(pa.timestamp("us"))]
            yield pa.RecordBatch.from_arrays(out, [*names, "allowed", "remaining", "window_start"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return hits.repartition(key).sortWithinPartitions(key, F.col(at).asc_nulls_first(), tie).mapInArrow(run, f"{out}, {VERDICT}")
