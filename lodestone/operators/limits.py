"""Sliding-window admission, a fold over time that no window frame can express."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admitted(rows: DataFrame, key: str, micros: str, tie: str, most: int, window: int) -> DataFrame:
    """(key, tie, admitted): a request passes if fewer than `most` passed in the `window` microseconds before it; refused ones don't count.

    Keys are spread by hash and each partition is sorted, so a task streams through its rows and holds at most `most`
    times of one key, however many rows the key has.  Rows with a null key or time are refused.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, passed = None, deque()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[micros], strict=True):
                if k != now:
                    now, passed = k, deque()
                while passed and passed[0] <= t - window:
                    passed.popleft()
                out.append(len(passed) < most)
                if out[-1]:
                    passed.append(t)
            yield pd.DataFrame({key: batch[key], tie: batch[tie], "admitted": out})

    sound = rows.where(F.col(key).isNotNull() & F.col(micros).isNotNull()).select(key, micros, tie)
    judged = sound.repartition(key).sortWithinPartitions(key, micros, tie).mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, admitted boolean")
    refused = rows.where(F.col(key).isNull() | F.col(micros).isNull()).select(key, tie, F.lit(False).alias("admitted"))
    return judged.unionByName(refused)
