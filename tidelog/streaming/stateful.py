"""The folds over streams: the same objects, kept as state from one micro-batch to the next."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import islice
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_dir


#: Bytes of a group's rows that are sorted at once; parts that a sorted run is read in; runs that are merged at once.
RUN_BYTES, PARTS, FAN = 8 << 20, 64, 128
#: Rows of a frame that is given out.
OUT_ROWS = 10_000


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    """A frame's rows, with null for what is missing and lists for arrays."""
    columns = []
    for i in range(frame.shape[1]):
        column = frame.iloc[:, i]
        values = column.astype(object).where(column.notna(), None).tolist()
        columns.append([v.tolist() if isinstance(v, np.ndarray) else v for v in values] if column.dtype == object else values)
    return list(zip(*columns, strict=True))


def _put(rows: Iterator[tuple], size: int) -> IO[bytes]:
    """Rows to a file without a name on the task's own machine, in parts of so many rows."""
    base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    file, rows = tempfile.TemporaryFile(dir=base if os.path.isdir(base) else None), iter(rows)
    while part := list(islice(rows, size)):
        pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _get(file: IO[bytes]) -> Iterator[tuple]:
    with file:
        while True:
            try:
                part = pickle.load(file)
            except EOFError:
                return
            yield from part


def _key(places: list[int]) -> Callable[[tuple], tuple]:
    """What rows are ordered by, nulls last; one column, the common case, costs the least."""
    first, *more = places
    if more:
        return lambda row: tuple([(row[i] is None, row[i]) for i in places])
    return lambda row: (row[first] is None, row[first])


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> Iterator[dict]:
    """A group's rows in order, nulls last, whatever their number: sorted runs go to files, which are merged as they are
    read. Once FAN runs are of one level, they are merged into one of the next."""
    names, key, rows, size, levels = [], None, [], 0, []

    def spill(level: int, run: Iterator[tuple], part: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append((_put(run, part), part))
        if len(levels[level]) >= FAN:
            files, levels[level] = levels[level], []
            spill(level + 1, merge(*[_get(f) for f, _ in files], key=key), min(n for _, n in files))

    for frame in frames:
        if key is None:
            names = list(frame.columns)
            key = _key([names.index(c) for c in order])
        rows += _tuples(frame)
        size += int(frame.memory_usage(index=False, deep=True).sum())
        if size >= RUN_BYTES:
            rows.sort(key=key)
            spill(0, iter(rows), max(1, len(rows) // PARTS))
            rows, size = [], 0
    rows.sort(key=key)
    runs = [_get(f) for level in reversed(levels) for f, _ in level]
    for row in merge(*runs, rows, key=key) if runs else rows:
        yield dict(zip(names, row, strict=True))


def stream_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """As ordered_fold, over a stream whose order within a key agrees with that of its micro-batches.

    A key's rows of a micro-batch are put in order by files, so memory holds its state, a run and a part of each run."""
    out = StructType.fromDDL(schema)

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = make()
        if state.exists:
            vars(fold).update(pickle.loads(state.get[0]))
        got = []
        for row in _in_order(frames, order):
            got += fold.step(row)
            if len(got) >= OUT_ROWS:
                yield pd.DataFrame(got, columns=out.names)
                got = []
        state.update((pickle.dumps(vars(fold)),))
        yield pd.DataFrame(got, columns=out.names) if got else pd.DataFrame(columns=out.names)

    return df.groupBy(*keys).applyInPandasWithState(update, out, "state binary", "append", "NoTimeout")


def windowed_counts(df: DataFrame, width: str, lateness: str, by: list[str] = ()) -> DataFrame:
    """Tumbling counts of a stream with a column ts; rows later than the watermark don't count."""
    return df.withWatermark("ts", lateness).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("count"))


def stream_pairs(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """Inner join of two streams (key, ts) whose times lie at most `within` apart, right after left."""
    a = left.withWatermark("ts", within).select(F.col("key").alias("l_key"), F.col("ts").alias("l_ts"), F.col("arrival").alias("l_arrival"))
    b = right.withWatermark("ts", within).select(F.col("key").alias("r_key"), F.col("ts").alias("r_ts"), F.col("arrival").alias("r_arrival"))
    return a.join(b, F.expr(f"l_key = r_key and r_ts >= l_ts and r_ts <= l_ts + interval {within}"))


def run_available(stream: DataFrame, what: str) -> DataFrame:
    """Run a stream over all there is, into files of the shared folder with its checkpoint beside them, and read those."""
    spark = stream.sparkSession
    path = new_dir(spark, what)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
