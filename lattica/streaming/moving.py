"""Moving-window accumulators that carry on from batch to batch.

The state of a series is the last d - 1 values before the next one, absent ones taken as its
first value, and how many values it has had: the same few numbers however long it runs.  Spark
keeps it by key and version, so a batch that is replayed starts from the state it started from before,
only keys with rows in a batch are touched, and a series that has been idle for its time to live is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Kernel = Callable[[np.ndarray], np.ndarray]
"""Windows (n, d), oldest value first, to one value each."""


@dataclass(frozen=True)
class MovingStream:
    """One windowed column over arriving series.

    Rows of a series must arrive in order from batch to batch; inside a batch they are put in order.  The
    rows of one series in one batch meet in one task: the source's limits per trigger bound them.
    Null keys are a series like any other.  ``ttl`` is the idle time in milliseconds after which a series
    is forgotten; rows that come later begin it anew.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    value: str
    d: int
    name: str
    kernel: Kernel
    ttl: int | None = None

    def windowed(self, stream: DataFrame) -> DataFrame:
        """The stream's rows (keys, order, value) with the windowed column."""
        keys, order, value, d, name, kernel, ttl = list(self.keys), list(self.order), self.value, self.d, self.name, self.kernel, self.ttl
        src = stream.select(*keys, *order, stream[value].cast("double").alias(value))
        out = T.StructType([*src.schema.fields, T.StructField(name, T.DoubleType())])

        def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            rows = pd.concat(list(parts)).sort_values(order, kind="stable")
            v = rows[value].to_numpy(float)
            tail, count = state.get if state.exists else ([float(v[0])] * (d - 1), 0)
            known = np.concatenate([np.asarray(tail, float), v])
            state.update(([float(x) for x in known[len(known) - d + 1:]], int(count) + len(v)))
            if ttl is not None:
                state.setTimeoutDuration(ttl)
            yield rows.assign(**{name: kernel(np.lib.stride_tricks.sliding_window_view(known, d))})

        timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
        return src.groupBy(*keys).applyInPandasWithState(step, out, "tail array<double>, count bigint", "append", timeout)

    def start(self, stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Write to Parquet in ``out``, whose log takes every batch once; both folders are shared by all executors."""
        w = self.windowed(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        return (w.trigger(**trigger) if trigger else w).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def ring_average(keys, order, value: str, d: int, ttl: int | None = None, name: str = "ma") -> MovingStream:
    """Mean of the last d values, the missing ones taken as the first."""
    return MovingStream(tuple(keys), tuple(order), value, d, name, lambda w: w.mean(axis=1), ttl)


def ring_deviation(keys, order, value: str, d: int, ttl: int | None = None, name: str = "dev") -> MovingStream:
    return MovingStream(tuple(keys), tuple(order), value, d, name, lambda w: np.sqrt(np.abs((w * w).mean(axis=1) - w.mean(axis=1) ** 2)), ttl)


def ring_decay(keys, order, value: str, d: int, beta: float, ttl: int | None = None, name: str = "dma") -> MovingStream:
    """Mean of the last d values with weights that decay by ``beta`` a step."""
    weights = float(beta) ** np.arange(d - 1, -1, -1)
    weights /= weights.sum()
    return MovingStream(tuple(keys), tuple(order), value, d, name, lambda w: w @ weights, ttl)
