"""Streaming forms of the operators.

Maps, fitted scorers and deciders have no state and run on a stream as they are (``apply``).
Resampling and the merge of overlapping windows are event-time windows that close by
watermark. Rolling features keep the last rows of each key in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.base import Fitted, Learnable, NotFitted, Operator


def apply(stream: DataFrame, operators: list[Operator | Fitted]) -> DataFrame:
    """Stateless operators and fitted models in series."""
    for op in operators:
        if isinstance(op, Learnable):
            raise NotFitted(f"{op.op_name} has to be fitted on a table first")
        stream = op.run(stream)
    return stream


def resample(stream: DataFrame, time: str, value: str, by: list[str], every: str, late: str) -> DataFrame:
    """The last value of each interval and key, once the watermark has passed it."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, every).alias("w"), *by)
        .agg(F.max_by(value, time).alias(value), F.count("*").alias("n"))
        .select(F.col("w.start").alias("t"), *by, value, "n")
    )


def merge_overlaps(stream: DataFrame, time: str, score: str, by: list[str], late: str) -> DataFrame:
    """Mean score of a point over all windows that scored it, when no more can come."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 second").alias("w"), *by).agg(F.avg(score).alias(score), F.count("*").alias("n")).select(F.col("w.start").alias("t"), *by, score, "n")


def rolling_mean(stream: DataFrame, key: str, time: str, value: str, size: int) -> DataFrame:
    """Mean of a key's last ``size`` values at each row, from the ``size``-th on.

    The state of a key is its last ``size - 1`` values; rows of a batch are taken in order of
    ``time``, and batches in order of arrival.
    """
    key_type = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(time)
        values = np.concatenate([np.asarray(held, float), rows[value].to_numpy(float)])
        sums = np.concatenate([[0.0], np.cumsum(values)])
        at = np.arange(len(held), len(values))
        full = at + 1 >= size
        state.update((values[-(size - 1) :].tolist() if size > 1 else [],))
        out = rows[full][[time]].copy()
        out.insert(0, key, k[0])
        out[f"{value}_rolling_mean"] = (sums[at[full] + 1] - sums[at[full] + 1 - size]) / size
        yield out

    schema = f"`{key}` {key_type}, `{time}` timestamp, `{value}_rolling_mean` double"
    return stream.select(key, F.col(time).cast("timestamp").alias(time), value).groupBy(key).applyInPandasWithState(update, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, through a memory table: for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def through(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, written as Parquet below ``folder`` and read back: for results of any size."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
