"""Exponentially weighted combination as a stream: the weights of each (zone, hour) are kept between micro-batches."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hourgrid.operators.combine import walk_weights

OUT = ("zone string, local_date date, hour int, y_true double, y_pred double, squared_loss double, weights array<double>, "
       "next_weights array<double>")


def combined(cells: DataFrame, experts: Sequence[str], eta: float | DataFrame, start: Sequence[float] | None = None) -> DataFrame:
    """``combine.ewa_with_reset`` over arriving ``cells`` (zone, local_date, hour, y_true and a column for each expert).

    Days of a (zone, hour) must arrive in order, in any cut into micro-batches, several days in one or one at a time: the state is
    the weights after the last day and that day. A cell that is no later than it (late, or sent twice) is left out.
    Cells with a missing value change nothing and are left out. ``eta`` is one rate, or a static table (zone, hour, eta).
    Null zones are a series of their own; with a table of rates they have none.
    """
    w0 = [1.0 / len(experts)] * len(experts) if start is None else [float(v) for v in start]
    rated = (cells.join(eta.select("zone", "hour", "eta"), ["zone", "hour"]) if isinstance(eta, DataFrame)
             else cells.withColumn("eta", F.lit(float(eta))))
    names = list(experts)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, weights = state.get if state.exists else (-1 << 31, w0)
        rows = pd.concat(list(batches)).dropna(subset=["local_date", "y_true", *names])
        number = (pd.to_datetime(rows["local_date"]) - pd.Timestamp(0)).dt.days
        rows = rows.assign(_day=number).query("_day > @day").drop_duplicates("_day").sort_values("_day")
        if len(rows):
            x, y = rows[names].to_numpy(float), rows["y_true"].to_numpy(float)
            w = walk_weights(x, y, float(rows["eta"].iloc[0]), np.array(weights))
            mix = (w[:-1] * x).sum(axis=1)
            state.update((int(rows["_day"].iloc[-1]), [float(v) for v in w[-1]]))
            yield pd.DataFrame({"zone": key[0], "local_date": rows["local_date"], "hour": rows["hour"], "y_true": y, "y_pred": mix,
                                "squared_loss": (mix - y) ** 2, "weights": list(w[:-1]), "next_weights": list(w[1:])})
    columns = rated.select("zone", "local_date", "hour", "y_true", "eta", *[F.col(c).cast("double").alias(c) for c in names])
    return columns.groupBy("zone", "hour").applyInPandasWithState(
        step, OUT, "day int, weights array<double>", "append", GroupStateTimeout.NoTimeout)


def write_combined(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that combines what is there now and stops; each row is written once, also when a batch is run again."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
