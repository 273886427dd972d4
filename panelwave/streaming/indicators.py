"""Incremental indicators: the batch kernel with an entity's state kept by Spark between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelwave.operators.recursive import RECURSIVE_COLUMNS, indicators
from panelwave.operators.sizing import ship_package, spread

#: one named field for each smoothing; a field that a stored state lacks starts anew
STATE_FIELDS = (
    "bar", "ema_8", "ema_20", "ema_21", "ema_50", "fast", "slow", "signal", "atr_14_run", "atr_14", "atr_10_run", "atr_10",
    "plus_run", "plus", "minus_run", "minus", "adx_run", "adx", "gain_run", "gain", "loss_run", "loss", "trend",
)
STATE = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in STATE_FIELDS])
OUTPUT = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in RECURSIVE_COLUMNS],
])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _advance(high: np.ndarray, low: np.ndarray, close: np.ndarray, state: dict) -> dict[str, np.ndarray]:
    start = np.zeros(len(close), bool)
    start[0] = not state
    with np.errstate(invalid="ignore"):
        return indicators(high, low, close, start, state)


class IndicatorProcessor(StatefulProcessor):
    """transformWithState processor: typed state, and an initial state from a batch run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("indicators", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = dict(zip(STATE_FIELDS, self.state.get())) if self.state.exists() else {}
        state = {c: list(v) for c, v in held.items() if v is not None}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("date")  # one entity's bars of one micro-batch
        made = _advance(*(pdf[c].to_numpy("float64") for c in ("high", "low", "close")), state)
        self.state.update(tuple([float(x) for x in state[c]] for c in STATE_FIELDS))
        yield pd.DataFrame({"entity": key[0], "date": pdf["date"].to_numpy(), **made})[OUTPUT.fieldNames()]

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        row = initial.iloc[-1]
        self.state.update(tuple([float(x) for x in row[c]] for c in STATE_FIELDS))

    def close(self) -> None:
        pass


def last_states(panel: DataFrame, order: str = "date") -> DataFrame:
    """(entity, STATE_FIELDS...) after the last row of each entity of a batch panel."""
    schema = T.StructType([panel.schema["entity"], *STATE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.string()), *[pa.array([state[c]], pa.list_(pa.float64())) for c in STATE_FIELDS]], schema.fieldNames())

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("entity")).to_pylist()
            bars = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("high", "low", "close")]
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                if last != (names[a],):
                    if last is not None:
                        yield out()
                    last, state = (names[a],), {}
                _advance(*(c[a:b] for c in bars), state)
        if last is not None:
            yield out()

    ship_package(panel.sparkSession)
    rows = panel.select("entity", order, "high", "low", "close")
    return spread(rows, "entity").sortWithinPartitions("entity", order).mapInArrow(run, schema)


def stream_indicators(bars: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """EMA, Wilder averages and supertrend of an arriving bar stream (entity, date, high, low, close).

    Bars of one entity must arrive in date order across micro-batches; inside a micro-batch they are sorted. ``initial``
    (``last_states`` of a batch panel) seeds entities that the batch has seen; it counts in a query's first run only.
    The session's state store provider must be PROVIDER.
    """
    ship_package(bars.sparkSession)
    return bars.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=IndicatorProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="none",
        initialState=None if initial is None else initial.groupBy("entity"))
