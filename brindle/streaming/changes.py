"""Running totals that are shown only when they change, with state that survives.

The totals and the value last shown are keyed state of the query, kept in its
checkpoint: a restarted query goes on from them and shows nothing twice. Rows of
a micro-batch are added up where they are read, so a busy key sends one row a
task to its state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that :func:`changed_totals` needs: set it before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
WATCHED = "total"


def partial_sums(stream: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(``keys``, ``columns``): sums of each Arrow batch by key, null where it has no value.
    No state and no shuffle; null keys are keys."""
    fields = [stream.schema[k] for k in keys]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate([(c, "sum") for c in columns])
                out = sums.select([*keys, *(f"{c}_sum" for c in columns)]).rename_columns([*keys, *columns])
                yield from out.combine_chunks().to_batches()

    return stream.select(*keys, *(stream[c].cast("double").alias(c) for c in columns)).mapInArrow(run, schema)


class ChangedTotals(StatefulProcessor):
    """State of a key: the running sums and the whole total last shown (0 before the first)."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str]) -> None:
        self.keys, self.columns = list(keys), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", T.StructType([*(T.StructField(c, T.DoubleType()) for c in self.columns), T.StructField("__shown", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (0.0,) * len(self.columns) + (0,)
        sums, shown = list(held[:-1]), held[-1]
        for frame in rows:
            sums = [a + float(frame[c].sum()) for a, c in zip(sums, self.columns, strict=True)]
        total = int(sum(sums))
        self.state.update((*sums, total))
        if total != shown:
            yield pd.DataFrame([[*key, *sums, total]], columns=[*self.keys, *self.columns, WATCHED])

    def close(self) -> None:
        pass


def changed_totals(stream: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(``keys``, ``columns``, total): a key's running totals after each batch that
    changed their whole sum; ``total`` is that sum without its fraction.

    Null values add nothing. Rows come in update mode; the session needs
    :data:`STATE_STORE`. One row a key and batch at most.
    """
    taken = {*keys, WATCHED} & {*columns} or {WATCHED} & {*keys}
    if taken:
        raise ValueError(f"columns share the names {sorted(taken)}")
    sums = partial_sums(stream, keys, columns)
    out = T.StructType([*(sums.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in columns), T.StructField(WATCHED, T.LongType())])
    return sums.groupBy(*keys).transformWithStateInPandas(ChangedTotals(keys, columns), out, "Update", "None")
