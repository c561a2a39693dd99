"""Structured Streaming forms of the crowd metric and the emotion totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def centred_window(ts: Column, width_ms: int) -> Column:
    """The window around a multiple of the width. Unlike the batch bucket, a time
    half way between two multiples goes to the later one."""
    return F.window(ts, f"{width_ms} milliseconds", f"{width_ms} milliseconds", f"{width_ms // 2} milliseconds")


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """``ts`` as an instant: watermarks refuse zone-less timestamps."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def movement_metric(stream: DataFrame, ts: str, person: str, value: str, width_ms: int, delay: str = "1 day") -> DataFrame:
    """(start, end, metric): mean over persons of the deviation within a window.

    Two chained aggregations in append mode: a window is emitted once the
    watermark has passed it, and its state is dropped then.
    """
    timed = as_event_time(stream, ts).withWatermark(ts, delay)
    by_person = timed.groupBy(centred_window(F.col(ts), width_ms).alias("w"), person).agg(F.stddev_samp(value).alias("sd"))
    again = by_person.groupBy(F.window(F.window_time("w"), f"{width_ms} milliseconds", f"{width_ms} milliseconds", f"{width_ms // 2} milliseconds").alias("w"))
    return again.agg(F.avg("sd").alias("metric")).select("w.start", "w.end", "metric")


def recent(stream: DataFrame, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows of the last ``hours``; older ones are late and have no state."""
    return as_event_time(stream, ts).withWatermark(ts, f"{hours} hours").where(F.col(ts) >= as_of - F.make_interval(hours=F.lit(hours)))


def emotion_totals(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Running totals over the whole stream, for complete mode."""
    return stream.agg(*(F.sum(c).alias(c) for c in columns), F.sum(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))).cast("bigint").alias("total"))


def on_change(totals: DataFrame, show: Callable[[dict], None], checkpoint: str, trigger: dict | None = None, watched: str = "total") -> StreamingQuery:
    """Call ``show`` with the totals whenever ``watched`` differs from the last shown.

    Batches run one after another; the first is compared with 0. Totals are one
    row. After a restart the last shown value is compared anew.
    """
    last = {"value": 0}

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.limit(1).collect():
            if (row[watched] or 0) != last["value"]:
                last["value"] = row[watched] or 0
                show(row.asDict())

    return totals.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
