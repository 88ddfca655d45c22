"""Steps over streams: those that work row by row run on a streaming DataFrame as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..diagnostics import fail
from ..operators.frame import Frame
from ..operators.steps import Context, Step


def stream_steps(stream: DataFrame, steps: list[Step], sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """`stream` after the steps; row errors fail the micro-batch. Steps that need all rows or an order are errors."""
    frame = Frame.of(stream)
    ctx = Context({n: Frame.of(d) for n, d in (sources or {}).items()}, check="lazy")
    for s in steps:
        if not s.row_wise:
            fail("QUERY_INVALID_STEP_CONFIG", f"{type(s).__name__} doesn't run on a stream: it needs all rows")
        frame = s.apply(frame, ctx)
    return frame.out()


def windowed(stream: DataFrame, time: str, every: str, late: str, keys: list[str], aggregates: dict, slide: str | None = None) -> DataFrame:
    """Tumbling (or, with `slide`, sliding) windows of event time; rows more than `late` behind are dropped."""
    from pyspark.sql import functions as F

    span = F.window(time, every, slide) if slide else F.window(time, every)
    grouped = stream.withWatermark(time, late).groupBy(span.alias("window"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)
