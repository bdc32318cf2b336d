"""Streams of glyphs and events: the batch operators per micro-batch, and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import ink


def score_stream(glyphs: DataFrame, template: DataFrame, sink: str, checkpoint: str, level: str = "intermedio") -> StreamingQuery:
    """Fidelity of a stream of whole glyphs (g, t, a: array of pixels), stateless.

    Each micro-batch is joined to the fixed templates and appended to Parquet; the
    checkpoint makes every glyph count once.
    """
    fixed = ink.gather(template, ["t"], "p")
    joined = glyphs.join(F.broadcast(fixed), "t", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<row:int,col:int>>")))
    scored = ink.fidelity(joined, {level: K.TOLERANCE[level]}).select("g", "t", "level", "precision", "coverage", "fidelity")
    return scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Count and sum of ``value`` by tumbling window; works on batches and streams alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
