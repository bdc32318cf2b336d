"""Writers: metadata by split, label lines, templates by level, JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(df: DataFrame, path: str) -> None:
    """Sample metadata as Parquet, a folder for each split."""
    df.select("image_path", "label", "class_idx", "source", "split", "width", "height").write.mode("overwrite").partitionBy("split").parquet(path)


def templates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("level").parquet(path)


def label_line(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("0 %.6f %.6f %.6f %.6f", cx, cy, w, h)


def labels(df: DataFrame, path: str) -> None:
    """Label lines, partitioned by the image's stem."""
    df.select("stem", label_line(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def as_base64(content: Column) -> Column:
    return F.base64(content)
