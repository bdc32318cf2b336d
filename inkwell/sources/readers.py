"""Readers: labels, class maps, folders of images, annotations, metadata, configurations."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.boxes import parse_labels

METADATA = "image_path string, label string, class_idx int, source string, split string, width int, height int"


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(image stem, line number, parsed label, problem) of a folder of YOLO label files."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select(stem(F.col("file")).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return parse_labels(lines)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp,avif}") -> DataFrame:
    """(path, stem, folder, length, content) of all images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("folder"), "length", "content")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def folder_class(path: Column) -> Column:
    """Class by folder: a single character, class_X or X_...; null if none fits."""
    name = folder(path)
    return F.coalesce(F.when(F.length(name) == 1, name), F.nullif(F.regexp_extract(name, r"^class_(.)$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^(.)_", 1), F.lit("")))


def paired(images_: DataFrame, labels: DataFrame) -> DataFrame:
    """Images beside the label of the same stem."""
    return images_.join(labels, "stem")


def label_or_fallback(text: Column, full_box: Column) -> Column:
    """Label file content: as read, the whole picture as a box if asked for, else empty."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.when(full_box, F.lit("0 0.500000 0.500000 1.000000 1.000000")), F.lit(""))


def decode(content: str = "content", decoders: tuple = ()) -> Column:
    """First decoder's result that isn't null; each is a function of a binary column."""
    return reduce(lambda a, b: F.coalesce(a, b), [d(F.col(content)) for d in decoders])


# Class maps ------------------------------------------------------------------------


def class_map(json: DataFrame, column: str = "json") -> DataFrame:
    """(class_idx, ch) of a class map in any of three layouts: an idx2char object, a flat
    object of numbers to characters, or a list of characters. Others give no rows."""
    nested = F.from_json(F.get_json_object(column, "$.idx2char"), "map<string,string>")
    flat = F.from_json(column, "map<string,string>")
    listed = F.from_json(column, "array<string>")
    as_map = F.coalesce(nested, F.when(F.col(column).rlike(r"^\s*\{"), flat))
    pairs = F.when(F.col(column).rlike(r"^\s*\["), F.transform(listed, lambda c, i: F.struct(i.alias("class_idx"), c.alias("ch")))).otherwise(
        F.transform(F.map_entries(F.map_filter(as_map, lambda k, v: k.try_cast("int").isNotNull())), lambda e: F.struct(e["key"].cast("int").alias("class_idx"), e["value"].alias("ch")))
    )
    return json.select(F.explode(pairs).alias("e")).select("e.class_idx", "e.ch")


def gap_filled(classes: DataFrame, n: int) -> DataFrame:
    """All n classes; one without a character is called UNK_<number>."""
    every = classes.sparkSession.range(n).select(F.col("id").cast("int").alias("class_idx"))
    return every.join(classes, "class_idx", "left").select("class_idx", F.coalesce("ch", F.concat(F.lit("UNK_"), F.col("class_idx").cast("string"))).alias("ch"))


def default_classes(spark: SparkSession) -> DataFrame:
    """Digits, upper and lower case, accented letters, punctuation and strokes, in order."""
    chars = [*K.DIGITS, *K.UPPER, *K.LOWER, *K.ACCENTED_UPPER, *K.ACCENTED_LOWER, *K.PUNCTUATION, *K.STROKES]
    return spark.createDataFrame(list(enumerate(chars)), "class_idx int, ch string")


def distinct_chars(text: Column) -> Column:
    """Distinct characters in order of their first occurrence."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def annotation_chars(json: DataFrame, column: str = "json") -> DataFrame:
    """Distinct characters of the words in {file: word} objects."""
    words = json.select(F.explode(F.map_values(F.from_json(column, "map<string,string>"))).alias("w"))
    return words.select(F.explode(distinct_chars(F.col("w"))).alias("ch")).distinct()


def matched_chars(text: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Distinct characters of all matches of a pattern's first group."""
    found = text.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("m"))
    return found.select(F.explode(distinct_chars(F.col("m"))).alias("ch")).distinct()


# Metadata, templates and configuration -------------------------------------------------


def metadata(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sample metadata; a split is pruned to its folder."""
    out = spark.read.schema(METADATA).parquet(path)
    return out.where(F.col("split") == split) if split else out


def templates(wanted: DataFrame, stored: DataFrame, default_level: str = "intermedio") -> DataFrame:
    """Template pixels of each wanted (ch, level): its own, else of the other case, else of
    the default level, else of the other case there. ``stored`` has (ch, level, pixels)."""
    t = F.broadcast(stored.select(F.col("ch").alias("_c"), F.col("level").alias("_l"), "pixels"))
    out = wanted
    swap = F.when(F.col("ch") == F.upper("ch"), F.lower("ch")).otherwise(F.upper("ch"))
    tries = [(F.col("ch"), F.col("level")), (swap, F.col("level")), (F.col("ch"), F.lit(default_level)), (swap, F.lit(default_level))]
    for i, (ch, level) in enumerate(tries):
        out = out.join(t.withColumnsRenamed({"_c": f"_c{i}", "_l": f"_l{i}", "pixels": f"_p{i}"}), (ch == F.col(f"_c{i}")) & (level == F.col(f"_l{i}")), "left")
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"_p{i}") for i in range(len(tries))]).alias("pixels"), F.coalesce(*[F.when(F.col(f"_p{i}").isNotNull(), F.lit(i)) for i in range(len(tries))]).alias("step"))


def overlay(defaults: dict[str, str], saved: Column) -> Column:
    """Defaults with a saved JSON object's entries over them; bad JSON leaves the defaults.

    ``saved`` holds text values; keys that aren't among the defaults are kept too.
    """
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    given = F.coalesce(F.from_json(saved, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)


def valid_levels(df: DataFrame, level: str = "level") -> DataFrame:
    return df.where(F.col(level).isin(*K.TOLERANCE))


def error_rows(df: DataFrame, error: Column) -> DataFrame:
    """Failed requests as rows: the error's text, status and a score of 0."""
    return df.select("*", error.alias("error"), F.when(error.isNotNull(), 500).otherwise(200).alias("status_code"))


def safe_bytes(content: Column, most: int = 5 * 1024 * 1024) -> Column:
    """Content up to the size limit, null above."""
    return F.when(F.length(content) <= most, content)


def from_base64(text: Column) -> Column:
    """Bytes of base64 text; null if it isn't valid."""
    return F.try_to_binary(text, F.lit("base64"))


# Packed image sets and reports -----------------------------------------------------------


def idx_images(files: DataFrame, size: int = 28) -> DataFrame:
    """(file, i, image): pictures of IDX files as bytes of size x size, cut in Arrow batches.

    ``files`` comes from ``binaryFile``; a file that isn't such a set gives no rows.
    """

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None or len(raw) < 16 or raw[:4] != b"\x00\x00\x08\x03":
                    continue
                n = min(int.from_bytes(raw[4:8], "big"), (len(raw) - 16) // (size * size))
                for at in range(0, n, 4096):
                    some = range(at, min(n, at + 4096))
                    images = [raw[16 + i * size * size : 16 + (i + 1) * size * size] for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(list(some), pa.int32()), pa.array(images, pa.binary())], names=["file", "i", "image"])

    return files.select("path", "content").mapInArrow(run, "file string, i int, image binary")


def idx_labels(files: DataFrame) -> DataFrame:
    """(file, i, label) of IDX label files."""
    body = F.substring("content", 9, 2**31 - 1)
    rows = files.where(F.hex(F.substring("content", 1, 4)) == "00000801").select(F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace(F.hex(body), "(..)", "$1,"), ",")).alias("i", "h"))
    return rows.where("h <> ''").select("file", "i", F.conv("h", 16, 10).cast("int").alias("label"))


def missing_classes(report: DataFrame, column: str = "json") -> DataFrame:
    """Classes that a coverage report lists as missing everywhere."""
    return report.select(F.explode(F.from_json(F.get_json_object(column, "$.global_missing"), "array<string>")).alias("ch")).distinct()
