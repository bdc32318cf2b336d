"""Expressions on names, slugs and scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ocr import ACCENTED, BASES, among

# File names of characters that have no letter or digit in theirs.
SYMBOL_NAMES = {
    ".": "punto",
    ",": "coma",
    ";": "punto_coma",
    ":": "dos_puntos",
    "?": "interrogacion",
    "!": "exclamacion",
}


def safe_name(ch: Column) -> Column:
    """File name of a character: letters with their case, accents spelt out, digits marked,
    known symbols by name, others by code point."""
    names = F.create_map(*[F.lit(x) for k, v in SYMBOL_NAMES.items() for x in (k, v)])
    accent = F.concat(F.translate(F.lower(ch), K.ACCENTED_LOWER, K.BASE_LOWER), F.when(F.lower(ch) == "ü", "_dieresis").otherwise("_acute"))
    case = F.when(F.lower(ch) == ch, "_lower").otherwise("_upper")
    return (
        F.when(among(ch, ACCENTED), F.concat(accent, case))
        .when(F.lower(ch) == "ñ", F.concat(F.lit("n_tilde"), case))
        .when(ch.rlike("^[A-Za-z]$"), F.concat(F.lower(ch), case))
        .when(ch.rlike("^[0-9]$"), F.concat(F.lit("digit_"), ch))
        .otherwise(F.coalesce(F.element_at(names, ch), F.concat(F.lit("u"), F.lpad(F.lower(F.hex(F.ascii(ch))), 4, "0"))))
    )


def slug_char(slug: Column) -> Column:
    """Character that a folder's name stands for: itself, its case suffix, its accent or
    its symbol's name; null if none."""
    names = F.create_map(*[F.lit(x) for k, v in SYMBOL_NAMES.items() for x in (v, k)])
    letter = F.regexp_extract(slug, "^([a-z])_(lower|upper)$", 1)
    upper = slug.endswith("_upper")
    accent = F.regexp_extract(slug, "^([a-z])_acute_(lower|upper)$", 1)
    cased = lambda c: F.when(upper, F.upper(c)).otherwise(c)
    return F.coalesce(
        F.when(F.length(slug) == 1, slug),
        F.nullif(F.regexp_extract(slug, "^digit_([0-9])$", 1), F.lit("")),
        F.when(slug.rlike("^n_tilde_"), cased(F.lit("ñ"))),
        F.when(slug.rlike("^u_dieresis_"), cased(F.lit("ü"))),
        F.when(accent != "", cased(F.translate(accent, BASES[:5], ACCENTED[:5]))),
        F.when(letter != "", cased(letter)),
        F.element_at(names, slug),
    )


def percent_scale(score: Column) -> Column:
    """A score of 0..1 or 0..100 on the scale to 100, clamped."""
    x = F.when(score > 1, score).otherwise(score * 100)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def base_url(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def colour_band(accuracy: Column, kind: Column) -> Column:
    """high, mid or low by accuracy, with the kind of data; no data has no band."""
    level = F.when(accuracy >= 0.8, "high").when(accuracy >= 0.5, "mid").otherwise("low")
    return F.when(kind == "no_data", F.lit("none")).otherwise(F.concat_ws(":", kind, level))


def nfc(text: Column) -> Column:
    """Unicode's composed form, which Spark has no function for; in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(text)


def class_index(chars: DataFrame, classes: DataFrame, ch: str = "ch") -> DataFrame:
    """``class_idx`` of each character, as written or composed; null if it has none.

    ``classes`` (class_idx, ch) is the fixed alphabet; of equal characters the first counts.
    """
    table = classes.groupBy(F.col("ch").alias("_ch")).agg(F.min("class_idx").alias("class_idx"))
    composed = F.when(F.col(ch).rlike(r"\p{M}"), nfc(F.col(ch))).otherwise(F.col(ch))
    return chars.withColumn("_key", composed).join(F.broadcast(table), F.col("_key") == F.col("_ch"), "left").drop("_key", "_ch")


def emnist_char(label: Column) -> Column:
    """Character of a by-class label: digits, then upper, then lower case."""
    chars = K.DIGITS + K.UPPER.replace("Ñ", "") + K.LOWER.replace("ñ", "")
    return F.when(label.between(0, len(chars) - 1), F.substring(F.lit(chars), label + 1, F.lit(1)))
