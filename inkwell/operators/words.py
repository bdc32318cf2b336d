"""Words from characters: two passes with context, dictionary and sequence correction.

Input rows are characters with their place (page_id, line, word, pos) and ``top``, the
best characters with probabilities. The first pass reads each by its position, the second
reads uncertain middles again; both are expressions on one row, so a word's characters
need not wait for one another.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import ocr as O

KEYS = ["page_id", "line", "word"]


def _expected(kind: str, first: Column, sentence: Column) -> Column:
    if kind == "digit":
        return F.lit("digit")
    if kind == "letter":
        return F.when(first & sentence, "letter_upper").when(first, "letter").otherwise("letter_lower")
    return F.lit("letter_or_digit") if kind == "mixed" else F.lit(None).cast("string")


def read_characters(chars: DataFrame, kind: str = "letter", keys: list[str] | None = None, retry_under: float = 0.7) -> DataFrame:
    """Adds ``result`` (ch, p, method) to every character after both passes."""
    keys = keys or KEYS
    whole = Window.partitionBy(*keys)
    n, i = F.count("*").over(whole), F.row_number().over(whole.orderBy("pos"))
    sentence = (F.col("line") == 0) & (F.col("word") == 0) if {"line", "word"} <= set(chars.columns) else F.lit(False)
    rows = chars.withColumns({"_n": n, "_i": i})
    start = F.when(sentence, "sentence_start").otherwise("word_start")
    context = F.when(F.col("_n") == 1, "standalone").when(F.col("_i") == 1, start).when(F.col("_i") == F.col("_n"), "word_end").otherwise("word_middle")
    rows = rows.withColumns({"context": context, "expected_type": _expected(kind, F.col("_i") == 1, sentence), "expected_char": F.lit(None).cast("string")})
    first = O.classify(rows).withColumnRenamed("result", "_first")
    again = first.withColumns({"context": F.lit("word_middle"), "expected_type": F.lit({"letter": "letter_lower", "digit": "digit"}.get(kind)).cast("string")})
    second = O.classify(again)
    middle = (F.col("_i") > 1) & (F.col("_i") < F.col("_n")) & (F.col("_first.p") < retry_under) & (F.col("result.p") > F.col("_first.p"))
    out = second.withColumn("result", F.when(middle, F.col("result")).otherwise(F.col("_first")))
    return out.select(*chars.columns, "result")


def gather(read: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per word: raw_word, confidence, chars (ch, p, alternatives), n."""
    keys = keys or KEYS
    part = F.struct("pos", F.col("result.ch").alias("ch"), F.col("result.p").alias("p"), F.slice("top", 1, 5).alias("alternatives"))
    words = read.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("chars"), F.avg("result.p").alias("confidence"))
    return words.withColumns({"raw_word": F.array_join(F.transform("chars", lambda c: c["ch"]), ""), "n": F.size("chars")})


def _replace(word: Column, at: Column, ch: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), ch, F.substring(word, at + 2, F.length(word)))


def variants(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, raw_word, variant): one letter replaced by an alternative over 0.005, its base,
    its accents or its other case; two by the three best each, in words of up to eight."""
    keys = keys or KEYS
    chars = words.select(*keys, "raw_word", "n", F.posexplode("chars").alias("i", "c"))
    ch = F.col("c.ch")
    lower = F.lower(ch)
    accents = F.create_map(*[x for base in "aeiou" for x in (F.lit(base), F.array(*[F.lit(a) for a, b in zip(K.ACCENTED_LOWER, K.BASE_LOWER, strict=True) if b == base]))])
    accented = F.coalesce(F.element_at(accents, lower), F.array().cast("array<string>"))
    cased = F.transform(accented, lambda a: F.when(ch == lower, a).otherwise(F.upper(a)))
    swapped = F.when(ch == lower, F.upper(ch)).otherwise(lower)
    likely = F.transform(F.filter("c.alternatives", lambda a: a["p"] > 0.005), lambda a: a["ch"])
    offers = F.array_distinct(F.concat(likely, F.array_compact(F.array(O.base_of(ch), F.when(O.among(ch, O.LETTERS), swapped))), cased))
    one = chars.select(*keys, "raw_word", "i", F.explode(F.filter(offers, lambda a: a != ch)).alias("a"))
    single = one.select(*keys, "raw_word", _replace(F.col("raw_word"), F.col("i"), F.col("a")).alias("variant"))
    best = F.transform(F.slice("c.alternatives", 1, 3), lambda a: a["ch"])
    short = chars.where("n <= 8").select(*keys, "raw_word", "i", F.explode(best).alias("a"))
    # A word of up to eight letters gives at most 28 x 9 pairs.
    left, right = short.alias("l"), short.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("j"), F.col("a").alias("b")).alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"l.{k}") == F.col(f"r._{k}"))
    both = left.join(right, same & (F.col("l.i") < F.col("r.j")))
    double = both.select(*[F.col(f"l.{k}") for k in keys], F.col("l.raw_word"), _replace(_replace(F.col("l.raw_word"), F.col("l.i"), F.col("l.a")), F.col("r.j"), F.col("r.b")).alias("variant"))
    return single.unionByName(double).distinct()


def _offers(ch: str, alternatives) -> list[str]:
    """What may stand in a letter's place, as in ``variants``."""
    lower = ch.lower()
    found = [a["ch"] for a in alternatives if a["p"] is not None and a["p"] > 0.005]
    found.append(BASES.get(ch))
    if ch in O.LETTERS:
        found.append(ch.upper() if ch == lower else lower)
    found += [a if ch == lower else a.upper() for a, b in zip(K.ACCENTED_LOWER, K.BASE_LOWER, strict=True) if b == lower and b in "aeiou"]
    return [a for a in found if a is not None and a != ch]


BASES = dict(zip(O.ACCENTED, O.BASES, strict=True))


def _variants_of(word: str, chars) -> set[str]:
    """``variants`` of one word."""
    put = lambda w, i, a: w[:i] + a + w[i + 1 :]
    out = {put(word, i, a) for i, c in enumerate(chars) if c["ch"] is not None for a in _offers(c["ch"], c["alternatives"])}
    if len(chars) <= 8:
        best = [[a["ch"] for a in c["alternatives"][:3] if a["ch"] is not None] for c in chars]
        for i, here in enumerate(best):
            for a in here:
                first = put(word, i, a)
                out.update(put(first, j, b) for j in range(i + 1, len(best)) for b in best[j])
    return out


def _best_entry(word: str, chars, known: set[str]) -> str | None:
    """The variant in the lexicon that agrees with the word in most places, the first of equals."""
    low = word.lower()
    hits = [v for v in _variants_of(word, chars) if v.lower() in known]
    return min(hits, key=lambda v: (-sum(a == b for a, b in zip(low, v.lower(), strict=False)), v)) if hits else None


def _fix_sequence(word: str, chars) -> str | None:
    """The word with the least certain letter of its first impossible run replaced."""
    bad = set(K.impossible_sequences())
    low = word.lower()
    runs = lambda w, i: (w[i : i + 2], w[i : i + 3] if i + 3 <= len(w) else "")
    for i in range(len(low) - 1):
        if not bad & set(runs(low, i)):
            continue
        for at in sorted((i, i + 1), key=lambda k: chars[k]["p"]):
            for alt in chars[at]["alternatives"]:
                if alt["ch"] != word[at] and alt["p"] > 0.005:
                    new = word[:at] + alt["ch"] + word[at + 1 :]
                    if not bad & set(runs(new.lower(), i)):
                        return new
    return None


def _sequence_fix(words: str, chars: str) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([_fix_sequence(w, c) if w is not None and c is not None and len(w) == len(c) else None for w, c in zip(words, chars, strict=True)], dtype=object)

    return run(words, chars)


#: Entries of a lexicon up to which it is sent to every task.
SMALL_LEXICON = 100_000


def _best_entries(words: str, chars: str, known: set[str]) -> Column:
    @F.pandas_udf("known boolean, best string")
    def run(words: pd.Series, chars: pd.Series) -> pd.DataFrame:
        found = [(w is not None and w.lower() in known, None if c is None else _best_entry(w, c, known)) for w, c in zip(words, chars, strict=True)]
        return pd.DataFrame(found, columns=["known", "best"]).astype({"best": object})

    return run(words, chars)


def _looked_up(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Words of two letters or more with ``_e``, whether they are in the lexicon (null if not),
    and ``_v``, their best variant in it. A small lexicon is looked up where the words are;
    variants are joined to a larger one."""
    known = lexicon.select(F.lower(F.col("_e")).alias("_e")).where("_e is not null").distinct()
    some = known.limit(SMALL_LEXICON + 1).collect()
    if len(some) <= SMALL_LEXICON:
        # One letter is never corrected, so its alternatives stay behind.
        long_ = F.when(F.length("raw_word") >= 2, F.col("chars"))
        rows = words.withColumn("_f", _best_entries("raw_word", long_, {r[0] for r in some}))
        return rows.withColumns({"_e": F.when(F.col("_f.known"), F.lower("raw_word")), "_v": F.col("_f.best")}).drop("_f")
    hits = variants(words.where(F.length("raw_word") >= 2), keys).join(known, F.lower("variant") == F.col("_e"), "left_semi")
    letters = lambda c: F.split(F.lower(c), "")
    agree = F.aggregate(F.zip_with(letters("raw_word"), letters("variant"), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    best = hits.groupBy(*keys).agg(F.min(F.struct((-agree).alias("o"), "variant")).alias("_m")).select(*keys, F.col("_m.variant").alias("_v"))
    return words.join(known, F.lower("raw_word") == F.col("_e"), "left").join(best, keys, "left")


def correct(words: DataFrame, lexicon: DataFrame, kind: str = "letter", keys: list[str] | None = None, entry: str = "entry") -> DataFrame:
    """Adds word, corrected and correction_method: dictionary first, then the sequence fix.

    Of the variants in the lexicon the one that agrees in most places wins, the first in
    order of equals.
    """
    keys = keys or KEYS
    rows = _looked_up(words, lexicon.select(F.col(entry).alias("_e")), keys)
    usable = (F.length("raw_word") >= 2) & F.lit(kind in ("letter", "mixed"))
    by_lexicon = F.when(usable & F.col("_e").isNull() & (F.lower("_v") != F.lower("raw_word")), F.col("_v"))
    rows = rows.withColumn("_d", by_lexicon).withColumn("_s", F.when(F.length("raw_word") >= 2, _sequence_fix("raw_word", F.when(F.length("raw_word") >= 2, F.col("chars")))))
    method = F.when(F.col("_d").isNotNull(), "dictionary").when(F.col("_s").isNotNull() & (F.col("_s") != F.col("raw_word")), "sequence_fix").otherwise("none")
    rows = rows.withColumn("correction_method", method)
    word = F.when(method == "dictionary", F.col("_d")).when(method == "sequence_fix", F.col("_s")).otherwise(F.col("raw_word"))
    return rows.withColumns({"word_text": word, "corrected": method != "none"}).drop("_e", "_v", "_d", "_s")


def page_results(words: DataFrame) -> DataFrame:
    """Per page: the text, its lines, word and character counts, and mean confidence."""
    # Dealt by page, lines and pages are both made where their words are.
    line = words.repartition("page_id").groupBy("page_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "word_text"))), lambda x: x["word_text"]), " ").alias("text"), F.count("*").alias("word_count"), F.sum("n").alias("char_count"), F.sum(F.col("confidence") * F.col("n")).alias("_c"))
    return line.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("lines"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), (F.sum("_c") / F.sum("char_count")).alias("avg_confidence"))
