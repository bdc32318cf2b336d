"""Context-aware recognition: probabilities, expected characters, confusion rules, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

TOP = "array<struct<ch:string,p:double>>"
LETTERS = K.LOWER + K.UPPER + K.ACCENTED_LOWER + K.ACCENTED_UPPER
ACCENTED, BASES = K.ACCENTED_LOWER + K.ACCENTED_UPPER, K.BASE_LOWER + K.BASE_UPPER
TYPES = {
    "letter": LETTERS,
    "letter_lower": K.LOWER + K.ACCENTED_LOWER,
    "letter_upper": K.UPPER + K.ACCENTED_UPPER,
    "digit": K.DIGITS,
    "punct": K.PUNCTUATION,
    "letter_or_digit": LETTERS + K.DIGITS,
}


def among(x: Column, chars) -> Column:
    """Whether a character is one of ``chars``."""
    return F.coalesce(x.isin(*chars), F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit."""

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    return let(logits, lambda v: let(let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))), shares))


def scale_cosines(logits: Column, factor: float = 30.0) -> Column:
    """Raw cosines, recognised by a largest value of at most 1.5, are multiplied."""
    largest = F.array_max(F.transform(logits, F.abs))
    return F.when(largest <= 1.5, F.transform(logits, lambda x: x * factor)).otherwise(logits)


def top_k(p: Column, chars: Column, k: int) -> Column:
    """The k most probable characters with their probabilities; equals by class number."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("o"), i.alias("i"), F.element_at(chars, i + 1).alias("ch"), x.alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["ch"].alias("ch"), x["p"].alias("p")))


def probability_of(top: Column, ch: Column) -> Column:
    found = F.filter(top, lambda x: x["ch"] == ch)
    return F.coalesce(F.get(found, F.lit(0))["p"], F.lit(0.0))


def mean_arrays(arrays: list[Column]) -> Column:
    """Elementwise mean, the fold of test-time variants."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return F.transform(out, lambda x: x / len(arrays))


def type_filter(top: Column, kind: Column) -> Column:
    """Entries of the expected type, all if none is left or the type is unknown."""
    allowed = F.lit(None).cast(TOP)
    for name, chars in TYPES.items():
        allowed = F.when(kind == name, _kept(top, chars)).otherwise(allowed)
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, allowed).otherwise(top)


def _kept(top: Column, chars: str) -> Column:
    return F.filter(top, lambda x: among(x["ch"], chars))


def base_of(ch: Column) -> Column:
    """The letter without its accent; null for others."""
    return F.when(among(ch, ACCENTED), F.translate(ch, ACCENTED, BASES))


def acceptable(expected: str) -> list[str]:
    """Characters that count as the expected one: case variants, bases and accents, and
    whatever is often read instead of it."""
    out = {expected}
    if expected.isalpha():
        out |= {expected.lower(), expected.upper()}
    if expected in ACCENTED:
        out.add(BASES[ACCENTED.index(expected)])
    for accent, base in zip(ACCENTED, BASES, strict=True):
        if base == expected.lower():
            out |= {accent, accent.upper()}
    out |= {read for read, (_, meant) in K.CONFUSIONS.items() if expected in meant or expected.lower() in meant}
    return sorted(out)


def acceptable_map(chars: str) -> Column:
    return F.create_map(*[x for ch in dict.fromkeys(chars) for x in (F.lit(ch), F.array(*[F.lit(a) for a in acceptable(ch)]))])


def boost(top: Column, accepted: Column, factor: float = 3.0) -> Column:
    """Probabilities of acceptable characters times the factor, at most 1, sorted again;
    equals keep their order."""
    raised = F.transform(top, lambda x, i: F.struct((-F.when(F.array_contains(accepted, x["ch"]), F.least(x["p"] * factor, F.lit(1.0))).otherwise(x["p"])).alias("o"), i.alias("i"), x["ch"].alias("ch")))
    return F.transform(F.array_sort(raised), lambda x: F.struct(x["ch"].alias("ch"), (-x["o"]).alias("p")))


def _first(top: Column, chars: str, least: float, other: bool = False) -> Column:
    """First entry among (or not among) ``chars`` with more than the least probability."""

    def ok(x: Column) -> Column:
        hit = among(x["ch"], chars)
        return (~hit if other else hit) & (x["p"] > least)

    return F.get(F.filter(top, ok), F.lit(0))


def _meant(raw: Column, chars: str) -> Column:
    """What the confusion table offers for a character, of the given kind, in its order."""
    table = {read: [m for m in meant if m in chars] for read, (_, meant) in K.CONFUSIONS.items()}
    entries = [x for read, meant in table.items() for x in (F.lit(read), F.array(*[F.lit(m) for m in meant]) if meant else F.array().cast("array<string>"))]
    return F.element_at(F.create_map(*entries), raw)


def resolve(raw: Column, conf: Column, top: Column, context: Column) -> Column:
    """The six ordered confusion rules: struct(ch, p, method), null if none applies."""

    def result(ch: Column, p: Column, method: str, when: Column) -> Column:
        return F.when(when & ch.isNotNull(), F.struct(ch.alias("ch"), p.alias("p"), F.lit(method).alias("method")))

    in_word = context.isin("word_start", "word_middle", "word_end")
    punct = "".join(c for c in K.PUNCTUATION if c not in "'-")
    letter, digit, text = _first(top, LETTERS, 0.01), _first(top, K.DIGITS, 0.01), _first(top, K.STROKES, 0.01, other=True)
    letters, digits = _meant(raw, LETTERS), _meant(raw, K.DIGITS)
    offered = F.get(F.filter(F.transform(letters, lambda c: F.struct(c.alias("ch"), probability_of(top, c).alias("p"))), lambda x: x["p"] > 0.001), F.lit(0))
    any_meant = F.element_at(F.create_map(*[x for r, (_, m) in K.CONFUSIONS.items() for x in (F.lit(r), F.lit(m[0]))]), raw)
    base = base_of(raw)
    base_p = probability_of(top, base)
    lower = F.lower(raw)
    lower_p = probability_of(top, lower)
    upper = among(raw, K.UPPER + K.ACCENTED_UPPER)
    middle = context == "word_middle"
    rule1, rule3, rule5 = in_word & among(raw, punct), in_word & among(raw, K.DIGITS), (context == "digit_seq") & among(raw, LETTERS)
    return F.coalesce(
        result(letter["ch"], letter["p"], "punct_in_word→letter", rule1),
        result(offered["ch"], offered["p"], "confusion_table_in_word", rule1),
        result(F.coalesce(F.get(letters, F.lit(0)), any_meant), conf * 0.5, "forced_confusion_remap", rule1),
        result(base, F.least(conf + base_p, F.lit(1.0)), "accent_uncertain→base", (conf < 0.90) & (base_p > conf * 0.15)),
        result(base, conf * 0.9, "accent_in_word→base", in_word & (conf < 0.95)),
        result(letter["ch"], letter["p"], "digit_in_word→letter", rule3),
        result(F.get(letters, F.lit(0)), conf * 0.5, "digit_confusion→letter", rule3),
        result(lower, F.greatest(lower_p, conf * 0.8), "upper_in_middle→lower", middle & upper & (lower_p > conf * 0.05)),
        result(lower, conf * 0.7, "force_lower_in_middle", middle & upper),
        result(digit["ch"], digit["p"], "letter_in_digits→digit", rule5),
        result(F.get(digits, F.lit(0)), conf * 0.5, "letter_confusion→digit", rule5),
        result(text["ch"], text["p"], "stroke_in_text→char", (context != "standalone") & raw.isin(*K.STROKES)),
    )


def classify(df: DataFrame, top: str = "top", context: str = "context", kind: str = "expected_type", expected: str = "expected_char", chars: str = LETTERS + K.DIGITS + K.PUNCTUATION) -> DataFrame:
    """Adds ``result``: struct(ch, p, method) by boost, type filter, rules, then the raw reading."""
    t, c = F.col(top), F.col(context)
    raw, conf = F.get(t, F.lit(0))["ch"], F.get(t, F.lit(0))["p"]
    rows = df.withColumn("_accepted", F.element_at(acceptable_map(chars), F.col(expected)))
    rows = rows.withColumn("_work", F.when(F.col("_accepted").isNull(), t).otherwise(boost(t, F.col("_accepted")))).withColumn("_typed", type_filter(F.col("_work"), F.col(kind)))
    work, typed = F.get("_work", F.lit(0)), F.get("_typed", F.lit(0))
    make = lambda ch, p, m: F.struct(ch.alias("ch"), F.least(p, F.lit(1.0)).alias("p"), F.lit(m).alias("method"))
    by_boost = F.when(F.col(expected).isNotNull() & (work["ch"] != raw) & (probability_of(t, work["ch"]) > 0.005), make(work["ch"], work["p"], "expected_boost"))
    by_type = F.when(F.col(kind).isNotNull() & (typed["ch"] != raw), make(typed["ch"], typed["p"], "type_filter"))
    sure = F.when((conf > 0.97) & (c == "unknown"), make(raw, conf, "high_confidence"))
    return rows.withColumn("result", F.coalesce(by_boost, by_type, resolve(raw, conf, F.col("_work"), c), sure, make(raw, conf, "raw"))).drop("_accepted", "_work", "_typed")


def contexts(chars: DataFrame, keys: list[str], order: str = "pos", sentence_start: Column | None = None) -> DataFrame:
    """Positional context of each character of a word, and its neighbours."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(order)
    n, i = F.count("*").over(w), F.row_number().over(o)
    start = F.when(sentence_start, "sentence_start").otherwise("word_start") if sentence_start is not None else F.lit("word_start")
    context = F.when(n == 1, "standalone").when(i == 1, start).when(i == n, "word_end").otherwise("word_middle")
    return chars.withColumns({"context": context, "left": F.lag("ch").over(o), "right": F.lead("ch").over(o)})


def display_char(ch: Column, conf: Column, least: float = 0.05) -> Column:
    return F.when(ch.isNull() | (ch == "") | (ch == "unknown") | (conf < least), "?").otherwise(ch)


def char_type(ch: Column) -> Column:
    return (
        F.when(among(ch, ACCENTED), "accented")
        .when(among(ch, K.LOWER), "lowercase")
        .when(among(ch, K.UPPER), "uppercase")
        .when(among(ch, K.DIGITS), "digit")
        .when(among(ch, K.PUNCTUATION), "punctuation")
        .when(ch.isin(*K.STROKES), "stroke")
        .otherwise("other")
    )


def expected_type(ch: Column) -> Column:
    return F.when(among(ch, LETTERS), "letter").when(among(ch, K.DIGITS), "digit").when(among(ch, K.PUNCTUATION), "punct")


def confusion_type(true: Column, pred: Column, accents_first: bool = True) -> Column:
    """Kind of a confusion, in fixed order: accents, case, shape, other."""
    accented, bases = K.ACCENTED_LOWER + "ñ" + K.ACCENTED_UPPER + "Ñ", K.BASE_LOWER + "n" + K.BASE_UPPER + "N"
    bare = lambda c: F.when(among(c, accented), F.translate(c, accented, bases))
    to_base, to_accent = bare(true) == pred, bare(pred) == true
    order = [(to_base, "accent→base"), (to_accent, "base→accent")]
    out = F.lit(None).cast("string")
    for hit, name in order if accents_first else order[::-1]:
        out = F.coalesce(out, F.when(hit, name))
    letter = lambda c: c.rlike(r"^\p{L}$")
    case = letter(true) & letter(pred) & (F.lower(true) == F.lower(pred)) & (true != pred)
    shape = F.lit(False)
    for group in ("1lI", "0Oo", "5Ss"):
        shape = shape | (among(true, group) & among(pred, group))
    return F.coalesce(out, F.when(case, "case"), F.when(shape, "shape"), F.lit("other"))


def confusion_table(spark) -> DataFrame:
    """(ch, grp, base, alternatives) of the fixed confusions."""
    rows = [(ch, group, BASES[ACCENTED.index(ch)] if group == "accent" else None, list(meant)) for ch, (group, meant) in K.CONFUSIONS.items()]
    return spark.createDataFrame(rows, "ch string, grp string, base string, alternatives array<string>")


def variants(word: DataFrame, word_col: str = "word") -> DataFrame:
    """Every word with its one-edit variants: each letter replaced by what the confusion
    table offers for it, its accents or base, or its other case."""
    table = {}
    for ch in LETTERS + K.DIGITS:
        out = list(K.CONFUSIONS.get(ch, ("", ""))[1])
        if ch in ACCENTED:
            out.append(BASES[ACCENTED.index(ch)])
        out += [a for a, b in zip(ACCENTED, BASES, strict=True) if b == ch]
        if ch.isalpha():
            out.append(ch.swapcase())
        table[ch] = list(dict.fromkeys(x for x in out if x != ch and len(x) == 1))
    offers = F.create_map(*[x for ch, alts in table.items() for x in (F.lit(ch), F.array(*[F.lit(a) for a in alts]) if alts else F.array().cast("array<string>"))])
    w = F.col(word_col)
    rows = word.select(word_col, F.posexplode(F.split(w, "")).alias("pos", "ch")).where("ch <> ''")
    alts = rows.select(word_col, "pos", F.explode(F.element_at(offers, F.col("ch"))).alias("alt"))
    variant = F.concat(F.substring(w, F.lit(1), F.col("pos")), F.col("alt"), F.substring(w, F.col("pos") + 2, F.length(w)))
    return alts.select(word_col, variant.alias("variant")).distinct()


def dictionary_correct(words: DataFrame, lexicon: DataFrame, word_col: str = "word", entry_col: str = "entry") -> DataFrame:
    """Each word with its correction: itself if in the lexicon, else the variant in it that
    agrees in most positions, the first in order of equals; null if none."""
    known = lexicon.select(F.lower(F.col(entry_col)).alias("_e")).distinct()
    hits = variants(words, word_col).join(known, F.lower("variant") == F.col("_e"), "left_semi")
    agree = F.aggregate(F.zip_with(F.split(F.lower(word_col), ""), F.split(F.lower("variant"), ""), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    best = hits.groupBy(word_col).agg(F.min(F.struct((-agree).alias("o"), F.col("variant"))).alias("m")).select(word_col, F.col("m.variant").alias("_v"))
    own = words.join(known, F.lower(F.col(word_col)) == F.col("_e"), "left").join(best, word_col, "left")
    return own.withColumn("correction", F.when(F.col("_e").isNotNull(), F.col(word_col)).otherwise(F.col("_v"))).drop("_e", "_v")


def impossible(word: Column) -> Column:
    """Position from 0 of the first two or three letters that no word has; -1 if none."""
    hits = [F.when(F.instr(F.lower(word), s) > 0, F.instr(F.lower(word), s) - 1) for s in K.impossible_sequences()]
    return F.coalesce(F.least(*hits), F.lit(-1))
