"""Small document tables with every awkward case, shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators make on the way.
EXTRA = DOCS + ", row long, size long, digest string, start long, fp long, block string, shard int"


def prose(rng, n, vocabulary=None):
    words = vocabulary or ["alpha", "beta", "gamma", "delta", "the", "of", "and", "river", "stone", "cloud", "Über", "naïve"]
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


def documents(n=60, seed=1):
    """Nulls in every column, empty, blank and very long texts, exact copies and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 90)) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(base)]
    k = n
    for text in (None, "", "   \n\t", base[0], base[0], base[3], prose(rng, 30_000), "x", "日本語 テスト 🙂", None, ""):
        rows.append((k, text, None, rng.choice(["a", None]), None))
        k += 1
    rows.append(rows[3])
    rows.append((None, "no id at all", "en", "a", None))
    rows.append((None, base[-1], "en", "b", None))
    return rows


def frame(spark, rows=None, extra=False):
    rows = documents() if rows is None else rows
    if extra:
        return spark.createDataFrame([(*r, 1, 2, "d", 3, 4, "b", 5) for r in rows], EXTRA)
    return spark.createDataFrame(rows, DOCS)


#: Names that operators use, or once used, for columns of their own.
CLASHING = ["_id", "_sha", "_sha_", "_row", "_ranges", "_kept", "_winner", "row", "rows", "parts", "doc", "sha", "copy", "shard", "slot", "place", "first", "words", "number", "fp", "fp2", "digest", "root", "class", "component_id", "p", "l", "r", "_n", "raw", "size", "start", "text_sha256", "_cell"]


def clashing(spark, rows):
    """Documents with all those columns beside their own, each with a value of its row."""
    schema = DOCS + "".join(f", `{c}` long" for c in CLASHING)
    return spark.createDataFrame([(*r, *[k * 1000 + i for k in range(len(CLASHING))]) for i, r in enumerate(rows)], schema)
