"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of that
family, of bounded size) names the digests that may be frequent. Their exact counts and
winners are then verified over all rows. The verified winners, at most ``heavy`` rows,
are broadcast, and the rows of those groups are settled on the map side without a
shuffle. All other digests are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty, unused


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    return docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))


def _heavy_winners(rows: DataFrame, heavy: int) -> DataFrame:
    """Digest, winner and size of each group with over 1/heavy of the rows."""
    total = rows.count()
    least = max(2, total // heavy + 1)
    # A digest with over 1/heavy of the rows can't be missed: the sketch's error is
    # 3.5 / (8 * heavy) of the rows, so its upper estimate is above the bound.
    top = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {heavy}, {8 * heavy})").alias("top"))
    names = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= least // 2).select(F.col("t.item").alias("h")).distinct()
    exact = rows.join(F.broadcast(names), F.xxhash64("digest") == F.col("h"), "left_semi")
    exact = exact.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size"))
    return exact.where(F.col("group_size") >= least)


def _winners(rows: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(heavy, other) winners of settled ``rows``: digest, winner (doc_id, row), group_size.

    ``other`` has the groups of two rows or more that aren't heavy.
    """
    hot = settle(_heavy_winners(rows, heavy))
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size"))
    return hot, groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as the empty text. Of equal
    texts the row with the largest id stays (a null id is smallest); of rows that also
    share the id exactly one stays. An empty table gives an empty result; other columns
    are not read.
    """
    rows = settle(_digests(docs, id_col, text_col))
    winners, groups = _winners(rows, heavy)
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.join(groups.where("group_size > 1"), "digest", "left").withColumns({"winner": F.coalesce("winner", F.struct("doc_id", "row")), "group_size": F.coalesce("group_size", F.lit(1))})
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("winner.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000) -> DataFrame:
    """``docs`` with one row of each text, all columns as they were.

    The row that ``exact_duplicates`` keeps stays; of rows that repeat both text and id one
    stays, whichever comes first if they differ in other columns. Rows of heavy groups other
    than the winner are removed on the map side, before their texts are shuffled. Columns
    may have any names; an empty table stays empty.
    """
    rows = settle(_digests(docs, id_col, text_col))
    winners, groups = _winners(rows, heavy)
    sha, name = unused(docs, "_sha"), unused(docs, "_winner")
    named = docs.withColumn(sha, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    hot = winners.select(F.col("digest").alias(sha), F.struct(F.col("winner.doc_id").alias("id")).alias(name))
    light = named.join(F.broadcast(hot), sha, "left").where(F.col(name).isNull() | F.col(id_col).eqNullSafe(F.col(f"{name}.id"))).select(*named.columns)
    keep = groups.select("digest", "winner.doc_id").unionByName(winners.select("digest", "winner.doc_id"))
    # Rows that repeat both text and id are told from the digests; they are rare.
    repeats = settle(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("digest").distinct())
    some = not repeats.isEmpty()
    parts = []
    if some:
        # At most ``heavy`` of them: a winner that repeats very often is reduced where it lies.
        often = F.broadcast(settle(winners.join(repeats, "digest", "left_semi")).select(F.col("digest").alias(sha)))
        parts.append(light.join(often, sha, "left_semi").dropDuplicates([sha]))
        light = light.join(often, sha, "left_anti")
    keep = settle(keep.select(F.col("digest").alias(sha + "k"), F.col("doc_id").alias(name)))
    out = light.join(keep, (F.col(sha) == F.col(sha + "k")) & F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    if some:
        again = repeats.withColumnRenamed("digest", sha)
        parts.append(out.join(again, sha, "left_semi").dropDuplicates([sha]))
        out = out.join(again, sha, "left_anti")
    for part in parts:
        out = out.unionByName(part.select(*out.columns))
    return out.select(*docs.columns)
