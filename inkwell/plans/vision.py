"""Queries on rendered glyph pictures, words on pages, and generated inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import views as V
from ..operators import boxes as B
from ..operators import generate as G
from ..operators import ink, raster
from ..operators import words as W
from ..operators.ocr import softmax
from .base import Catalogue, r6

catalogue = Catalogue()
add = catalogue.add


def _pictures(spark, sf_dir):
    """(g, content): each student glyph's ink, widened, as a PNG."""
    drawn = V.ink_glyphs(spark, sf_dir).select("g", raster.drawn_column("a").alias("d"))
    return drawn.where("d.ink > 0").select("g", "d.ink", "d.content")


@add(f"""WITH {V.SQL["ink_student"]}, d AS (SELECT i AS x FROM range(-2, 3) s(i)),
    wide AS (SELECT DISTINCT g, row + a.x AS row, col + b.x AS col FROM ink_student, d a, d b WHERE abs(b.x) <= round_even(sqrt(4 - a.x * a.x), 0))
    SELECT g, count(*)::INT AS ink, count(*)::INT AS dark FROM wide WHERE row BETWEEN 0 AND 127 AND col BETWEEN 0 AND 127 GROUP BY g""")
def image_round_trip(spark, sf_dir):
    """Pictures written as PNG and read back: the dark pixels are the ink that was drawn."""
    dark = raster.image_column(lambda img: int((img < 128).sum()), "int")
    return _pictures(spark, sf_dir).select("g", "ink", dark.alias("dark"))


@add()
def image_quality(spark, sf_dir):
    q = _pictures(spark, sf_dir).select("g", raster.quality_column().alias("q"))
    return q.select("g", r6("q.blur").alias("blur"), r6("q.contrast").alias("contrast"), r6("q.brightness").alias("brightness"), r6("q.ink_ratio").alias("ink_ratio"), r6("q.shadow").alias("shadow"), "q.is_digital", "q.is_blurry", "q.is_low_contrast", "q.is_dark", "q.has_shadow")


@add()
def image_normalized(spark, sf_dir):
    n = _pictures(spark, sf_dir).select("g", raster.normalization_column().alias("n"))
    return n.select("g", "n.source", r6("n.angle").alias("angle"), "n.w_obj", "n.h_obj", r6("n.scale_factor").alias("scale_factor"), r6("n.centroid_x").alias("centroid_x"), r6("n.centroid_y").alias("centroid_y"), "n.valid")


def _page_chars(spark, sf_dir):
    """Boxes read in order as words; each character's alternatives come from its box."""
    placed = B.words(B.lines_by_anchor(V.boxes(spark, sf_dir)), ["page_id", "line"])
    letter = lambda k: F.char(97 + F.pmod(F.col("x1") * k + F.col("y1"), F.lit(26)))
    conf = 0.5 + F.pmod(F.col("x1"), F.lit(50)) / 100.0
    top = F.array(F.struct(letter(1).alias("ch"), conf.alias("p")), F.struct(letter(3).alias("ch"), ((1 - conf) * 0.6).alias("p")), F.struct(F.char(48 + F.pmod(F.col("x1"), F.lit(10))).alias("ch"), ((1 - conf) * 0.2).alias("p")))
    return placed.select("page_id", "line", "word", F.col("ord").alias("pos"), top.alias("top"))


def _corrected(spark, sf_dir):
    found = W.gather(W.read_characters(_page_chars(spark, sf_dir)))
    lexicon = V.words(spark, sf_dir).where("n >= 5 and length(word) <= 3").select(F.col("word").alias("entry"))
    return W.correct(found, lexicon)


@add()
def page_words(spark, sf_dir):
    """Every word of every page with its correction and the method that gave it."""
    return _corrected(spark, sf_dir).select("page_id", "line", "word", "raw_word", F.col("word_text").alias("text"), "correction_method", r6("confidence").alias("confidence"))


@add()
def page_recognition(spark, sf_dir):
    p = W.page_results(_corrected(spark, sf_dir))
    return p.withColumn("avg_confidence", r6("avg_confidence"))


@add(f"""WITH t AS (SELECT i / 511.0::DOUBLE AS t FROM range(512) s(i)), names(k, name) AS (VALUES {", ".join(f"({k}, '{name}')" for k, name in enumerate(K.STROKES))}),
    unit AS (SELECT name, CASE k WHEN 0 THEN t WHEN 1 THEN 0.5 WHEN 2 THEN 1 - t WHEN 3 THEN t WHEN 4 THEN 0.5 + 0.25 * sin(2 * pi() * t) ELSE 0.5 + 0.5 * sin(2 * pi() * t) END AS r,
        CASE k WHEN 0 THEN 0.5 WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN t WHEN 4 THEN t ELSE 0.5 + 0.5 * cos(2 * pi() * t) END AS c FROM names, t),
    px AS (SELECT DISTINCT name, (16 + round(r * 95))::INT AS row, (16 + round(c * 95))::INT AS col FROM unit),
    near8 AS (SELECT a.name, a.row, a.col, count(b.row) AS n FROM px a LEFT JOIN px b ON a.name = b.name AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY ALL)
    SELECT name, count_if(n = 1) AS endpoints, count_if(n >= 3) AS junctions, count_if(n = 0) AS isolated, count(*) AS pixels, min(row) AS top, max(row) AS bottom, min(col) AS left, max(col) AS right FROM near8 GROUP BY name""")
def stroke_templates(spark, sf_dir):
    """The six generated strokes as glyphs: pixels, endpoints and box."""
    s = G.strokes(spark)
    ends = ink.endpoints_junctions(s, ["name"])
    box = ink.density_and_box(s, ["name"]).select("name", "top", "bottom", "left", "right")
    return ends.join(box, "name")


@add("""SELECT p_partkey // 10 AS canvas, count(*) AS items, sum(p_size)::BIGINT AS height FROM part GROUP BY 1""")
def canvas_items(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("canvas"), "p_size")
    return p.groupBy("canvas").agg(F.count("*").alias("items"), F.sum("p_size").alias("height"))


def _millionths(x: str) -> str:
    """SQL of a whole number of millionths as a decimal of six places."""
    return f"(({x}) // 1000000)::VARCHAR || '.' || lpad((({x}) % 1000000)::VARCHAR, 6, '0')"


@add(f"""WITH RECURSIVE items AS (SELECT (p_partkey // 10)::INT AS canvas, p_partkey::INT AS ord, (20 + p_size)::INT AS w, (30 + p_size % 7)::INT AS h, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS i FROM part),
    placed AS (SELECT canvas, ord, i, 0 AS x1, 0 AS y1, w, h, h AS high FROM items WHERE i = 1
        UNION ALL SELECT n.canvas, n.ord, n.i, CASE WHEN x1 + p.w + 8 + n.w > 320 THEN 0 ELSE x1 + p.w + 8 END, CASE WHEN x1 + p.w + 8 + n.w > 320 THEN y1 + high + 8 ELSE y1 END,
            n.w, n.h, CASE WHEN x1 + p.w + 8 + n.w > 320 THEN n.h ELSE greatest(high, n.h) END FROM placed p JOIN items n ON n.canvas = p.canvas AND n.i = p.i + 1)
    SELECT canvas, ord, x1, y1, x1 + w AS x2, y1 + h AS y2, '0 ' || {_millionths('((2 * x1 + w)::BIGINT * 3125 + 1) // 2')} || ' ' || {_millionths('((2 * y1 + h)::BIGINT * 3125 + 1) // 2')} || ' ' || {_millionths('w::BIGINT * 3125')} || ' ' || {_millionths('h::BIGINT * 3125')} AS line FROM placed""")
def canvas_layout(spark, sf_dir):
    """Parts set as crops on canvases of ten: boxes without overlap, and their label lines."""
    items = V.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).cast("int").alias("canvas"), F.col("p_partkey").cast("int").alias("ord"), (20 + F.col("p_size")).cast("int").alias("w"), (30 + F.col("p_size") % 7).cast("int").alias("h"))
    placed = G.place_rows(items, 320)
    return B.to_yolo(placed, 320, 320).select("canvas", "ord", "x1", "y1", "x2", "y2", "line")


@add("""WITH h AS (SELECT (o_custkey % 50)::INT AS run, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS epoch, (o_orderkey % 1000)::DOUBLE AS score FROM orders),
    b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
    m AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS improved FROM b) SELECT run, epoch, score, best, epoch - improved AS since, epoch - improved >= 10 AS stop FROM m""")
def early_stopping(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("int").alias("run"), F.col("o_orderkey"), (F.col("o_orderkey") % 1000).cast("double").alias("score"))
    h = o.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("o_orderkey"))).drop("o_orderkey")
    return G.early_stop(h, 10).select("run", F.col("epoch").cast("long").alias("epoch"), "score", "best", F.col("since").cast("long").alias("since"), "stop")


@add("""WITH l AS (SELECT vec_id AS img, label, i - 1 AS k, embedding[i]::DOUBLE * 30 AS logit FROM embeddings, range(1, 65) r(i)), s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY img)) AS e FROM l), p AS (SELECT img, label, k, e / sum(e) OVER (PARTITION BY img) AS p FROM s)
    SELECT img, label, round(-pow(1 - p, 2) * ln(greatest(p, 1e-12)), 6) AS loss FROM p WHERE k = label""")
def focal_loss(spark, sf_dir):
    p = V.logits(spark, sf_dir).withColumn("p", F.element_at(softmax(F.col("logits")), F.col("label") + 1))
    return p.select("img", "label", r6(G.focal_loss(F.col("p"))).alias("loss"))
