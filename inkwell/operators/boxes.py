"""Detection boxes: filters, coordinates, overlap, suppression, reading order, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def plausible(boxes: DataFrame, width: int, height: int, confidence: float = K.CONFIDENCE, least_side: int = 5) -> DataFrame:
    """Boxes that are confident, wide and high enough, of a plausible area and aspect."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = w * h / float(width * height)
    return boxes.where((F.col("conf") >= confidence) & (w >= least_side) & (h >= least_side) & (h > 0) & area.between(*K.AREA_RATIO) & (w / h).between(*K.ASPECT_RATIO))


def clamp_to(boxes: DataFrame, width: int, height: int) -> DataFrame:
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c), F.lit(most)))
    return boxes.withColumns({"x1": at("x1", width), "x2": at("x2", width), "y1": at("y1", height), "y2": at("y2", height)})


def unletterbox(boxes: DataFrame, target: int, width: int, height: int) -> DataFrame:
    """Centre and size within a square canvas back to corners in the picture."""
    ratio = min(target / width, target / height)
    left, top = (target - width * ratio) / 2, (target - height * ratio) / 2
    corner = lambda c, s, sign, pad: ((F.col(c) + sign * F.col(s) / 2 - pad) / ratio)
    return boxes.withColumns({"x1": corner("cx", "w", -1, left), "y1": corner("cy", "h", -1, top), "x2": corner("cx", "w", 1, left), "y2": corner("cy", "h", 1, top)})


def to_yolo(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Normalised centre and size, and the label line of class 0."""
    out = boxes.withColumns(
        {
            "cx": (F.col("x1") + F.col("x2")) / 2.0 / width,
            "cy": (F.col("y1") + F.col("y2")) / 2.0 / height,
            "w": (F.col("x2") - F.col("x1")) / float(width),
            "h": (F.col("y2") - F.col("y1")) / float(height),
        }
    )
    return out.withColumn("line", F.format_string("0 %.6f %.6f %.6f %.6f", "cx", "cy", "w", "h"))


def from_yolo(labels: DataFrame, width: int, height: int) -> DataFrame:
    side = lambda c, s, sign, most: ((F.col(c) + sign * F.col(s) / 2) * most).cast("int")
    return labels.withColumns({"x1": side("cx", "w", -1, width), "y1": side("cy", "h", -1, height), "x2": side("cx", "w", 1, width), "y2": side("cy", "h", 1, height)})


def parse_labels(lines: DataFrame, line: str = "line") -> DataFrame:
    """Label lines with their five numbers and ``problem``: null, wrong_fields or non_numeric."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.withColumn("_p", parts)
    numbers = [F.expr(f"try_cast(get(_p, {i}) as double)") for i in range(5)]
    problem = F.when(F.size("_p") != 5, "wrong_fields").when(F.array_contains(F.transform("_p", lambda x: x.try_cast("double").isNull()), True), "non_numeric")
    return rows.select(*lines.columns, problem.alias("problem"), *[F.when(problem.isNull(), n).alias(c) for n, c in zip(numbers, ("cls", "cx", "cy", "w", "h"), strict=True)])


def sanitize_labels(labels: DataFrame, least: float = 0.01, edge: float = 0.001) -> DataFrame:
    """Labels of at least the least side, clipped to the inside; ``clipped`` tells which moved."""
    inside = lambda c: F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.col(c)))
    kept = labels.where((F.col("w") >= least) & (F.col("h") >= least))
    changed = F.exists(F.array("cx", "cy", "w", "h"), lambda x: (x < edge) | (x > 1 - edge))
    return kept.withColumn("clipped", changed).withColumns({c: inside(c) for c in ("cx", "cy", "w", "h")})


def intersection(a, b) -> Column:
    """Area that two boxes share; ``a`` and ``b`` give the column of a side."""
    zero = F.lit(0)
    w = F.greatest(zero, F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")))
    h = F.greatest(zero, F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")))
    return w * h


def area(a) -> Column:
    return (a("x2") - a("x1")) * (a("y2") - a("y1"))


def side_of(prefix: str):
    return lambda c: F.col(f"{prefix}.{c}")


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_pairs(a: DataFrame, b: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs of boxes ``a`` and ``b`` of the same page that overlap, with inter, union, iou."""
    on = F.col("a.page_id") == F.col("b.page_id")
    inter = intersection(side_of("a"), side_of("b"))
    joined = a.alias("a").join(b.alias("b"), (on & condition if condition is not None else on) & (inter > 0))
    union = area(side_of("a")) + area(side_of("b")) - inter
    return joined.select(F.col("a.page_id").alias("page_id"), F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), inter.alias("inter"), union.alias("union"), (inter / union).alias("iou"))


def true_positives(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Predicted boxes with an IoU of at least ``least`` with any true box of the page.

    Compared in whole numbers: intersection x 1000 against the union x 1000 least.
    """
    inter = intersection(side_of("a"), side_of("b"))
    union = area(side_of("a")) + area(side_of("b")) - inter
    on = (F.col("a.page_id") == F.col("b.page_id")) & (inter * 1000 >= union * int(least * 1000)) & (union > 0)
    return predicted.alias("a").join(truth.alias("b"), on, "left_semi")


def without_overlap(boxes: DataFrame, most: float = 0.05) -> DataFrame:
    """Boxes whose IoU with every box placed before them on the page is at most ``most``."""
    inter = intersection(side_of("a"), side_of("b"))
    union = area(side_of("a")) + area(side_of("b")) - inter
    on = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.box_id") < F.col("a.box_id")) & (inter * 1000 > union * int(most * 1000))
    return boxes.alias("a").join(boxes.alias("b"), on, "left_anti")


def _gather(boxes: DataFrame, order: list[Column], extra: list[str]) -> DataFrame:
    fields = ["box_id", "x1", "y1", "x2", "y2", *extra]
    return boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *fields))).alias("boxes"))


def suppress(boxes: DataFrame, threshold: float = K.OVERLAP, inclusive: bool = True, most: int | None = K.MAX_BOXES) -> DataFrame:
    """Greedy non-maximum suppression per page: by falling confidence (ties by box_id), a
    box stays unless a kept one overlaps it by more than the threshold.

    ``inclusive`` keeps a box whose overlap equals the threshold. Compared in whole
    numbers. A fold over each page's sorted array; a page's boxes lie in one row.
    """
    per = 1000
    limit = int(round(threshold * per))
    rows = _gather(boxes, [-F.col("conf_pm"), F.col("box_id")], ["conf_pm"])
    kind = rows.schema["boxes"].dataType.simpleString()

    def clash(k: Column, b: Column) -> Column:
        ka, ba = (lambda c: k[c]), (lambda c: b[c])
        inter = intersection(ka, ba)
        union = area(ka) + area(ba) - inter
        return inter * per > union * limit if inclusive else inter * per >= union * limit

    def step(kept: Column, b: Column) -> Column:
        free = ~F.exists(kept, lambda k: clash(k, b))
        if most:
            free = free & (F.size(kept) < most)
        return F.when(free, F.concat(kept, F.array(b))).otherwise(kept)

    kept = F.aggregate("boxes", F.array().cast(kind), step)
    out = rows.select("page_id", F.posexplode(kept).alias("rank", "b"))
    return out.select("page_id", "rank", "b.box_id", "b.x1", "b.y1", "b.x2", "b.y2", "b.conf_pm")


def best(boxes: DataFrame) -> DataFrame:
    """The most confident box of each page, the smallest box_id of equals."""
    top = F.max_by(F.struct("box_id", "x1", "y1", "x2", "y2", "conf_pm"), F.struct("conf_pm", -F.col("box_id")))
    return boxes.groupBy("page_id").agg(top.alias("b")).select("page_id", "b.*")


def lines_by_anchor(boxes: DataFrame, tolerance: float = K.ANCHOR_TOLERANCE) -> DataFrame:
    """Reading order by anchors: a box within tolerance x upper median height of the line's
    first box joins the line; boxes come by vertical centre, then box_id. Adds line, ord."""
    rows = _gather(boxes, [F.col("y1") + F.col("y2"), F.col("box_id")], [])
    heights = F.sort_array(F.transform("boxes", lambda b: b["y2"] - b["y1"]))
    rows = rows.withColumn("tol", F.element_at(heights, (F.floor(F.size("boxes") / 2) + 1).cast("int")) * (2 * tolerance))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0).cast("int").alias("anchor"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        y = b["y1"] + b["y2"]
        new = (s["line"] < 0) | (F.abs(y - s["anchor"]) > F.col("tol"))
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(line.alias("line"), F.when(new, y).otherwise(s["anchor"]).alias("anchor"), F.concat(s["out"], F.array(line)).alias("out"))

    lines = F.aggregate("boxes", start, step, lambda s: s["out"])
    out = rows.select("page_id", F.explode(F.arrays_zip(F.col("boxes").alias("b"), lines.alias("line"))).alias("z"))
    out = out.select("page_id", F.col("z.b.box_id").alias("box_id"), F.col("z.line").alias("line"), *[F.col(f"z.b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    w = Window.partitionBy("page_id").orderBy("line", "x1", "box_id")
    return out.withColumn("ord", F.row_number().over(w) - 1)


def lines_first_fit(boxes: DataFrame, ratio: float = K.LINE_TOLERANCE, least: float = K.LINE_LEAST) -> DataFrame:
    """Reading order by first fit: a box joins the first line whose mean centre is within
    max(least, ratio x median height); lines stand by their mean centre. Adds line, ord.

    Centres are kept doubled and means as sums and counts, so that all is whole numbers.
    """
    rows = _gather(boxes, [F.col("y1") + F.col("y2"), F.col("box_id")], [])
    rows = rows.join(boxes.groupBy("page_id").agg(F.percentile(F.col("y2") - F.col("y1"), 0.5).alias("median")), "page_id")
    rows = rows.withColumn("tol", 2 * F.greatest(F.lit(least), F.col("median") * ratio))
    kind = "array<struct<total:bigint,n:int>>"
    start = F.struct(F.array().cast(kind).alias("lines"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        y = (b["y1"] + b["y2"]).cast("long")
        fits = F.transform(s["lines"], lambda x: F.abs(y - x["total"] / x["n"]) <= F.col("tol"))
        at = F.array_position(fits, True)
        grown = F.transform(s["lines"], lambda x, i: F.when(i + 1 == at, F.struct((x["total"] + y).alias("total"), (x["n"] + 1).alias("n"))).otherwise(x))
        added = F.concat(s["lines"], F.array(F.struct(y.alias("total"), F.lit(1).alias("n"))))
        line = F.when(at > 0, at - 1).otherwise(F.size(s["lines"])).cast("int")
        return F.struct(F.when(at > 0, grown).otherwise(added).cast(kind).alias("lines"), F.concat(s["out"], F.array(line)).alias("out"))

    folded = rows.withColumn("s", F.aggregate("boxes", start, step))
    out = folded.select("page_id", F.explode(F.arrays_zip(F.col("boxes").alias("b"), F.col("s.out").alias("found"))).alias("z"))
    out = out.select("page_id", F.col("z.b.box_id").alias("box_id"), F.col("z.found").alias("found"), *[F.col(f"z.b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    centre = F.avg(F.col("y1") + F.col("y2")).over(Window.partitionBy("page_id", "found"))
    out = out.withColumn("centre", centre)
    out = out.withColumn("line", F.dense_rank().over(Window.partitionBy("page_id").orderBy("centre", "found")) - 1)
    w = Window.partitionBy("page_id").orderBy("line", F.col("x1") + F.col("x2"), "box_id")
    return out.withColumn("ord", F.row_number().over(w) - 1).drop("found", "centre")


def words(ordered: DataFrame, keys: list[str], gap: float = K.WORD_GAP, order: str = "ord") -> DataFrame:
    """Word number from 0 within each line: a new one after a gap of over 1.5 median widths."""
    w = Window.partitionBy(*keys).orderBy(order)
    median = F.percentile(F.col("x2") - F.col("x1"), 0.5).over(Window.partitionBy(*keys))
    # A line without its key is left out.
    rows = ordered.dropna(subset=keys).withColumn("limit", median * gap)
    rows = rows.withColumn("new", (F.col("x1") - F.lag("x2").over(w) > F.col("limit")).cast("int"))
    return rows.withColumn("word", F.coalesce(F.sum("new").over(w), F.lit(0)).cast("int")).drop("new", "limit")


def page_text(chars: DataFrame, page: str = "page_id", char: str = "ch") -> DataFrame:
    """Characters joined to words, words by spaces to lines, lines to the page's text."""
    word = chars.groupBy(page, "line", "word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", char))), lambda x: x[char]), "").alias("text"))
    line = word.groupBy(page, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"))
    return line.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("lines"))


def parse_detections(output: DataFrame, values: str = "values", candidates: int = 8400, confidence: float = K.CONFIDENCE) -> DataFrame:
    """Candidates of a detector's flat output of five rows (cx, cy, w, h, confidence), each
    of ``candidates`` values; those confident enough, numbered by box_id."""
    at = lambda k: F.element_at(values, (F.col("box_id") + 1 + k * candidates).cast("int"))
    rows = output.withColumn("box_id", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    rows = rows.withColumns({c: at(k) for k, c in enumerate(("cx", "cy", "w", "h", "conf"))})
    return rows.where(F.col("conf") >= confidence).drop(values)
