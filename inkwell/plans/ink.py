"""Ink, sequence and score queries over the derived glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import views as V
from ..operators import ink, score, sequence
from .base import Catalogue, r6

catalogue = Catalogue()

INK = V.with_sql("ink_template", "ink_student")
LEVELS = "levels(level, tol) AS (VALUES ('principiante', 8.0::DOUBLE), ('intermedio', 5.0::DOUBLE), ('avanzado', 3.0::DOUBLE))"
NEAREST = """near AS (SELECT g, a.t, a.row, a.col, min((a.row - p.row) * (a.row - p.row) + (a.col - p.col) * (a.col - p.col)) AS d2
    FROM ink_student a JOIN ink_template p ON a.t = p.t GROUP BY ALL)"""
BACK = """back AS (SELECT g, p.t, p.row, p.col, min((a.row - p.row) * (a.row - p.row) + (a.col - p.col) * (a.col - p.col)) AS d2
    FROM ink_student a JOIN ink_template p ON a.t = p.t GROUP BY ALL)"""
COVERED = """hits AS (SELECT level, a.g, p.row, p.col, max(CASE WHEN abs(a.row - p.row) <= tol AND
        abs(a.col - p.col) <= round_even(tol * sqrt(greatest(0, tol * tol - (a.row - p.row) * (a.row - p.row)) / (tol * tol)), 0) THEN 1 ELSE 0 END) AS hit
        FROM ink_student a JOIN ink_template p ON a.t = p.t CROSS JOIN levels GROUP BY ALL),
    cover AS (SELECT g, level, sum(hit)::BIGINT * 1.0::DOUBLE / count(*) AS coverage FROM hits GROUP BY g, level)"""
FIDELITY = f"""{LEVELS}, {NEAREST}, {COVERED},
    errors AS (SELECT g, level, avg(greatest(0.0, sqrt(d2) - tol)) AS mean_error FROM near CROSS JOIN levels GROUP BY g, level),
    fidelity AS (SELECT g, level, mean_error, coverage, greatest(0.0, 100.0 * (1.0 - mean_error / 12.0)) AS precision FROM errors JOIN cover USING (g, level))"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.pairs_of(V.ink_glyphs(spark, sf_dir), V.ink_template(spark, sf_dir))


@catalogue.add(f"{INK}, {FIDELITY} SELECT g, level, round(mean_error, 6) AS mean_error, round(precision, 6) AS precision, round(coverage, 6) AS coverage, round(0.65 * precision + 0.35 * coverage * 100.0, 6) AS fidelity FROM fidelity")
def ink_dt_fidelity(spark, sf_dir):
    f = ink.fidelity(glyphs(spark, sf_dir))
    return f.select("g", "level", *[r6(c).alias(c) for c in ("mean_error", "precision", "coverage", "fidelity")])


@catalogue.add(f"{INK}, {LEVELS}, {COVERED} SELECT level, round(avg(coverage), 6) AS mean_coverage, count_if(coverage = 1) AS complete, count(*) AS glyphs FROM cover GROUP BY level")
def ink_coverage(spark, sf_dir):
    f = ink.fidelity(glyphs(spark, sf_dir))
    return f.groupBy("level").agg(r6(F.avg("coverage")).alias("mean_coverage"), F.count_if(F.col("coverage") == 1).alias("complete"), F.count("*").alias("glyphs"))


@catalogue.add(f"""{INK}, {LEVELS}, {NEAREST} SELECT g, level, count_if(d2 <= tol * tol)::INT AS inside, count_if(d2 > tol * tol AND d2 <= 4 * tol * tol)::INT AS warning, count_if(d2 > 4 * tol * tol)::INT AS outside
    FROM near CROSS JOIN levels GROUP BY g, level""")
def ink_heat_zones(spark, sf_dir):
    return ink.heat_zones(glyphs(spark, sf_dir))


@catalogue.add(f"""{INK}, {NEAREST}, {BACK}, one AS (SELECT g, t, max(d2) AS there, avg(sqrt(d2)) AS m FROM near GROUP BY g, t), two AS (SELECT g, t, max(d2) AS back FROM back GROUP BY g, t)
    SELECT g, t, round(sqrt(greatest(there, back)), 6) AS hausdorff, round(greatest(0.0, 100.0 - 2.0 * greatest(0.0, sqrt(greatest(there, back)) - 5.0)), 6) AS score,
        round(greatest(0.0, 100.0 - 1.5 * sqrt(greatest(there, back))), 6) AS prototype_score, round(m, 6) AS mean_min_distance FROM one JOIN two USING (g, t)""")
def ink_hausdorff(spark, sf_dir):
    h = ink.hausdorff(glyphs(spark, sf_dir))
    return h.select("g", "t", *[r6(c).alias(c) for c in ("hausdorff", "score", "prototype_score", "mean_min_distance")])


@catalogue.add(f"""{INK}, both_ AS (SELECT a.g, a.t, count(*) AS n FROM ink_student a JOIN ink_template p USING (t, row, col) GROUP BY a.g, a.t),
    sa AS (SELECT g, t, count(*) AS n FROM ink_student GROUP BY g, t), sp AS (SELECT t, count(*) AS n FROM ink_template GROUP BY t)
    SELECT sa.g, sa.t, (sp.n - coalesce(b.n, 0))::INT AS only_p, (sa.n - coalesce(b.n, 0))::INT AS only_a, coalesce(b.n, 0)::INT AS both,
        round(coalesce(b.n, 0) * 100.0::DOUBLE / (sa.n + sp.n - coalesce(b.n, 0)), 6) AS iou FROM sa JOIN sp USING (t) LEFT JOIN both_ b ON b.g = sa.g""")
def ink_iou(spark, sf_dir):
    return ink.overlay(glyphs(spark, sf_dir)).withColumn("iou", r6("iou"))


NEIGHBOURS = """steps(dr, dc) AS (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)),
    near8 AS (SELECT a.g, a.row, a.col, count(b.g)::INT AS neighbours FROM ink_student a CROSS JOIN steps LEFT JOIN ink_student b ON b.g = a.g AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.g, a.row, a.col)"""


@catalogue.add(f"{INK}, {NEIGHBOURS} SELECT g, row, col, neighbours FROM near8")
def ink_neighbors(spark, sf_dir):
    return ink.neighbours_of(V.ink_glyphs(spark, sf_dir), ["g"])


@catalogue.add(f"{INK}, {NEIGHBOURS} SELECT g, count_if(neighbours = 1) AS endpoints, count_if(neighbours >= 3) AS junctions, count_if(neighbours = 0) AS isolated, count(*) AS pixels FROM near8 GROUP BY g")
def ink_endpoints_junctions(spark, sf_dir):
    return ink.endpoints_of(V.ink_glyphs(spark, sf_dir), ["g"])


PARTS = f"""WITH RECURSIVE {V.SQL["ink_template"]}, {V.SQL["ink_student"]}, steps(dr, dc) AS (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)),
    links AS (SELECT a.g, a.row * 128 + a.col AS x, b.row * 128 + b.col AS y FROM ink_student a CROSS JOIN steps JOIN ink_student b ON b.g = a.g AND b.row = a.row + dr AND b.col = a.col + dc),
    walk AS (SELECT g, row * 128 + col AS x, row * 128 + col AS root FROM ink_student UNION SELECT l.g, l.y, w.root FROM walk w JOIN links l ON l.g = w.g AND l.x = w.x WHERE w.root < l.y),
    roots AS (SELECT g, x, min(root) AS root FROM walk GROUP BY g, x), parts AS (SELECT g, root, count(*) AS n FROM roots GROUP BY g, root)"""


@catalogue.add(f"""{PARTS}
    SELECT g, count(*)::INT AS components, max(n)::INT AS largest, round(1.0::DOUBLE / count(*), 6) AS continuity FROM parts GROUP BY g""")
def ink_components(spark, sf_dir):
    sizes = V.ink_glyphs(spark, sf_dir).select("g", ink.components_column("a").alias("s"))
    return sizes.select("g", F.size("s").alias("components"), F.array_max("s").alias("largest"), r6(1.0 / F.size("s")).alias("continuity"))


@catalogue.add()
def ink_loops(spark, sf_dir):
    """Loops of each student glyph and whether they match the template's."""
    template = ink.gather(V.ink_template(spark, sf_dir), ["t"], "p").select("t", ink.loops_column("p").alias("template_loops"))
    student = V.ink_glyphs(spark, sf_dir).select("g", "t", ink.loops_column("a").alias("loops"))
    return student.join(template, "t").select("g", "t", "loops", "template_loops", (F.col("loops") == F.col("template_loops")).alias("same"))


@catalogue.add(f"""{INK} SELECT g, count(*) AS pixels, min(row) AS top, max(row) AS bottom, min(col) AS left, max(col) AS right, round(count(*) / 16384.0::DOUBLE, 6) AS density,
    round(count(*)::DOUBLE / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)), 6) AS fill FROM ink_student GROUP BY g""")
def ink_density_bbox(spark, sf_dir):
    d = ink.density_of(V.ink_glyphs(spark, sf_dir), ["g"])
    return d.withColumn("density", r6("density")).withColumn("fill", r6("fill"))


@catalogue.add(f"""{INK}, {NEIGHBOURS}, s AS (SELECT g, count(*) AS area, count_if(neighbours < 8) AS perimeter FROM near8 GROUP BY g)
    SELECT g, area, perimeter, round(CASE WHEN area < 4 THEN 0.0 WHEN perimeter = 0 THEN 1.0 ELSE least(1.0, 4.0 * pi() * area / (perimeter * perimeter)) END, 6) AS smoothness FROM s""")
def ink_smoothness(spark, sf_dir):
    return ink.smoothness_of(V.ink_glyphs(spark, sf_dir), ["g"]).withColumn("smoothness", r6("smoothness"))


@catalogue.add(f"""{INK}, offsets AS (SELECT dr, dc FROM range(-8, 9) a(dr), range(-8, 9) b(dc) WHERE dr <> 0 OR dc <> 0),
    free AS (SELECT a.g, a.row, a.col, dr * dr + dc * dc AS d2 FROM ink_student a CROSS JOIN offsets ANTI JOIN ink_student b ON b.g = a.g AND b.row = a.row + dr AND b.col = a.col + dc),
    depth AS (SELECT g, row, col, sqrt(min(d2)) AS d FROM free GROUP BY g, row, col)
    SELECT g, round(avg(d), 6) AS thickness_mean, round(stddev_pop(d), 6) AS thickness_std FROM depth GROUP BY g""")
def ink_thickness(spark, sf_dir):
    t = V.ink_glyphs(spark, sf_dir).select("g", ink.thickness_column("a").alias("t"))
    return t.select("g", r6(F.col("t")[0]).alias("thickness_mean"), r6(F.col("t")[1]).alias("thickness_std"))


@catalogue.add()
def ink_ssim(spark, sf_dir):
    s = glyphs(spark, sf_dir).select("g", ink.ssim_column("a", "p").alias("ssim"))
    return s.select("g", r6("ssim").alias("ssim"), r6((F.col("ssim") + 1) / 2 * 100).alias("ssim_score"))


ALIGN = """centre AS (SELECT g, t, sum(row)::DOUBLE / count(*) AS r, sum(col)::DOUBLE / count(*) AS c FROM ink_student GROUP BY g, t),
    target AS (SELECT t, sum(row)::DOUBLE / count(*) AS r, sum(col)::DOUBLE / count(*) AS c FROM ink_template GROUP BY t),
    shift AS (SELECT g, s.t, p.r - s.r AS dr, p.c - s.c AS dc FROM centre s JOIN target p ON p.t = s.t),
    moved AS (SELECT g, a.t, CASE WHEN sqrt(dr * dr + dc * dc) >= 1 THEN row + floor(dr + 0.5)::INT ELSE row END AS row, CASE WHEN sqrt(dr * dr + dc * dc) >= 1 THEN col + floor(dc + 0.5)::INT ELSE col END AS col
        FROM ink_student a JOIN shift USING (g))"""


@catalogue.add(f"{INK}, {ALIGN} SELECT g, t, count(*) AS pixels, sum(row)::BIGINT AS row_sum, sum(col)::BIGINT AS col_sum FROM moved WHERE row BETWEEN 0 AND 127 AND col BETWEEN 0 AND 127 GROUP BY g, t")
def ink_align(spark, sf_dir):
    moved = glyphs(spark, sf_dir).where(F.size("p") > 0).select("g", "t", ink.totals_column(ink.aligned_column()).alias("s"))
    return moved.select("g", "t", "s.*").where("pixels > 0")


@catalogue.add(f"""{INK}, m AS (SELECT g, count(*) AS n, sum(col)::DOUBLE AS sx, sum(row)::DOUBLE AS sy, sum(col * col)::DOUBLE AS sxx, sum(row * row)::DOUBLE AS syy, sum(col * row)::DOUBLE AS sxy FROM ink_student GROUP BY g),
    a AS (SELECT g, n, CASE WHEN n < 10 OR abs((sxx - sx * sx / n) - (syy - sy * sy / n)) < 1e-5 THEN 0.0 ELSE degrees(0.5 * atan2(2 * (sxy - sx * sy / n), (sxx - sx * sx / n) - (syy - sy * sy / n))) END AS raw FROM m)
    SELECT g, n, round(raw, 6) AS raw, round(CASE WHEN abs(raw) > 30 THEN 0.0 ELSE raw END, 6) AS angle FROM a""")
def ink_deskew_angle(spark, sf_dir):
    d = ink.deskew_of(V.ink_glyphs(spark, sf_dir), ["g"])
    return d.select("g", "n", r6("raw").alias("raw"), r6("angle").alias("angle"))


@catalogue.add(f"""WITH {V.SQL["ink_template"]}, lanes(level, r) AS (VALUES ('principiante', 3), ('intermedio', 2), ('avanzado', 1)), d AS (SELECT i AS x FROM range(-3, 4) s(i)),
    wide AS (SELECT DISTINCT level, t, row + a.x AS row, col + b.x AS col FROM ink_template, lanes, d a, d b WHERE abs(a.x) <= r AND abs(b.x) <= round_even(r * sqrt((r * r - a.x * a.x)::DOUBLE / (r * r)), 0))
    SELECT level, t, count(*) AS pixels FROM wide WHERE row BETWEEN 0 AND 127 AND col BETWEEN 0 AND 127 GROUP BY level, t""")
def ink_lanes(spark, sf_dir):
    template = V.ink_template(spark, sf_dir)
    out = None
    for level in K.LANE_KERNEL:
        part = ink.dilate(template, ["t"], level).groupBy("t").agg(F.count("*").alias("pixels")).select(F.lit(level).alias("level"), "t", "pixels")
        out = part if out is None else out.unionByName(part)
    return out


@catalogue.add(f"""{PARTS}, largest AS (SELECT g, max(n) AS most FROM parts GROUP BY g)
    SELECT g, sum(n)::BIGINT AS pixels FROM parts JOIN largest USING (g) WHERE n >= 0.3::DOUBLE * most GROUP BY g""")
def ink_fragments(spark, sf_dir):
    """Pixels left after fragments under 30 % of the largest are removed."""
    kept = V.ink_glyphs(spark, sf_dir).select("g", ink.kept_column("a").alias("a"))
    return kept.where(F.size("a") > 0).select("g", F.size("a").cast("long").alias("pixels"))


@catalogue.add()
def ink_thin_prune(spark, sf_dir):
    """Pixels of the template lanes after thinning, and after spurs are pruned."""
    lane = ink.gather(ink.dilate(V.ink_template(spark, sf_dir), ["t"], "intermedio"), ["t"], "a")
    thin = lane.select("t", F.size("a").alias("lane"), ink.thinned_column("a").alias("s"))
    return thin.select("t", "lane", F.size("s").alias("thinned"), F.size(ink.pruned_column("s")).alias("pruned"))


# Sequences -----------------------------------------------------------------------

ORDERED = """ordered AS (SELECT g, t, row, col, n, (row_number() OVER (PARTITION BY g ORDER BY atan2((n * row - sr)::DOUBLE, (n * col - sc)::DOUBLE), row, col) - 1)::INT AS ord
        FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n, sum(row) OVER (PARTITION BY g) AS sr, sum(col) OVER (PARTITION BY g) AS sc FROM ink_student)),
    ordered_p AS (SELECT t, row, col, n, (row_number() OVER (PARTITION BY t ORDER BY atan2((n * row - sr)::DOUBLE, (n * col - sc)::DOUBLE), row, col) - 1)::INT AS ord
        FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n, sum(row) OVER (PARTITION BY t) AS sr, sum(col) OVER (PARTITION BY t) AS sc FROM ink_template))"""


@catalogue.add(f"{INK}, {ORDERED} SELECT g, t, row, col, n, ord FROM ordered")
def seq_angular_order(spark, sf_dir):
    return sequence.ordered_rows(V.ink_glyphs(spark, sf_dir), ["g", "t"])


@catalogue.add(f"""{INK}, {ORDERED} SELECT o.g, i::INT AS ord, o.row, o.col FROM ordered o, range(32) r(i) WHERE i < least(n, 32) AND o.ord = CASE WHEN n <= 32 THEN i ELSE floor(i * (n - 1) / 31) END""")
def seq_subsample(spark, sf_dir):
    return sequence.subsampled_rows(V.ink_glyphs(spark, sf_dir), ["g"], 32)


def _resampled_sql(source: str, key: str, name: str) -> str:
    return f"""{name}_seg AS (SELECT {key}, ord, row::DOUBLE AS row, col::DOUBLE AS col, coalesce(lead(row) OVER w, first(row) OVER w)::DOUBLE AS row2, coalesce(lead(col) OVER w, first(col) OVER w)::DOUBLE AS col2 FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY ord)),
    {name}_len AS (SELECT *, sqrt((row2 - row) * (row2 - row) + (col2 - col) * (col2 - col)) AS step FROM {name}_seg),
    {name}_cum AS (SELECT *, sum(step) OVER (PARTITION BY {key} ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_len),
    {name}_all AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY {key} ORDER BY ord), 0.0) AS start, max(upto) OVER (PARTITION BY {key}) * 49 / 50 / 50 AS unit FROM {name}_cum),
    {name} AS (SELECT {key}, k::INT AS ord, (1 - s) * row + s * row2 AS row, (1 - s) * col + s * col2 AS col FROM (SELECT *, (k * unit - start) / (step + 1e-9) AS s FROM {name}_all, range(50) r(k) WHERE unit > 0 AND k >= ceil(start / unit) AND k <= ceil(upto / unit) - 1))"""


@catalogue.add(f"{INK}, {ORDERED}, {_resampled_sql('ordered', 'g', 'rs')} SELECT g, ord, round(row, 4) AS row, round(col, 4) AS col FROM rs")
def seq_resample(spark, sf_dir):
    s = sequence.resampled_rows(V.ink_glyphs(spark, sf_dir), ["g"])
    return s.select("g", F.col("ord").cast("int").alias("ord"), F.round("row", 4).alias("row"), F.round("col", 4).alias("col"))


PROCRUSTES = f"""{_resampled_sql('ordered', 'g', 'rs')}, {_resampled_sql('ordered_p', 't', 'rp')},
    sums AS (SELECT g, count(*) AS n, sum(a.row) AS sr, sum(a.col) AS sc, sum(p.row) AS pr, sum(p.col) AS pc, sum(a.row * a.row) + sum(a.col * a.col) AS aa, sum(p.row * p.row) + sum(p.col * p.col) AS pp,
        sum(a.row * p.row) AS m11, sum(a.row * p.col) AS m12, sum(a.col * p.row) AS m21, sum(a.col * p.col) AS m22 FROM rs a JOIN (SELECT DISTINCT g, t FROM ink_student) USING (g) JOIN rp p ON p.t = ink_student.t AND p.ord = a.ord GROUP BY g)"""


def _procrustes(spark, sf_dir) -> DataFrame:
    d = glyphs(spark, sf_dir).select("g", sequence.disparity_column().alias("disparity")).where("disparity is not null")
    return d.withColumn("score", F.greatest(F.lit(0.0), 100.0 - 50.0 * F.col("disparity")))


@catalogue.add(f"""{INK}, {ORDERED}, {PROCRUSTES.replace("ink_student.t", "gt.t").replace("(SELECT DISTINCT g, t FROM ink_student) USING", "(SELECT DISTINCT g, t FROM ink_student) gt USING")},
    cov AS (SELECT g, n, aa - (sr * sr + sc * sc) / n AS na, pp - (pr * pr + pc * pc) / n AS np, m11 - sr * pr / n AS c11, m12 - sr * pc / n AS c12, m21 - sc * pr / n AS c21, m22 - sc * pc / n AS c22 FROM sums),
    d AS (SELECT g, 1 - (c11 * c11 + c12 * c12 + c21 * c21 + c22 * c22 + 2 * abs(c11 * c22 - c12 * c21)) / (na * np) AS disparity FROM cov)
    SELECT g, round(disparity, 4) AS disparity, round(greatest(0.0, 100.0 - 50.0 * disparity), 4) AS score FROM d""")
def seq_procrustes(spark, sf_dir):
    p = _procrustes(spark, sf_dir)
    return p.select("g", F.round("disparity", 4).alias("disparity"), F.round("score", 4).alias("score"))


def _vectors_sql(source: str, key: str, name: str) -> str:
    return f"""{name}_ends AS (SELECT {key}, ord // greatest(1, n // 12) AS run, arg_min(row, ord) AS r1, arg_min(col, ord) AS c1, arg_max(row, ord) AS r2, arg_max(col, ord) AS c2 FROM {source} WHERE ord // greatest(1, n // 12) < 12 GROUP BY ALL),
    {name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY run) AS seq, (r2 - r1) / sqrt((r2 - r1) * (r2 - r1) + (c2 - c1) * (c2 - c1)) AS vr, (c2 - c1) / sqrt((r2 - r1) * (r2 - r1) + (c2 - c1) * (c2 - c1)) AS vc FROM {name}_ends WHERE r1 <> r2 OR c1 <> c2)"""


def _cosines(spark, sf_dir) -> DataFrame:
    m = glyphs(spark, sf_dir).select("g", sequence.cosine_column().alias("mean"))
    return m.select("g", F.coalesce("mean", F.lit(0.0)).alias("mean_cosine"), F.coalesce((F.col("mean") + 1) / 2 * 100, F.lit(50.0)).alias("score"))


@catalogue.add(f"""{INK}, {ORDERED}, {_vectors_sql('ordered', 'g, t', 'va')}, {_vectors_sql('ordered_p', 't', 'vp')},
    m AS (SELECT va.g, avg(greatest(-1.0, least(1.0, va.vr * vp.vr + va.vc * vp.vc))) AS mean FROM va JOIN vp USING (t, seq) GROUP BY va.g)
    SELECT g, round(coalesce(mean, 0.0), 6) AS mean_cosine, round(coalesce((mean + 1) / 2 * 100, 50.0), 6) AS score FROM (SELECT DISTINCT g FROM ink_student) LEFT JOIN m USING (g)""")
def seq_segment_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir).select("g", r6("mean_cosine").alias("mean_cosine"), r6("score").alias("score"))


def _trajectory(spark, sf_dir) -> DataFrame:
    return glyphs(spark, sf_dir).where(F.size("p") > 0).select("g", sequence.dtw_column("p", "a").alias("trajectory"))


@catalogue.add()
def seq_dtw(spark, sf_dir):
    return _trajectory(spark, sf_dir).select("g", r6("trajectory").alias("trajectory"), r6(F.greatest(F.lit(0.0), 100.0 - K.TRAJECTORY_FACTOR * F.col("trajectory"))).alias("score"))


@catalogue.add(f"{INK}, {NEAREST} SELECT g, t, round(avg(sqrt(d2)), 6) AS mean_min_distance FROM near GROUP BY g, t")
def seq_mean_min_dist(spark, sf_dir):
    return ink.hausdorff(glyphs(spark, sf_dir)).select("g", "t", r6("mean_min_distance").alias("mean_min_distance"))


# Scores --------------------------------------------------------------------------


@catalogue.add()
def score_final(spark, sf_dir):
    """All eight components and the final score of each student glyph."""
    return score.scored(glyphs(spark, sf_dir))


@catalogue.add()
def score_feedback(spark, sf_dir):
    s = score.scored(glyphs(spark, sf_dir))
    text = score.feedback(F.col("score_final"), F.col("dt_coverage"), F.col("dt_precision"), F.col("topology"), F.col("hausdorff"))
    return s.select("g", text.alias("feedback"))


SIMPLE = f"""{INK}, {FIDELITY}, {BACK}, h AS (SELECT g, greatest(there, back) AS d2 FROM (SELECT g, max(d2) AS there FROM near GROUP BY g) JOIN (SELECT g, max(d2) AS back FROM back GROUP BY g) USING (g)),
    parts AS (SELECT g, 0.65 * precision + 0.35 * coverage * 100.0 AS fid, coverage * 100.0 AS cov, greatest(0.0, 100.0 - 2.0 * greatest(0.0, sqrt(d2) - 5.0)) AS haus FROM fidelity JOIN h USING (g) WHERE level = 'intermedio'),
    simple AS (SELECT g, fid, cov, haus, (fid * 0.30 + cov * 0.20 + haus * 0.04) / 0.54 AS score FROM parts)"""


def _simple(spark, sf_dir) -> DataFrame:
    """The SQL-expressible part of the score: fidelity, coverage and Hausdorff, reweighted."""
    pairs = glyphs(spark, sf_dir)
    f = ink.fidelity(pairs, {"intermedio": K.TOLERANCE["intermedio"]})
    h = ink.hausdorff(f.select("g", "t", "a", "p", F.struct("fidelity", "coverage").alias("f")), keep=["f"])
    rows = h.select("g", F.col("f.fidelity").alias("fid"), (F.col("f.coverage") * 100.0).alias("cov"), F.col("score").alias("haus"))
    return rows.withColumn("score", (F.col("fid") * K.WEIGHTS["dt_precision"] + F.col("cov") * K.WEIGHTS["dt_coverage"] + F.col("haus") * K.WEIGHTS["hausdorff"]) / 0.54)


@catalogue.add(f"""{SIMPLE} SELECT g, round(score, 6) AS score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band,
    concat_ws(' ', CASE WHEN score >= 85 THEN '{K.FEEDBACK_GOOD}' WHEN score >= 65 THEN '{K.FEEDBACK_FAIR}' ELSE '{K.FEEDBACK_POOR}' END, CASE WHEN cov < 50 THEN '{K.FEEDBACK_COVERAGE}' END,
        CASE WHEN fid < 50 THEN '{K.FEEDBACK_PRECISION}' END, CASE WHEN haus < 40 THEN '{K.FEEDBACK_HAUSDORFF}' END) AS feedback FROM simple""")
def score_band(spark, sf_dir):
    s = _simple(spark, sf_dir)
    bands = score.band(F.col("score"), ((85, "excellent"), (70, "good"), (50, "fair"), (float("-inf"), "poor")))
    return s.select("g", r6("score").alias("score"), bands.alias("band"), score.feedback(F.col("score"), F.col("cov"), F.col("fid"), F.lit(100.0), F.col("haus")).alias("feedback"))


@catalogue.add(f"""{SIMPLE}, shown AS (SELECT g // 10 AS page, CASE WHEN g % 7 = 0 THEN 0.0 ELSE score END AS s FROM simple)
    SELECT page, count(*) AS n_detected, count_if(s > 0) AS n_evaluated, round(coalesce(avg(CASE WHEN s > 0 THEN s END), 0.0), 6) AS avg_score FROM shown GROUP BY page""")
def page_avg_score(spark, sf_dir):
    """Ten glyphs to a page; every seventh glyph has an invalid mask and scores 0."""
    s = _simple(spark, sf_dir).select(F.floor(F.col("g") / 10).cast("int").alias("page"), F.when(F.col("g") % 7 == 0, 0.0).otherwise(F.col("score")).alias("s"))
    return score.page_average(s, "page", "s").withColumn("avg_score", r6("avg_score"))


@catalogue.add(f"""{INK}, firsts AS (SELECT g // 10 AS page, min(g) AS f FROM ink_student GROUP BY g // 10), both_ AS (SELECT a.g, f, a.row, a.col, min((a.row - p.row) * (a.row - p.row) + (a.col - p.col) * (a.col - p.col)) AS d2
    FROM ink_student a JOIN firsts ON firsts.page = a.g // 10 AND a.g <> f JOIN ink_student p ON p.g = f GROUP BY ALL)
    SELECT g, f AS first_g, round(greatest(0.0, 100.0 * (1.0 - avg(greatest(0.0, sqrt(d2) - 5.0)) / 12.0)), 6) AS precision FROM both_ GROUP BY g, f""")
def page_first_glyph_template(spark, sf_dir):
    """The first glyph of each page of ten is the template of the others."""
    g = V.ink_glyphs(spark, sf_dir).select("g", "a").withColumn("page", F.floor(F.col("g") / 10)).withColumn("first_g", F.col("g"))
    heads = g.groupBy("page").agg(F.min_by(F.struct("g", "a"), "g").alias("f"))
    rows = g.join(heads, "page").where("g <> f.g").select("g", F.col("f.g").alias("first_g"), "a", F.col("f.a").alias("p"), F.lit(0).alias("t"))
    out = ink.fidelity(rows, {"intermedio": K.TOLERANCE["intermedio"]})
    return out.select("g", "first_g", r6("precision").alias("precision"))
