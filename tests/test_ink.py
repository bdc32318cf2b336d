import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell import constants as K
from inkwell.operators import ink, score, sequence

PLUS = [(10 + d, 10) for d in range(-3, 4)] + [(10, 10 + d) for d in (-3, -2, -1, 1, 2, 3)]
RING = [(20 + r, 20 + c) for r in range(8) for c in range(8) if r in (0, 7) or c in (0, 7)]
CURVE = sorted({(24 + (i * 5) % 80, 24 + (i * i + 7) % 80) for i in range(64)})


def glyphs(spark, *pairs):
    rows = [(g, g, [list(p) for p in a], [list(p) for p in t]) for g, (a, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "g int, t int, a array<struct<row:int,col:int>>, p array<struct<row:int,col:int>>")


def pixels(spark, *shapes):
    return spark.createDataFrame([(g, g, r, c) for g, s in enumerate(shapes) for r, c in s], "g int, t int, row int, col int")


def by_level(df):
    return {r.level: r for r in df.collect()}


def test_identical_glyphs(spark):
    f = by_level(ink.fidelity(glyphs(spark, (CURVE, CURVE))))
    assert all(r.precision == 100 and r.coverage == 1 and r.fidelity == pytest.approx(100) for r in f.values())
    h = ink.hausdorff(glyphs(spark, (CURVE, CURVE))).first()
    assert (h.hausdorff, h.score) == (0, 100)
    assert ink.structural_similarity(ink.grid([{"row": r, "col": c} for r, c in CURVE]), ink.grid([{"row": r, "col": c} for r, c in CURVE])) == pytest.approx(1)


def test_empty_student_and_template(spark):
    for pair in (([], CURVE), (CURVE, []), ([], [])):
        f = by_level(ink.fidelity(glyphs(spark, pair)))
        assert all((r.precision, r.coverage, r.fidelity) == (0, 0, 0) for r in f.values())
        h = ink.hausdorff(glyphs(spark, pair)).first()
        assert (h.hausdorff, h.score) == (K.UNDEFINED, 0)
    assert sequence.banded_dtw(np.zeros((0, 2)), np.array(CURVE)) == K.UNDEFINED


def test_one_pixel_six_away(spark):
    f = by_level(ink.fidelity(glyphs(spark, ([(64, 70)], [(64, 64)]))))
    r = f["intermedio"]
    assert r.mean_error == 1 and r.precision == pytest.approx(91.666667) and r.coverage == 0 and r.fidelity == pytest.approx(59.583333)
    easy = f["principiante"]
    assert (easy.precision, easy.coverage, easy.fidelity) == (100, 1, pytest.approx(100))


def test_plus_sign(spark):
    r = ink.endpoints_junctions(pixels(spark, PLUS), ["g"]).first()
    assert (r.endpoints, r.junctions, r.pixels) == (4, 5, 13)
    g = ink.grid([{"row": r, "col": c} for r, c in PLUS])
    assert ink.component_sizes(g) == [13] and ink.loops(g) == 0


def test_ring_has_a_loop_and_components_count():
    as_grid = lambda s: ink.grid([{"row": r, "col": c} for r, c in s])
    assert ink.loops(as_grid(RING)) == 1
    assert ink.loops(as_grid(RING + [(r + 40, c) for r, c in RING])) == 2
    assert ink.component_sizes(as_grid(RING + [(100, 100), (101, 101), (90, 3)])) == [28, 2, 1]
    assert ink.component_sizes(as_grid([])) == [] and ink.loops(as_grid([])) == 0


@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=60))
@settings(max_examples=30, deadline=None)
def test_components_match_a_plain_search(points):
    todo, sizes = set(points), []
    while todo:
        edge, n = [todo.pop()], 0
        while edge:
            r, c = edge.pop()
            n += 1
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= near
            edge += near
        sizes.append(n)
    mask = np.zeros((16, 16), bool)
    for r, c in points:
        mask[r, c] = True
    assert ink.component_sizes(mask) == sorted(sizes, reverse=True)


def test_thickness_and_smoothness(spark):
    square = [(r, c) for r in range(10, 15) for c in range(10, 15)]
    d = ink.background_distance(ink.grid([{"row": r, "col": c} for r, c in square]))
    assert sorted(d.tolist()) == [1.0] * 16 + [2.0] * 8 + [3.0]
    s = ink.smoothness(pixels(spark, square, [(1, 1), (1, 2)]), ["g"]).orderBy("g").collect()
    assert (s[0].area, s[0].perimeter, s[0].smoothness) == (25, 16, pytest.approx(min(1, 4 * math.pi * 25 / 256)))
    assert s[1].smoothness == 0


def test_thinning_leaves_a_line_and_pruning_shortens():
    bar = np.zeros((40, 40), bool)
    bar[10:15, 5:30] = True
    thin = ink.thin(bar)
    assert 0 < thin.sum() < 30 and len(ink.component_sizes(thin)) == 1
    assert ink.prune_spurs(thin, 1).sum() == thin.sum() - 2


def test_ssim_matches_plain_windows():
    rng = np.random.default_rng(1)
    x, y = rng.random((20, 20)) < 0.4, rng.random((20, 20)) < 0.4
    values = []
    for i in range(14):
        for j in range(14):
            a, b = (z[i : i + 7, j : j + 7].astype(float).ravel() for z in (x, y))
            c = np.cov(a, b)
            values.append((2 * a.mean() * b.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((a.mean() ** 2 + b.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
    assert ink.structural_similarity(x, y) == pytest.approx(np.mean(values))


def test_dilation_by_ellipses():
    assert K.ellipse_half_widths(1) == [1, 0]  # a cross
    assert K.ellipse_half_widths(8)[0] == 8 and K.ellipse_half_widths(8)[6] == 5


def test_align_moves_by_the_centroids(spark):
    student = pixels(spark, [(r + 3, c - 2) for r, c in RING])
    moved = ink.align(student, pixels(spark, RING).select("t", "row", "col"))
    assert {(r.row, r.col) for r in moved.collect()} == set(RING)


def test_procrustes_ignores_place_size_and_turn(spark):
    base = sorted({(40 + int(20 * math.sin(t / 9)), 40 + int(9 * math.cos(t / 9))) for t in range(56)})
    shifted = [(r + 11, c + 5) for r, c in base]
    other = [(r, c) for r, c in CURVE]
    p = pixels(spark, base, base, base)
    a = pixels(spark, base, shifted, other)
    order = lambda d: sequence.resample(sequence.angular_order(d, ["g", "t"]), ["g", "t"])
    out = {r.g: r for r in sequence.procrustes(order(a), order(p).select("t", "ord", "row", "col"), ["g"], ["t"]).collect()}
    assert out[0].disparity == pytest.approx(0, abs=1e-9) and out[1].disparity == pytest.approx(0, abs=1e-9)
    assert out[2].disparity > 0.05 and out[2].score == pytest.approx(100 - 50 * out[2].disparity)


def test_resampling_matches_interpolation(spark):
    points = sequence.angular_order(pixels(spark, RING), ["g"])
    ordered = [(r.row, r.col) for r in points.orderBy("ord").collect()]
    got = [(r.row, r.col) for r in sequence.resample(points, ["g"]).orderBy("ord").collect()]
    curve = np.array([*ordered, ordered[0]], float)
    along = np.r_[0, np.cumsum(np.sqrt((np.diff(curve, axis=0) ** 2).sum(1)))]
    target = np.arange(50) * along[-1] * 49 / 50 / 50
    want = np.c_[np.interp(target, along, curve[:, 0]), np.interp(target, along, curve[:, 1])]
    assert np.allclose(got, want, atol=1e-6)


def plain_loops(mask):
    wide = {(r + a, c + b) for r, c in np.argwhere(mask).tolist() for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    h, w = mask.shape
    todo = {(r, c) for r in range(-1, h + 1) for c in range(-1, w + 1)} - {(r, c) for r, c in wide if 0 <= r < h and 0 <= c < w}
    found = 0
    while todo:
        edge, corner = [todo.pop()], False
        while edge:
            r, c = edge.pop()
            corner |= r in (-1, h) and c in (-1, w)
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= near
            edge += near
        found += not corner
    return found


@given(st.sets(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=70))
@settings(max_examples=60, deadline=None)
def test_loops_match_a_plain_search(points):
    mask = np.zeros((16, 16), bool)
    for r, c in points:
        mask[r, c] = True
    assert ink.loops(mask) == plain_loops(mask)


def plain_dtw(p, a, ratio=0.25):
    n, m = len(p), len(a)
    band, d = max(1, int(max(n, m) * ratio)), {}
    for i in range(n):
        for j in range(max(0, i - band), min(m, i + band + 1)):
            before = [d[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in d]
            d[i, j] = math.dist(p[i], a[j]) + (0 if i == j == 0 else min(before) if before else 1e9)
    end = d.get((n - 1, m - 1), min([v for (i, j), v in d.items() if i == n - 1 or j == m - 1], default=1e9))
    return 999.0 if end >= 1e9 else end / max(n, m)


@pytest.mark.parametrize(("n", "m"), [(1, 1), (5, 5), (20, 13), (64, 64), (3, 20), (20, 3), (64, 50)])
def test_dtw_matches_the_plain_table(n, m):
    rng = np.random.default_rng(n * 100 + m)
    p, a = rng.integers(0, 128, (6, n, 2)).astype(float), rng.integers(0, 128, (6, m, 2)).astype(float)
    assert sequence.banded_dtw_batch(p, a).tolist() == pytest.approx([plain_dtw(x, y) for x, y in zip(p, a, strict=True)])


def test_dtw_of_shifted_sequences():
    p = np.array([(i, 0) for i in range(20)])
    assert sequence.banded_dtw(p, p) == 0
    assert sequence.banded_dtw(p, p + [0, 3]) == pytest.approx(3)
    assert sequence.banded_dtw(p, p[:3]) < K.UNDEFINED


def test_weights_add_up_and_score_is_bounded(spark):
    assert sum(K.WEIGHTS.values()) == pytest.approx(1)
    one = spark.range(1)
    best = score.component_scores(*[F.lit(x) for x in (100.0, 1.0, True, 100.0, 100.0, 0.0, 0.0, 100.0)])
    worst = score.component_scores(F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(K.UNDEFINED), F.lit(K.UNDEFINED), F.lit(0.0))
    r = one.select(score.final_score(best).alias("a"), score.final_score(worst).alias("b")).first()
    assert r.a == pytest.approx(100) and r.b == pytest.approx(0.2 * 30)


@pytest.mark.parametrize(("value", "text"), [(64.99, K.FEEDBACK_POOR), (65.0, K.FEEDBACK_FAIR), (85.0, K.FEEDBACK_GOOD)])
def test_feedback_bands(spark, value, text):
    full = F.lit(100.0)
    assert spark.range(1).select(score.feedback(F.lit(value), full, full, full, full)).first()[0] == text
    poor = spark.range(1).select(score.feedback(F.lit(value), F.lit(49.0), F.lit(49.0), F.lit(30.0), F.lit(39.0))).first()[0]
    assert poor == " ".join([text, K.FEEDBACK_COVERAGE, K.FEEDBACK_PRECISION, K.FEEDBACK_TOPOLOGY, K.FEEDBACK_HAUSDORFF])


def test_page_average_ignores_zeros(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 80.0), (1, 60.0), (2, 0.0)], "page int, s double")
    out = {r.page: r for r in score.page_average(rows, "page", "s").collect()}
    assert (out[1].avg_score, out[1].n_evaluated) == (70, 2) and out[2].avg_score == 0


@given(st.sets(st.tuples(st.integers(0, 127), st.integers(0, 127)), max_size=30))
@settings(max_examples=20, deadline=None)
def test_distance_map_is_exact(points):
    mask = np.zeros((128, 128), bool)
    for r, c in points:
        mask[r, c] = True
    got = ink.distance_map(mask)
    for r, c in ((0, 0), (64, 13), (127, 127), *list(points)[:3]):
        assert got[r, c] == min(((r - a) ** 2 + (c - b) ** 2 for a, b in points), default=-1)


def test_large_and_small_glyphs_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = [[(int(r), int(c)) for r, c in np.unique(rng.integers(0, 128, (n, 2)), axis=0)] for n in (1, 40, 300)]
    df = glyphs(spark, *[(a, p) for a in some for p in some])
    run = lambda: [tuple(r) for r in ink.fidelity(df).select("g", "level", "mean_error", "coverage").orderBy("g", "level").collect()]
    plain = run()
    x, y = np.array(some[2]), np.array(some[1])
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).min(1))
    assert [r[2] for r in plain if r[:2] == (7, "intermedio")][0] == pytest.approx(np.maximum(0, d - 5).mean())
    flat = lambda s: [r * 128 + c for r, c in s]
    for a in some:
        for p in some:
            small = ink._Nearest()(flat(a), flat(p))
            monkeypatch.setattr(ink, "PAIRWISE", 0)
            assert (ink._Nearest()(flat(a), flat(p)) == small).all()
            monkeypatch.undo()
    for radius in (1, 3, 5, 8):
        wide = ink._widened(ink.grid(flat(some[1])), radius)
        half = K.ellipse_half_widths(radius)
        want = {(r, c) for r in range(128) for c in range(128) if any(abs(r - a) <= radius and abs(c - b) <= half[min(abs(r - a), radius)] for a, b in some[1])}
        assert set(map(tuple, np.argwhere(wide).tolist())) == want


def test_score_parts_match_the_sequence_operators(spark):
    """The kernel's sequences beside those that Spark computes on the thinned, moved ink."""
    rng = np.random.default_rng(8)
    inks = [[(40 + int(r), 40 + int(c)) for r, c in np.unique(rng.integers(0, 30, (n, 2)), axis=0)] for n in (60, 200, 25)]
    student = pixels(spark, *inks)
    template = spark.createDataFrame([(t, r, c) for t in range(3) for r, c in CURVE], "t int, row int, col int")
    pairs = ink.pairs(student, template)
    got = {r.g: r for r in pairs.select("g", score.glyph_metrics("a", "p").alias("m")).select("g", "m.*").collect()}
    thin = pairs.select("g", "t", F.explode(ink.thinned_column("a")).alias("q")).select("g", "t", "q.row", "q.col")
    moved = ink.align(thin, template)
    order = lambda df, keys: sequence.angular_order(df, keys)
    far = {r.g: r for r in ink.hausdorff(ink.pairs(moved, template)).collect()}
    procrustes = {r.g: r for r in sequence.procrustes(sequence.resample(order(moved, ["g", "t"]), ["g", "t"]), sequence.resample(order(template, ["t"]), ["t"]), ["g"], ["t"]).collect()}
    a, p = order(thin, ["g", "t"]), order(template, ["t"])
    cosine = {r.g: r for r in sequence.segment_cosine(a.select("g").distinct(), sequence.segment_vectors(a, ["g", "t"]), sequence.segment_vectors(p, ["t"])).collect()}
    paths = sequence.as_array(sequence.subsample(a, ["g", "t"]), ["g", "t"], "sa").join(sequence.as_array(sequence.subsample(p, ["t"]), ["t"], "sp"), "t")
    path = {r.g: r.d for r in paths.select("g", sequence.trajectory_column(F.col("sp"), F.col("sa")).alias("d")).collect()}
    assert sorted(got) == [0, 1, 2]
    for g, r in got.items():
        assert r.hausdorff == pytest.approx(far[g].hausdorff) and r.disparity == pytest.approx(procrustes[g].disparity)
        assert r.cosine == pytest.approx(cosine[g].mean_cosine) and r.trajectory == pytest.approx(path[g])
        mask = ink.thin(ink.grid([x * 128 + y for x, y in inks[g]]))
        on = ink.grid([x * 128 + y for x, y in CURVE])
        assert r.same_loops == (ink.loops(mask) == ink.loops(on)) and r.ssim == pytest.approx(ink.structural_similarity(score.centred(mask, on), on))


def test_score_of_like_and_empty_glyphs(spark):
    ring = RING
    rows = {r.g: r for r in score.scored(glyphs(spark, (ring, ring), ([], ring), (ring, []))).collect()}
    assert rows[0].score_final == 100.0 and {rows[0][k] for k in K.WEIGHTS} == {100.0}
    for g in (1, 2):
        assert (rows[g].dt_precision, rows[g].dt_coverage, rows[g].hausdorff, rows[g].trajectory, rows[g].procrustes, rows[g].cosine) == (0, 0, 0, 0, 0, 50)
