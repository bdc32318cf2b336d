"""Kernels over whole batches beside the plain versions, and that pixels stay in their rows."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from inkwell import constants as K
from inkwell.operators import batch, ink, sequence
from inkwell.operators import raster as R
from inkwell.operators import words as W

SF = "/root/testdata/sf0.001"


def some_masks():
    rng = np.random.default_rng(5)
    masks = [np.zeros((128, 128), bool), np.ones((128, 128), bool)]
    for share in (0.0001, 0.004, 0.05, 0.5):
        masks += [rng.random((128, 128)) < share for _ in range(3)]
    blob = np.zeros((128, 128), bool)
    blob[20:90, 30:36] = blob[50:56, 10:100] = blob[0, 0] = blob[127, 120:] = True
    return np.array([*masks, blob, blob.T])


def test_canvas_kernels_match_the_plain_ones():
    masks, others = some_masks(), some_masks()[::-1]
    p = batch.of_masks(masks)
    assert (batch.thin(masks) == [ink.thin(m) for m in masks]).all()
    assert batch.loops(masks).tolist() == [ink.loops(m) for m in masks]
    sizes, counts = batch.component_sizes(p)
    assert [s.tolist() for s in np.split(sizes, np.cumsum(counts)[:-1])] == [ink.component_sizes(m) for m in masks]
    q, d = batch.background_distances(masks[2:])
    for own, m in zip(np.split(d, q.ends[:-1]), masks[2:], strict=True):
        assert own.tolist() == ink.background_distance(m).tolist()
    assert batch.structural_similarities(masks, others).tolist() == [ink.structural_similarity(a, b) for a, b in zip(masks, others, strict=True)]


def test_pair_kernels_match_the_plain_ones(monkeypatch):
    masks, others = some_masks(), some_masks()[::-1]
    p, q = batch.of_masks(masks), batch.of_masks(others)
    flat = lambda m: np.flatnonzero(m).tolist()
    want = np.concatenate([ink._Nearest()(flat(a), flat(b)) for a, b in zip(masks, others, strict=True)])
    back = np.concatenate([ink._Nearest()(flat(b), flat(a)) for a, b in zip(masks, others, strict=True)])
    hits = [[int(ink._widened(a, r)[b].sum()) for a, b in zip(masks, others, strict=True)] for r in (1, 3, 8)]
    for most in (ink.PAIRWISE, 0):
        monkeypatch.setattr(ink, "PAIRWISE", most)
        there, here = batch.nearest(p, q, back=True)
        assert there.tolist() == want.tolist() and here.tolist() == back.tolist()
        assert batch.covered(p, q, [1, 3, 8]).tolist() == hits


def test_sequence_kernels_match_the_plain_ones():
    masks, others = some_masks()[[0, 2, 3, 5, 6, 14, 15]], some_masks()[[5, 3, 14, 6, 0, 15, 2]]
    p, q = (batch.by_angle(batch.of_masks(m)) for m in (masks, others))
    plain = [[sequence.by_angle(np.argwhere(m)) for m in side] for side in (masks, others)]
    assert np.stack([p.row, p.col], 1).tolist() == np.concatenate(plain[0]).tolist()
    left, right = batch.evenly(p), batch.evenly(q)
    short = [[sequence.evenly(x) for x in side] for side in plain]
    assert batch.banded_dtw(left, right).tolist() == [sequence.banded_dtw(a, b) for a, b in zip(*short, strict=True)]
    (u, one), (v, two) = batch.along_curves(p), batch.along_curves(q)
    for got, usable, a, b in zip(batch.disparities(u, v), one & two, *plain, strict=True):
        assert not usable and min(len(a), len(b)) < 2 or got == pytest.approx(sequence.disparity(a, b)) or min(len(a), len(b)) < 3
    for got, a, b in zip(batch.mean_cosines(p, q), *plain, strict=True):
        assert sequence.mean_cosine(a, b) is None and np.isnan(got) or got == pytest.approx(sequence.mean_cosine(a, b))


def test_dtw_of_unlike_lengths_matches_the_plain_one():
    rng = np.random.default_rng(6)
    left, right = ([rng.integers(0, 128, (n, 2)) for n in sizes] for sizes in ((1, 3, 64, 50, 7, 0, 33), (64, 3, 2, 61, 40, 5, 30)))
    points = lambda s: batch.Points(*np.concatenate(s).T, np.array([len(x) for x in s]))
    assert batch.banded_dtw(points(left), points(right)).tolist() == [sequence.banded_dtw(a, b) for a, b in zip(left, right, strict=True)]


def moves_pixels(plan: str, key: str) -> list[str]:
    """Exchanges, joins, sorts and windows that get rows made of the table's rows."""
    rows = [(len(re.match(r"[\s:+\-*()0-9]*", line)[0]), line.strip()) for line in plan.splitlines() if line.strip()]
    out = []
    for i, (depth, line) in enumerate(rows):
        if re.search(r"Exchange|Join|Sort|Window|Aggregate", line):
            below = []
            for d, other in rows[i + 1 :]:
                if d <= depth:
                    break
                below.append((d, other))
            for j, (d, other) in enumerate(below):
                if "Generate" in other:
                    scan = []
                    for e, last in below[j + 1 :]:
                        if e <= d:
                            break
                        scan.append(last)
                    if any(key in s for s in scan):
                        out.append(line[:60])
    return out


#: Query and key of the table whose rows are glyphs or images.
GATHERED = [
    ("ink_align", "p_partkey"),
    ("percentile_threshold", "s_suppkey"),
    ("seq_subsample", "p_partkey"),
    ("digital_flag", "s_suppkey"),
    ("pixel_quality", "s_suppkey"),
    ("score_feedback", "p_partkey"),
    ("score_final", "p_partkey"),
    ("seq_dtw", "p_partkey"),
    ("image_normalized", "p_partkey"),
    ("image_quality", "p_partkey"),
    ("image_round_trip", "p_partkey"),
    ("ink_smoothness", "p_partkey"),
    ("ink_endpoints_junctions", "p_partkey"),
    ("ink_neighbors", "p_partkey"),
    ("ink_ssim", "p_partkey"),
    ("ink_density_bbox", "p_partkey"),
    ("ink_deskew_angle", "p_partkey"),
    ("seq_angular_order", "p_partkey"),
    ("seq_procrustes", "p_partkey"),
    ("seq_resample", "p_partkey"),
    ("seq_segment_cosine", "p_partkey"),
    ("ink_thickness", "p_partkey"),
    ("score_band", "p_partkey"),
    ("ink_dt_fidelity", "p_partkey"),
    ("ink_components", "p_partkey"),
    ("ink_heat_zones", "p_partkey"),
]


@pytest.mark.parametrize("name, key", GATHERED)
def test_pixels_are_made_after_the_last_shuffle(spark, name, key):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert key in plan and not moves_pixels(plan, key)


@pytest.mark.parametrize("name", ["ink_align", "ink_neighbors", "ink_density_bbox", "ink_components"])
def test_odd_parts_give_the_rows_of_the_sql(spark, tmp_path, name):
    """A key that stands twice is one glyph; a part without size has no pixel with a place."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{SF}/part.parquet' LIMIT 30")
    con.execute("INSERT INTO part SELECT * REPLACE (p_size + 3 AS p_size) FROM part LIMIT 5")
    con.execute("INSERT INTO part SELECT * REPLACE (p_partkey + 1000 AS p_partkey, NULL AS p_size) FROM part LIMIT 2")
    con.execute(f"CREATE TABLE nation AS FROM '{SF}/nation.parquet'")
    for t in ("part", "nation"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    if name == "ink_components":  # a glyph without pixels has no components, and SQL no row
        want, df = [r for r in want if r[0] < 1000], df.where("g < 1000")
    norm = lambda rows: sorted(tuple((v is None, round(float(v), 5) if v is not None else 0) for v in r) for r in rows)
    assert norm(map(tuple, df.collect())) == norm(want)


def test_whiten_joins_no_pixels(spark):
    query = __spark_entry__.queries()["whiten"](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "s_suppkey" in plan and "Join" not in plan
    want = duckdb.connect()
    want.execute(f"CREATE VIEW supplier AS FROM '{SF}/supplier.parquet'")
    assert sorted(map(tuple, query.collect())) == sorted(want.execute(__spark_entry__.oracle_sql()["whiten"]).fetchall())


def test_masks_by_runs_match_a_search():
    for mask in (*some_masks(), np.random.default_rng(2).random((37, 90)) < 0.4):
        parts = ink._search(mask, batch.EIGHT)
        found = R.parts_of(mask)
        assert sorted(found.sizes[found.sizes > 0].tolist()) == sorted(map(len, parts))
        kept = np.zeros_like(mask)
        for part in parts:
            if len(part) >= 9 or len(part) == max(map(len, parts)):
                kept[tuple(np.array(part).T)] = True
        assert (R.keep_components(mask, 9, True) == kept).all()
        for degrees in (-29.5, 3.0, 17.3):
            assert (R.turned(mask, degrees) == (R.rotate(np.where(mask, 255, 0).astype(np.uint8), degrees) > 127)).all()


def test_filters_by_matrix_match_a_convolution(monkeypatch):
    img = np.random.default_rng(3).integers(0, 256, (40, 23)).astype(np.uint8)
    plain = lambda k: np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, np.pad(img.astype(float), ((len(k) // 2,) * 2, (0, 0)), mode="reflect"))
    kernel = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    want = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 1, np.pad(plain(kernel), ((0, 0), (2, 2)), mode="reflect"))
    for side in (R.MATRIX_SIDE, 0):
        monkeypatch.setattr(R, "MATRIX_SIDE", side)
        assert np.allclose(R._along(img, kernel), want)


def test_small_and_large_lexicons_give_the_same_words(spark, monkeypatch):
    """Looked up where the words are, or joined."""
    alike = {"a": "á", "o": "0", "t": "r", "n": "ñ"}
    rows = []
    for k, word in enumerate(("casa", "cosa", "tó", "a", "nino", "zzq", "Gato")):
        for i, ch in enumerate(word):
            rows.append((k, 0, 0, i, [(ch, 0.6), (alike.get(ch, "e"), 0.3), ("i", 0.004)]))
    chars = spark.createDataFrame(rows, "page_id int, line int, word int, pos int, top array<struct<ch:string,p:double>>")
    lexicon = spark.createDataFrame([("cesa",), ("ta",), ("niño",), ("gato",), ("é",), (None,)], "entry string")
    run = lambda: sorted(map(tuple, W.correct(W.gather(W.read_characters(chars)), lexicon).select("page_id", "raw_word", "word_text", "correction_method").collect()))
    small = run()
    monkeypatch.setattr(W, "SMALL_LEXICON", 0)
    assert run() == small and {r[3] for r in small} > {"dictionary"}


def test_words_and_pages_take_one_shuffle_of_boxes(spark):
    """Only the line items are dealt by page, and words once more for the pages."""
    for name, most in (("page_words", 1), ("page_recognition", 2)):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == most and "Join" not in plan
