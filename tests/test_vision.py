import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import constants as K
from inkwell.operators import generate as G
from inkwell.operators import raster as R
from inkwell.operators import words as W
from inkwell.sources import png

RNG = np.random.default_rng(4)


def letter(size=100):
    img = np.full((size, size), 240, np.uint8)
    img[20:80, 45:53] = 20
    img[40:46, 25:75] = 20
    return img


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (9, 4, 3)])
def test_png_round_trip(shape):
    img = RNG.integers(0, 256, shape).astype(np.uint8)
    assert (png.decode_image(png.encode_png(img)) == img).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    img = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    flat, rows = img.reshape(6, -1).astype(int), []
    for y in range(6):
        up = flat[y - 1] if y else np.zeros(15, int)
        left = np.r_[np.zeros(3, int), flat[y][:-3]]
        corner = np.r_[np.zeros(3, int), up[:-3]]
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, nearest][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (png.decode_image(data) == img).all()


def test_bad_bytes_give_none():
    for data in (None, b"", b"no picture", png.SIGNATURE, png.encode_png(letter())[:60]):
        assert png.decode_image(data) is None
    pgm = b"P5 # c\n3 2\n255\n" + bytes(range(6))
    assert png.decode_image(pgm).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert png.read_npy(b"x") is None


def test_thresholds_find_the_ink():
    img = letter()
    ink = img < 100
    for mask in (R.binarize_otsu(img), R.binarize_clean(img), R.binarize(img, True, contrast=90.0)):
        assert (mask == ink).all()
    assert R.binarize_adaptive(img, 31, 5)[30, 49] and not R.binarize_adaptive(img, 31, 5)[5, 5]
    assert R.binarize_sauvola(img)[30, 45] and not R.binarize_sauvola(img)[5, 5]


def test_filters_keep_a_flat_picture():
    flat = np.full((20, 30), 77, np.uint8)
    assert np.allclose(R.gaussian(flat, 7), 77) and np.allclose(R.box_mean(flat, 5), 77) and not R.laplacian(flat).any()
    assert (R.resize(flat, 7, 11) == 77).all() and (R.resize(flat, 50, 61) == 77).all()
    assert (R.divide_background(flat) == 127).all()


def test_geometry():
    assert R.letterbox(np.zeros((10, 20), np.uint8), 40).tolist()[0] == [255] * 40
    assert (R.letterbox(np.zeros((10, 20), np.uint8), 40)[10:30] == 0).all()
    t = R.prepare(letter())
    assert t.shape == (1, 3, 128, 128) and abs(int(R.denormalize(t)[64, 5, 0]) - 240) <= 1
    mask, info = R.on_canvas(letter() < 100)
    y, x = np.nonzero(mask)
    assert (info["w_obj"], info["h_obj"]) == (50, 60) and y.max() - y.min() + 1 <= 98 and abs(x.mean() - 63.5) < 4
    assert R.on_canvas(np.zeros((5, 5), bool))[1]["scale_factor"] == 0
    assert (R.rotate(letter(), 0) == letter()).all()
    assert R.hull_area(np.array([(0, 0), (0, 4), (4, 0), (4, 4), (2, 2)])) == 16


def test_cleaning():
    paper = np.repeat(letter()[..., None], 3, axis=2)
    lined = paper.copy()
    lined[60:63] = (60, 90, 230)
    assert R.has_colour_lines(lined) and not R.has_colour_lines(paper)
    gone = R.remove_colour_lines(lined)
    assert not R.has_colour_lines(gone) and abs(int(gone[61, 10, 0]) - 240) < 20
    assert R.clean_crop(lined).shape == (100, 100) and R.clean_crop(None).shape == (128, 128)
    assert R.polarity(letter()) == "dark_on_light" and R.polarity(255 - letter()) == "light_on_dark"
    assert (R.dark_on_light(255 - letter()) == letter()).all()


def test_masks():
    mask = letter() < 100
    noisy = mask.copy()
    noisy[3, 3] = noisy[90, 90] = True
    assert (R.remove_specks(noisy) == mask).all()
    assert R.mask_usable(mask) and not R.mask_garbage(mask)
    assert R.mask_garbage(np.zeros((50, 50), bool)) and R.mask_garbage(np.ones((50, 50), bool))
    dots = np.zeros((100, 100), bool)
    dots[::5, ::5] = True
    assert R.mask_garbage(dots)
    grid = mask.copy()
    grid[90] = True
    assert not R.without_ruling(grid)[90].any()
    assert (R.erode(R.dilate(mask, R.ellipse(3)), R.ellipse(3)) >= mask).all()


def test_normalization_reports_what_it_did():
    for img in (letter(), np.repeat(letter()[..., None], 3, axis=2)):
        mask, info = R.normalize_character(img)
        assert mask.shape == (128, 128) and info["valid"] and mask.any()
    assert R.normalize_character(None)[1]["source"] == "empty"
    assert not R.normalize_character(np.full((40, 40), 255, np.uint8))[1]["valid"]
    assert len(R.tta_variants(letter())) == 5


def test_effects_are_seeded():
    assert (R.apply_effects(letter(), 5) == R.apply_effects(letter(), 5)).all()
    for f in (R.shadow, R.gradient_light, R.graphite_noise, R.ink_variation, R.pencil, R.smudges):
        out = f(letter(), np.random.default_rng(1))
        assert out.shape == letter().shape and out.dtype == np.uint8
    assert R.paper(64, np.random.default_rng(2)).mean() > 180


def test_columns_survive_bad_pictures(spark):
    df = spark.createDataFrame([(1, bytearray(png.encode_png(letter()))), (2, bytearray(b"junk")), (3, None)], "id int, content binary")
    out = {r.id: r for r in df.select("id", R.quality_column().alias("q"), R.normalization_column().alias("n"), R.cleaned_column().alias("c"), R.mask_column().alias("m")).collect()}
    assert out[1].n.valid and out[1].c and out[1].m and out[1].q.contrast > 0
    for i in (2, 3):
        assert out[i].c is None and out[i].m is None and out[i].q.contrast is None and out[i].n.valid is None


def test_a_picture_that_fails_is_null(spark):
    def fails(img):
        raise ValueError("unfit")

    df = spark.createDataFrame([(1, bytearray(png.encode_png(letter())))], "id int, content binary")
    row = df.select(R.image_column(fails, "int").alias("a"), R.struct_column(fails, "x int, y int").alias("b")).first()
    assert row.a is None and row.b.x is None and row.b.y is None


def test_ruling_and_tilt():
    mask = np.zeros((160, 160), bool)
    mask[40, 10:150] = mask[60:70, 20:39] = True
    out = R.without_ruling(mask)
    assert not out[40].any() and (out[60:70] == mask[60:70]).all()
    runs = R._runs(mask)
    assert (runs[40, 10:150] == 140).all() and (runs[65, 20:39] == 19).all() and runs.sum() == 140 * 140 + 10 * 19 * 19
    y, x = np.mgrid[0:160, 0:160]
    bar = (abs((y - 80) - np.tan(np.radians(12)) * (x - 80)) < 4) & (abs(x - 80) < 60)
    assert R.tilt(bar) == pytest.approx(12, abs=0.5) and abs(R.tilt(R.upright(bar)[0])) < 1.5
    assert R.tilt(np.eye(160, dtype=bool)) == 0.0 and R.tilt(np.zeros((9, 9), bool)) == 0.0


def test_mask_faults_are_named():
    dots = np.zeros((100, 100), bool)
    dots[::5, ::5] = True
    assert R.mask_faults(dots) == {"scattered"} and R.mask_faults(np.ones((9, 9), bool)) == {"flooded"}
    assert R.mask_faults(np.zeros((9, 9), bool)) == {"empty"} == R.mask_faults(None)
    speck = np.zeros((100, 100), bool)
    speck[3, 3] = True
    assert R.mask_faults(speck) == {"faint"}


def test_words_are_read_and_corrected(spark):
    def char(word, pos, *top):
        return (1, 0, word, pos, list(top))

    rows = [
        char(0, 0, ("E", 0.9), ("e", 0.05)),
        char(0, 1, ("I", 0.6), ("l", 0.3)),
        char(1, 0, ("c", 0.9), ("e", 0.05)),
        char(1, 1, ("4", 0.5), ("a", 0.4)),
        char(1, 2, ("s", 0.9), ("5", 0.05)),
        char(1, 3, ("o", 0.5), ("a", 0.4)),
        char(2, 0, ("z", 0.9), ("2", 0.05)),
        char(2, 1, ("z", 0.6), ("a", 0.3)),
    ]
    chars = spark.createDataFrame(rows, "page_id int, line int, word int, pos int, top array<struct<ch:string,p:double>>")
    lexicon = spark.createDataFrame([("el",), ("casa",)], "entry string")
    found = W.correct(W.gather(W.read_characters(chars)), lexicon)
    got = {r.word: (r.word_text.lower(), r.correction_method) for r in found.collect()}
    assert got[0][0] == "el" and got[1] == ("casa", "dictionary")
    assert got[2] == ("za", "sequence_fix")
    page = W.page_results(found).first()
    assert page.text.lower() == "el casa za" and (page.lines, page.words, page.chars) == (1, 3, 8)


def test_generated_inputs(spark):
    s = G.strokes(spark)
    assert {r.name for r in s.select("name").distinct().collect()} == set(K.STROKES)
    assert s.where("row < 0 or row > 127 or col < 0 or col > 127").count() == 0
    counts = {r["layout"]: r["count"] for r in G.layouts(spark, 5000, {"a": 3, "b": 1}).groupBy("layout").count().collect()}
    assert counts["a"] == pytest.approx(3750, abs=150) and sum(counts.values()) == 5000
    items = spark.createDataFrame([(1, i, 30 + i % 5, 20 + i % 3) for i in range(30)], "canvas int, ord int, w int, h int")
    placed = G.place_rows(items, 200).collect()
    assert len(placed) == 30 and all(p.x2 <= 200 for p in placed)
    clash = [(a, b) for a in placed for b in placed if a.ord < b.ord and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2]
    assert not clash
    h = spark.createDataFrame([(1, e, s) for e, s in enumerate([0.1, 0.5, 0.4, 0.5, 0.6, 0.2, 0.3])], "run int, epoch int, score double")
    assert [r.since for r in G.early_stop(h, 2).orderBy("epoch").collect()] == [0, 0, 1, 2, 0, 1, 2]
    q = spark.range(1).select(G.images_per_class(F.lit(True)).alias("a"), G.negatives(F.lit(3), F.lit(10)).alias("b"), G.negatives(F.lit(3), F.lit(None).cast("int")).alias("c")).first()
    assert (q.a, q.b, q.c) == (200, 290, 100)
