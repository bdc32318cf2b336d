import pytest
from pyspark.sql import functions as F

from inkwell import constants as K
from inkwell.functions import text as T
from inkwell.operators import boxes as B
from inkwell.operators import dataset as D
from inkwell.operators import images as I
from inkwell.operators import ocr as O
from inkwell.operators import report as R
from inkwell.sources import readers, writers
from inkwell.streaming import scoring

BOX = "page_id int, box_id int, x1 int, y1 int, x2 int, y2 int, conf_pm int, truth boolean"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r, True) for i, r in enumerate(rows)], BOX)


def test_iou_and_suppression(spark):
    b = boxes(spark, (0, 0, 10, 10, 900), (5, 0, 15, 10, 800))
    r = B.iou_pairs(b, b, F.col("a.box_id") < F.col("b.box_id")).first()
    assert (r.inter, r.union) == (50, 150) and r.iou == pytest.approx(1 / 3)
    assert B.suppress(b, 0.40).count() == 2 and B.suppress(b, 0.30).count() == 1
    half = boxes(spark, (0, 0, 30, 10, 900), (10, 0, 40, 10, 800))  # IoU exactly 0.5
    assert B.suppress(half, 0.50, inclusive=True).count() == 2 and B.suppress(half, 0.50, inclusive=False).count() == 1


def test_suppression_is_idempotent_and_limited(spark):
    rows = [((7 * i) % 50, (3 * i) % 40, (7 * i) % 50 + 20, (3 * i) % 40 + 20, (37 * i) % 1000) for i in range(40)]
    once = B.suppress(boxes(spark, *rows), 0.2)
    again = B.suppress(once.drop("rank").withColumn("truth", F.lit(True)), 0.2)
    assert {r.box_id for r in once.collect()} == {r.box_id for r in again.collect()}
    assert B.suppress(boxes(spark, *rows), 1.0, most=5).count() == 5


def test_true_positive_and_overlap(spark):
    p, t = boxes(spark, (0, 0, 10, 10, 1), (50, 50, 60, 60, 1)), boxes(spark, (0, 0, 10, 11, 1))
    assert [r.box_id for r in B.true_positives(p, t).collect()] == [0]
    assert [r.box_id for r in B.without_overlap(boxes(spark, (0, 0, 10, 10, 1), (1, 1, 11, 11, 1), (90, 0, 95, 9, 1))).orderBy("box_id").collect()] == [0, 2]


def plain_first_fit(rows):
    heights = sorted(r[3] - r[1] for r in rows)
    n = len(heights)
    median = heights[n // 2] if n % 2 else (heights[n // 2 - 1] + heights[n // 2]) / 2
    tol, lines = max(8.0, 0.35 * median), []
    for i in sorted(range(n), key=lambda i: ((rows[i][1] + rows[i][3]) / 2, i)):
        y = (rows[i][1] + rows[i][3]) / 2
        for line in lines:
            if abs(y - sum(c for _, c in line) / len(line)) <= tol:
                line.append((i, y))
                break
        else:
            lines.append([(i, y)])
    order = sorted(range(len(lines)), key=lambda k: (sum(c for _, c in lines[k]) / len(lines[k]), k))
    return {i: rank for rank, k in enumerate(order) for i, _ in lines[k]}


def test_reading_order_first_fit(spark):
    rows = [((i * 37) % 300, (i * 53) % 120, (i * 37) % 300 + 20, (i * 53) % 120 + 15 + i % 9, 1) for i in range(40)]
    got = {r.box_id: r.line for r in B.lines_first_fit(boxes(spark, *rows)).collect()}
    assert got == plain_first_fit(rows)
    assert sorted(r.ord for r in B.lines_first_fit(boxes(spark, *rows)).collect()) == list(range(40))


def test_words_of_cosa(spark):
    rows = spark.createDataFrame([(1, 0, i, x, x + 20) for i, x in enumerate((0, 25, 50, 110))], "page_id int, line int, ord int, x1 int, x2 int")
    w = B.words(rows, ["page_id", "line"])
    assert [r.word for r in w.orderBy("ord").collect()] == [0, 0, 0, 1]
    text = B.page_text(w.withColumn("ch", F.element_at(F.array(*[F.lit(c) for c in "cosa"]), F.col("ord") + 1)))
    assert text.first().text == "cos a"


def test_labels_parse_and_sanitize(spark):
    lines = spark.createDataFrame([("0 .5 .5 .2 .2",), ("0 .5 .5 .2",), ("0 x .5 .2 .2",), ("0 .5 .5 .005 .2",), (None,)], "line string")
    p = B.parse_labels(lines)
    assert [r.problem for r in p.collect()] == [None, "wrong_fields", "non_numeric", None, "wrong_fields"] or [r.problem for r in p.collect()][:4] == [None, "wrong_fields", "non_numeric", None]
    assert B.sanitize_labels(p.where("problem is null")).count() == 1


def top(*pairs):
    return F.array(*[F.struct(F.lit(c).alias("ch"), F.lit(float(p)).alias("p")) for c, p in pairs])


@pytest.mark.parametrize(
    ("pairs", "context", "kind", "expected", "want"),
    [
        ([("!", 0.8), ("l", 0.1)], "word_middle", None, None, ("l", "punct_in_word→letter")),
        ([("!", 0.8), ("l", 0.005)], "word_middle", None, None, ("l", "confusion_table_in_word")),
        ([("!", 0.8), ("?", 0.1)], "word_start", None, None, ("i", "forced_confusion_remap")),
        ([("á", 0.6), ("a", 0.3)], "standalone", None, None, ("a", "accent_uncertain→base")),
        ([("á", 0.92), ("x", 0.01)], "word_end", None, None, ("a", "accent_in_word→base")),
        ([("0", 0.9), ("o", 0.05)], "word_middle", None, None, ("o", "digit_in_word→letter")),
        ([("0", 0.9), ("?", 0.05)], "word_middle", None, None, ("O", "digit_confusion→letter")),
        ([("A", 0.9), ("a", 0.08)], "word_middle", None, None, ("a", "upper_in_middle→lower")),
        ([("A", 0.9), ("b", 0.08)], "word_middle", None, None, ("a", "force_lower_in_middle")),
        ([("l", 0.9), ("1", 0.08)], "digit_seq", None, None, ("1", "letter_in_digits→digit")),
        ([("l", 0.9), ("x", 0.08)], "digit_seq", None, None, ("1", "letter_confusion→digit")),
        ([("círculo", 0.9), ("o", 0.08)], "unknown", None, None, ("o", "stroke_in_text→char")),
        ([("círculo", 0.9), ("o", 0.08)], "standalone", None, None, ("círculo", "raw")),
        ([("x", 0.98)], "unknown", None, None, ("x", "high_confidence")),
        ([("x", 0.5)], "unknown", None, None, ("x", "raw")),
        ([("x", 0.5), ("5", 0.2)], "unknown", "digit", None, ("5", "type_filter")),
        ([("x", 0.5), ("y", 0.2)], "unknown", "digit", None, ("x", "raw")),
        ([("0", 0.5), ("o", 0.3)], "unknown", None, "o", ("0", "raw")),
        ([("x", 0.5), ("o", 0.3)], "unknown", None, "o", ("o", "expected_boost")),
        ([("x", 0.01), ("o", 0.004)], "unknown", None, "o", ("x", "raw")),
    ],
)
def test_rules(spark, pairs, context, kind, expected, want):
    df = spark.range(1).select(top(*pairs).alias("top"), F.lit(context).alias("context"), F.lit(kind).cast("string").alias("expected_type"), F.lit(expected).cast("string").alias("expected_char"))
    r = O.classify(df).first().result
    assert (r.ch, r.method) == want and r.p <= 1


def test_dictionary_and_sequences(spark):
    words = spark.createDataFrame([("casa",), ("c4sa",), ("nino",), ("zzz",), ("lo",)], "word string")
    lexicon = spark.createDataFrame([("casa",), ("niño",), ("lo",)], "entry string")
    fixed = {r.word: r.correction for r in O.dictionary_correct(words, lexicon).collect()}
    assert fixed["casa"] == "casa" and fixed["lo"] == "lo" and fixed["zzz"] is None
    bad = {r.word: r.at for r in words.select("word", O.impossible(F.col("word")).alias("at")).collect()}
    assert bad == {"casa": -1, "c4sa": -1, "nino": -1, "zzz": 0, "lo": -1}


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("cls"))
    out = D.stratified_split(df, ["cls"], [F.xxhash64("id")])
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    shares = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 700) < 10 and abs(shares["val"] - 150) < 10
    assert D.random_split(df, "id").where("split = 'val'").count() == pytest.approx(200, abs=45)


def test_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], "s") for i in range(90)], "id long, cls string, source string")
    out = D.sample_weights(df, {})
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(90)
    one = D.effective_weights(spark.createDataFrame([(0, 1), (1, 1)], "cls int, n long"))
    assert [r.weight for r in one.collect()] == pytest.approx([1, 1])


def test_weighted_sample_of_odd_weights(spark):
    rows = [(i, w) for i, w in enumerate([None, 0.0, -1.0, 0.1, 0.2, 1e-9, 3.7] + [0.3] * 60)]
    df = spark.createDataFrame(rows, "id long, w double")
    for size in (1, 7, 1000):
        out = D.weighted_sample(df, "w", 3000, cell_rows=size).collect()
        assert sorted(r.draw for r in out) == list(range(3000)) and {r.id for r in out} & {0, 1, 2} == set()
        assert sum(r.id == 6 for r in out) / 3000 == pytest.approx(3.7 / 22, abs=0.02)
    again = D.weighted_sample(df.repartition(3), "w", 3000, cell_rows=1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert D.weighted_sample(df.where("id < 3"), "w", 10).count() == 0


def test_weighted_sample_follows_the_weights(spark):
    df = spark.createDataFrame([(i, float(1 + 9 * (i % 2))) for i in range(50)], "id long, w double")
    out = D.weighted_sample(df, "w", 5000)
    assert out.count() == 5000
    assert out.where("id % 2 = 1").count() == pytest.approx(4500, abs=120)


def test_keep_first_and_coverage(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (None, "x")], "id int, k string")
    assert sorted((r.id, r.k, r.copies) for r in D.keep_first(df.where("id is not null"), [F.col("k")], [F.col("id")]).collect()) == [(1, "x", 2), (2, "y", 1)]
    cov = D.coverage(spark.createDataFrame([("s", 0), ("s", 2), ("t", 1)], "source string, cls int"), 3)
    assert {r.source: (r.covered, r.missing, r.pct) for r in cov.collect()} == {"s": (2, [1], 66.67), "t": (1, [0, 2], 33.33)}


def test_report_of_nothing_predicted(spark):
    p = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (2, 1, "a")], "true_cls int, pred_cls int, source string")
    r = {x.cls: x for x in R.class_report(p).collect()}
    assert (r[1].precision, r[1].recall, r[1].f1) == (0, 0, 0) and r[2].precision == 0 and r[0].precision == 1 and r[0].recall == 0.5


@pytest.mark.parametrize(("a", "b", "want"), [("á", "a", "accent→base"), ("a", "á", "base→accent"), ("s", "S", "case"), ("0", "O", "shape"), ("o", "0", "shape"), ("a", "b", "other"), ("Ñ", "N", "accent→base")])
def test_confusion_type(spark, a, b, want):
    assert spark.range(1).select(O.confusion_type(F.lit(a), F.lit(b))).first()[0] == want


def test_safe_names_round_trip(spark):
    chars = spark.createDataFrame([(c,) for c in O.LETTERS + K.DIGITS + ".,;:?!"], "ch string")
    named = chars.withColumn("name", T.safe_name(F.col("ch")))
    assert named.select("name").distinct().count() == chars.count()
    assert named.where(T.slug_char(F.col("name")) != F.col("ch")).count() == 0


def test_class_maps(spark):
    maps = spark.createDataFrame([('{"idx2char": {"0": "a", "1": "b"}}',), ('{"2": "c"}',), ('["x", "y"]',), ("nonsense",)], "json string")
    assert sorted((r.class_idx, r.ch) for r in readers.class_map(maps).collect()) == [(0, "a"), (0, "x"), (1, "b"), (1, "y"), (2, "c")]
    assert readers.gap_filled(readers.class_map(maps).where("class_idx = 2"), 3).orderBy("class_idx").collect()[0].ch == "UNK_0"
    default = readers.default_classes(spark)
    assert default.count() == default.select("ch").distinct().count()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("i.png", "a", 0, "s", "train", 4, 5), ("j.png", "b", 1, "s", "val", 4, 5)], readers.METADATA)
    writers.metadata(rows, str(tmp_path / "meta"))
    assert [r.label for r in readers.metadata(spark, str(tmp_path / "meta"), "val").collect()] == ["b"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/one.txt").write_text("0 .5 .5 .1 .1\n0 1 2\n")
    got = readers.label_lines(spark, str(tmp_path / "labels")).orderBy("line_no").collect()
    assert [(r.stem, r.problem) for r in got] == [("one", None), ("one", "wrong_fields")]
    (tmp_path / "img/a").mkdir(parents=True)
    (tmp_path / "img/a/x_1.png").write_bytes(b"\x89PNG")
    found = readers.images(spark, str(tmp_path / "img")).select("stem", readers.folder_class(F.col("path")).alias("c"), "length").first()
    assert (found.stem, found.c, found.length) == ("x_1", "a", 4)
    writers.report(rows.select("label"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_template_fallback(spark):
    stored = spark.createDataFrame([("a", "intermedio", [1]), ("B", "avanzado", [2])], "ch string, level string, pixels array<int>")
    wanted = spark.createDataFrame([("a", "intermedio"), ("A", "intermedio"), ("a", "avanzado"), ("A", "avanzado"), ("b", "avanzado"), ("z", "avanzado")], "ch string, level string")
    got = {(r.ch, r.level): (r.pixels, r.step) for r in readers.templates(wanted, stored).collect()}
    assert got == {("a", "intermedio"): ([1], 0), ("A", "intermedio"): ([1], 1), ("a", "avanzado"): ([1], 2), ("A", "avanzado"): ([1], 3), ("b", "avanzado"): ([2], 1), ("z", "avanzado"): (None, None)}


def test_configuration_and_base64(spark):
    df = spark.createDataFrame([('{"k": "2", "x": "y"}',), ("bad",), (None,)], "saved string")
    got = [r.c for r in df.select(readers.overlay({"k": "1", "l": "en"}, F.col("saved")).alias("c")).collect()]
    assert got == [{"k": "2", "l": "en", "x": "y"}, {"k": "1", "l": "en"}, {"k": "1", "l": "en"}]
    assert [r[0] for r in spark.createDataFrame([("YWI=",), ("!!",)], "t string").select(readers.from_base64(F.col("t"))).collect()] == [b"ab", None]


def test_image_rules(spark):
    px = spark.createDataFrame([(1, r, c, 255 if (r + c) % 2 else 0) for r in range(10) for c in range(10)], "img int, row int, col int, v int")
    q = I.quality(px, 10).first()
    assert q.blur == pytest.approx((4 * 255) ** 2) and q.contrast == pytest.approx(127.5) and q.extremes == 1
    assert I.otsu(px).first().threshold == 0
    assert I.polarity(px, 10).first().polarity == "ambiguous"


def test_streams(spark, tmp_path):
    schema = "g int, t int, a array<struct<row:int,col:int>>"
    spark.createDataFrame([(1, 0, [(5, 5)]), (2, 0, [(9, 9)])], schema).write.parquet(str(tmp_path / "in"))
    template = spark.createDataFrame([(0, 5, 5)], "t int, row int, col int")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, template, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = {r.g: r.precision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[1] == 100 and out[2] == pytest.approx(100 * (1 - (32**0.5 - 5) / 12))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.total) for r in scoring.windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_smaller_rules(spark):
    px = spark.createDataFrame([(1, 0, 0, 200), (1, 0, 1, 10), (2, 0, 0, 100), (2, 0, 1, 101), (3, 0, 0, 0), (3, 0, 1, 9)], "img int, row int, col int, v int")
    gone = {r.img: r.reason for r in I.degenerate(px, spark.createDataFrame([(i,) for i in range(1, 5)], "img int")).collect()}
    assert gone == {2: "flat", 3: "flat", 4: "unreadable"}
    p = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 1, "a"), (1, 1, "a")], "true_cls int, pred_cls int, source string")
    d = R.detail(p, spark.createDataFrame([(0, 1)], "cls int, base int")).first()
    assert d.support == 3 and d.base_pct == pytest.approx(200 / 3) and [w.pred_cls for w in d.wrong] == [1]
    assert R.low_classes(R.class_report(p), 0.6).first().classes == [0, 1]
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 0.9, 0.1],)], "values array<double>")
    box = B.parse_detections(flat, candidates=2).collect()
    assert [(b.box_id, b.cx, b.h, b.conf) for b in box] == [(0, 1.0, 7.0, 0.9)]


def test_classes_of_characters(spark):
    classes = spark.createDataFrame([(0, "é"), (1, "/"), (2, "/")], "class_idx int, ch string")
    chars = spark.createDataFrame([("é",), ("é",), ("/",), ("x",)], "ch string")
    assert sorted((r.ch, r.class_idx) for r in T.class_index(chars, classes).where("class_idx is not null").collect()) == [("/", 1), ("é", 0), ("é", 0)]
    labels = spark.createDataFrame([(0,), (10,), (36,), (61,), (62,)], "l int").select(T.emnist_char(F.col("l")).alias("c"))
    assert [r.c for r in labels.collect()] == ["0", "A", "a", "z", None]


def test_packed_image_sets(spark, tmp_path):
    (tmp_path / "images").write_bytes(b"\0\0\x08\x03" + (2).to_bytes(4, "big") + (2).to_bytes(4, "big") * 2 + bytes(range(8)))
    (tmp_path / "labels").write_bytes(b"\0\0\x08\x01" + (3).to_bytes(4, "big") + bytes([7, 0, 61]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.i, bytes(r.image)) for r in readers.idx_images(files, 2).orderBy("i").collect()] == [(0, bytes(range(4))), (1, bytes(range(4, 8)))]
    assert [r.label for r in readers.idx_labels(files).orderBy("i").collect()] == [7, 0, 61]
    report = spark.createDataFrame([('{"global_missing": ["a", "b", "a"]}',)], "json string")
    assert sorted(r.ch for r in readers.missing_classes(report).collect()) == ["a", "b"]
