import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import language_id, quality, queries, toxicity

from .cases import documents, frame

SOUNDS = {"en": ["th", "ing", "and", "er", "of"], "fr": ["eau", "oi", "é", "le", "qu"], "de": ["sch", "ung", "ein", "ß", "ch"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(n=150, seed=2):
    rng = random.Random(seed)
    return [(i, speech(rng, lang, 40), lang, "a", 1) for i, lang in enumerate(rng.choice(sorted(SOUNDS)) for _ in range(n))]


def test_gradients_are_those_of_the_loss():
    net = language_id.ByteGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths = language_id.to_grid([b"hello wo", b"abc", b"zzzzzzzz"], 8)
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, lengths, y)
    for k in net.p:
        at = tuple(np.argwhere(g[k] != 0)[1])
        before, step = net.p[k][at], 1e-2
        net.p[k][at] = before + step
        up = net.gradients(x, lengths, y)[0]
        net.p[k][at] = before - step
        down = net.gradients(x, lengths, y)[0]
        net.p[k][at] = before
        assert g[k][at] == pytest.approx((up - down) / 2 / step, rel=1e-2, abs=1e-6)


def test_language_of_held_out_rows(spark):
    docs = frame(spark, labelled())
    held = zlib.crc32
    model = language_id.learn(docs.where(queries.fold() % 5 != 0), per_language=50, epochs=8)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    out = [(r[2], got[r[0]]) for r in labelled() if held(str(r[0]).encode()) % 5 == 0]
    assert np.mean([lang == p for lang, (p, _) in out]) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_of_odd_rows(spark):
    model = language_id.learn(frame(spark, labelled(60)), per_language=20, epochs=2)
    rows = [*documents(5), (900, "123 456", None, None, 1), (901, "\x00 ", None, None, 1)]
    out = {r.doc_id: r for r in language_id.identify(frame(spark, rows, extra=True), model).collect()}
    for i, text in ((r[0], r[1]) for r in rows):
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in text or "")) or i is None
    assert out[900].score == 0 and out[900].lang_pred == "und"
    empty = language_id.learn(frame(spark, []))
    assert [r.lang_pred for r in language_id.identify(frame(spark, rows[:2]), empty).collect()] == ["und", "und"]
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_pooling_does_not_depend_on_the_batch():
    model = language_id.LanguageModel(language_id.ByteGRU(3), ["a", "b", "c"], 16)
    texts = ["some words", "x" * 1000, "", None, "other words " * 50]
    together = model.predict(texts)
    for i, t in enumerate(texts):
        one = model.predict([t])
        assert one[0][0] == together[0][i] and one[1][0] == pytest.approx(together[1][i], abs=1e-5)


def insults(n=240, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = speech(rng, rng.choice(sorted(SOUNDS)), 120).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["dreckwort", "villainous", "scoundrel"])
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 0 if i % 5 == 0 else 1, int(toxic)))
    return rows, labels


def test_toxic_rows_are_told_from_others(spark):
    rows, labels = insults()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks.where(queries.fold() % 3 != 1))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(y, got[i]) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([r.predicted for y, r in held if y]) > 0.8
    assert np.mean([r.predicted for y, r in held if not y]) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_toxicity_of_odd_rows(spark):
    rows, labels = insults(80)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    odd = documents(5)
    out = toxicity.score_toxicity(frame(spark, odd, extra=True), model).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (5, 6, 14, 15)}) == 1  # null and empty
    blank = toxicity.learn(docs, marks.where("toxic = 5"))
    assert len({r.score for r in toxicity.score_toxicity(docs, blank).collect()}) == 1
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_windows_cover_the_text():
    text = "".join(chr(97 + i % 26) for i in range(1000))
    for n in (0, 1, 23, 24, 25, 100, 1000):
        w = toxicity.windows_of(text[:n])
        covered = set()
        for k, part in enumerate(w):
            assert part == text[:n].encode()[k * 16 : k * 16 + 24]
            covered |= set(range(k * 16, k * 16 + len(part)))
        assert covered == set(range(n))


def graded(n=180, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        grade = i % 3
        words = speech(rng, "en", 60).split()
        words = [w.upper() + "!!" if rng.random() < (0.8, 0.3, 0.0)[grade] else w for w in words]
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, grade, 0))
    return rows, labels


def test_grades_are_ordered(spark):
    rows, labels = graded()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.grade(docs, model, least=2).collect()}
    held = [(g, got[i]) for i, g, _ in labels if i % 2]
    assert np.mean([round(r.expected_grade) == g for g, r in held]) > 0.85
    assert min(r.tail_probability for g, r in held if g == 2) > max(r.tail_probability for g, r in held if g == 0)


def test_ordinal_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=300), [-0.5, 0.8])
    model = quality.fit(x, y, 3)
    tails = model.tails(x)
    p = np.concatenate([1 - tails[:, :1], tails[:, :1] - tails[:, 1:], tails[:, 1:]], axis=1)
    assert -np.log(p[np.arange(300), y]).mean() < 0.6
    assert (p > 0).all()


def test_quality_of_odd_rows(spark):
    rows, labels = graded(60)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks)
    odd = frame(spark, documents(5), extra=True)
    out = quality.grade(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.tail_probability <= 1 for r in out)
    kept = quality.keep_selected(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.selected for r in out)
    flat = quality.learn(docs, marks.where("quality = 1"))
    assert all(r.selected for r in quality.grade(docs, flat).collect())
    assert quality.grade(frame(spark, []), model).count() == 0


def test_labels_are_never_inputs(spark):
    rows, labels = insults(80)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 7})
    a = sorted(r.score for r in toxicity.score_toxicity(docs, model).collect())
    assert a == sorted(r.score for r in toxicity.score_toxicity(other, model).collect())
