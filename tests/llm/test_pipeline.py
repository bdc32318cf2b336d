import random

import __spark_entry__ as entry_point
import corpus_pipeline
from inkwell.llm import bpe, exact_dedup, near_dedup, quality

from .cases import frame, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randrange(60, 160))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "en", rng.choice(["a", "b", "c"]), 1))
        labels.append((i, 0 if bad else 1, 0))
    good = [r for r, label in zip(rows, labels, strict=True) if label[1]]
    rows += [(1000 + i, good[i][1], "en", "a", 1) for i in range(10)]
    rows += [(2000 + i, good[20 + i][1] + " more", "en", "b", 1) for i in range(10)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, good


def test_stages_in_turn(spark, tmp_path):
    rows, good = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    want = {r[0] for r in good}
    assert kept[0] == want | set(range(1000, 1010)) | set(range(2000, 2010))
    assert kept[1] == kept[0] - {good[i][0] for i in range(10)}
    assert kept[2] == kept[1] - set(range(2000, 2010))
    texts = {r[0]: r[1] for r in rows}
    ranks, pattern = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN
    table = bpe.vocabulary(ranks, pattern).bytes_of
    for r in docs.collect():
        assert bpe.decode_ids(__import__("numpy").array(r.ids), table).decode() in texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_equals_the_stages_and_entry_names_it(spark, tmp_path):
    corpus(spark, str(tmp_path))
    a = corpus_pipeline.run(spark, str(tmp_path))
    b = entry_point.queries()["pipeline"](spark, str(tmp_path))
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert pick(a) == pick(b) and a.count() > 0
    assert all(any(q.startswith(f"op{n}_") for q in entry_point.queries()) for n in range(1, 11))
    assert quality and exact_dedup and near_dedup


def test_empty_documents_pass_through(spark, tmp_path):
    docs = frame(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_and_odd_rows_pass_through(spark, tmp_path):
    rng = random.Random(12)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, prose(rng, 30_000), None, "a", 1), (None, "no id", "en", None, 2), (4, "x", "en", "b", 1), (4, "x", "en", "b", 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {3}
