import hashlib
import os
import random
import subprocess
import sys
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkwell.llm import bpe, queries, token_output
from inkwell.llm.common import Feistel, checkpoint_dir, running_start

from .cases import documents, frame

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(RANKS, PATTERN).ranks, special_tokens={})


ODD = ["'s 'S don't we'll  x", "    a\x1cb\x85c", "\x1c\x1d\x1e\x1f", "a  \n\n b\t\tc   ", "<|endoftext|> ok", "٣٤ ½ ² Ⅷ", "é ​﻿", "𝔘𝔫𝔦 🏳️‍🌈", "\r\n\r\n  end ", "\x00\x01", "ǅ ª º ʰ", "क्षि தமி", "12345 1,000.50"]


@pytest.mark.parametrize("extra", [False, True])
def test_ids_equal_the_library_and_decode_to_the_text(spark, extra):
    rows = documents() + [(5000 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    coder = library()
    encoded = bpe.encode(frame(spark, rows, extra), RANKS, PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, tuple(r.ids)) for r in encoded.collect()), key=str)
    want = sorted(((r[0], len(x := coder.encode_ordinary(r[1] or "")), tuple(x)) for r in rows), key=str)
    assert got == want
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded, RANKS, PATTERN).collect()), key=str)
    assert back == sorted(((r[0], (r[1] or "").encode()) for r in rows), key=str)


def test_every_basic_code_point_splits_as_in_the_library():
    rng = random.Random(2)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    coder, split = library(), bpe.splitter(PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(points) + rng.choice(["", " ", "a", "\n", "  ", "1"]) for _ in range(60))
        assert [i for w in split(text) for i in coder.encode_ordinary(w)] == coder.encode_ordinary(text)


def test_digests(spark):
    rows = documents(10)
    coder = library()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(frame(spark, rows), RANKS, PATTERN), RANKS, PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(x := coder.encode_ordinary(r[1] or "")), sha(" ".join(map(str, x)).encode()), sha((r[1] or "").encode())) for r in rows]
    assert got == sorted(want, key=str)
    both = bpe.encode_with_digests(frame(spark, rows), RANKS, PATTERN, keep_ids=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in both), key=str) == got
    assert all(len(r.ids) == r.n_tokens for r in both)
    assert bpe.encode(frame(spark, []), RANKS, PATTERN).count() == 0
    assert bpe.encode_with_digests(frame(spark, []), RANKS, PATTERN).count() == 0


def test_blocks_and_the_cache_are_cut_by_size():
    """Several blocks for each task, and a cache of words that is cleared all the time."""
    code = """
import sys
from pyspark.sql import SparkSession
from inkwell.llm import bpe
from tests.llm.cases import documents, frame
from tests.llm.test_tokens import PATTERN, RANKS, library
bpe.BLOCK_BYTES, bpe.KEEP = 300, 5
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from pyspark import cloudpickle
cloudpickle.register_pickle_by_value(bpe)
rows, coder = documents(30), library()
got = sorted((str(r.doc_id), tuple(r.ids)) for r in bpe.encode(frame(spark, rows).coalesce(1), RANKS, PATTERN, buckets=3).collect())
assert got == sorted((str(r[0]), tuple(coder.encode_ordinary(r[1] or ""))) for r in rows)
"""
    with tempfile.TemporaryDirectory() as folder:
        subprocess.run([sys.executable, "-c", code, folder], cwd=Path(__file__).resolve().parents[2], check=True, env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])})


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    p = Feistel(size, 99)
    out = p.forward(np.arange(size))
    assert sorted(out.tolist()) == list(range(size))
    assert (p.inverse(out) == np.arange(size)).all()
    if size > 60:
        assert (Feistel(size, 100).forward(np.arange(size)) != out).any()


def test_running_start(spark):
    rows = [(i, i % 3, i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, k long, n long")
    plain = running_start(df, "n", ["id"], ["k"], "at", cell_rows=7).collect()
    out = running_start(df, "n", ["id"], ["k"], "at", cell_rows=3, span=4).collect()
    assert sorted(out) == sorted(running_start(df, "n", ["id"], ["k"], "at", cell_rows=3).collect()) and len(plain) == len(out)
    for k in range(3):
        spans = sorted((r["at"], r["at"] + r["n"]) for r in out if r["k"] == k)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def rebuilt(got, stride):
    """Each document's ids without the marks, by doc_id; rows that share an id end to end."""
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.part)):
        texts.setdefault(r.doc_id, []).append(bytes(r.tokens[: r.n_tokens]))
    return {i: b"".join(x) for i, x in texts.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_sequences_fill_every_slot_and_rebuild_the_texts(spark, extra):
    rows = documents(25)
    got = token_output.training_sequences(frame(spark, rows, extra).coalesce(1), stride=64, shard_slots=50).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert len(got) == sum(len((r[1] or "").encode()) // 64 + 1 for r in rows)
    assert all(len(r.tokens) == 64 and r.byte_offset == r.slot % 50 * 64 and r.shard == r.slot // 50 and r.crc32 == zlib.crc32(r.tokens) for r in got)
    texts = rebuilt(got, 64)
    for i, text in ((r[0], r[1]) for r in rows if r[0] is not None and r[0] != 3):
        assert texts[i] == (text or "").encode() + bytes([token_output.END])
    # The slots are the permutation of the sequences' numbers in the order of the rows.
    numbers = Feistel(len(got), 20).forward(np.arange(len(got)))
    want, at = {}, 0
    for r in rows:
        n = len((r[1] or "").encode()) // 64 + 1
        want |= {int(numbers[at + p]): (r[0], p) for p in range(n)}
        at += n
    assert {r.slot: (r.doc_id, r.part) for r in got} == want


def test_sequences_of_ids(spark):
    rows = [(i, [k * i % 50_000 for k in range(i * 7)]) for i in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = token_output.training_sequences(docs, stride=16, shard_slots=10, ids_col="ids", width=2, marks=(60_000, 60_001)).collect()
    texts = {i: [] for i, _ in rows}
    for r in sorted(got, key=lambda r: r.part):
        assert r.byte_offset == r.slot % 10 * 32
        texts[r.doc_id] += np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()
    assert texts == {i: [*(x or []), 60_000] for i, x in rows}
    with pytest.raises(Exception, match="fit"):
        token_output.training_sequences(docs, ids_col="ids", width=1).collect()


def test_shard_files_hold_the_sequences_and_are_resumable(spark, tmp_path):
    docs, folder = frame(spark, documents(25)).coalesce(1), f"{tmp_path}/shards"
    options = {"stride": 64, "shard_slots": 50}
    want = sorted(map(tuple, token_output.training_sequences(docs, **options).collect()))
    Path(folder).mkdir()
    Path(folder, ".part-7-left-over.bin").write_bytes(b"x")
    layout = token_output.write_shards(docs, folder, **options)
    names = [f"shard-{n:08d}.{kind}" for n in range(layout.shards) for kind in ("bin", "idx")]
    assert sorted(p.name for p in Path(folder).iterdir()) == sorted([*names, "manifest.json"]) and layout.shards > 5
    assert b"".join(Path(folder, n).read_bytes() for n in names if n.endswith("bin")) == b"".join(r[-1] for r in want)
    assert sorted(map(tuple, token_output.read_shards(spark, folder).collect())) == want
    for first in (1, 120, len(want) - 1, len(want)):
        assert sorted(map(tuple, token_output.read_shards(spark, folder, first).collect())) == want[first:]
    Path(folder, "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        token_output.read_shards(spark, folder)


def test_a_changed_input_is_an_error(spark):
    @F.pandas_udf("string")
    def other(text: pd.Series) -> pd.Series:
        return pd.Series(["y" * int(n) for n in np.random.default_rng().integers(0, 50_000, len(text))])

    docs = frame(spark, documents(10)).withColumn("text", other.asNondeterministic()("text"))
    with pytest.raises(Exception, match="other rows"):
        token_output.training_sequences(docs, stride=64, fixed=True).collect()
    assert token_output.training_sequences(docs, stride=64).count() > 0


def test_the_query_returns_what_the_shard_files_hold(spark, tmp_path):
    frame(spark, documents(25)).write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(shared.glob("training-*/*"))
    got = queries.op1_training_order(spark, str(tmp_path)).collect()
    files = {p.name: p.read_bytes() for p in set(shared.glob("training-*/*")) - before if p.suffix == ".bin"}
    assert sum(map(len, files.values())) == 1024 * len(got)
    assert all(files[f"shard-{r.shard:08d}.bin"][r.byte_offset : r.byte_offset + 1024] == r.tokens for r in got)
    texts = rebuilt(got, 1024)
    for r in documents(25):
        if r[0] is not None and r[0] != 3:
            assert texts[r[0]] == (r[1] or "").encode() + bytes([token_output.END])
    assert len(got) == sum(len((r[1] or "").encode()) // 1024 + 1 for r in documents(25))


def test_sequences_of_nothing(spark, tmp_path):
    assert token_output.training_sequences(frame(spark, [])).count() == 0
    assert token_output.write_shards(frame(spark, []), f"{tmp_path}/none").shards == 0
    assert token_output.read_shards(spark, f"{tmp_path}/none").count() == 0
