"""The queries themselves, over the smallest tables, beside plain versions of their contracts."""

import zlib
from collections import Counter, defaultdict

import pytest

from inkwell.llm import queries


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_query(spark, docs):
    out = queries.op2_language(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    known = {d.lang for d in docs.values()} - {None}
    for r in out:
        letters = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert (r.lang_pred in known) == letters and (r.lang_pred == "und") == (not letters)
    held = [r for r in out if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)


def test_toxicity_query(spark, docs):
    out = queries.op4_toxicity(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_shards_query(spark, docs):
    out = queries.op6_shards(spark, DATA).collect()
    raw = {i: (d.text or "").encode() for i, d in docs.items()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((i, len(t) + 16, zlib.crc32(t)) for i, t in raw.items())
    slots, where = defaultdict(list), defaultdict(set)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        where[raw[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())


def test_mixture_query(spark, docs):
    out = queries.op8_mixture(spark, DATA).collect()
    words = {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted(words.items())
    size = Counter()
    for i, d in docs.items():
        size[d.source] += words[i]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, [(5, 2, 1)[k % 3] for k in range(len(names))], strict=True))
    left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        whole = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / whole >= 2 * size[s]}
        if not full:
            target |= {s: left * weights[s] / whole for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in out:
        source = docs[r.doc_id].source
        taken[source] += r.taken
        assert r.taken <= 2 * r["size"] and r.source_size == size[source] and r.target == pytest.approx(target[source])
    assert all(taken[s] == pytest.approx(target[s], rel=0.02, abs=260) for s in names)
    again = queries.op8_mixture(spark, DATA).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_fingerprint_query(spark, docs):
    out = queries.op3_simhash(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    prints = {r.fingerprint for r in out}
    want, todo = {}, set(prints)
    for h in sorted(prints):
        if h in todo:
            edge = group = {h}
            while edge:
                todo -= edge
                edge = {x for x in todo if any((int(x, 16) ^ int(y, 16)).bit_count() <= 3 for y in edge)}
                group = group | edge
            want |= dict.fromkeys(group, h)
    assert {r.fingerprint: r.near_class for r in out} == want
    by_text = defaultdict(set)
    for r in out:
        by_text[docs[r.doc_id].text or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_quality_query(spark, docs):
    out = queries.op5_quality(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs) and all(r.selected == (r.tail_probability >= 0.3) for r in out)
