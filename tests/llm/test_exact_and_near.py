import pathlib
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup, near_dedup, simhash
from inkwell.llm.components import components

from .cases import clashing, documents, frame, prose


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return {t: (max([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("heavy", [2, 1000])
@pytest.mark.parametrize("extra", [False, True])
def test_exact_duplicates_match_brute_force(spark, heavy, extra):
    rows = documents() + [(1000 + i, "a hot text", "en", "a", 10) for i in range(40)]
    out = exact_dedup.exact_duplicates(frame(spark, rows, extra), heavy=heavy).collect()
    assert len(out) == len(rows)
    want = brute_exact(rows)
    by_sha = {sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in out:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(dict.fromkeys(by_sha, 1))


@pytest.mark.parametrize("heavy", [2, 1000])
def test_exact_drop_keeps_one_row_and_all_columns(spark, heavy):
    rows = documents() + [(1000 + i, "a hot text", "en", "a", 10) for i in range(40)] + [(1039, "a hot text", "fr", "a", 10)] * 60
    docs = clashing(spark, rows)
    kept = exact_dedup.drop_exact_duplicates(docs, heavy=heavy)
    assert kept.columns == docs.columns
    kept, all_rows = kept.collect(), set(docs.collect())
    assert sorted(r.text or "" for r in kept) == sorted({r[1] or "" for r in rows}) and set(kept) <= all_rows
    want = brute_exact(rows)
    assert all(r.doc_id == want[r.text or ""][0] for r in kept)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0


def reference_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_majority_fingerprints_match_definition():
    texts = [r[1] for r in documents(20)] + ["ÀB a b C", "one two", "A\x1cB c\x0bd"]
    assert [int(x) for x in simhash.majority_fingerprints(texts, 3)] == [reference_fingerprint(t, 3) for t in texts]


def brute_components(rows, words, radius):
    fps = [reference_fingerprint(r[1], words) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return sorted(((r[0], fps[i], min([x for x in groups[find(i)] if x is not None], default=None)) for i, r in enumerate(rows)), key=str)


def chains(rng, n):
    """Texts that differ little from one another, so that links form chains."""
    rows, k = [], 5000
    for _ in range(n):
        words = prose(rng, 150).split()
        for _ in range(6):
            rows.append((k, " ".join(words), "en", "a", 1))
            words[rng.randrange(len(words))] = f"w{k}"
            k += 1
    return rows


@pytest.mark.parametrize("full", [4096, 4])
@pytest.mark.parametrize(("words", "radius"), [(3, 2), (3, 3), (5, 6)])
def test_near_duplicates_match_brute_force(spark, words, radius, full):
    rows = documents(40) + chains(random.Random(3), 12)
    out = near_dedup.near_duplicates(frame(spark, rows, extra=True), words=words, radius=radius, radius2=-1, full=full).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=str) == brute_components(rows, words, radius)


def test_links_of_random_points_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in np.repeat(centres, 12)}
    frame_ = spark.createDataFrame([(near_dedup._signed(p), 0) for p in points], "fp long, fp2 long")
    for radius, full in ((2, 4096), (2, 3), (4, 4096), (4, 8)):
        roots = {r.node: r.root for r in components(near_dedup.links(frame_, radius, full=full)).collect()}
        todo, want = set(points), []
        while todo:
            group, edge = set(), {todo.pop()}
            while edge:
                group |= edge
                edge = {p for p in todo if any((p ^ q).bit_count() <= radius for q in edge)}
                todo -= edge
            want.append(frozenset(group))
        got = defaultdict(set)
        for p in points:
            got[roots.get(near_dedup._signed(p), near_dedup._signed(p))].add(p)
        assert {frozenset(g) for g in got.values()} == set(want)


@pytest.mark.parametrize("full", [4096, 16])
def test_both_fingerprints_count(spark, full):
    rows = chains(random.Random(5), 25) + documents(20)
    texts = [r[1] for r in rows]
    one, two = simhash.majority_fingerprints(texts, 5), near_dedup._second_fingerprints(texts, 5)
    d1 = np.bitwise_count(one[:, None] ^ one[None]).astype(int)
    d2 = np.bitwise_count(two[:, None] ^ two[None]).astype(int)
    linked = ((d1 <= 6) | (d2 <= 6)) & (d1 + d2 <= 15) | (d1 == 0)
    label = np.arange(len(rows))
    while (new := np.where(linked, label[None], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = new
    want = sorted(((r[0], min((rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None), default=None)) for i, r in enumerate(rows)), key=str)
    out = near_dedup.near_duplicates(frame(spark, rows), words=5, radius=6, radius2=15, full=full).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == want


def shuffle_files(spark):
    """Bytes of each shuffle file that there is."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {str(f): f.stat().st_size for folder in folders for f in pathlib.Path(folder).rglob("shuffle_*")}


@pytest.mark.parametrize("full", [None, 64])
def test_probes_of_many_keys_take_little_disk(spark, full):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64) << np.uint64(1)
    # Some that share most bits, so that their keys are crowded, and some near others.
    fps[:300, 0] = fps[0, 0] & ~np.uint64((1 << 30) - 1) | (fps[:300, 0] >> np.uint64(34))
    for i in range(2000, 2400):
        for k in range(2):
            fps[i, k] = fps[i - 1000, k]
            for b in rng.choice(64, int(rng.integers(0, 18)), replace=False).tolist():
                fps[i, k] ^= np.uint64(1 << b)
    assert len(np.unique(fps[:, 0])) > 2950
    points = spark.createDataFrame([tuple(map(near_dedup._signed, map(int, r))) for r in np.unique(fps, axis=0)], "fp long, fp2 long").localCheckpoint()
    before = shuffle_files(spark)
    # Four partitions, each probed within two bits, are what the plan takes from about 1 GB on.
    found = near_dedup.links(points, 11, 26, part_counts=(4,), **({"full": full} if full else {})).collect()
    new = sum(size for f, size in shuffle_files(spark).items() if f not in before)
    assert full or new < 3000 * len(fps)
    d1, d2 = (np.bitwise_count(x[:, None] ^ x[None]).astype(int) for x in fps.T)
    a, b = np.nonzero(((d1 <= 11) | (d2 <= 11)) & (d1 + d2 <= 26) & (d1 > 0))
    want = spark.createDataFrame([(near_dedup._signed(int(fps[i, 0])), near_dedup._signed(int(fps[j, 0]))) for i, j in zip(a, b, strict=True) if i < j], "a long, b long")
    roots = lambda df: sorted(map(tuple, components(df).collect()))
    assert len(found) > 100 and roots(spark.createDataFrame(found, "a long, b long")) == roots(want)


def test_small_tables_take_few_files(spark):
    rng = random.Random(41)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60)), "en", "a", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more", "en", "a", 1) for i in range(10)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = frame(spark, rows).repartition(1).localCheckpoint()
        before = shuffle_files(spark)
        assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == set(range(30))
        assert len(shuffle_files(spark).keys() - before.keys()) < 500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_thresholds_add_up_and_cost_least():
    costs = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 3}, {-1: 0, 0: 9, 1: 90}]
    assert near_dedup.allocate(costs, 3) == [0, 1, -1]
    groups = near_dedup.correlated_partitions(10, np.eye(64) * 5, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_near_drop_keeps_rows_not_ids(spark):
    rng = random.Random(31)
    a, b, c = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(200)) for _ in range(3))
    near_b = b.replace(" ", "  ", 1) + " more"
    rows = [(1, a, "en", "a", 1), (0, b, "en", "a", 1), (1, near_b, "en", "a", 1), (1, a, "fr", "a", 1), (None, c, "en", "a", 1), (None, c + " more", "en", "a", 1), (7, c + " end", "en", "a", 1), (None, None, None, None, None), (None, "", None, None, None)]
    docs = clashing(spark, rows)
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("0", b), ("7", c + " end"), ("None", "")])
    assert set(kept) <= set(docs.collect())


def test_near_drop_finds_copies_and_keeps_the_rest(spark):
    rng = random.Random(9)
    rows, near = [], set()
    for i in range(40):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(200)]
        rows.append((i, " ".join(words), "en", "a", 1))
        if i % 4 == 0:
            words[100] = "changed"
            rows.append((1000 + i, " ".join(words), "en", "a", 1))
            near.add(1000 + i)
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - near
    assert near_dedup.drop_near_duplicates(frame(spark, [])).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / max(len(a | b), 1)


def shared_part(rng, k, changed):
    """A text of 200 words, and one that differs in a run of ``changed`` of them."""
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(200)]
    return " ".join(words), " ".join([*words[: 100 - changed], *[f"n{k}x{i}" for i in range(changed)], *words[100:]])


def test_near_drop_keeps_texts_under_the_similarity(spark):
    rng = random.Random(15)
    rows, want = [], set()
    for i in range(60):
        one, two = shared_part(rng, i, (14, 24, 32, 40)[i % 4])
        rows += [(i, one, "en", "a", 1), (1000 + i, two, "en", "a", 1)]
        want |= {i} | ({1000 + i} if jaccard(one, two) < 0.8 else set())
    middle = [jaccard(rows[k][1], rows[k + 1][1]) for k in range(0, 120, 2)]
    assert sum(0.6 <= j < 0.8 for j in middle) >= 40 and sum(j >= 0.8 for j in middle) >= 10
    # Equal votes, other sets: the repeated line decides every bit of the fingerprints.
    line = "one two three four five " * 400
    rows += [(5000 + i, line + " ".join(f"u{i}x{k}" for k in range(100)), "en", "a", 1) for i in range(4)]
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == want | {5000, 5001, 5002, 5003}


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 7}, {"block_bytes": 6000}])
def test_verified_classes_match_brute_force(spark, blocks):
    rng = random.Random(16)
    rows = chains(rng, 8) + [r for r in documents(20) if r[0] is not None]
    base = [f"t{rng.randrange(4000)}" for _ in range(150)]
    for i in range(70):
        words = list(base)
        for _ in range(i // 9):
            words[rng.randrange(150)] = f"c{rng.randrange(40)}"
        rows.append((9000 + i, " ".join(words), "en", "a", 1))
    docs = frame(spark, rows, extra=True)
    coarse = near_dedup.near_duplicates(docs).collect()
    text, group = defaultdict(set), defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1] or "")
    assert all(len(t) == 1 for t in text.values())
    for r in coarse:
        group[r.component_id].add(r.doc_id)
    assert max(map(len, group.values())) > 40
    want = {}
    sets = {i: set(simhash.shingle_hashes(next(iter(t)), 5).tolist()) for i, t in text.items()}
    for ids in group.values():
        todo = set(ids)
        while todo:
            found = edge = {todo.pop()}
            while edge:
                edge = {i for i in todo if any(sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in edge)}
                todo -= edge
                found = found | edge
            want |= dict.fromkeys(found, min(found))
    out = near_dedup.near_duplicates(docs, jaccard=0.8, **blocks).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((r[0], want[r[0]]) for r in rows)
    assert len({r.component_id for r in out}) > len(group)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 104), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 102: 100, 104: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None)], "doc_id string, text string")
    assert {r.doc_id: r.kept for r in exact_dedup.exact_duplicates(docs).collect()} == {"a": False, "b": True, "c": True}
    assert exact_dedup.exact_duplicates(docs).where(F.col("kept")).count() == 2
