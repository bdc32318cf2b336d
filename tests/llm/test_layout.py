import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import fingerprints, mixing, sharding

from .cases import clashing, documents, frame, prose


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1000)), max_size=60), st.integers(0, 35))
@settings(max_examples=80, deadline=None)
def test_tree_finds_the_tightest_room(keys, size):
    tree, held = sharding.RoomTree(), []
    for i, (room, b) in enumerate(keys):
        key = (room, b * 1000 + i)
        tree.insert(key)
        held.append(key)
        if i % 3 == 2:
            gone = held.pop(len(held) // 2)
            tree.remove(gone)
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(50, 150))
@settings(max_examples=80, deadline=None)
def test_best_fit_decreasing_matches_the_plain_rule(sizes, capacity):
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        b = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, sizes[i]))
        rooms[b] -= sizes[i]
        want[i] = b
    assert sharding.best_fit_decreasing(sizes, capacity) == want


@pytest.mark.parametrize("extra", [False, True])
def test_shards_are_even_whole_and_numbered(spark, extra):
    rows = documents(200) + [(9000 + i, "copy of one text", None, "a", 1) for i in range(60)]
    out = sharding.assign_shards(frame(spark, rows, extra), shards=6, cell_rows=10).collect()
    assert len(out) == len(rows)
    slots, size, where = defaultdict(list), Counter(), defaultdict(set)
    sizes = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == sizes
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    rest = [v for v in size.values() if v < 100_000]  # the longest text fills a shard
    assert max(rest) - min(rest) < 0.05 * max(rest)


@pytest.mark.parametrize("share", [0.03, 0.05, 0.1, 0.34])
def test_a_hot_group_leaves_the_other_bins_even(share):
    rng = random.Random(13)
    sizes = [rng.randrange(500, 1500) for _ in range(10_240)]
    sizes.append(int(sum(sizes) * share / (1 - share)))
    load = Counter()
    for size, b in zip(sizes, sharding.pack_into(sizes, 40), strict=True):
        load[b] += size
    rest = sorted(load.values())[:-1]
    assert sorted(load) == list(range(40)) and max(rest) < 1.01 * min(rest)


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_no_bin_stays_empty(sizes, bins):
    assert set(sharding.pack_into(sizes, bins)) == set(range(min(bins, len(sizes))))


def test_shards_beside_a_hot_group_are_even(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 30), None, "a", 1) for i in range(800)] + [(9000 + i, "one hot text " * 18, None, "a", 1) for i in range(400)]
    size = Counter()
    for r in sharding.assign_shards(frame(spark, rows), shards=8).collect():
        size[r.shard] += r.size
    rest = sorted(size.values())[:-1]
    assert sorted(size) == list(range(8)) and max(rest) < 1.05 * min(rest)


@pytest.mark.parametrize("region", [64, 5])
def test_shards_of_a_capacity(spark, region):
    rows = [(i, "x" * (50 + i), None, "a", 1) for i in range(200)] + [(i, "one text", None, "a", 1) for i in range(5)] + [(900, "y" * 1500, None, "a", 1)]
    out = sharding.assign_shards(frame(spark, rows), capacity=1000, region=region).collect()
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert len(out) == len(rows) and sorted(size) == list(range(len(size)))
    assert sorted(size.values())[-2] <= 1000 < max(size.values()) == 1516
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert len(size) <= -(-sum(size.values()) // 1000) * (1.1 if region == 64 else 1.4) + 1
    assert sharding.assign_shards(frame(spark, []), shards=3).count() == 0
    assert sharding.assign_shards(frame(spark, []), capacity=3).count() == 0


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
@settings(deadline=None)
def test_shares_are_capped_and_complete(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.capped_shares(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))
    free = [g / w for g, w, s in zip(got, weights, sizes, strict=True) if g < 2 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 100))
@settings(max_examples=50, deadline=None)
def test_drawn_counts_meet_the_quotas(quotas, slots):
    counts = mixing.draw_counts(quotas, slots, 3)
    assert counts.sum(axis=0).tolist() == (quotas if sum(quotas) else [0] * len(quotas)) or not sum(quotas)
    assert all(s == slots for s in counts.sum(axis=1)[:-1])


def mixture_rows(seed=6):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 300)), "en", rng.choice(["a", "b", "c", None]), 1) for i in range(300)]
    return rows + [(1000, None, None, "a", None), (1001, " \n", None, "b", None), (1002, "one", None, "z", None), rows[5], rows[5]]


@pytest.mark.parametrize("extra", [False, True])
def test_mixture_meets_the_targets(spark, extra):
    rows = mixture_rows()
    found, picks = mixing.mix(frame(spark, rows, extra), shard_slots=100)
    found, picks = found.collect(), picks.collect()
    assert len(found) == len(rows)
    size, taken = Counter(), Counter()
    copies, source = Counter(r.row for r in found), {r.row: (r.source, r.target, r.source_size) for r in found}
    words = {r.row: r["size"] for r in found}
    for p in picks:
        taken[p.row] += p.words
        assert 0 <= p.first and p.first + p.words <= words[p.row]
    by_source = Counter()
    for row, n in taken.items():
        assert n <= 2 * words[row] * copies[row]
        by_source[source[row][0]] += n
    for name, target, total in set(source.values()):
        assert by_source[name] == pytest.approx(target, rel=0.02, abs=2)
    for r in found:
        size[r.source] += r["size"]
    assert {s: t for s, _, t in source.values()} == dict(size)
    assert sum(t for _, t, _ in set(source.values())) == pytest.approx(1.5 * sum(size.values()))
    places = [(p.shard, p.slot) for p in picks]
    assert max(Counter(s for s, _ in set(places)).values()) <= 100
    assert len(places) == len(set((p.shard, p.slot, p.place) for p in picks))
    other = mixing.mix(frame(spark, rows[::-1]).repartition(5), shard_slots=100)[1].collect()
    plain = lambda ps: sorted((p.shard, p.slot, p.place, p.doc_id, p.first, p.words) for p in ps)
    assert plain(other) == plain(picks)


def test_mixture_texts_are_parts_of_documents(spark):
    rows = mixture_rows()
    rows += [rows[9][:2] + ("fr",) + rows[9][3:], (None, rows[4][1], "en", "a", 1), (None, rows[4][1], "en", "a", 1), (4, rows[7][1], "en", "a", 1)]
    docs = clashing(spark, rows)
    out = mixing.mixed_documents(docs, shard_slots=100, places=True)
    assert out.columns == [*docs.columns, "shard_", "slot_", "place_"]
    out = out.collect()
    of_row = {r["_id"]: r for r in docs.collect()}  # numbered by row
    taken = Counter()
    for r in out:
        own = of_row[r["_id"]]
        assert all(own[c] == r[c] for c in docs.columns if c not in ("text", "n_chars"))
        assert r.text in own.text and r.n_chars == len(r.text)
        taken[r["_id"]] += len(r.text.split())
    # No row is taken more than twice, repeated ones included, and a source's words meet its target.
    words = {i: len((r.text or "").split()) for i, r in of_row.items()}
    assert all(n <= 2 * words[i] for i, n in taken.items())
    found, picks = (df.collect() for df in mixing.mix(docs, shard_slots=100))
    by_source = Counter()
    for i, n in taken.items():
        by_source[of_row[i].source] += n
    for name, target in {(r.source, r.target) for r in found}:
        assert by_source[name] == pytest.approx(target, rel=0.02, abs=2)
    # Every slot of every shard holds the same documents' words as the picks say, in order.
    want, got = defaultdict(list), defaultdict(list)
    for p in sorted(picks, key=lambda p: p.place):
        want[p.shard, p.slot].append((p.place, p.doc_id, p.words))
    for r in sorted(out, key=lambda r: r["place_"]):
        got[r["shard_"], r["slot_"]].append((r["place_"], r.doc_id, len(r.text.split())))
    assert got == want
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [(1, " ", None, "a", 0), (2, None, None, None, None)])).count() == 0


def test_mixed_rows_stand_in_the_order_of_shards(spark):
    docs = frame(spark, mixture_rows())
    out = mixing.mixed_documents(docs, shard_slots=20, places=True)
    parts = out.rdd.glom().map(lambda rows: [(r.shard, r.slot, r.place) for r in rows]).collect()
    assert len(parts) > 3 and [x for p in parts for x in p] == sorted(x for p in parts for x in p)
    assert mixing.mixed_documents(docs, shard_slots=20).columns == docs.columns


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(frame(spark, [(i, "a b", None, f"s{i}", 1) for i in range(4)]))


def test_likeness_follows_the_texts(spark):
    rng = random.Random(7)
    rows = [(i * 3, prose(rng, rng.randrange(40, 400)), "en", "a", 1) for i in range(120)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "x", None, None, None), (1003, "a b c", None, None, None)]
    out = sorted(fingerprints.edit_likeness(frame(spark, rows, extra=True)).collect(), key=lambda r: r.doc_id)
    ordered = sorted(rows)
    assert [r.doc_id for r in out] == [r[0] for r in ordered]
    for k, r in enumerate(out):
        text, following = ordered[k][1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(changed.encode()).hexdigest()
        mine, other, after = (fingerprints.weighted_fingerprints([t]) for t in (text, changed, following))
        assert r.fingerprint == fingerprints.hex_digits(mine)[0] and r.edited_fingerprint == fingerprints.hex_digits(other)[0]
        assert r.near_edited == pytest.approx(fingerprints.likeness(mine, other)[0])
        assert r.near_next == pytest.approx(fingerprints.likeness(mine, after)[0])
    assert np.mean([r.near_edited for r in out[:120]]) > 0.4 > 0.2 > np.mean([r.near_next for r in out[:120]])


def test_one_document_is_its_own_next(spark):
    out = fingerprints.edit_likeness(frame(spark, [(5, "some words here", "en", "a", 1)])).collect()
    assert out[0].near_next == 1.0 and out[0].n_chars == 15
    assert fingerprints.edit_likeness(frame(spark, [])).count() == 0
    repeated = fingerprints.edit_likeness(frame(spark, documents(10))).collect()
    assert len(repeated) == len(documents(10))


def test_fingerprints_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 3000)]
    whole = fingerprints.weighted_fingerprints(texts)
    monkeypatch.setattr("inkwell.llm.simhash.SLICE", 64)
    assert (fingerprints.weighted_fingerprints(texts) == whole).all()
    assert (fingerprints.weighted_fingerprints([texts[5]]) == whole[5]).all()


@pytest.mark.parametrize("full", [20_000, 3])
@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_near_classes_match_brute_force(spark, radius, full):
    rng = random.Random(10)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(128)
        for _ in range(4):
            values.add(base ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(0, 5))))
    hot = rng.getrandbits(128)
    values |= {hot ^ (1 << b) for b in range(40)}
    hexes = sorted(f"{v:032x}" for v in values)
    rows = spark.createDataFrame([(h,) for h in hexes + hexes[:5] + hexes[:5]] + [(None,)], "fingerprint string")
    want, todo = {}, set(hexes)
    for h in hexes:
        if h in todo:
            edge = group = {h}
            while edge:
                todo -= edge
                edge = {x for x in todo if any((int(x, 16) ^ int(y, 16)).bit_count() <= radius for y in edge)}
                group = group | edge
            want |= dict.fromkeys(group, h)
    got = {r.fingerprint: (r.near_class, r.rows) for r in fingerprints.near_classes(rows, radius, full=full).collect()}
    assert got == {h: (c, 3 if h in hexes[:5] else 1) for h, c in want.items()}
    assert fingerprints.near_classes(rows.where("false"), radius).count() == 0


def reference_print(text):
    """The 128 votes of a text's runs of five words, one term and one bit at a time."""
    distinct = Counter(fingerprints.term_hashes(text).tolist())
    out = 0
    for half in (0, 1):
        for bit in range(64):
            vote = 0.0
            for h, n in distinct.items():
                h = h if not half else int(fingerprints.mix64(np.array([h], np.uint64) ^ fingerprints._SECOND)[0])
                vote += (1 + math.log(n)) * (1 if h >> bit & 1 else -1)
            out |= (vote > 1e-9) << (64 * (1 - half) + bit)
    return f"{out:032x}"


def test_fingerprints_match_a_plain_vote():
    rng = random.Random(21)
    texts = [prose(rng, n) for n in (0, 1, 5, 6, 30, 80)] + ["a b c d e " * 9, "Ä ß\tx y\x0bz w " * 3]
    assert fingerprints.hex_digits(fingerprints.weighted_fingerprints(texts)) == [reference_print(t) for t in texts]
    # Terms are the runs themselves: a word more, a changed word or other white space.
    terms = lambda t: fingerprints.term_hashes(t).tolist()
    assert terms("a b c d e") == terms(" A\tb c\nd  e ") != terms("a b c d f") and len(terms("a b c d e f")) == 2


def test_fingerprints_frame(spark):
    out = fingerprints.fingerprints(frame(spark, documents(10), extra=True)).collect()
    by_text = defaultdict(set)
    for r, row in zip(sorted(out, key=str), sorted(out, key=str), strict=True):
        by_text[r.fingerprint].add(row.doc_id)
    assert len(out) == len(documents(10)) and all(len(r.fingerprint) == 32 for r in out)
