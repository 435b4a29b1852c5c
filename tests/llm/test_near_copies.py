"""The pipeline's near-dedup against Jaccard similarity by brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from findling.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common, either = sets[a] & sets[b], sets[a] | sets[b]
            if 5 * len(common) >= 4 * len(either) and 5 * common.total() >= 4 * either.total():
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    best = {}
    for k, (doc_id, _) in enumerate(rows):
        best[root(k)] = min(best.get(root(k), doc_id), doc_id)
    return sorted(best.values())


def kept(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def pair(rng, common, own, other):
    """Two texts that have so many shingles in common and of their own."""
    base = words(rng, common + 4)
    return " ".join(base + words(rng, own)), " ".join(base + words(rng, other))


def test_every_pair_at_the_threshold_is_found(spark):
    rng, rows = random.Random(1), []
    for common, own, other in [(4, 0, 1), (4, 1, 0), (8, 1, 1), (80, 10, 10), (80, 0, 20), (400, 50, 50)] * 10:
        rows += [(len(rows) + k, t) for k, t in enumerate(pair(rng, common, own, other))]
    want = list(range(0, len(rows), 2))
    assert kept_by_brute_force(rows) == want and kept(spark, rows) == want


def many(rng):
    """Texts of many lengths on both sides of the threshold, short ones, equal ones, and such that share a passage."""
    texts = [None, "", " ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    for _ in range(60):
        n = rng.choice([3, 5, 6, 9, 20, 60, 200])
        base = words(rng, n)
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(n)] = words(rng, 1)[0]
            texts.append(" ".join(text + words(rng, rng.choice([0, 1, 2]))))
    return texts


@pytest.mark.parametrize(("few", "heavy"), [(12, 8), (2, 2), (2, 1 << 30)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, few, heavy):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CELL", 1 << 16 if few > 2 else 8)
    monkeypatch.setattr(simhash, "LEAST", heavy)
    rng = random.Random(2)
    passage = words(rng, 30)
    # A chain, in which only neighbours are similar, and texts that share a passage and no more.
    line, chain = words(rng, 160), []
    for k in range(30):
        chain.append(" ".join(line[k * 2 : k * 2 + 60]))
    texts = many(rng) + chain + [" ".join(passage + words(rng, rng.randint(0, 20))) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_repeats_and_pairs_under_the_threshold_are_not_linked(spark):
    rng, texts = random.Random(3), []
    for _ in range(3):
        line = words(rng, 34) * 20
        texts += [" ".join(words(rng, 300) + line) for _ in range(2)]
    for common, own, other in [(300, 50, 50), (79, 10, 10), (4, 1, 1)] * 5:
        texts += pair(rng, common, own, other)
    rows = list(enumerate(texts))
    assert kept(spark, rows) == list(range(len(rows))) == kept_by_brute_force(rows)


def test_near_copies_do_not_depend_on_the_number_of_documents(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for _ in range(10):
        rows += [(len(rows) + k, t) for k, t in enumerate(pair(rng, 80, 10, 10))]
    monkeypatch.setattr(type(spark.range(0)), "count", lambda self: 1 << 40)  # as many as it may be told
    assert kept(spark, rows) == list(range(0, len(rows), 2))


def test_frequent_shingles_share_no_cell():
    import numpy as np

    rng = np.random.default_rng(5)
    passage = np.sort(rng.integers(0, 1 << 40, 30, dtype=np.uint64))  # the least hashes of all
    sets = [np.sort(np.concatenate([passage, rng.integers(1 << 41, 1 << 63, 70, dtype=np.uint64)])) for _ in range(50)]
    assert len({x for s in sets for x in simhash.prefix(s, passage).tolist()}) == 50 * 21
    assert {len(simhash.prefix(s, passage[:0])) for s in sets} == {21}


def test_a_large_group_sends_rows_in_proportion(spark, monkeypatch):
    """One cell of one group of near copies, and a few rows of other groups: parts hold each row once, and the few in each."""
    monkeypatch.setattr(simhash, "CELL", 50)
    for n in (200, 2000):
        rows = [(1, k, 10, 10, bytes(64), 0 if k < n else k) for k in range(n + 3)]
        cells = spark.createDataFrame(rows, "cell long, node long, n long, m long, bits binary, component long")
        parts = -(-(n + 3) // 50)
        assert simhash.parted(cells).count() == n + 3 * parts
        assert simhash.parted(cells.drop("component")).count() == n + 3 + parts - 1
        links = simhash.pairs_in(cells.drop("component"))
        assert links.count() == n + 2


def test_temporary_tables_go(spark, tmp_path):
    from findling.llm import common

    before = {p for p in __import__("pathlib").Path(common.shared_dir(spark).removeprefix("file://")).rglob("*.parquet")}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], SCHEMA)
    out = simhash.one_of_each(docs)
    left = {p.parent.name.rsplit("-", 1)[0] for p in __import__("pathlib").Path(common.shared_dir(spark).removeprefix("file://")).rglob("*.parquet") if p not in before}
    assert left == {"rows", "groups"} and out.count() == 2


def test_rows_do_not_grow_with_pairs(spark, monkeypatch):
    """Nearly all pairs of a group pass sizes and parities, and few are similar: no table lists them."""
    cells = spark.createDataFrame([(1, k, 10, 10, bytes(64), k) for k in range(200)], "cell long, node long, n long, m long, bits binary, component long")
    assert simhash.pairs_in(cells).count() == 199
    rng, made, staged = random.Random(6), {}, simhash.staged
    base, texts = words(rng, 1004), []
    for k in range(40):
        text = list(base)
        for i in rng.sample(range(100), 15):  # each changes five shingles
            text[i * 10 + 2] = f"own{k}x{i}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))

    def counted(df, name, last=False):
        out = staged(df, name, last)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    assert kept(spark, rows) == kept_by_brute_force(rows)
    assert len(kept_by_brute_force(rows)) > 20 and made["texts"] == 40
    assert all(n <= 80 for name, n in made.items() if name != "cells")


@pytest.mark.parametrize("distance", [4, 12])
def test_near_dedup_comes_through_the_grid_of_fingerprints(spark, monkeypatch, distance):
    rng, seen = random.Random(7), {}
    texts = many(rng) + [x for _ in range(5) for x in pair(rng, 300, 2, 2)]
    rows, linked_prints = list(enumerate(texts)), simhash.linked_prints

    def spied(prints, n_prints, d):
        seen["prints"] = {r.w0 for r in prints.collect()}
        out = linked_prints(prints, n_prints, d)
        seen["linked"] = {r.node: r.component for r in out.collect()}
        return out

    monkeypatch.setattr(simhash, "linked_prints", spied)
    monkeypatch.setattr(simhash, "DISTANCE", distance)
    assert kept(spark, rows) == kept_by_brute_force(rows)
    prints = [int.from_bytes(simhash.fingerprint((t or "").encode(), 5), "little", signed=True) for t in texts]
    assert seen["prints"] == set(prints)
    near = {(a, b) for a in seen["prints"] for b in seen["prints"] if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert near and set(seen["linked"]) == {x for p in near for x in p} and all(seen["linked"][a] == seen["linked"][b] for a, b in near)
