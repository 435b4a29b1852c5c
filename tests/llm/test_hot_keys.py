"""Joins in which some keys hold very many rows."""

import random

import pytest

from findling.llm import common, simhash


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_labelled_equals_a_join(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "TASK", 2)
    rows = [(1, k) for k in range(20)] + [(2, k) for k in range(5)] + [(3, 0), (4, 0), (5, 0)]
    names = {1: "one", 2: None, 3: "three", 4: None}
    labels = spark.createDataFrame([(k, v, sum(r[0] == k for r in rows)) for k, v in names.items()], "key long, name string, n_rows long")
    got = common.labelled(spark.createDataFrame(rows, "key long, value long"), labels, "key", len(rows))
    assert got.columns == ["key", "value", "name"]
    assert sorted((r.key, r.value, str(r.name)) for r in got.select("key", "value", "name").collect()) == sorted((k, v, str(names[k])) for k, v in rows if k in names)


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_components_of_hubs_and_chains(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "TASK", 2)
    rng = random.Random(3)
    links = [(500, k) for k in range(501, 600)] + [(k, k + 1) for k in range(0, 60)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)]
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in {y for a, b in links if a != b for y in (a, b)})
    rng.shuffle(links)
    got = simhash.components(spark.createDataFrame(links, simhash.LINKS))
    assert sorted((r.node, r.component) for r in got.collect()) == want


def test_most_rows_of_one_print(spark, monkeypatch):
    rows = [(k, "the same text of six words") for k in range(40)] + [(40 + k, f"an own text {k} of words {k * k}") for k in range(10)] + [(None, "only without a key at all")]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    for hot in (1, 3, 10_000):
        monkeypatch.setattr(common, "HOT", hot)
        monkeypatch.setattr(common, "TASK", 2)
        found.append(sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all(c == "0" for d, _, c in found[0] if d != "None" and int(d) < 40)
