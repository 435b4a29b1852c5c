"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, by brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from findling.llm import decontamination, idfiles, language, media, packing, pieces, sharding, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, cell int"


@pytest.fixture(scope="module")
def rows():
    words = [f"w{k}" for k in range(400)]
    base, shared = " ".join(words[:90]), " ".join(words[200:250])
    texts = [base, base, base.replace("w5 ", "zz "), None, "", " \n", f"start {shared} end", f"other\t{shared}\nlast one", "Ä ß é", "x " * 30_000 + shared, "short text", "short text", "123 456"]
    return [(k, t, "en" if k % 2 else "de", "s", len(t or ""), "b", 1) for k, t in enumerate(texts)] + [(None, base, None, None, None, None, None), (2, "again", "en", None, 5, "b", 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty, rows):
    got = {(r.doc_id, r.n_words) for r in pieces.token_counts(docs).collect()}
    assert got == {(r[0], len((r[1] or "").split())) for r in rows}
    assert pieces.token_counts(empty).count() == 0


def test_language(docs, empty, rows):
    out = language.identified(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out if r.doc_id is not None}
    assert by[3] == by[4] == by[12] == "und"
    assert language.identified(empty).count() == 0
    assert {r.lang_pred for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sharding(spark, docs, empty, rows):
    out = sharding.shard_table(docs).collect()
    assert len(out) == len(rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    many = sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", [1, 1, 2], [1, 1, 2, 1]).groupBy("shard", "grown_shard").count().collect()
    assert all(r.grown_shard in (r.shard, 3) for r in many)
    share = Counter()
    for r in many:
        share[r.shard] += r["count"]
    assert abs(share[2] / 20_000 - 0.5) < 0.02
    assert sharding.shard_table(empty).count() == 0


def test_id_files(docs, empty, rows):
    from findling.llm.encoding import Encoder, default_vocabulary

    enc = Encoder(default_vocabulary())
    want, at = [], 0
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        n = len(enc.ids(text)) + 1
        want.append((doc_id, at, n))
        at += n
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in idfiles.id_file_table(docs).collect())
    assert got == sorted(want)
    assert idfiles.id_file_table(empty).count() == 0


def test_packing(docs, empty, rows):
    out = packing.packed_documents(docs).collect()
    assert sum(r.piece == 0 for r in out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed_documents(empty).count() == 0
    assert packing.sequences(docs).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * sum(r.length for r in out)


def test_toxicity(spark, docs, empty):
    bad = [(100 + k, f"you awful muppet number {k} here", 1) for k in range(60)]
    good = [(200 + k, f"a kind person number {k} here", 0) for k in range(90)]
    own = spark.createDataFrame([(a, b) for a, b, _ in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in bad + good], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(own, labels).collect()}
    assert all(out[a].predicted == c for a, _, c in bad + good)
    assert toxicity.without_toxic(own, labels).count() == 90
    assert toxicity.scored(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.scored(empty, labels).count() == 0


def test_substrings(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 200)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1000)
    own = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in own for i in range(len(w) - 34))
    want = []
    for doc_id, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((doc_id if doc_id is not None else -1, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_table(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.removed_table(empty).count() == 0
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[6] == "start end"
    assert substrings.repeated_spans(docs).filter("doc_id = 6").first()[1:] == (1, 51)


def test_media(docs, empty, rows):
    out = media.media_features(media.media_table(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next((x[1] or "").encode() for x in rows if x[0] == r.doc_id and len((x[1] or "").encode()) == r.n_bytes)
        size = max(576, -(-len(text) // 576) * 576)
        assert r.payload_sha256 == hashlib.sha256(text + b"\xff" * (size - len(text))).hexdigest()
    assert media.media_features(media.media_table(empty)).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(7, " ".join(f"W{k}" for k in range(3, 20))), (1, "short text"), (9, ""), (4, None), (None, "x x")], "item_id long, text string")
    for windows in (100_000, 2):
        out = {r.doc_id: r for r in decontamination.contamination(docs, items, windows=windows).filter("doc_id is not null and doc_id <> 2").collect()}
        assert (out[0].n_hit, out[0].n_items, out[0].contaminated) == (17, 1, True)
        assert out[10].items_sha256 == hashlib.sha256(b"1").hexdigest() and out[10].n_hit == 2
        assert not out[3].contaminated and out[3].n_words == 0 and not out[6].contaminated
    assert decontamination.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, items.limit(0)).collect())
    kept = decontamination.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and {0, 1, 10, 11}.isdisjoint(r.doc_id for r in kept.collect())


def test_simhash(docs, empty, rows):
    import numpy as np

    prints = [int.from_bytes(simhash.fingerprint((r[1] or "").encode()), "little") for r in rows]
    f = np.array(prints, np.uint64)
    above = list(range(len(f)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4), strict=True):
        a, b = root(int(a)), root(int(b))
        above[max(a, b)] = min(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    want = sorted((str(r[0]), f"{prints[k]:016x}", least.get(root(k))) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and None not in ids and {6, 8, 9} <= set(ids)
    assert 7 not in ids  # 46 of its 50 shingles are those of 6


def test_large_cells_are_split(docs, monkeypatch):
    whole = sorted((r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "CELL", 2)
    assert sorted((r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == whole


def test_lists_grow_with_the_input():
    for a, b in ((10**11, 10**12), (10**12, 10**14)):
        lists = [(size / substrings.sizes_of(size)[0]) * (size / substrings.sizes_of(size)[1]) for size in (a, b)]
        assert 0.9 < lists[1] / lists[0] / (b / a) < 1.1
    assert substrings.sizes_of(10**8) == (substrings.BATCH_BYTES, substrings.RANGE_BYTES)


def test_lists_in_spark_grow_with_the_input(spark, monkeypatch):
    """Counts the rows that the first exchange holds at two sizes."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 4000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4000)
    monkeypatch.setattr(substrings, "LIST_BYTES", 1000)
    counts = []
    for n in (60, 960):
        texts = [" ".join(f"w{(k * 7919 + i * 104729) % 1000003}" for i in range(150)) for k in range(n)]
        size = sum(map(len, texts))
        batch, bucket = substrings.sizes_of(size)
        run = -(-size // batch)
        per = -(-n // run)
        rows = 0
        for b in range(run):
            own = substrings.Batch([t.encode() for t in texts[b * per : (b + 1) * per]])
            _, hashes = own.windows(18)
            out = substrings._lists(b, hashes, None, hashes == hashes, -(-size // bucket), 64)
            rows += out.num_rows if out else 0
        counts.append(rows / n)
    assert counts[1] < 2 * counts[0]


def test_windows_of_equal_first_hashes_are_told_apart():
    import numpy as np

    h, m = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint32)
    asked = np.array([5, 5, 5, 9, 8, 10], np.uint64)
    assert substrings._are_in(asked, np.array([2, 1, 7, 3, 3, 3], np.uint32), h, m).tolist() == [True, True, False, True, False, False]
    lists = [substrings._lists(k, np.array([5, 7], np.uint64) << np.uint64(60), np.array([k, 4], np.uint32), np.ones(2, bool), 1, 64) for k in (1, 2)]
    import pyarrow as pa

    found = substrings._repeated(pa.Table.from_batches(lists))
    assert [substrings._wanted(found.slice(k, 1))[0].tolist() for k in range(2)] == [[7 << 60]] * 2
