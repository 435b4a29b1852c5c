"""Every column of the queries that SQL cannot express, by brute force; the pipeline from end to end; clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findling.llm import decontamination, encoding, language, media, pieces, queries, sharding, simhash, substrings, toxicity

LONG = 1 << 20


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    own = {"en": "the river and a small stone house near old town".split(), "de": "der kleine fluss und das alte haus bei dem stein".split()}
    texts = []
    for k in range(40):
        lang = "en" if k % 2 else "de"
        texts.append((k, " ".join(rng.choices(own[lang], k=rng.randint(1, 400))), lang))
    texts += [(40, None, "en"), (41, "", "de"), (42, " 12 ?!", None), (43, texts[3][1], "en"), (44, "ünßeen wörter ﬁn", None), (45, "word-piece, " * (LONG // 10), None)]
    return texts


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(encoding.default_vocabulary())
    return {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t, _ in rows}


def test_op1_counts_greedy_pieces(spark, sf_dir, rows):
    own, known = set(pieces.entries(encoding.default_vocabulary())), {}
    longest = max(map(len, own))

    def greedy(word):
        if word not in known:
            symbols, at, n = (*word, pieces.END), 0, 0
            while at < len(symbols):
                at = next(end for end in range(min(len(symbols), at + longest), at, -1) if symbols[at:end] in own)
                n += 1
            known[word] = n
        return known[word]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op1_token_counts(spark, sf_dir).collect()}
    for k, text, _ in rows:
        words = (text or "").encode().lower().split()
        assert got[k] == (len(words), sum(map(greedy, words)))


def test_op2_scores_by_backoff(spark, sf_dir, rows):
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k, _, _ in rows}
    counts = {}
    for k, text, lang in rows:
        if lang and not held[k]:
            for word in language.words_of(text):
                for n in range(6):
                    counts.setdefault(lang, [Counter() for _ in range(6)])[n].update(language.grams(word, n))
    langs = sorted(counts)

    def cost(gram, n, lang):
        own = counts[lang][n]
        return min(language.PENALTY, -math.log10(own[gram] / own.total())) if own[gram] else language.PENALTY

    def of_word(word):
        for n in (0, 5, 4, 3, 2, 1):
            found = [g for g in language.grams(word, n) if any(counts[x][n][g] for x in langs)]
            if found:
                return [sum(cost(g, n, x) for g in found) / len(found) for x in langs]
        return [language.PENALTY] * len(langs)

    for r in queries.op2_language_id(spark, sf_dir).collect():
        words = language.words_of(dict((k, t) for k, t, _ in rows)[r.doc_id])
        assert r.held_out == held[r.doc_id]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        by = {w: of_word(w) for w in set(words)}
        mean = [sum(by[w][k] for w in words) / len(words) for k in range(len(langs))]
        best = mean.index(min(mean))
        assert r.lang_pred == langs[best]
        assert r.score == pytest.approx(1 / sum(10 ** (-min(len(words), 10) * (m - mean[best])) for m in mean), rel=1e-6)


def test_op4_files_hold_the_library_ids(spark, sf_dir, rows, ids):
    at, want = 0, []
    for k, _, _ in rows:
        want.append((k, at, len(ids[k]), zlib.crc32(ids[k].tobytes())))
        at += len(ids[k])
    assert sorted(tuple(r) for r in queries.op4_bitplane_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op5_pieces_hold_the_library_ids(spark, sf_dir, ids):
    out = queries.op5_best_two_fit(spark, sf_dir).collect()
    want = sorted((k, n, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for k, x in ids.items() for n, at in enumerate(range(0, len(x), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    total = sum(map(len, ids.values()))
    assert len(by) <= 1.05 * total / 4096 + 2


def labelled(spark):
    bad = [(1000 + k, f"you awful muppet number {k} here, m\u0443pp3t", 1) for k in range(60)]
    good = [(2000 + k, f"a kind person number {k} here with muppetry", 0) for k in range(90)]
    return spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b, _ in bad + good], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(a, 0, c) for a, _, c in bad + good], "doc_id long, quality int, toxic int")


def test_op6_scores_by_plain_counts(spark, rows):
    docs, labels = labelled(spark)
    lexicon = toxicity.learn(docs, labels.filter(~toxicity.held_out()))
    assert lexicon.scale in toxicity.SCALES and lexicon.terms
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in every.collect()}
    for r in toxicity.score(every, lexicon).collect():
        text, n = toxicity.folded(texts[r.doc_id])
        x = lexicon.bias
        for term, w in zip(lexicon.terms, lexicon.weights.tolist(), strict=True):
            hits = sum(text.startswith(term, k) for k in range(len(text))) if term in text else 0
            x += w * min(hits, toxicity.MOST_COUNT) / (1 + math.log1p(n / lexicon.scale))
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op6_labels_that_disagree_and_repeated_rows(spark):
    docs, labels = labelled(spark)
    whole = toxicity.learn(docs, labels)
    mixed = labels.unionByName(labels.filter("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(labels.limit(5).withColumn("toxic", F.lit(None).cast("int")))
    again = toxicity.learn(docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat(F.lit("\uffff"), "text"))), mixed)
    assert whole.terms == again.terms and np.allclose(whole.weights, again.weights)
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs.withColumn("text", F.lit(None).cast("string")), labels).count() == docs.count()


def test_regression_finds_the_minimum():
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 3, (200, 6)).astype(float)
    y, own = (rng.random(200) < 0.4).astype(float), rng.random(200) + 0.5
    row, column = np.nonzero(dense)
    w, bias, _ = toxicity.regression(toxicity.Sparse(row, column, dense[row, column], 200, 6), y, own)
    p = 1 / (1 + np.exp(-(dense @ w + bias)))
    assert np.abs(dense.T @ (own * (p - y)) + w).max() < 1e-3 and abs((own * (p - y)).sum()) < 1e-3


def plain_hash(image):
    """Cosine hash by the definition, with loops."""
    h, w = image.shape
    small = [[0.0] * 24 for _ in range(24)]
    for a in range(24):
        for b in range(24):
            for y in range(a * h // 24, min(h, (a + 1) * h // 24 + 1)):
                part = min(y + 1, (a + 1) * h / 24) - max(y, a * h / 24)
                small[a][b] += max(0.0, part) * float(image[y, b])
    terms = [round(sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 48) * math.cos(math.pi * v * (2 * x + 1) / 48) for y in range(24) for x in range(24)), 4) for u in range(8) for v in range(8)]
    middle = sorted(terms[1:])[31]
    return sum(1 << (63 - k) for k, t in enumerate(terms) if t > middle)


def test_op8_columns(spark, sf_dir, rows):
    docs = queries.table(spark, sf_dir, "documents")
    stored = {r.doc_id: bytes(r.media) for r in media.media_table(docs).collect()}
    texts = {k: (t or "").encode() for k, t, _ in rows}
    for r in queries.op8_media_png(spark, sf_dir).collect():
        payload = texts[r.doc_id] + b"\xff" * (max(576, -(-len(texts[r.doc_id]) // 576) * 576) - len(texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        if r.doc_id < 6 or r.doc_id == 41:
            assert bin(int(r.feature, 16) ^ plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 24))).count("1") <= 1  # rounding at the median
    assert {media.decode_png(x).shape[1] for x in stored.values()} == {24}


def test_op8_filters_and_bad_rows(spark):
    import struct

    rng = np.random.default_rng(1)
    smooth = np.cumsum(rng.integers(0, 3, (30, 17)), axis=1).astype(np.uint8)
    for image in (smooth, smooth.T.copy(), rng.integers(0, 256, (5, 40), dtype=np.uint8), np.full((1, 1), 255, np.uint8)):
        assert (media.decode_png(media.encode_png(image)) == image).all()
        assert len(media.cosine_hash(image)) == 16
    kinds = [media.decode_png(media.encode_png(x)) is not None and __import__("zlib").decompress(media.encode_png(x)[41:-16])[0] for x in (smooth, smooth.T.copy())]
    assert kinds == [1, 2]
    # Every row with another filter, by the format's definition.
    raw, before = b"", np.zeros(17, int)
    for y, line in enumerate(smooth.astype(int)):
        kind, out = y % 5, []
        for x in range(17):
            left, corner = (line[x - 1], before[x - 1]) if x else (0, 0)
            p = left + before[x] - corner
            guess = (0, left, before[x], (left + before[x]) // 2, min((left, before[x], corner), key=lambda v: abs(p - v)))[kind]
            out.append(int(line[x] - guess) % 256)
        raw, before = raw + bytes([kind, *out]), line
    head = media._chunk(b"IHDR", struct.pack(">IIBBBBB", 17, 30, 8, 0, 0, 0, 0))
    assert (media.decode_png(media.SIGNATURE + head + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")) == smooth).all()
    good = media.encode_png(smooth)
    bad = spark.createDataFrame([(1, 5, bytearray(good)), (2, 5, None), (3, 5, bytearray(good[:-20])), (4, 5, bytearray(b"x")), (5, 5, bytearray(good[:45] + b"!!" + good[47:]))], "doc_id long, n_bytes long, media binary")
    out = {r.doc_id: r for r in media.media_features(bad.withColumn("more", F.lit(1))).collect()}
    assert out[1].feature and out[2].media_bytes is None and all(out[k].payload_sha256 is None and out[k].feature is None for k in (2, 3, 4, 5))
    assert out[4].media_bytes == 1


def test_op9_spans_are_bytes_of_the_original(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa"
    text = f"é intro {item.upper().replace(' ', '  ')}! the end"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "end")], "item_id long, text string")
    for windows in (100_000, 1):
        got = sorted((r.start, r.end, r["items"]) for r in decontamination.hit_spans(docs, bench, windows=windows).collect())
        assert [(text.encode()[a:b].decode(), x) for a, b, x in got] == [(item.upper().replace(" ", "  "), ["8", "9"]), ("end", ["8", "9"])]
    assert decontamination.hit_spans(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["_row", "_kept", "shard", "grown_shard", "node", "w0", "cell", "component", "first", "batch", "n", "data", "toxic", "_HASH", "slot"])
def test_clashing_names_keep_their_values(spark, name):
    shared = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a {shared} b", 77), (2, f"c d {shared} e f", 78), (3, "x", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` long")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    want = {r[0]: r[2] for r in rows}
    for out in (substrings.without_repeats(docs), decontamination.remove_contaminated(docs, bench)):
        assert out.columns == docs.columns
        assert all(r[name] == want[r.doc_id] for r in out.collect())
    if name in ("_row", "component", "node"):
        assert {r.doc_id: r[name] for r in simhash.one_of_each(docs).collect()} == {1: 77, 3: None}
    if name == "_HASH":
        placed = sharding.numbered(docs.withColumn("shard", F.lit(0)), "doc_id").collect()
        assert sorted(r.slot for r in placed) == [0, 1, 2] and {r.doc_id: r[name] for r in placed} == want


def test_write_shards_keeps_a_column_of_that_name(spark, tmp_path):
    docs = spark.range(50).selectExpr("id AS doc_id", "id AS shard", "id AS grown_shard")
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", [1, 1])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("shard = doc_id and grown_shard = doc_id and shard_ in (0, 1)").count() == 50


def test_empty_tables_through_the_stages(spark, sf_dir):
    docs, labels = labelled(spark)
    none = docs.limit(0)
    assert simhash.one_of_each(none).count() == substrings.without_repeats(none).count() == toxicity.without_toxic(none, labels).count() == 0
    assert decontamination.remove_contaminated(none, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_pipeline_from_end_to_end(spark, tmp_path, ids):
    rng = random.Random(11)
    words = lambda n: " ".join(f"v{rng.randrange(10**8)}" for _ in range(n))
    docs, labels = labelled(spark)
    near, passage, item = words(100), words(60), words(15)
    own = [(1, near), (2, f"{near} more"), (3, f"{words(200)} {passage} {words(200)}"), (4, f"{words(200)} {passage} {words(200)}"), (5, f"{words(20)} {item} {words(9)}"), (6, None), (7, ""), (8, words(9000)), (9, "you awful muppet")]
    docs.unionByName(spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in own], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, table = str(tmp_path), queries.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.staged(stage(spark, table, d), "test")
        seen[name] = table
        if name != "best_fit_packing":
            assert table.columns == docs.columns
    left = {name: {r.doc_id for r in t.filter("doc_id < 1000").collect()} for name, t in seen.items()}
    assert left["toxicity"] == {1, 2, 3, 4, 5, 6, 7, 8} and seen["toxicity"].filter("doc_id between 1000 and 1999").count() == 0
    assert left["simhash_near_dedup"] == {1, 3, 4, 5, 6, 8}
    cut = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert passage.split()[0] not in cut[3].text and len(cut[3].text.split()) == 400 and cut[3].n_chars == len(cut[3].text) and cut[6].text is None
    assert left["decontamination"] == {1, 3, 4, 6, 8} == left["best_fit_packing"]
    out = corpus_pipeline.run(spark, d)
    assert sorted(tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(tuple(r) for r in seen["best_fit_packing"].select("doc_id", "piece", "start", "length", "ids_crc32").collect())
