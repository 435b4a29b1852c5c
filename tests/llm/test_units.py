"""Parts of the operators without Spark, against plain definitions."""

import random
import zlib

import numpy as np
import pytest

from findling.llm import decontamination, encoding, idfiles, language, media, packing, pieces, simhash, toxicity


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = encoding.default_vocabulary()
    enc, lib = encoding.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    signs = [*"ab'sC_t  \n\t\r\x1c\x85É1²ﬁ<>.!ßİſ×ĲÀ́%#", "<|endoftext|>", "'ll", "Don't"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(1500)]
    for text, ids in zip(texts, enc.batch(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, text
    assert enc.ids(None).tolist() == []


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_id_file_round_trip(tmp_path, kind, width):
    rng = np.random.default_rng(2)
    docs = [(k, rng.integers(0, 1 << 15, n).astype("<u4")) for k, n in enumerate([0, 1, 7, idfiles.BLOCK, 3 * idfiles.BLOCK + 5, 2])]
    path = tmp_path / "x.bin"
    with path.open("wb") as f:
        w = idfiles.Writer(f, width, kind)
        for k, ids in docs:
            w.add(k, ids)
        w.close()
    with path.open("rb") as f:
        got = list(idfiles.Reader(f).documents())
    starts = np.cumsum([0] + [len(x) for _, x in docs])
    assert got == [(k, int(s), len(x), zlib.crc32(x.tobytes())) for (k, x), s in zip(docs, starts, strict=False)]
    with path.open("rb") as f, pytest.raises(ValueError):
        idfiles.Reader(__import__("io").BytesIO(f.read()[:-9]))


def test_packing_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4097, 3000), np.full(50, 4096), np.array([], np.int64), np.array([3000, 1096] * 20)):
        where, offset = packing.assign(lengths, 4096)
        for b in np.unique(where):
            own = where == b
            order = np.argsort(offset[own])
            assert (offset[own][order] == np.cumsum(lengths[own][order]) - lengths[own][order]).all()
            assert lengths[own].sum() <= 4096
        n = len(np.unique(where))
        assert n <= np.ceil(lengths.sum() / 4096) * 1.02 + 2


def test_automaton_counts_greedy_pieces():
    rng = random.Random(4)
    entries = sorted({tuple(rng.choices([97, 98, 99], k=rng.randint(1, 5))) + (pieces.END,) * rng.randint(0, 1) for _ in range(40)} | {(b,) for b in (97, 98, 99, pieces.END)})
    own, auto = set(entries), pieces.Automaton(entries)
    for _ in range(2000):
        word = bytes(rng.choices([97, 98, 99], k=rng.randint(0, 12)))
        symbols, at, n = (*word, pieces.END), 0, 0
        while at < len(symbols):
            end = len(symbols)
            while symbols[at:end] not in own:
                end -= 1
            at, n = end, n + 1
        assert auto.count(word) == n


def test_fingerprint_majority():
    import xxhash

    text = b"One two three four FIVE six  seven\n eight"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(5)]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 5)
    assert int.from_bytes(simhash.fingerprint(text), "little") == want
    assert simhash.fingerprint(None) == bytes(8)
    assert int.from_bytes(simhash.fingerprint(b"A b"), "little") == xxhash.xxh64_intdigest(b"a b", 42)


def test_near_connects_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for b in base for _ in range(20)], np.uint64).reshape(-1, 1)
    got = _groups(len(prints), simhash.near(prints, 6))
    x, y = np.nonzero(np.bitwise_count(prints[:, 0][:, None] ^ prints[:, 0][None, :]) <= 6)
    assert got == _groups(len(prints), list(zip(x.tolist(), y.tolist(), strict=True)))


def _groups(n, links):
    above = list(range(n))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_png_round_trip_and_checks():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (48, 24), dtype=np.uint8)
    for row_filter in (0, 1, 2):
        data = media.encode_png(image, row_filter)
        assert (media.decode_png(data) == image).all()
        with pytest.raises(ValueError):
            media.decode_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    import struct

    for kind in (3, 4):  # filtered by the format's definition, one sample at a time
        rows, before = [], np.zeros(24, int)
        for row in image.astype(int):
            out = [kind]
            for x in range(24):
                left, corner = (row[x - 1], before[x - 1]) if x else (0, 0)
                if kind == 3:
                    guess = (left + before[x]) // 2
                else:
                    p = left + before[x] - corner
                    guess = min((left, before[x], corner), key=lambda v: abs(p - v))
                out.append(int(row[x] - guess) % 256)
            rows.append(bytes(out))
            before = row
        head = media._chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 48, 8, 0, 0, 0, 0))
        data = media.SIGNATURE + head + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")
        assert (media.decode_png(data) == image).all()
    assert media.cosine_hash(image) == media.cosine_hash(image.copy()) and len(media.cosine_hash(image)) == 16


def test_matcher_maps_to_the_original():
    words = decontamination.normalised(b"Alpha, BETA gamma-delta 5 six")
    assert words == [b"alpha", b"beta", b"gamma", b"delta", b"5", b"six"]
    m = decontamination.Matcher({(b"beta", b"gamma"): {"1"}, (b"gamma", b"delta"): {"2"}, (b"six",): {"3"}})
    ranges, own = m.scan(words)
    assert ranges == [(1, 4), (5, 6)] and own == {"1", "2", "3"}
    assert decontamination.byte_ranges(b"Alpha, BETA gamma-delta 5 six", ranges) == [(7, 23), (26, 29)]
    assert decontamination.Matcher({}).scan(words) == ([], set())


def test_folding_and_language_edges():
    assert toxicity.folded("1d10t Ｉdіot  i-d")[0] == toxicity.folded("idiot idiot i d")[0]
    assert toxicity.folded(None) == (" ", 0)
    empty = language.Model([], {}, np.empty((0, 0)))
    assert empty.predict("abc") == ("und", 0.0)
    model = language.Model(["a", "b"], {"0xy": 0, "1z": 1}, np.array([[1.0, 7.0], [7.0, 1.0]]))
    assert model.predict("xy")[0] == "a" and model.predict("zz")[0] == "b" and model.predict("12 !")[0] == "und" and model.predict(None)[0] == "und"
