"""Op 9. Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Text is lower-cased (A-Z) and every other ASCII character outside a-z and 0-9 becomes a space; words are what stands
between spaces. Each window of `width` consecutive item words is a pattern, one symbol a word. A text's words are scanned
once; matches are ranges of word numbers, and those map to byte offsets of the original.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import staged, text_bytes

WIDTH = 10
#: Windows in one automaton (some 600 bytes each). More windows are scanned in as many passes as they need.
WINDOWS = 100_000
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalised(data: bytes) -> list[bytes]:
    return data.translate(_KEEP).split()


def item_windows(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Matcher:
    """One automaton whose symbols are words: each word of the windows is a character, any other word is NUL."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.symbols: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        for words, items in windows.items():
            key = "".join([self.symbols.setdefault(w, self._symbol(len(self.symbols))) for w in words])
            self.machine.add_word(key, (len(words), tuple(sorted(items))))
        if windows:
            self.machine.make_automaton()

    @staticmethod
    def _symbol(k: int) -> str:
        return chr(k + 1 if k + 1 < 0xD800 else k + 0x801)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of word numbers (end exclusive) covered by matches, and the items matched."""
        if not words or not len(self.machine):
            return [], set()
        get = self.symbols.get
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for at, (n, own) in self.machine.iter("".join([get(w, "\0") for w in words])):
            items.update(own)
            start, end = at + 1 - n, at + 1
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, end))
        return ranges, items


def byte_ranges(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of ranges of word numbers."""
    is_word = np.frombuffer(data.translate(_KEEP), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def item_blocks(benchmark: DataFrame, width: int = WIDTH, windows: int = WINDOWS) -> Iterator[tuple[bytes, bool]]:
    """Pickled windows of the items with the items that have them, at most `windows` at a time, and whether they are the last.
    Tasks build the automaton; the driver holds two blocks at most."""
    before: bytes | None = None
    own: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, data in benchmark.select(F.col("item_id").cast("string"), text_bytes()).filter(F.col("item_id").isNotNull()).toLocalIterator():
        for w in item_windows(normalised(bytes(data)), width):
            own.setdefault(w, set()).add(item_id)
            if len(own) >= windows:
                if before is not None:
                    yield before, False
                before, own = pickle.dumps(own), {}
    if own or before is None:
        if before is not None:
            yield before, False
        before = pickle.dumps(own)
    yield before, True


_loaded: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    data = shared.value
    key = hashlib.md5(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Matcher(pickle.loads(data))
    return _loaded[key]


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, ranges (merged word ranges as little-endian pairs of 64-bit numbers), offsets (the same ranges as byte
    offsets in the original text) and items of every row of docs."""
    spark = docs.sparkSession
    # A later pass adds to the ranges of the pass before it; between passes the table is written, so one automaton is held.
    table = docs.select("doc_id", "text", F.lit(b"").alias("ranges"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for block, last in item_blocks(benchmark, width, windows):
        shared = spark.sparkContext.broadcast(block)
        schema = f"doc_id long, {'offsets binary' if last else 'text string'}, ranges binary, items array<string>, n_words long"

        def one_pass(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    out_ranges, out_items, out_n, out_offsets = [], [], [], []
                    for data, before, own in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
                        words = normalised(data or b"")
                        ranges, items = matcher.scan(words)
                        if before:
                            ranges = _merged([*ranges, *map(tuple, np.frombuffer(before, "<i8").reshape(-1, 2).tolist())])
                        out_ranges.append(np.array(ranges, "<i8").tobytes())
                        out_items.append(sorted(items.union(own)))
                        out_n.append(len(words))
                        if last:
                            out_offsets.append(np.array(byte_ranges(data, ranges) if ranges else [], "<i8").tobytes())
                    made = {"doc_id": batch.column("doc_id")} | ({"offsets": pa.array(out_offsets, pa.binary())} if last else {"text": batch.column("text")})
                    yield pa.RecordBatch.from_pydict(made | {"ranges": pa.array(out_ranges, pa.binary()), "items": pa.array(out_items, pa.list_(pa.string())), "n_words": pa.array(out_n, pa.int64())})

        table = table.mapInArrow(one_pass, schema)
        if not last:
            table = staged(table, "contamination-pass")
    return table


def hit_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """doc_id, start and end (exclusive) of each hit as byte offsets in the original UTF-8 text, and the items of the document.
    Clean rows give none; null, repeated and other rows as in contamination()."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("offsets").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            both = np.concatenate([np.empty((0, 2), np.int64), *own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("items").take(at)], ["doc_id", "start", "end", "items"])

    return hits(docs, benchmark, width, windows).select("doc_id", "offsets", "items").mapInArrow(spread, "doc_id long, start long, end long, items array<string>")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """One row for every row of docs.

    A null or empty text has no words and is clean; a long text is scanned whole, its words in memory at once; repeated rows are
    judged each for itself; items without words or without item_id match nothing; repeated items count once for each item_id;
    an empty benchmark leaves all documents clean; an empty table gives an empty one; other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [int(np.diff(np.frombuffer(x, "<i8").reshape(-1, 2)).sum()) for x in batch.column("ranges").to_pylist()]
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(map(len, items), pa.int64()),
                "items_sha256": pa.array((hashlib.sha256(",".join(x).encode()).hexdigest() for x in items), pa.string()), "contaminated": pa.array((n > 0 for n in n_hit), pa.bool_()),
            })

    return hits(docs, benchmark, width, windows).mapInArrow(digest, HITS)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """The rows of docs without any hit, with their own columns, whatever their names. Null, empty, long and repeated texts,
    items and empty tables as in contamination()."""
    kept = docs
    for block, last in item_blocks(benchmark, width, windows):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
                yield batch.filter(pa.array([not matcher.scan(normalised(x.as_py() or b""))[0] for x in texts], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
        if not last:
            kept = staged(kept, "contamination-pass")
    return kept
