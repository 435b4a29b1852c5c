"""Op 7. Exact substring dedup by fixed-block anchors.

A window of `width` words that occurs twice holds, in either place, a whole block of (width + 1) // 2 words that starts at a
multiple of that length in its document. So the non-overlapping blocks of all documents are indexed, and every rolling
window of block length is probed against the index; a block hash that also occurs elsewhere is an anchor. Anchors are
extended: each window of `width` words that holds one is compared, by a 64-bit and another 32-bit hash of its words, with all
such windows, and those that occur twice make up the maximal exact repeats. Their union is what gets removed.

Hashes travel as sorted, difference-coded lists, one for each pair of document batch and hash range, so an exchange costs
a few bytes a word and no key's rows meet in one task: a window occurs once in a batch's list, however frequent it is.
Batches and ranges grow with the square root of the input, so the number of lists grows in proportion to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from findling.llm.common import U64, mix, pack_sorted, spans, text_bytes, unpack_sorted, volume

WIDTH = 35
#: UTF-8 bytes of one batch of documents, on average, and of the texts whose windows meet in one hash range, at the least; and
#: of texts for each list of hashes, beyond which batches and ranges grow: 0.2 and 0.5 GB of text at 100 TB.
BATCH_BYTES, RANGE_BYTES, LIST_BYTES = 4 << 20, 12 << 20, 1024
#: Bits of a probe beyond those that number the blocks: one probe in 2**SPARE_BITS is an anchor by chance, and then no repeat.
SPARE_BITS = 12
#: Multipliers of the rolling sums, the second for the further 32 bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_REMEMBERED = 300_000
LISTS = "batch long, bucket int, data binary"
FOUND = "batch long, data binary"
REMOVED = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
SPANS = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("end", LongType())])


class WordHashes(dict):
    """63-bit hashes of words; a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 7) >> 1
        return found


_hashes = WordHashes()


def word_hashes(data: bytes) -> np.ndarray:
    parts = []
    for part in spans(data):
        words = part.split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)))
    return (parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)).view(U64)


class Batch:
    """Word hashes of some documents one after another, and hashes of their rolling windows."""

    def __init__(self, texts: list[bytes | None]) -> None:
        own = [word_hashes(x or b"") for x in texts]
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(own) if own else np.empty(0, U64)
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.words))  # words from here to the document's end
        self.sums = {0: self._sums(0)}

    def _sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words times the powers of a base, and the inverse powers."""
        n = len(self.words)
        powers = np.full(n + 1, U64(_BASES[k]), U64)
        powers[0] = 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.words * np.cumprod(powers, dtype=U64)[:n], dtype=U64, out=sums[1:])
        powers[1:] = U64(pow(_BASES[k], -1, 1 << 64))
        return sums, np.cumprod(powers, dtype=U64)

    def hashes(self, at: np.ndarray, width: int, k: int = 0) -> np.ndarray:
        if k not in self.sums:
            self.sums[k] = self._sums(k)
        sums, back = self.sums[k]
        return mix((sums[at + width] - sums[at]) * back[at])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows that lie in one document."""
        at = np.flatnonzero(self.left >= width)
        return at, self.hashes(at, width)

    def more(self, at: np.ndarray, width: int) -> np.ndarray:
        """32 bits of another hash of the windows that start there."""
        return (self.hashes(at, width, 1) >> U64(32)).astype(np.uint32)

    def aligned(self, at: np.ndarray, width: int) -> np.ndarray:
        """Whether starts are multiples of the width in their document."""
        return (np.arange(len(self.words)) - np.repeat(self.starts, self.sizes))[at] % width == 0

    def covered(self, starts: np.ndarray, width: int) -> np.ndarray:
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, starts + width, 1)
        return np.cumsum(edge)[:-1] > 0


def _is_in(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """wanted: ascending."""
    if not len(wanted):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(wanted, hashes)
    at[at == len(wanted)] = 0
    return wanted[at] == hashes


def _are_in(hashes: np.ndarray, more: np.ndarray, wanted: np.ndarray, wanted_more: np.ndarray) -> np.ndarray:
    """Whether pairs (hash, more) are wanted; wanted: ascending, perhaps with equal hashes one after another."""
    out = np.zeros(len(hashes), bool)
    if not len(wanted):
        return out
    at = np.searchsorted(wanted, hashes)
    left = np.flatnonzero(at < len(wanted))
    left = left[wanted[at[left]] == hashes[left]]
    while len(left):
        out[left] |= wanted_more[at[left]] == more[left]
        at[left] += 1
        left = left[at[left] < len(wanted)]
        left = left[wanted[at[left]] == hashes[left]]
    return out


def _firsts(hashes: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """Where sorted hashes, or pairs, differ from the one before."""
    new = hashes[1:] != hashes[:-1]
    if more is not None:
        new |= more[1:] != more[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _order(hashes: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    return np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))


def _sealed(flags: np.ndarray, hashes: np.ndarray, more: np.ndarray | None) -> bytes:
    parts = [zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes()), b"" if more is None else more.tobytes()]
    return b"".join([*(len(x).to_bytes(4, "little") for x in parts), *parts, pack_sorted(hashes)])


def _opened(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Flags (as many rows), hashes and further bits of a list."""
    n, m = (int.from_bytes(data[k : k + 4], "little") for k in (0, 4))
    hashes = unpack_sorted(data[8 + n + m :])
    flags = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]), np.uint8), count=rows * len(hashes)).astype(bool)
    return flags.reshape(rows, len(hashes)), hashes, np.frombuffer(data[8 + n : 8 + n + m], np.uint32) if m else None


def _lists(batch: int, hashes: np.ndarray, more: np.ndarray | None, marked: np.ndarray, buckets: int, bits: int) -> pa.RecordBatch | None:
    """Rows of LISTS: ascending different hashes of each range, which of them occur twice here, and which are marked."""
    if not len(hashes):
        return None
    order = _order(hashes, more)
    hashes, marked = hashes[order], marked[order]
    more = None if more is None else more[order]
    first = _firsts(hashes, more)
    twice = np.diff(np.append(first, len(hashes))) > 1
    marked = np.logical_or.reduceat(marked, first)
    hashes, more = hashes[first], None if more is None else more[first]
    bucket = ((hashes >> U64(bits - 32)) * U64(buckets) >> U64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    rows = [_sealed(np.stack([twice[a:b], marked[a:b]]), hashes[a:b], None if more is None else more[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"batch": pa.array([batch] * len(rows), pa.int64()), "bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "data": pa.array(rows, pa.binary())})


def _repeated(rows: pa.Table) -> pa.Table:
    """For one hash range: the hashes that occur twice at least and are marked somewhere, for each batch that has them."""
    batches = rows.column("batch").to_numpy()
    flags, parts, further = zip(*(_opened(x.as_py(), 2) for x in rows.column("data")), strict=True)
    source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    values, more = np.concatenate(parts), None if further[0] is None else np.concatenate(further)
    twice, marked = np.concatenate(flags, axis=1)
    order = _order(values, more)
    values, source, more = values[order], source[order], None if more is None else more[order]
    first = _firsts(values, more)
    sizes = np.diff(np.append(first, len(values)))
    hot = ((sizes > 1) | np.logical_or.reduceat(twice[order], first)) & np.logical_or.reduceat(marked[order], first)
    keep = np.flatnonzero(np.repeat(hot, sizes))
    keep = keep[np.argsort(source[keep], kind="stable")]
    owners, cuts = np.unique(source[keep], return_index=True)
    none = np.empty((0, 0), bool)
    found = [_sealed(none, values[x], None if more is None else more[x]) for x in np.split(keep, cuts[1:])] if len(owners) else []
    return pa.table({"batch": pa.array(batches[owners], pa.int64()), "data": pa.array(found, pa.binary())})


def _wanted(found: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """All hashes of the lists, ascending, with their further bits."""
    parts = [_opened(x.as_py(), 0) for x in found.column("data")]
    if not parts:
        return np.empty(0, U64), np.empty(0, np.uint32)
    hashes = np.concatenate([x for _, x, _ in parts])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], None if parts[0][2] is None else np.concatenate([x for _, _, x in parts])[order]


def _slices(rows: pa.Table, limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Runs of rows of about `limit` bytes of text, or one longer row."""
    sizes = np.cumsum([len(x) for x in rows.column("text").cast(pa.large_binary()).to_pylist()])
    start = 0
    while start < rows.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield rows.slice(start, end - start)
        start = end


def sizes_of(size: int) -> tuple[int, int]:
    """Bytes of a batch and of a range for a table of so many bytes of text."""
    grown = max(1.0, (size * LIST_BYTES / (BATCH_BYTES * RANGE_BYTES)) ** 0.5)
    return int(BATCH_BYTES * grown), int(RANGE_BYTES * grown)


def with_repeats(docs: DataFrame, keys: list[str], make, schema: StructType, width: int = WIDTH) -> DataFrame:
    """For each run of documents: make(rows, batch, covered), as a record batch of `schema`.

    covered says of each word of the run whether a repeated window holds it. Documents are dealt once to small batches, at
    random; the three passes read that same exchange.
    """
    spark = docs.sparkSession
    n, size = volume(docs)
    batch_bytes, range_bytes = sizes_of(size)
    batches = max(1, -(-size // batch_bytes))
    buckets = max(1, -(-size // range_bytes))
    block = (width + 1) // 2
    bits = min(64, max(40, (size // (4 * block) + 1).bit_length() + SPARE_BITS))
    parts = max(1, min(batches, max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches // 4)))
    slim = docs.select(*keys, text_bytes().alias("text"))
    dealt = slim.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))).repartition(parts, "batch")
    shift = U64(64 - bits)

    def probes(rows: pa.Table) -> pa.Table:
        hashes, marked = [np.empty(0, U64)], [np.empty(0, bool)]
        for run in _slices(rows):
            b = Batch(run.column("text").to_pylist())
            at, own = b.windows(block)
            hashes.append(own >> shift)
            marked.append(b.aligned(at, block))
        out = _lists(rows.column("batch")[0].as_py(), np.concatenate(hashes), None, np.concatenate(marked), buckets, bits)
        return pa.Table.from_batches([out]) if out else _EMPTY

    def extend(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return _EMPTY
        anchors, hashes, more = _wanted(found)[0], [np.empty(0, U64)], [np.empty(0, np.uint32)]
        for run in _slices(rows):
            b = Batch(run.column("text").to_pylist())
            at, own = b.windows(block)
            hit = np.zeros(len(b.words) + 1, np.int32)
            hit[at[_is_in(own >> shift, anchors)] + 1] = 1
            hit = np.cumsum(hit)
            at = np.flatnonzero(b.left >= width)
            at = at[hit[at + width - block + 1] > hit[at]]
            hashes.append(b.hashes(at, width))
            more.append(b.more(at, width))
        hashes = np.concatenate(hashes)
        out = _lists(rows.column("batch")[0].as_py(), hashes, np.concatenate(more), np.ones(len(hashes), bool), buckets, 64)
        return pa.Table.from_batches([out]) if out else _EMPTY

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        repeated = _wanted(found)
        out = []
        for run in _slices(rows):
            b = Batch(run.column("text").to_pylist())
            at, hashes = b.windows(width)
            near = _is_in(hashes, repeated[0])
            at, hashes = at[near], hashes[near]
            out.append(make(run, b, b.covered(at[_are_in(hashes, b.more(at, width), *repeated)] if len(at) else at, width)))
        return pa.Table.from_batches(out) if out else to_arrow_schema(schema).empty_table()

    grouped = dealt.groupBy("batch")
    anchors = grouped.applyInArrow(probes, LISTS).groupBy("bucket").applyInArrow(_repeated, FOUND)
    repeats = grouped.cogroup(anchors.groupBy("batch")).applyInArrow(extend, LISTS).groupBy("bucket").applyInArrow(_repeated, FOUND)
    return grouped.cogroup(repeats.groupBy("batch")).applyInArrow(finish, schema)


_EMPTY = pa.table({"batch": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})


def _kept(data: bytes, gone: np.ndarray) -> bytes:
    """Words that stay, joined by single spaces."""
    out, at = [], 0
    for part in spans(data):
        words = part.split()
        flags = gone[at : at + len(words)]
        at += len(words)
        out += [w for w, x in zip(words, flags.tolist(), strict=True) if not x] if flags.any() else words
    return b" ".join(out)


def removed_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs.

    A null text has no words; a text of fewer than `width` words loses nothing; rows repeated whole lose all windows, as
    every window occurs elsewhere; a null doc_id is kept; a long text is read a bounded run of words at a time, but its hashes
    (8 bytes a word) are held together; an empty table gives an empty one; other columns are ignored.
    """

    def make(run: pa.Table, b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        removed, digests = [], []
        for data, a, n in zip(run.column("text").to_pylist(), b.starts.tolist(), b.sizes.tolist(), strict=True):
            own = gone[a : a + n]
            removed.append(int(own.sum()))
            digests.append(hashlib.sha256(_kept(data, own)).hexdigest())
        return pa.RecordBatch.from_pydict({"doc_id": run.column("doc_id").combine_chunks(), "n_words": pa.array(b.sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return with_repeats(docs, ["doc_id"], make, REMOVED, width)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Maximal repeats: doc_id, start and end (exclusive) as word numbers. Rows without a repeat give none, null and short texts
    among them; rows of one doc_id give theirs each; an empty table gives none; other columns are ignored."""

    def make(run: pa.Table, b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        ids, starts, ends = [], [], []
        for doc_id, a, n in zip(run.column("doc_id").to_pylist(), b.starts.tolist(), b.sizes.tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a : a + n], [False]]).astype(np.int8)))
            ids += [doc_id] * (len(edges) // 2)
            starts += edges[::2].tolist()
            ends += edges[1::2].tolist()
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})

    return with_repeats(docs, ["doc_id"], make, SPANS, width)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with texts cut: a text that loses words becomes its other words joined by single spaces; n_chars follows it.

    Null texts and texts of fewer than `width` words stay as they are; a text that loses all words becomes empty; rows
    repeated whole lose all their windows, each of them; long texts are cut like others; an empty table gives an empty one;
    other columns, whatever their names, are kept.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    types = {n: docs.schema[c].dataType for n, c in zip(names, docs.columns, strict=True)}
    text, size = names[docs.columns.index("text")], names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    # The text itself travels as bytes, in its own column only whether it is null.
    slim = docs.toDF(*names).withColumn("text", F.col(text).cast("string")).withColumn(text, F.col(text).isNull())

    def make(run: pa.Table, b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        texts, sizes = [], run.column(size).to_pylist() if size else []
        for k, (data, is_null, a, n) in enumerate(zip(run.column("text").to_pylist(), run.column(text).to_pylist(), b.starts.tolist(), b.sizes.tolist(), strict=True)):
            if gone[a : a + n].any():
                data = _kept(data, gone[a : a + n])
                if size:
                    sizes[k] = len(data.decode())
            texts.append(None if is_null else data)
        made = {n: run.column(n).combine_chunks() for n in names} | {text: pa.array(texts, pa.binary()).cast(pa.string())}
        if size:
            made[size] = pa.array(sizes).cast(run.column(size).type)
        return pa.RecordBatch.from_pydict(made)

    schema = StructType([StructField(n, types[n]) for n in names])
    return with_repeats(slim, names, make, schema, width).toDF(*docs.columns)
