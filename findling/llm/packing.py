"""Op 5. Best-two-fit packing of documents into sequences of bounded length.

Documents longer than a sequence are cut; every other piece stays whole. A bin is filled greedily with the longest pieces
that fit; then, as long as it helps, its shortest piece is replaced by two unpacked pieces that fit the gap so widened more
tightly. Equal lengths are interchangeable, so a group of pieces is packed from the counts of its lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import staged
from findling.llm.encoding import default_vocabulary, encoder

CAPACITY = 4096
END_ID = 1
#: Pieces packed by one task. Each group ends with at most a few loose bins, so larger groups waste less.
GROUP = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pack_counts(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Bins of lengths, each of at most `capacity` in sum, that use every length as often as counted."""
    left = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    order = sorted(left)

    def take(k: int) -> None:
        left[k] -= 1
        if not left[k]:
            del left[k]
            order.pop(bisect_right(order, k) - 1)

    def give(k: int) -> None:
        if k not in left:
            insort(order, k)
            left[k] = 0
        left[k] += 1

    def best_two(room: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum in (least, room]."""
        best, found = least, None
        low, high = 0, bisect_right(order, room - 1) - 1
        while low <= high:
            a, b = order[low], order[high]
            if a + b > room or (low == high and left[a] < 2):
                high -= 1
                continue
            if a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return found

    bins = []
    while order:
        own, gap = [], capacity
        while order and (k := bisect_right(order, gap)):
            size = order[k - 1]
            take(size)
            own.append(size)
            gap -= size
        while gap and order and len(own) > 1:
            smallest = own[-1]  # filled from the longest down, and what comes later is kept in order
            pair = best_two(gap + smallest, smallest)
            if pair is None:
                break
            own.pop()
            for x in pair:
                take(x)
            give(smallest)
            gap += smallest - sum(pair)
            own = sorted([*own, *pair], reverse=True)
        bins.append(own)
    return bins


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    values, counts = np.unique(lengths, return_counts=True)
    queues = {int(v): list(x) for v, x in zip(values, np.split(np.argsort(lengths, kind="stable"), np.cumsum(counts)[:-1]), strict=True)} if len(values) else {}
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, own in enumerate(pack_counts({int(v): int(c) for v, c in zip(values, counts, strict=True)}, capacity)):
        at = 0
        for size in own:
            k = queues[size].pop()
            where[k], offset[k] = number, at
            at += size
    return where, offset


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; with_ids adds the ids (4 bytes each)."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, n, start, len(part), zlib.crc32(part.data), *([part.tobytes()] * with_ids)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(table: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces are dealt to groups of about `group` by a hash; each group is packed by one task, from five numbers a piece.
    """
    groups = max(1, round(table.count() / group))

    def one(rows: pa.Table) -> pa.Table:
        where, offset = assign(rows.column("length").to_numpy(), capacity)
        base = rows.column("_group")[0].as_py() << 32
        return rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    dealt = table.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(one, PACKED)


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; one row for each piece.

    A null or empty text is the end id alone; a long text is cut into pieces, its ids in memory at once; a null doc_id is kept;
    repeated rows are packed each for itself; an empty table gives none; other columns are ignored.
    """
    return pack(staged(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (4 bytes each, at most `capacity`). Null, long and repeated texts, null
    keys and empty tables as in packed_documents()."""
    cut = staged(pieces(docs, vocabulary, capacity, with_ids=True), "pieces")
    placed = pack(cut.drop("ids"), capacity)
    keys = ["doc_id", "piece", "ids_crc32"]
    held = cut.select(*(F.col(k).alias(f"_{k}") for k in keys), "ids").dropDuplicates([f"_{k}" for k in keys])
    on = F.col("piece").eqNullSafe(F.col("_piece")) & F.col("ids_crc32").eqNullSafe(F.col("_ids_crc32")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = placed.join(held, on)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
