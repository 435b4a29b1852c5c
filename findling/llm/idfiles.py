"""Op 4. Token-id files: fixed-size id blocks transposed into bit or byte planes, each plane compressed by zstandard.

File layout: magic, the planes of block 0, 1, ..., the document table, the index, the index's size (8 bytes), magic.
The index is JSON: id width, plane kind, ids in each block, the size of every plane, the document table's size. Blocks hold
BLOCK ids but the last; the document table is the doc_ids (8 bytes each) and lengths (8 bytes each), compressed.
A file holds the documents of one doc_id range in ascending order; the manifest lists the files in order.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findling.llm.common import fresh_path, staged, volume
from findling.llm.encoding import default_vocabulary, encoder

MAGIC = b"FINDIDS1"
BLOCK = 1 << 16
END_ID = 1
#: UTF-8 bytes of text for one file.
FILE_BYTES = 32 << 20
MANIFEST = "part int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """Planes of a block, most significant last. Bit plane 8*j+k holds bit k of byte j of every id."""
    cells = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "bit":
        cells = np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little")
        return [x.tobytes() for x in cells]
    return [x.tobytes() for x in np.ascontiguousarray(cells.T)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view(f"<u{width}").ravel().astype("<u4")


class Writer:
    def __init__(self, out, width: int, kind: str = "byte") -> None:
        if width not in (1, 2, 4) or kind not in ("bit", "byte"):
            raise ValueError("width is 1, 2 or 4; kind is bit or byte")
        self.out, self.width, self.kind = out, width, kind
        self.packer = zstandard.ZstdCompressor(level=1)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[int] = []
        self.sizes: list[list[int]] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.packer.compress(x) for x in to_planes(ids, self.width, self.kind)]
        for x in planes:
            self.out.write(x)
        self.blocks.append(len(ids))
        self.sizes.append([len(x) for x in planes])

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            joined = np.concatenate(self.held)
            full = len(joined) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(joined[at : at + BLOCK])
            self.held, self.n_held = [joined[full:]], len(joined) - full

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        table = self.packer.compress(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.out.write(table)
        index = json.dumps({"width": self.width, "kind": self.kind, "blocks": self.blocks, "planes": self.sizes, "table": len(table)}).encode()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to the blocks of a file through its index."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size() if hasattr(source, "size") else source.seek(0, io.SEEK_END)
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not an id file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        index = json.loads(self._at(size - 16 - n, n))
        self.width, self.kind, self.blocks, self.sizes = index["width"], index["kind"], index["blocks"], index["planes"]
        self.starts = np.cumsum([len(MAGIC), *(sum(x) for x in self.sizes)]).tolist()
        table = zstandard.ZstdDecompressor().decompress(self._at(self.starts[-1], index["table"]))
        both = np.frombuffer(table, "<i8")
        self.doc_ids, self.lengths = both[: len(both) // 2], both[len(both) // 2 :]

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        data = self._at(self.starts[k], sum(self.sizes[k]))
        planes, at = [], 0
        for n in self.sizes[k]:
            planes.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
            at += n
        return from_planes(planes, self.blocks[k], self.width, self.kind)

    def documents(self) -> Iterator[tuple[int, int, int, int]]:
        """doc_id, start in the file, length and checksum of each document, one block in memory at a time."""
        block, at, start, k = np.empty(0, "<u4"), 0, 0, 0
        for doc_id, length in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            crc, left = 0, length
            while left:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                part = block[at : at + left]
                crc = zlib.crc32(part.data, crc)
                at += len(part)
                left -= len(part)
            yield doc_id, start, length, crc
            start += length


def write_id_files(docs: DataFrame, path: str, vocabulary: str | None = None, kind: str = "byte", end_id: int = END_ID) -> DataFrame:
    """Encodes docs(doc_id, text) into id files under `path`, a URI that all executors reach; returns the manifest.

    One shuffle, by doc_id ranges. A task writes a file under a name of its own and then renames it, so that a repeated
    task leaves the same file.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume(docs)[1] // FILE_BYTES))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    ranged = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(path)
        enc = encoder(vocabulary)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end, writer, draft = np.array([end_id], "<u4"), None, f"{folder}/.draft-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(draft)
                writer = Writer(out, width, kind)
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for doc_id, ids in zip(piece.column(0).to_pylist(), enc.batch(piece.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            name = f"ids-{part:06d}.bin"
            store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{path}/{name}"], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    return staged(ranged.mapInArrow(write, MANIFEST), "id-manifest")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of every document, from the files alone."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    rows = list(Reader(f).documents())
                ids, starts, lengths, crcs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": np.array(starts, np.int64) + base, "n_tokens": lengths, "ids_crc32": pa.array(crcs, pa.int64())})

    return files.repartition(n, "part").mapInArrow(read, ROWS)


def id_file_table(docs: DataFrame, vocabulary: str | None = None, kind: str = "byte") -> DataFrame:
    """Writes all documents into id files and returns what the files hold of each.

    A null or empty text is the end id alone; a long text runs over as many blocks as it needs; rows without doc_id have no
    place in the order and are left out; repeated doc_ids follow one another in the order of their texts; an empty table gives
    no file and no row; other columns are ignored.
    """
    path = fresh_path(docs.sparkSession, "id-files")
    return read_id_files(write_id_files(docs, path, vocabulary, kind))
