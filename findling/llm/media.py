"""Op 8. Media columns: 8-bit grey PNG in binary columns, and perceptual hashes of its low cosine frequencies.

The codec is written out here: chunks with CRC-32 checks, zlib streams, and all five row filters undone with numpy. The writer
takes, for each image, that filter of none, left and above whose residues have the least absolute sum.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from findling.llm.common import text_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A payload is padded to a multiple of UNIT bytes by PAD, and shown WIDTH samples wide.
UNIT, PAD, WIDTH = 576, 255, 24
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    if kind == 1:
        return np.concatenate([image[:, :1], image[:, 1:] - image[:, :-1]], axis=1)
    if kind == 2:
        return np.concatenate([image[:1], image[1:] - image[:-1]])
    return image


def encode_png(image: np.ndarray, row_filter: int | None = None, level: int = 6) -> bytes:
    """PNG of an (h, w) array of uint8, with filter 0 (none), 1 (left) or 2 (above) on every row: by default the one whose
    residues, as signed numbers, have the least absolute sum, of equal ones the first."""
    h, w = image.shape
    if row_filter is None:
        row_filter = min(range(3), key=lambda kind: int(np.abs(_filtered(image, kind).view(np.int8).astype(np.int16)).sum()))
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = row_filter, _filtered(image, row_filter)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes any filters: a sample needs those to its left, above and between, which lie on the two diagonals before its own."""
    h, w = rows.shape
    out = np.zeros((h + 1, w + 1), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = rows[y, x] + np.choose(kinds[y], [np.zeros_like(left), left, up, (left + up) // 2, nearest]) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The (h, w) samples of an 8-bit grey PNG without interlace; ValueError for damaged or other data."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts = 8, None, []
    while True:
        if at + 12 > len(data):
            raise ValueError("cut short")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey without interlace")
    w, h = head[:2]
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != h * (w + 1):
        raise ValueError("wrong amount of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if (kinds > 2).any():
        return _by_diagonals(kinds, out)
    out[kinds == 1] = np.cumsum(out[kinds == 1], axis=1, dtype=np.uint8)
    if (kinds == 2).any():
        turns = np.flatnonzero(np.diff(kinds)) + 1
        for a, b in zip([0, *turns], [*turns, h], strict=True):
            if kinds[a] == 2:
                above = out[a - 1] if a else np.zeros(w, np.uint8)
                out[a:b] = np.cumsum(np.concatenate([above[None], out[a:b]]), axis=0, dtype=np.uint8)[1:]
    return out


def _cosines(n: int) -> np.ndarray:
    k, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_BASIS = _cosines(WIDTH)[:8]


def _shrunk(image: np.ndarray) -> np.ndarray:
    """Sums of WIDTH equal shares of the rows; a row between two shares counts in both by its parts."""
    edges = np.arange(WIDTH + 1) * image.shape[0] / WIDTH
    total = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    low = edges.astype(np.int64)
    at = total[low] + (edges - low)[:, None] * (total[np.minimum(low + 1, len(total) - 1)] - total[low])
    return np.diff(at, axis=0)


def cosine_hash(image: np.ndarray) -> str:
    """64-bit hash of an image of any size: averaged to 24 by 24, its 8 by 8 lowest cosine terms against their median without
    the mean term."""
    small = _shrunk(image)
    if image.shape[1] != WIDTH:
        small = _shrunk(small.T).T
    terms = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def as_image(data: bytes) -> np.ndarray:
    """Bytes padded to a positive multiple of UNIT, as rows of WIDTH samples."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return np.frombuffer(data + bytes([PAD]) * (size - len(data)), np.uint8).reshape(-1, WIDTH)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG of each text's bytes in a binary column, one row for every row of docs.

    A null text counts as empty and is one unit of padding; a long text is one tall image, in memory at once; a null doc_id is
    kept; an empty table gives an empty one; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([encode_png(as_image(x)) for x in texts], pa.binary())})

    return docs.select("doc_id", text_bytes().alias("data")).mapInArrow(encode, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Decodes the stored column, with all checks, and computes digests and the cosine hash, for every row of media.

    Of a null or damaged image all that follows from its samples is null, media_bytes and media_sha256 too if it is null; an
    empty table gives an empty one; other columns are ignored.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    try:
                        image = decode_png(data or b"")
                    except (ValueError, struct.error, zlib.error):
                        rows.append((doc_id, n, None, None, None, *stored, None))
                        continue
                    payload = image.tobytes()
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, cosine_hash(image)))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, FEATURES)
