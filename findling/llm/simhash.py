"""Op 10. SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes the vector of bit counts of its two-bit segments, each 0, 1 or 2, packed in one number. Flipping a bit
moves one count by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints.
The segments are dealt to blocks; fingerprints at most d bits apart differ in the counts of at most d blocks, so they share a
cell, that is the counts of some `blocks - d` blocks. Inside a cell, rows are kept apart that differ by more than d in their
total count, and the rest are compared exactly. Each cell gives links enough to connect what is linked in it, never all
pairs. Equal fingerprints are one point; links are joined to components by rounds of large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import U64, free_name, labelled, mix, passing, spans, staged, text_bytes

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = 32
#: Rows of a cell that are compared in one task; larger cells are dealt to pairs of parts.
CELL = 1 << 16
#: Large cells are joined by broadcast up to so many (20 bytes each).
BROADCAST = 100_000
#: All pairs of a cell of so many rows are compared at once.
FEW = 12
LINKS = "a long, b long"
_HALF = 1 << 15  # shingles summed at once


def shingle_hashes(data: bytes, width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a text, lower-cased in A-Z, a bounded run at a time."""
    carried: list[bytes] = []
    seen = False
    digest = xxhash.xxh64_intdigest
    for part in spans(data.lower()):
        words = carried + part.split()
        n = len(words) - width + 1
        if n > 0:
            seen = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:n - 1]]).tolist()
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), U64, n)
            carried = words[n:]
        else:
            carried = words
    if not seen and carried:
        yield np.array([digest(b" ".join(carried), seed)], U64)


def fingerprint(data: bytes | None, width: int = SHINGLE, words: int = 1, seed: int = SEED) -> bytes:
    """64 * words bits, least significant byte first: bit k is set if over half of the shingle hashes have it set.

    Bits beyond the first 64 come from further mixings of the same hashes. A text without words gives zeros.
    """
    return votes(shingle_hashes(data or b"", width, seed), words)


def votes(runs: Iterable[np.ndarray], words: int = 1) -> bytes:
    """The fingerprint of hashes that come in runs."""
    counts, total = np.zeros(64 * words, np.int64), 0
    for hashes in runs:
        for at in range(0, len(hashes), _HALF):
            part = hashes[at : at + _HALF]
            total += len(part)
            for k in range(words):
                own = part if k == 0 else mix(part + U64(k))
                bits = np.unpackbits(own.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > total, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", width: int = SHINGLE, words: int = 1, seed: int = SEED) -> DataFrame:
    """The key and the print, a column for every 64 bits (w0, w1, ...), of every row of docs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join([fingerprint(x.as_py(), width, words, seed) for x in batch.column(1)]), "<i8").reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(words))], [key, *(f"w{k}" for k in range(words))])

    return docs.select(F.col(key).cast("long").alias(key), text_bytes().alias("data")).mapInArrow(make, f"{key} long" + "".join(f", w{k} long" for k in range(words)))


def block_masks(blocks: int, shared: int) -> list[int]:
    """Masks of two-bit counts, one for each choice of `shared` of `blocks` blocks of segments."""
    edges = [SEGMENTS * k // blocks for k in range(blocks + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(own[k] for k in choice) for choice in combinations(range(blocks), shared)]


def choose_blocks(points: int, distance: int) -> int:
    """Blocks with the least work for so many points: rows to deal against pairs to compare. Results do not depend on it."""

    def work(blocks: int) -> float:
        tables = math.comb(blocks, blocks - distance)
        cells = 2 ** (1.415 * SEGMENTS * (blocks - distance) / blocks)  # a count pair agrees by chance in 3 of 8 cases
        return tables * points * (500 + points / 2 / cells)

    return min(range(distance + 1, min(SEGMENTS, distance + 6) + 1), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect all rows of (n, words) fingerprints linked within `distance`: a forest, never all pairs."""
    n, links = len(prints), []
    if n < 2:
        return links
    total = np.bitwise_count(prints).sum(axis=1, dtype=np.int32)
    order = np.argsort(total, kind="stable")
    prints, total = prints[order], total[order]
    if n <= 512:
        apart = np.bitwise_count(prints[:, None, 0] ^ prints[None, :, 0]).astype(np.int32)
        for k in range(1, prints.shape[1]):
            apart += np.bitwise_count(prints[:, None, k] ^ prints[None, :, k])
        a, b = np.nonzero(np.triu(apart <= distance, 1))
        if len(a) <= n:
            return list(zip(order[a].tolist(), order[b].tolist(), strict=True))
    # Breadth first: what is reached leaves the rest, which each reached row is compared with once, in its range of totals.
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            a = int(np.searchsorted(total[left], total[k] - distance))
            b = int(np.searchsorted(total[left], total[k] + distance, side="right"))
            if a == b:
                continue
            reached = np.bitwise_count(prints[left[a:b]] ^ prints[k]).sum(axis=1, dtype=np.int32) <= distance
            if reached.any():
                found = left[a:b][reached].tolist()
                links += [(int(order[k]), int(order[x])) for x in found]
                queue += found
                left = np.delete(left, a + np.flatnonzero(reached))
    return links


def small_cells(prints: np.ndarray, edges: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs inside the cells of at most `most` rows, all at once; edges are the cells' bounds."""
    sizes = np.diff(edges)
    cell = np.repeat(np.where(sizes <= most, np.arange(len(sizes)), -1), sizes)
    a, b = [], []
    for step in range(1, min(most, int(sizes.max(initial=0)))):
        same = np.flatnonzero((cell[step:] == cell[:-step]) & (cell[step:] >= 0))
        apart = np.bitwise_count(prints[same] ^ prints[same + step]).sum(axis=1, dtype=np.int32)
        hit = same[apart <= distance]
        a.append(hit)
        b.append(hit + step)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def stars(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The links of a forest as stars: each node with the smallest of its tree. Cells that hold the same group then give the
    same links, which count once."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for a, b in pairs:
        a, b = root(int(nodes[a])), root(int(nodes[b]))
        above[max(a, b)] = min(a, b)
    own = [(x, root(x)) for x in above]
    return np.array([r for _, r in own], np.int64), np.array([x for x, _ in own], np.int64)


def dealt(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of cells (keys, node, more) as (cell, node, more), each cell whole in a partition and in a run there."""
    rest = [c for c in cells.columns if c not in keys]
    # Rows of a cell of n rows go to k = ceil(n / CELL) parts, and each pair of parts, also of a part with itself, is a task's.
    large = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > CELL)
    parts = staged(large.select(*keys, F.ceil(F.col("n_rows") / CELL).cast("int").alias("k")), "large-cells")
    n_parts = parts.count()
    if n_parts:
        cells = cells.join(F.broadcast(parts) if n_parts <= BROADCAST else parts, keys, "left")
    else:
        cells = cells.withColumn("k", F.lit(1))
    k = F.coalesce("k", F.lit(1))
    spread = cells.withColumn("own", F.pmod(F.xxhash64("node"), k.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    cell = F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    # Two cells of one hash, if any, are compared as one: more pairs, the same links.
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.select(cell, *rest).repartition(n, "cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells with the cells' bounds, of rows sorted by their first column."""

    def done(found: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(found)
        cell = rows.column(0).to_numpy()
        return rows, np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])

    held: list[pa.RecordBatch] = []
    for batch in batches:  # the last cell of a batch may go on in the next
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != cell[0]:
            yield done(held)
            held = []
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield done([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(held)


def link_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def cell_links(cells: DataFrame, words: int, distance: int) -> DataFrame:
    """Links (node a, node b) inside the cells of rows (c0, c1, node, w0, ...)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_cells(batches):
            nodes = rows.column(1).to_numpy()
            prints = np.stack([rows.column(2 + w).to_numpy() for w in range(words)], axis=1).view(U64)
            x, y = small_cells(prints, edges, distance, FEW)
            a, b = [nodes[x]], [nodes[y]]
            for at in np.flatnonzero(np.diff(edges) > FEW).tolist():
                pairs = near(prints[edges[at] : edges[at + 1]], distance)
                if pairs:
                    x, y = stars(nodes[edges[at] : edges[at + 1]], pairs)
                    a.append(x)
                    b.append(y)
            yield link_batch(a, b)

    return dealt(cells.select("c0", "c1", "node", *(f"w{k}" for k in range(words))), ["c0", "c1"]).mapInArrow(link, LINKS)


def grid_cells(points: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Cells of 64-bit points (node, w0): c0 numbers the choice of blocks, c1 holds the counts of its segments."""
    low, high, odd = F.col("w0"), F.shiftrightunsigned("w0", 1), F.lit(0x5555555555555555)
    counts = F.shiftleft(high.bitwiseAND(low).bitwiseAND(odd), 1).bitwiseOR(high.bitwiseXOR(low).bitwiseAND(odd))
    masks = [F.struct(F.lit(k).alias("c0"), counts.bitwiseAND(F.lit(_signed(m))).alias("c1")) for k, m in enumerate(block_masks(blocks, blocks - distance))]
    return points.select("node", "w0", F.explode(F.array(*masks)).alias("cell")).select("cell.c0", "cell.c1", "node", "w0")


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of links (a, b), by large and small stars.

    Each half round keeps what is connected and hangs rows on smaller nodes; it ends when nothing changes. Every round is
    written to the shared folder, so a lost executor costs a round at most. The rows of a node with very many neighbours
    are not brought together.
    """
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(both, "stars")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        # Large star: each node hangs its larger neighbours on the smallest of itself and all its neighbours.
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n_rows"))
        large = labelled(ways.filter("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node hangs itself and its smaller neighbours on the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows"))
        small = labelled(large, least, "u", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = staged(small, "stars")


def linked_prints(prints: DataFrame, n_prints: int, distance: int) -> DataFrame:
    """node and component of the distinct prints (w0) that are within `distance` of others, by the grid of segment counts."""
    points = prints.select(F.col("w0").alias("node"), "w0")
    return components(cell_links(grid_cells(points, distance, choose_blocks(n_prints, distance)), 1, distance))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs.

    Null texts and texts without words have fingerprint zero and link like any other; rows without doc_id are points that
    may connect others, but name no component (theirs is null if no row of it has a doc_id); rows of equal doc_id take part
    each for itself; long texts are read a bounded run of words at a time; an empty table gives an empty one; other columns are
    ignored.
    """
    prints = staged(fingerprints(docs, "doc_id", width, 1, seed), "prints")
    points = staged(prints.groupBy("w0").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "points").withColumn("node", F.col("w0"))
    n_points, n_rows = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    found = linked_prints(points, n_points, distance)
    grouped = staged(points.join(found, "node", "left").select("w0", "least", "n_rows", F.coalesce("component", "node").alias("component")), "grouped")
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    named = labelled(grouped.select("w0", "component", F.col("n_rows").alias("n")), names, "component", n_points)
    out = labelled(prints, named.select("w0", "component_id", F.col("n").alias("n_rows")), "w0", n_rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar_documents: the least Jaccard similarity of the shingles, P / Q, and the least number of 64-bit words of the parity bits.
P, Q, WORDS = 4, 5, 8
#: Shingles that one in SHARE documents of a run holds, and LEAST at least, come last in the order of the prefixes; the HEAVY
#: most frequent of them are told to every task. Any order gives the same links: this one keeps cells small.
SHARE, LEAST, HEAVY = 500, 8, 100_000
_RUN = 1 << 22  # shingles counted at once
#: Distinct shingles of a cell's rows that are compared in one task, as CELL of its rows.
LOAD = 1 << 20
_NAMES = 1 << 18  # names a task of links_in remembers


def shingle_counts(data: bytes | None, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's distinct shingles, ascending, and how often it holds each."""
    return np.unique(np.concatenate([np.empty(0, U64), *shingle_hashes(data or b"", width, seed)]), return_counts=True)


def prefix(found: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first hashes of a set, in ascending order with the heavy ones (ascending) last; two sets of similarity P / Q or more
    have one in common, as all but these are too few."""
    if not len(found):
        return found
    if len(heavy):
        late = heavy[np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: len(found) + 1 + -P * len(found) // Q]


def heavy_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many documents hold, ascending, HEAVY at most: counted in runs of documents, where only those
    that are frequent in the run leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(run: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, U64), *run]), return_counts=True)
            often = n >= max(LEAST, len(run) // SHARE)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

        for batch in batches:
            run, size = [], 0
            for x in batch.column(0):
                run.append(shingle_counts(x.as_py(), width)[0])
                size += len(run[-1])
                if size > _RUN:
                    yield done(run)
                    run, size = [], 0
            yield done(run)

    counted = docs.select(text_bytes().alias("data")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "shingle").limit(HEAVY).select("shingle").toArrow()
    return np.sort(most.column(0).to_numpy().view(U64))


def parities(found: np.ndarray) -> bytes:
    """Parities of the numbers of hashes in classes, a power of two not under the set's size. Those of two sets differ in no
    more bits than the sets in hashes."""
    width = max(64 * WORDS, 1 << (len(found) - 1).bit_length() if len(found) else 1)
    return np.packbits(np.bincount((found & U64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


class Parities:
    """Parity bits of many rows. Rows of sizes within P / Q of each other have equal widths or one twice the other, which is
    folded then."""

    def __init__(self, bits: list[bytes]) -> None:
        self.width, self.at, self.rows = np.array([len(x) // 8 for x in bits]), np.zeros(len(bits), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w, w] = held = np.frombuffer(b"".join(bits[k] for k in own.tolist()), U64).reshape(-1, w)
            self.rows[w, w // 2] = held[:, : w // 2] ^ held[:, w // 2 :]

    def apart(self, k: int, others: np.ndarray) -> np.ndarray:
        out, w, widths = np.zeros(len(others), np.int64), int(self.width[k]), self.width[others]
        for o in np.unique(widths).tolist():
            at = np.flatnonzero(widths == o)
            out[at] = np.bitwise_count(self.rows[o, min(o, w)][self.at[others[at]]] ^ self.rows[w, min(o, w)][self.at[k]]).sum(axis=1, dtype=np.int64)
        return out


def bits_apart(x: bytes, y: bytes) -> int:
    """The number of differing parities of two rows, the wider folded."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def similar(apart, size):
    """Whether sets that differ in `apart` elements, of `size` together, have similarity P / Q or more."""
    return (P + Q) * apart <= (Q - P) * size


def could_be_similar(n: np.ndarray, bits: Parities, k: int, others: np.ndarray) -> np.ndarray:
    """Those of `others` that by sizes (rows of n: distinct shingles, all) and parities may be similar to k: never fewer than are."""
    others = others[similar(np.abs(n[others] - n[k]), n[others] + n[k]).all(axis=1)]
    return others[similar(bits.apart(k, others), n[others, 0] + n[k, 0])]


class Sets:
    """Shingles of the texts of a group, to be compared as sets and also with as many repeats as the texts have. Without the first
    a passage repeated often would make near copies of texts that share nothing else, without the second one of a short text
    and a long."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        found = [shingle_counts(x, width) for x in texts]
        self.n = np.array([[len(x), c.sum()] for x, c in found], np.int64).reshape(-1, 2)
        self.bits = Parities([parities(x) for x, _ in found])
        self.start = np.cumsum(self.n[:, 0]) - self.n[:, 0]
        self.counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in found)])
        names, self.ids = np.unique(np.concatenate([np.empty(0, U64), *(x for x, _ in found)]), return_inverse=True)
        self.held = np.zeros(len(names), np.int64)

    def near_copies(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that are near copies of k."""
        others = could_be_similar(self.n, self.bits, k, others)
        if not len(others):
            return others
        own = slice(self.start[k], self.start[k] + self.n[k, 0])
        self.held[self.ids[own]] = self.counts[own]
        sizes = self.n[others, 0]  # none is empty: a text without words is similar to no other
        edges = np.cumsum(sizes) - sizes
        at = np.repeat(self.start[others] - edges, sizes) + np.arange(sizes.sum())
        common = np.minimum(self.held[self.ids[at]], self.counts[at])
        self.held[self.ids[own]] = 0
        both = np.stack([np.add.reduceat((common > 0).astype(np.int64), edges), np.add.reduceat(common, edges)], axis=1)
        size = self.n[others] + self.n[k]
        return others[similar(size - 2 * both, size).all(axis=1)]


def cell_forest(alike: Callable[[int, np.ndarray], np.ndarray], tree: np.ndarray, only: int | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect all rows that are alike, breadth first; rows of one name in `tree` are connected from the start.
    With `only`, no more than what is reached from the rows of that name."""
    links, left = [], np.arange(len(tree))
    while len(left):
        reached = tree[left] == (tree[left[0]] if only is None else only)
        queue, left = left[reached].tolist(), left[~reached]
        for k in queue:  # it grows
            if not len(left):
                break
            found = alike(k, left)
            if len(found):
                names, first = np.unique(tree[found], return_index=True)
                links += [(k, x) for x in found[first].tolist()]
                reached = np.isin(tree[left], names)
                queue += left[reached].tolist()
                left = left[~reached]
        if only is not None:
            break
    return links


def shingle_sets(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, node (a hash of the shingles and their counts), n (distinct shingles), m (all), bits (parities), w0 (fingerprint) and keys
    (prefix) of every row."""
    late = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, width))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = late.value
        for batch in batches:
            sets, counts = zip(*(shingle_counts(x.as_py(), width) for x in batch.column(1)), strict=True) if batch.num_rows else ((), ())
            keys = [prefix(x, heavy) for x in sets]
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            node = np.array([xxhash.xxh64_intdigest(x.tobytes() + c.tobytes(), SEED) for x, c in zip(sets, counts, strict=True)], U64).view(np.int64)
            values = np.concatenate([np.empty(0, U64), *keys]).view(np.int64)
            prints = np.frombuffer(b"".join([votes([np.repeat(x, c)]) for x, c in zip(sets, counts, strict=True)]), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([parities(x) for x in sets], pa.binary()), pa.array(prints), pa.ListArray.from_arrays(ends, pa.array(values))], [key, "node", "n", "m", "bits", "w0", "keys"])

    return docs.select(F.col(key).cast("long").alias(key), text_bytes().alias("data")).mapInArrow(make, f"{key} long, node long, n long, m long, bits binary, w0 long, keys array<long>")


def shared_cells(cells: DataFrame) -> DataFrame:
    """Of rows (cell, node): all pairs (null, a, b) of cells of up to FEW rows, and the rows (cell, a, null) of larger ones."""
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = node = np.empty(0, np.int64)  # of the cell that may go on in the next batch
        sent = None  # a larger cell of which rows were sent
        for batch in chain(batches, [None]):
            if batch is not None:
                cell, node = np.concatenate([cell, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
            if not len(cell):
                continue
            edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            sizes = np.diff(edges)
            large = sizes > FEW
            if sent is not None:
                large |= cell[edges[:-1]] == sent
            sent = cell[-1] if large[-1] else None
            end = len(cell) if batch is None or large[-1] else edges[-2]
            is_large = np.repeat(large, sizes)[:end]
            own, held = cell[:end], node[:end]
            a, b = [], []
            for step in range(1, FEW):
                same = np.flatnonzero((own[step:] == own[:-step]) & ~is_large[step:])
                a.append(np.minimum(held[same], held[same + step]))
                b.append(np.maximum(held[same], held[same + step]))
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["cell", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(own[is_large]), pa.array(held[is_large]), pa.nulls(int(is_large.sum()), pa.int64())], ["cell", "a", "b"])
            cell, node = cell[end:], node[end:]

    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(split, "cell long, a long, b long")


def n_parts(rows, shingles):
    """Parts of a cell of so many rows with so many distinct shingles."""
    return F.ceil(F.greatest(rows / CELL, shingles / LOAD)).cast("int")


def numbers(n):
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def parted(cells: DataFrame) -> DataFrame:
    """Rows of cells (cell, node, n, more, perhaps component) as (part, node, n, more, component, home, first), each part whole in
    a partition and in a run there.

    A large cell makes several parts. Without components each row is in one of them and the least node (home) in all. With
    components the largest (home) has parts of its own, and so has the rest; each part of the rest meets each of both, so that
    all rows of different components meet (first: those of the rest). So the rows sent grow with the cell as long as the rest
    is a part or two.
    """
    grouped = "component" in cells.columns
    count = (F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"))
    if grouped:
        sizes = cells.groupBy("cell", "component").agg(*count).groupBy("cell").agg(F.max(F.struct("n_rows", "component", "n")).alias("most"), F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"))
        sizes = sizes.select("cell", F.col("most.component").alias("home"), n_parts(F.col("n_rows"), F.col("n")).alias("k"), n_parts(F.col("most.n_rows"), F.col("most.n")).alias("k_home"), n_parts(F.col("n_rows") - F.col("most.n_rows"), F.col("n") - F.col("most.n")).alias("k_rest"))
    else:
        sizes = cells.groupBy("cell").agg(*count, F.min("node").alias("home")).select("cell", "home", n_parts(F.col("n_rows"), F.col("n")).alias("k"), F.lit(1).alias("k_home"), F.lit(1).alias("k_rest"))
    large = staged(sizes.filter("k > 1"), "large-cells")
    n_large = large.count()
    rest = [c for c in cells.columns if c not in ("cell", "component")]
    if n_large:
        cells = cells.join(F.broadcast(large) if n_large <= BROADCAST else large, "cell", "left")
    else:
        cells = cells.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("home", "long"), ("k", "int"), ("k_home", "int"), ("k_rest", "int"))))

    def own(k: str):
        return F.pmod(F.xxhash64("node"), F.col(k).cast("long")).cast("int")

    def at(i, j, first: bool):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(first).alias("first"))

    if grouped:
        home = F.transform(numbers(F.col("k_rest")), lambda j: at(own("k_home"), j, False))
        others = F.concat(F.transform(numbers(F.col("k_home")), lambda i: at(i, own("k_rest"), False)), F.transform(numbers(F.col("k_rest")), lambda j: at(F.least(j, own("k_rest")), F.greatest(j, own("k_rest")), True)))
        parts = F.when(F.col("component") == F.col("home"), home).otherwise(others)
    else:
        parts = F.transform(F.when(F.col("node") == F.col("home"), numbers(F.col("k"))).otherwise(F.array(own("k"))), lambda i: at(i, F.lit(0), True))
    spread = cells.withColumn("at", F.explode(F.when(F.col("k").isNull(), F.array(at(F.lit(0), F.lit(0), True))).otherwise(parts)))
    component = F.col("component") if grouped else F.lit(None).cast("long").alias("component")
    # Parts are told apart by 64-bit hashes, as the shingles are.
    part = F.when(F.col("k").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "at.i", "at.j", "at.first")).alias("part")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.select(part, *rest, component, "home", F.col("at.first").alias("first")).repartition(n, "part").sortWithinPartitions("part", "home")


def links_in(cells: DataFrame, tree: str, compare: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """Links (a, b) of names (column `tree`) that connect the rows of each cell that are alike by `compare`, given the rows of one
    name are connected. All cells of a task give one forest, so that a task sends no more links than it has names."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def forest() -> pa.RecordBatch:
            return link_batch([np.array([root(x) for x in above], np.int64)], [np.array(list(above), np.int64)])

        for rows, edges in whole_cells(batches):
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = rows.slice(start, end - start)
                own = own.take(pa.array(np.argsort(own["node"].to_numpy())))
                names = [root(x) for x in own[tree].to_pylist()]
                if names.count(names[0]) == len(names):
                    continue
                only = None if own["first"][0].as_py() else root(own["home"][0].as_py())
                for x, y in cell_forest(compare(own), np.array(names, np.int64), only):
                    x, y = root(names[x]), root(names[y])
                    above[max(x, y)] = min(x, y)
                if len(above) > _NAMES:
                    yield forest()
                    above.clear()
        yield forest()

    return parted(cells).mapInArrow(link, LINKS).filter("a <> b").distinct()


def pairs_in(cells: DataFrame, tree: str = "node") -> DataFrame:
    """Links (a, b) that connect rows of cells (cell, node, n, m, bits, perhaps component) that may be similar."""

    def compare(rows: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        n, bits = np.stack([rows["n"].to_numpy(), rows["m"].to_numpy()], axis=1), Parities(rows["bits"].to_pylist())
        return lambda k, others: could_be_similar(n, bits, k, others)

    return links_in(cells, tree, compare)


def copies_in(cells: DataFrame, tree: str, width: int) -> DataFrame:
    """Links (a, b) that connect rows of cells (cell, node, n, data, perhaps component) whose texts are near copies."""
    return links_in(cells, tree, lambda rows: Sets(rows["data"].to_pylist(), width).near_copies)


def linked_in(cells: DataFrame, find: Callable[[DataFrame, str], DataFrame], tree: str, more: DataFrame | None = None) -> DataFrame:
    """node and component of all names (column `tree`) that the links of `find`, and those of `more`, connect in cells: within
    the parts of the cells first; then, of cells of several parts, also rows that are not yet connected."""
    links = find(cells, tree)
    found = staged(components(links if more is None else links.unionByName(more)), "found")
    many = staged(cells.groupBy("cell").agg(n_parts(F.count(F.lit(1)), F.sum("n")).alias("k")).filter("k > 1").select("cell"), "large-cells")
    n_many = many.count()
    if not n_many:
        return found
    again = cells.join(F.broadcast(many) if n_many <= BROADCAST else many, "cell", "left_semi")
    names = again.groupBy(tree).agg(F.count(F.lit(1)).alias("n_rows")).join(found.withColumnRenamed("node", tree) if tree != "node" else found, tree, "left")
    names = staged(names.select(tree, F.coalesce("component", tree).alias("component"), "n_rows"), "names")
    n_rows = names.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    rest = staged(find(labelled(again, names, tree, n_rows), "component"), "links")
    return found if rest.isEmpty() else staged(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)), "found")


def similar_documents(docs: DataFrame, key: str, width: int = 5) -> DataFrame:
    """key (a different number in each row) and component of every row: rows are linked where their shingles have Jaccard
    similarity P / Q or more, both as sets and counted with repeats, and links are closed.

    The rows are points of operator 10: SimHash fingerprints of the shingles, cells of their segment counts, and links up to
    DISTANCE differing bits make the first groups. Similar texts may differ in more bits, for which there is an exact way:
    similar sets share a hash among the first of each; pairs of different groups in the cells of these are tested by sizes
    and parities, which reject no similar pair, and what passes joins their groups. So no similar pair is in two groups. Then
    the exact check: each group's texts meet in one task, or in parts, and are linked by their shingles. No list of pairs is
    made but of cells of up to FEW rows. Rows of equal shingles
    and counts, null texts and texts without words among them, are one point; shingles of equal 64-bit hashes count as equal;
    long texts are read a bounded run of words at a time; an empty table gives an empty one; other columns are ignored.
    """
    with passing(docs.sparkSession):
        sets = staged(shingle_sets(docs, key, width), "sets")
        points = staged(sets.groupBy("node").agg(F.min(key).alias(key), F.first("n").alias("n"), F.first("m").alias("m"), F.first("bits").alias("bits"), F.first("w0").alias("w0"), F.count(F.lit(1)).alias("n_rows")), "points")
        n_points, n_rows = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
        prints = staged(points.groupBy("w0").agg(F.count(F.lit(1)).alias("n_rows")), "prints")
        near = linked_prints(prints, prints.count(), DISTANCE)
        names = prints.join(near, F.col("w0") == F.col("node"), "left").select("w0", F.coalesce("component", "w0").alias("group"), "n_rows")
        groups = staged(labelled(points.select("node", "w0"), names, "w0", n_points).select("node", "group"), "prints")
        cells = sets.join(points.select(key), key, "left_semi").select(F.explode("keys").alias("cell"), "node")
        shared = staged(shared_cells(cells), "cells")
        own = points.select("node", "n", "m", "bits").join(groups, "node")

        few = shared.filter("cell is null").select("a", "b").distinct()
        for side in ("a", "b"):
            few = few.join(own.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "m", "bits", "group"))), side)

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_a, n_b, m_a, m_b = (batch.column(k).to_numpy() for k in range(2, 6))
                apart = np.array([bits_apart(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)], np.int64)
                yield batch.select([0, 1]).filter(pa.array(similar(np.maximum(apart, np.abs(n_a - n_b)), n_a + n_b) & similar(np.abs(m_a - m_b), m_a + m_b)))

        few = few.filter("group_a <> group_b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"), "n_a", "n_b", "m_a", "m_b", "bits_a", "bits_b").mapInArrow(test, LINKS)
        large = shared.filter("cell is not null").select("cell", F.col("a").alias("node")).join(own, "node").select("cell", "node", "n", "m", "bits", "group")
        wide = linked_in(large, pairs_in, "group", few)
        names = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows")).join(wide.withColumnRenamed("node", "group"), "group", "left").select("group", F.coalesce("component", "group").alias("cell"), "n_rows")
        placed = staged(labelled(groups, names, "group", n_points).select("node", "cell"), "placed")
        many = placed.groupBy("cell").agg(F.lit(True).alias("many"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
        asked = labelled(placed, many, "cell", n_points).select("node", "cell").join(points.select("node", key, "n"), "node")
        texts = staged(asked.join(docs.select(key, text_bytes().alias("data")), key).select("cell", "node", "n", "data"), "texts")
        found = linked_in(texts, lambda rows, tree: copies_in(rows, tree, width), "node")
        names = points.select("node", "n_rows").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n_rows")
        return staged(labelled(sets.select(key, "node"), names, "node", n_rows).select(key, "component"), "groups", last=True)


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without all but one row of each group of near copies: the one of least doc_id stays, of equal ones any one row.

    Null and empty texts and such without words are copies of one another; rows without doc_id stay only in groups where none
    has one; long texts are read a bounded run of words at a time; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are.
    """
    row = free_name("_row", docs.columns)
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ranked = similar_documents(rows, row, width).join(rows.select(row, "doc_id"), row)
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
