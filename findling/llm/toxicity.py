"""Op 6. Toxicity by a weighted lexicon with exception phrases.

Texts are folded (case, homoglyphs, digits and signs that stand for letters) to words with single spaces between and around
them. One Aho-Corasick automaton finds the lexicon's terms, which are whole words or word beginnings, and the exception
phrases, which are terms with more letters or with a neighbouring word that labelled clean texts hold. Counts, limited and
normalised by the text's length, are weighed and summed, and a logistic function gives the score.

Terms are those word beginnings and words that far more toxic than clean texts hold, by a test of two shares; weights
come from logistic regression on the labelled sample.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import passing, staged

#: About so many labelled documents of each class are learned from, drawn by a hash of the key. Nothing else bounds the lexicon:
#: all terms and exceptions that pass the tests below are in it.
SAMPLE = 6000
#: Letters of a word beginning; texts that must hold a term; the least z score of its share's difference.
LETTERS, LEAST_TEXTS, LEAST_Z = (4, 8), 6, 6.0
MOST_COUNT = 4
#: Words after which a hit weighs less by the text's length; the one that fits the labels best is taken.
SCALES = (4000.0, 1000.0, 250.0)
SCORED = "doc_id long, held_out boolean, score double, predicted int"

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ѡ": "w",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
}
_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()} | {0xFF01 + k: chr(0x21 + k) for k in range(94)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_WIDE = {k: v.lower() for k, v in _FOLD.items() if v is not None and k >= 0xFF01}
_FOLD = {k: _LOOKALIKES.get(v.lower(), v.lower()) if v is not None and k in _WIDE else v for k, v in _FOLD.items()}
_SIGN = re.compile(r"[@$!|](?=[^\W_])")
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|[@$](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str | None) -> tuple[str, int]:
    """Folded words with single spaces between and around them, and their number. 'l' and 'i' fold to one letter."""
    if not text:
        return " ", 0
    text = text.lower()
    if _SIGN.search(text):
        text = _INSIDE.sub(lambda m: _SIGNS[m[0]], text)
    words = _WORD.findall(text.translate(_FOLD))
    return (f" {' '.join(words)} ", len(words)) if words else (" ", 0)


def beginnings(text: str) -> set[str]:
    """Candidate terms of a folded text: ' word ' and ' beg' of its words."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        for n in range(LETTERS[0], min(LETTERS[1], len(word)) + 1):
            out.add(f" {word[:n]}")
    return out


def find_twice(text: str, found: set[str]) -> set[str]:
    """Of strings that start at a space: those that start at two places at least (the space between may be shared)."""
    words = Counter(text.split())
    starts: Counter = Counter()
    for word, k in words.items():
        starts[f" {word} "] += k
        for n in range(LETTERS[0], min(LETTERS[1], len(word)) + 1):
            starts[f" {word[:n]}"] += k
    return {x for x in found if starts[x] > 1}


def _z(a: str, b: str, n: float, m: float):
    """How far apart the shares a/n and b/m of two columns are, in standard errors."""
    p = (F.col(a) + F.col(b) + 1) / (n + m + 2)
    return (F.col(a) / n - F.col(b) / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m))


def choose_terms(stats: list[tuple[str, int, float]]) -> list[str]:
    """Terms from (term, toxic texts with it, z score). Of a beginning and its longer forms, the longest that keeps nine tenths
    of the toxic texts stays."""
    texts = {term: a for term, a, _ in stats}

    def is_longer(term: str) -> bool:
        return any(texts.get(term[:n], 0) >= 0.9 * texts[term] for n in range(1, len(term)))

    return [term for term, _, _ in sorted(stats, key=lambda x: (-x[2], x[0])) if not is_longer(term)]


def phrases_of(text: str, machine: ahocorasick.Automaton) -> set[str]:
    """Longer forms of the terms found: the whole word, and it with the word before or after."""
    out = set()
    for end, (term, _) in machine.iter(text):
        start = end - len(term) + 1
        stop = text.index(" ", start + 1)
        word = text[start : stop + 1]
        if word != term:
            out.add(word)
        before = text.rfind(" ", 0, start) if start else -1
        if before >= 0:
            out.add(text[before : stop + 1])
        after = text.find(" ", stop + 1)
        if after > 0:
            out.add(text[start : after + 1])
    return out


def machine_of(terms: Iterable[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(term, (term, k))
    if len(out):
        out.make_automaton()
    return out


class Lexicon:
    """Terms and exception phrases with their weights."""

    def __init__(self, terms: list[str], weights: np.ndarray, bias: float, scale: float) -> None:
        self.terms, self.weights, self.bias, self.scale = terms, weights, bias, scale
        self.machine = machine_of(terms)

    def __reduce__(self):
        return Lexicon, (self.terms, self.weights, self.bias, self.scale)

    def counts(self, text: str) -> Counter:
        return Counter(k for _, (_, k) in self.machine.iter(text)) if len(self.machine) else Counter()

    def score(self, text: str | None) -> float:
        own, n = folded(text)
        x = self.bias + sum(self.weights[k] * min(c, MOST_COUNT) for k, c in self.counts(own).items()) * shrink(n, self.scale)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def shrink(n_words: float, scale: float) -> float:
    """Weight of a hit in a text of so many words."""
    return 1.0 / (1.0 + math.log1p(n_words / scale))


class Sparse:
    """Rows of few numbers, and a last column of ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> None:
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows) + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.column, self.value * v[self.row], self.columns), v.sum())

    def squares(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.column, self.value**2 * v[self.row], self.columns), v.sum())


def regression(x: Sparse, y: np.ndarray, own: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float, float]:
    """Weights, bias and mean loss of logistic regression with row weights, by Newton's method with conjugate gradients."""
    w, lam = np.zeros(x.columns + 1), np.full(x.columns + 1, ridge)
    lam[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        m = x.times(w)
        return float((own * (np.logaddexp(0, m) - y * m)).sum() + (lam * w * w).sum() / 2)

    def solve(curve: np.ndarray, aim: np.ndarray) -> np.ndarray:
        scale = 1 / (x.squares(curve) + lam)
        out, left = np.zeros_like(aim), aim.copy()
        way = scale * left
        size = left @ way
        enough = 1e-16 * size
        for _ in range(10 * len(aim)):
            if size <= enough:
                break
            turned = x.back(curve * x.times(way)) + lam * way
            step = size / (way @ turned)
            out, left = out + step * way, left - step * turned
            new = scale * left
            size, before = left @ new, size
            way = new + size / before * way
        return out

    best = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        step = solve(own * np.maximum(p * (1 - p), 1e-6), x.back(own * (p - y)) + lam * w)
        t = 1.0
        while t > 1e-3 and loss(w - t * step) > best:
            t /= 2
        w = w - t * step
        new = loss(w)
        if best - new < 1e-7 * max(1.0, best):
            break
        best = new
    return w[:-1], float(w[-1]), loss(w) / own.sum()


def _sums(rows: DataFrame, find) -> DataFrame:
    """Texts with each found string, once and twice, by class: (term, a, b, a2, b2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [Counter() for _ in range(4)]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(text)
                by[0 if toxic else 1].update(found)
                by[2 if toxic else 3].update(find_twice(text, found))
            names = sorted(set(by[0]) | set(by[1]))
            yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string())} | {c: pa.array([by[k][x] for x in names], pa.int64()) for k, c in enumerate(("a", "b", "a2", "b2"))})

    counted = rows.select("folded", "toxic").mapInArrow(count, "term string, a long, b long, a2 long, b2 long")
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a", "b", "a2", "b2")))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Fits on a hash sample of documents labels(doc_id, toxic) with the texts of docs, about `sample` of each class.

    A document with both labels counts as toxic; of rows with one doc_id that with the least text is learned from; null
    labels and keys teach nothing. Without labelled rows the lexicon is empty and every score about 0; with one class alone,
    about its share.
    """
    with passing(docs.sparkSession):
        own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
        share = {k: min(1.0, sample / max(1, sizes.get(k, 0))) for k in (0, 1)}
        drawn = staged(own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * (1 << 20)), "drawn")
        few = drawn.count() <= 4 * sample
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn) if few else drawn, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [folded(x.as_py()) for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([n for _, n in both], pa.int64()), batch.column(1)], ["folded", "n", "toxic"])

        rows = staged(texts.select("text", "toxic").mapInArrow(fold, "folded string, n long, toxic int"), "labelled")
        return fitted(rows, {k: sizes.get(k, 0) for k in (0, 1)}, share)


def fitted(rows: DataFrame, sizes: dict[int, int], share: dict[int, float]) -> Lexicon:
    """The lexicon of rows(folded, n, toxic), which are so large a share of the labelled documents of each class."""
    n_by = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n_by.get(1, 0), n_by.get(0, 0)
    if not n_toxic or not n_clean:
        share_of = sizes[1] / max(1, sum(sizes.values()))
        return Lexicon([], np.empty(0), math.log((share_of + 1e-6) / (1 - share_of + 1e-6)), 1.0)
    z = F.greatest(_z("a", "b", n_toxic, n_clean), _z("a2", "b2", n_toxic, n_clean))
    stats = _sums(rows, beginnings).filter(F.col("a") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    terms = choose_terms([(r["term"], r["a"], r["z"]) for r in stats.select("term", "a", "z").collect()])
    if not terms:
        return Lexicon([], np.empty(0), math.log((sizes[1] + 0.5) / (sizes[0] + 0.5)), 1.0)
    base = pickle.dumps(terms)
    held: dict[int, ahocorasick.Automaton] = {}

    def find(text: str) -> set[str]:
        if 0 not in held:
            held[0] = machine_of(pickle.loads(base))
        return phrases_of(text, held[0])

    # Exceptions: longer forms that clean texts hold more often, for their number, than toxic ones.
    clean = _sums(rows, find).filter(F.col("b") >= LEAST_TEXTS).filter(F.col("b") / n_clean > F.col("a") / n_toxic)
    every = terms + sorted({r["term"] for r in clean.select("term").collect()} - set(terms))
    lexicon = Lexicon(every, np.zeros(len(every)), 0.0, 1.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.counts(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"n": batch.column(1), "toxic": batch.column(2), "at": pa.array([list(c) for c in found], pa.list_(pa.int32())), "count": pa.array([[min(v, MOST_COUNT) for v in c.values()] for c in found], pa.list_(pa.int32()))})

    sampled = rows.mapInArrow(features, "n long, toxic int, at array<int>, count array<int>").collect()
    y = np.array([float(r["toxic"]) for r in sampled])
    weight = np.where(y > 0, 1 / share[1], 1 / share[0])
    weight *= len(weight) / weight.sum()
    row = np.repeat(np.arange(len(sampled)), [len(r["at"]) for r in sampled])
    column = np.array([k for r in sampled for k in r["at"]], np.int64)
    value = np.array([k for r in sampled for k in r["count"]], np.float64)
    best = None
    for scale in SCALES:
        shorter = np.array([shrink(r["n"], scale) for r in sampled])
        w, bias, lost = regression(Sparse(row, column, value * shorter[row], len(sampled), len(every)), y, weight)
        if best is None or lost < best[0]:
            best = (lost, w, bias, scale)
    return Lexicon(every, *best[1:])


_loaded: dict[str, Lexicon] = {}


def _own(name: str, shared) -> Lexicon:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pickle.loads(shared.value)
    return _loaded[name]


def held_out(modulus: int = 5, remainder: int = 0):
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. A null text is scored as an empty one."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(name, shared)
        for batch in batches:
            scores = np.array([own.score(x.as_py()) for x in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(rate, SCORED)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out, and scores all rows of docs.

    A null text is scored as an empty one; long texts are scored whole; repeated rows are scored each for itself; a null doc_id
    is not held out; labels that disagree count as toxic; with no labels all scores are about 0; an empty table gives an empty
    one; other columns are ignored.
    """
    return score(docs, learn(docs, labels.filter(~held_out())))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under a half, with their own columns, whatever their names.

    Null texts, long texts, repeated rows, labels that disagree and empty tables as in scored(); where no term was learned,
    no row goes.
    """
    lexicon, name = learn(docs, labels.filter(~held_out())), uuid.uuid4().hex
    if not len(lexicon.machine):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(name, shared)
        for batch in batches:
            yield batch.filter(pa.array([own.score(x.as_py()) < 0.5 for x in batch.column(batch.schema.get_field_index("text"))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
