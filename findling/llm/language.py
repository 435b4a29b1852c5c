"""Op 2. Language by word-first backoff.

Each language has relative frequencies of words and of character n-grams (of words with a space at either end). A word that
some language knows is scored by its negative log frequency in each, or by a penalty where it is unknown. For a word that
none knows, the mean over its longest known n-grams is taken, from MOST_CHARS characters down to one. A text's score is the
mean over its words; the smallest wins, and of equal ones the language that comes first.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_CHARS = 5
#: The model is fitted on about SAMPLE documents of each language, drawn by a hash of the key, and keeps the most frequent
#: KEPT words (index 0) and n-grams of each length in each language.
SAMPLE = 4000
KEPT = (30_000, 2_000, 4_000, 8_000, 10_000, 10_000)
#: Score of what a language does not know: the log of a frequency below any counted one.
PENALTY = 7.0
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 200_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and of what joins them; those without any letter are left out by the caller."""
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    if n == 0:
        return [word]
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by.items():
            for n in range(MOST_CHARS + 1):
                found: Counter = Counter()
                for word, k in words.items():
                    for g in grams(word, n):
                        found[g] += k
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "n": pa.array([n] * len(found), pa.int32()), "gram": pa.array(found.keys(), pa.string()), "k": pa.array(found.values(), pa.int64())})


class Model:
    """Score rows of known words and n-grams, one column for each language."""

    def __init__(self, langs: list[str], known: dict[str, int], scores: np.ndarray) -> None:
        self.langs, self.known, self.scores = langs, known, scores
        self.memo: dict[str, int] = {}
        self.table = np.empty((1024, len(langs)))

    def __reduce__(self):
        return Model, (self.langs, self.known, self.scores)

    def of_word(self, word: str) -> np.ndarray:
        for n in (0, *range(MOST_CHARS, 0, -1)):
            found = [self.known[f"{n}{g}"] for g in grams(word, n) if f"{n}{g}" in self.known]
            if found:
                return self.scores[found].mean(axis=0)
        return np.full(len(self.langs), PENALTY)

    def _row(self, word: str) -> int:
        at = self.memo.get(word)
        if at is None:
            at = len(self.memo)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[at] = self.of_word(word)
            self.memo[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence, the share of the best language if each word's margin counted, ten words at most."""
        words = words_of(text)
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.memo) > _REMEMBERED:
            self.memo.clear()
        get, total = self.memo.get, np.zeros(len(self.langs))
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            rows = np.array([get(w, -1) for w in part], np.int64)
            for k in np.flatnonzero(rows < 0).tolist():
                rows[k] = self._row(part[k])
            total += self.table[rows].sum(axis=0)
        mean = total / len(words)
        best = int(np.argmin(mean))
        share = 1.0 / np.exp(-np.log(10.0) * min(len(words), 10) * (mean - mean[best])).sum()
        return self.langs[best], float(share)


def learn(rows: DataFrame, key: str, sample: int = SAMPLE, kept: tuple[int, ...] = KEPT) -> Model:
    """Fits on a hash sample of rows (key, lang, text); lang must not be null. Rare languages give all their rows.

    Each language's sample is about `sample` rows and its tables are bounded by `kept`, so the model's size is bounded by
    the number of languages.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {}, np.empty((0, 0)))
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > sample:
            share = F.when(F.col("lang") == lang, F.lit(sample / n)).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < share * (1 << 20))
    counted = drawn.select("lang", "text").mapInArrow(_counts, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    own = W.partitionBy("lang", "n")
    limit = F.element_at(F.array(*map(F.lit, kept)), F.col("n") + 1)
    ranked = counted.withColumn("total", F.sum("k").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("k"), "gram"))).filter(F.col("rank") <= limit)
    langs = sorted(sizes)
    column = {x: i for i, x in enumerate(langs)}
    known: dict[str, int] = {}
    cells = []
    for r in ranked.select("lang", "n", "gram", (-F.log10(F.col("k") / F.col("total"))).alias("score")).toLocalIterator():
        cells.append((known.setdefault(f"{r['n']}{r['gram']}", len(known)), column[r["lang"]], min(r["score"], PENALTY)))
    scores = np.full((len(known), len(langs)), PENALTY)
    for a, b, s in cells:
        scores[a, b] = s
    return Model(langs, known, scores)


_loaded: dict[str, Model] = {}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (whether learning never saw the row), lang_pred and score of every row of docs.

    Null texts and texts without a letter are `und` with score 0, as all are where nothing could be learned; other columns
    are not read.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = pickle.loads(shared.value)
        own = _loaded[name]
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(3, 1).alias("held_out"), "text").mapInArrow(score, PREDICTED)


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs with a language that are not held out, and predicts all.

    Null texts and texts without a letter are `und`; long texts are scored whole; repeated rows teach and are predicted each for
    itself, and equal scores go to the language that comes first; rows without doc_id teach nothing and are not held out; an
    empty table gives an empty one; other columns are not read.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select("doc_id", "lang", "text")
    return predict(docs, learn(labelled, "doc_id"))
