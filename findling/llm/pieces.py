"""Op 1. Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, again and again, the longest vocabulary entry that starts the rest of a word. The trie of
the vocabulary gets failure links: where no edge goes on from a node, the link leads to the node of what is left after the
pieces that greedy splitting would take off so far, and the node's popped count tells how many those are. One pass over a
word's symbols, following each link at most once a symbol on average, gives its number of pieces; no piece is ever built.

Symbols are a word's UTF-8 bytes; a word-end symbol follows the last. All single bytes, with and without word end, are
entries, so every word can be split.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from findling.llm.common import spans, text_bytes
from findling.llm.encoding import default_vocabulary

END = 256
COUNTS = "doc_id long, n_words long, n_tokens long"
_REMEMBERED = 300_000


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def entries(vocabulary: str) -> list[tuple[int, ...]]:
    """Symbol strings of a byte-level vocabulary file with word ends; special tokens are none."""
    with open(vocabulary, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data["added_tokens"]}
    suffix, table = data["model"]["end_of_word_suffix"], byte_symbols()
    out = {(b,) for b in range(256)} | {(END,)}
    for token in data["model"]["vocab"]:
        if token not in special:
            body = token.removesuffix(suffix)
            if body:
                out.add(tuple(table[c] for c in body) + (END,) * (token != body))
    return sorted(out)


class Automaton:
    def __init__(self, vocabulary: list[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        ends = {0: False}
        for entry in vocabulary:
            node = 0
            for symbol in entry:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                node = self.next[node][symbol]
            ends[node] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque((0, s, n) for s, n in self.next[0].items())
        while queue:  # shorter prefixes first, as a node's link rests on its parent's
            parent, symbol, node = queue.popleft()
            if ends.get(node):
                self.fail[node], self.popped[node] = 0, 1
            else:
                count, at = self.popped[parent], self.fail[parent]
                while at >= 0 and symbol not in self.next[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][symbol], count
            queue.extend((node, s, n) for s, n in self.next[node].items())
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; an unsplittable word, which a full byte vocabulary rules out, is one."""
        node, count = 0, 0
        following, fail, popped = self.next, self.fail, self.popped
        for symbol in (*word, END):
            while symbol not in following[node]:
                if fail[node] < 0:
                    return 1
                count += popped[node]
                node = fail[node]
            node = following[node][symbol]
        while node:
            if fail[node] < 0:
                return 1
            count += popped[node]
            node = fail[node]
        return count

    def of_text(self, data: bytes) -> tuple[int, int]:
        """Words and pieces of a text; words are what stands between ASCII white space, lower-cased in A-Z."""
        n_words = n_pieces = 0
        for part in spans(data.lower()):
            words = part.split()
            n_words += len(words)
            known = self.known
            new = [w for w in set(words) if w not in known]
            if len(known) + len(new) > _REMEMBERED:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.count(w)
            n_pieces += sum(map(known.__getitem__, words))
        return n_words, n_pieces


_automata: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of docs.

    A null or empty text has neither; a long text is read a bounded run of words at a time; repeated rows are counted each for
    itself; a null doc_id is kept; an empty table gives an empty one; other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _automata:
            _automata[vocabulary] = Automaton(entries(vocabulary))
        own = _automata[vocabulary]
        for batch in batches:
            found = [own.of_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", text_bytes().alias("data")).mapInArrow(count, COUNTS)
