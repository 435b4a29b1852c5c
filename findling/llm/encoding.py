"""Whole-text token ids by the tokenizers library, one pre-token at a time.

The vocabulary drops white space and no merge crosses a pre-token, so the ids of a text are the ids of its pre-tokens in
order. In texts of the plain characters below (letters without combining marks that lower-case one to one, ASCII digits
and signs), a regular expression finds the same pre-tokens as the library's normaliser and splitter; the library's model
then encodes each. All other texts are cut at spaces, and the library encodes each chunk that is not plain whole.
Pre-tokens seen before come from a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUTS = str.maketrans({"\n": " ", "\t": " ", "\r": " "})
_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-įı-ſ]*")
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: Pre-tokens remembered by a worker; when half are new, those of the half before go.
REMEMBERED = 400_000
#: Characters whose ids are gathered at once.
STEP = 6 << 20
#: The splitting rules that the expressions above restate (fixed values); any other vocabulary takes the library's way only.
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, vocabulary: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if (steps[0].get("pattern") or {}).get("Regex") != _SPLIT_RULE:
            raise ValueError(f"{vocabulary} does not split as this encoder expects")
        self.special = [x["content"] for x in rules["added_tokens"]]
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def _pre_token(self, x: str) -> bytes:
        found = self.known.get(x)
        if found is None:
            found = self.older.get(x)
            if found is None:
                y = x if x.isascii() else self.bytes_of.pre_tokenize_str(x)[0][0]
                found = np.array([t.id for t in self.model.tokenize(y)], dtype="<u4").tobytes()
            if len(self.known) >= REMEMBERED // 2:
                self.older, self.known = self.known, {}
            self.known[x] = found
        return found

    def _of_plain(self, lowered: str) -> bytes:
        get = self.known.get
        return b"".join([get(x) or self._pre_token(x) for x in _PRE_TOKEN.findall(lowered)])

    def _of_chunk(self, chunk: str) -> bytes:
        if self._plain(chunk):
            return self._of_plain(chunk.lower())
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text; none for null."""
        return self.batch([text])[0]

    def _many_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Distinct chunks are encoded once and their ids gathered."""
        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = words.flatten().dictionary_encode()
        unique = [self._of_plain(x) for x in coded.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(unique), dtype="<u4")
        sizes = np.fromiter(map(len, unique), np.int64, len(unique)) // 4
        starts = (np.cumsum(sizes) - sizes).astype(np.int32)
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[which] - (ends - lengths).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)
        flat = pool[at]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [flat[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids (unsigned 32 bits) of each text, in order; none for null or empty texts."""
        out: list[np.ndarray] = []
        plain: list[str] = []
        where: list[int] = []
        held = 0

        def flush() -> None:
            for at, found in zip(where, self._many_plain(plain) if plain else (), strict=True):
                out[at] = found
            plain.clear()
            where.clear()

        nothing = np.empty(0, dtype="<u4")
        for text in texts:
            out.append(nothing)
            if not text:
                continue
            if self._plain(text):
                where.append(len(out) - 1)
                plain.append(text)
                held += len(text)
                if held > STEP:
                    flush()
                    held = 0
            else:
                out[-1] = np.frombuffer(b"".join([self._of_chunk(x) for x in text.translate(_CUTS).split(" ")]), dtype="<u4")
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
