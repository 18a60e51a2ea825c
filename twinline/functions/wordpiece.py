"""Word pieces by greedy longest match.

The rows stay where they are: blank-free chunks go to the Python workers in Arrow batches, a batch
looks at each distinct chunk once, and each worker remembers the pieces of the chunks it has seen.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import collect_small
from ..schemas import SPECIALS, UNK
from .lists import expand_values, in_slices, map_values
from .tokens import mark_text

MAX_WORD = 100
MAX_REMEMBERED = 100_000

# What separates words; other control characters are dropped.
_BLANKS = r"[ \t\n\r\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+"
_MARKERS = re.compile("(" + "|".join(re.escape(s) for s in SPECIALS) + ")")
# Code ranges of ideographs, each a word of its own.
_IDEOGRAPHS = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
]


def _stands_alone(char: str) -> bool:
    code = ord(char)
    if code < 128:
        return not char.isalnum() and 33 <= code <= 126
    return unicodedata.category(char)[0] == "P" or any(a <= code <= b for a, b in _IDEOGRAPHS)


def _basic_words(chunk: str) -> list[str]:
    """Words of a blank-free text: markers whole, punctuation and ideographs on their own."""
    words = []
    for part in _MARKERS.split(chunk):
        if part in SPECIALS:
            words.append(part)
            continue
        word = ""
        for char in part:
            if _stands_alone(char):
                words.extend([word, char] if word else [char])
                word = ""
            elif char != "�" and unicodedata.category(char)[0] != "C":
                word += char
        if word:
            words.append(word)
    return words


def match_pieces(word: str, vocab) -> list[str]:
    """Longest known piece first; a word that cannot be covered is one unknown piece."""
    if word in SPECIALS:
        return [word]
    if len(word) > MAX_WORD:
        return [UNK]
    pieces, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in vocab:
                pieces.append(piece)
                start = end
                break
        else:
            return [UNK]
    return pieces


class WordPiece:
    """Column functions over one vocabulary ``token, index``.

    A vocabulary is sent to every worker; ``max_bytes`` bounds its size as JSON, and a larger one is an error.
    """

    def __init__(self, vocab: DataFrame, token: str = "token", index: str = "index", max_bytes: int = 256 << 20):
        rows = collect_small(vocab.select(F.col(token), F.col(index).cast("int")), max_bytes)
        if rows is None:
            raise ValueError(f"the vocabulary takes more than {max_bytes} bytes")
        self.ids = {r[0]: r[1] for r in rows}
        self._shared = vocab.sparkSession.sparkContext.broadcast(self.ids)
        self._name = uuid.uuid4().hex

    def _cut(self, text: Column, result: str) -> Column:
        """Pieces of a text, or their indexes, as one list per row."""
        shared, name = self._shared, self._name

        @F.arrow_udf(f"array<{result}>")
        def cut(chunks: pa.Array) -> pa.Array:
            vocab = shared.value
            seen = _worker_memory(name)
            places = _worker_memory(name + ":places")
            if not places:
                places.update((piece, i) for i, piece in enumerate(vocab))

            def known(chunk: str) -> list[int]:
                found = seen.get(chunk)
                if found is None:
                    found = [places[p] for w in _basic_words(chunk) for p in match_pieces(w, vocab)]
                    if len(seen) >= MAX_REMEMBERED:
                        seen.clear()
                    seen[chunk] = found
                return found

            values = list(vocab) if result == "string" else list(vocab.values())
            names = pa.array(values, pa.string() if result == "string" else pa.int32())
            return in_slices(chunks, lambda some: expand_values(some, known, names))

        return cut(F.split(text, _BLANKS))

    def pieces(self, text: Column) -> Column:
        """Pieces of a text as given, without markers."""
        return self._cut(text, "string")

    def encode(self, text: Column) -> Column:
        """Vocabulary indexes of a text's pieces, without markers."""
        return self._cut(text, "int")

    def tokenize(self, text: Column) -> Column:
        """Pieces of the marked text; a missing text gives the two markers."""
        return self.pieces(mark_text(text))

    def id_of(self, piece: str) -> int:
        return self.ids[piece]

    def to_ids(self, pieces: Column) -> Column:
        """Vocabulary index of each piece, unknown pieces as ``[UNK]``."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def encode(lists: pa.Array) -> pa.Array:
            return in_slices(lists, lambda some: map_values(some, shared.value, shared.value[UNK], pa.int32()))

        return encode(pieces)

    def to_pieces(self, ids: Column) -> Column:
        """Piece of each vocabulary index."""
        shared, name = self._shared, self._name

        @F.arrow_udf("array<string>")
        def decode(lists: pa.Array) -> pa.Array:
            names = _worker_memory(name + ":names")
            if not names:
                names.update((i, p) for p, i in shared.value.items())
            return in_slices(lists, lambda some: map_values(some, names, UNK, pa.string()))

        return decode(ids)


_MEMORY: dict[str, dict] = {}


def _worker_memory(key: str) -> dict:
    """What this worker process has worked out for one vocabulary."""
    if key not in _MEMORY:
        if len(_MEMORY) > 8:
            _MEMORY.clear()
        _MEMORY[key] = {}
    return _MEMORY[key]
