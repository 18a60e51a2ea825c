"""Benchmark passages in documents by Wu-Manber search over words.

The patterns are all windows of 13 words of the benchmark items (a shorter item is one window). For
each pattern length a shift table, indexed by a hash of two neighbouring words, tells how far the search
may jump from a position that no pattern's end can cover; where the jump is zero, the bucket of patterns
with these last two words is compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .words import LETTERS, mix, word_slices

WINDOW = 13
# Items are searched in blocks of so many bytes of text, one pass over the documents for each block.
BLOCK_BYTES = 1 << 20
# A document's positions are searched in lanes of so many, all lanes of a slice side by side.
LANE = 64

_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + last)


class Patterns:
    """Wu-Manber tables for patterns of one length: ``rows`` is a matrix of word hashes."""

    def __init__(self, rows: np.ndarray, owners: list[list[int]]):
        self.length = rows.shape[1]
        block = min(2, self.length)
        # One-word patterns have blocks of one word: the word stands for its predecessor as well.
        ends = [_block(rows[:, j - block + 1], rows[:, j]) for j in range(block - 1, self.length)]
        order = np.argsort(ends[-1], kind="stable")
        self.rows, self.suffix = rows[order], ends[-1][order]
        self.owners = [owners[i] for i in order]
        self.block = block
        self.mask = np.uint64((1 << max(12, (8 * rows.size).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.length - block + 1, dtype=np.int64)
        for jump, hashes in enumerate(reversed(ends)):
            np.minimum.at(self.shift, (hashes & self.mask).astype(np.int64), jump)

    def find(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End positions and pattern numbers of all occurrences inside the texts."""
        first = bounds[:-1] + self.length - 1
        room = np.maximum(bounds[1:] - first, 0)
        lanes = -(-room // LANE)
        which = np.repeat(np.arange(len(room)), lanes)
        step = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[which] + step * LANE
        stop = np.minimum(at + LANE, bounds[1:][which])
        stops: list[np.ndarray] = []
        while len(at):
            hashes = _block(words[at - self.block + 1], words[at])
            jump = self.shift[(hashes & self.mask).astype(np.int64)]
            stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(stops) if stops else np.zeros(0, dtype=np.int64)
        hashes = _block(words[ends - self.block + 1], words[ends])
        low, high = np.searchsorted(self.suffix, hashes), np.searchsorted(self.suffix, hashes, side="right")
        sizes = high - low
        ends = np.repeat(ends, sizes)
        found = np.repeat(low, sizes) + np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k in range(self.length):
            same = words[ends - self.length + 1 + k] == self.rows[found, k]
            ends, found = ends[same], found[same]
        return ends, found


def build_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> tuple[list[Patterns], list[str]]:
    """The tables of ``(item_id, text)`` rows, by length, and the item ids their owners point to."""
    ids = sorted({item for item, _ in items})
    number = {item: i for i, item in enumerate(ids)}
    owners: dict[int, dict[bytes, set[int]]] = {}
    for words in word_slices(pa.array([text for _, text in items], pa.large_string()), LETTERS):
        for i in range(len(words)):
            part = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            length = min(window, len(part))
            for k in range(len(part) - length + 1 if length else 0):
                held = owners.setdefault(length, {}).setdefault(part[k : k + length].tobytes(), set())
                held.add(number[items[words.first + i][0]])
    tables = [
        Patterns(
            np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), length), [sorted(x) for x in rows.values()]
        )
        for length, rows in sorted(owners.items())
    ]
    return tables, ids


def search(column: pa.Array, tables: list[Patterns], ids: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text: its number of words, disjoint hit spans ``[start, end)`` as flat pairs, and items found."""
    for words in word_slices(column, LETTERS):
        cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        items: dict[int, set[int]] = {}
        for table in tables:
            ends, found = table.find(words.hashes, words.bounds)
            np.add.at(cover, ends - table.length + 1, 1)
            np.add.at(cover, ends + 1, -1)
            texts = np.searchsorted(words.bounds, ends, side="right") - 1
            for text, pattern in set(zip(texts.tolist(), found.tolist(), strict=True)):
                items.setdefault(text, set()).update(table.owners[pattern])
        hit = np.cumsum(cover)[:-1] > 0
        for i in range(len(words)):
            low, high = words.bounds[i], words.bounds[i + 1]
            spans = np.zeros(0, dtype=np.int64)
            if i in items:
                edges = np.diff(np.concatenate(([False], hit[low:high], [False])).astype(np.int8))
                spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).ravel()
            yield int(high - low), spans, [ids[x] for x in sorted(items.get(i, ()))]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    if len(pairs) < 2:
        return pairs.ravel()
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]))
    return np.stack([pairs[new, 0], reach[last]], axis=1).ravel()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_bytes`` of text (or one item); one block at a time on the driver."""
    rows = items.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    block: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` (its columns ``keep``, all by default) with a struct ``n_words, n_hit, spans, items``; and that column's name.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. ``spans`` holds the hit words as
    int64 pairs ``[start, end)``, ``items`` the ids found, sorted as strings (a null id is ``''``; rows that
    share an id are one item). Null and empty texts have no words. Documents stay where they are; the
    items of a block are sent to every task.
    """
    column = free_name(docs, "contamination")
    state = None
    for block in item_blocks(items, item_key, item_text, block_bytes):
        if state is not None:
            state = written(state, "passages")
        shared = docs.sparkSession.sparkContext.broadcast(build_patterns(block, window))
        state = _scan(docs if state is None else state, column, text, shared)
    if state is None:
        state = _scan(docs, column, text, docs.sparkSession.sparkContext.broadcast(([], [])))
    return state.select(*(docs.columns if keep is None else keep), column), column


def _scan(docs: DataFrame, column: str, text: str, shared) -> DataFrame:
    earlier = column in docs.columns
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != column], T.StructField(column, _STATE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, ids = shared.value
        for batch in batches:
            names = [n for n in batch.schema.names if n != column]
            old = batch.column(column).to_pylist() if earlier else None
            out = []
            for i, (n, spans, items) in enumerate(search(batch.column(text), tables, ids)):
                if old:
                    spans = _merged(np.concatenate((np.frombuffer(old[i]["spans"], dtype=np.int64), spans)))
                    items = sorted({*old[i]["items"], *items})
                hits = int(spans[1::2].sum() - spans[::2].sum())
                out.append({"n_words": n, "n_hit": hits, "spans": spans.tobytes(), "items": items})
            kind = pa.struct(
                [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))]
            )
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, kind)], [*names, column])

    return docs.mapInArrow(run, schema)


def is_contaminated(column: str) -> Column:
    """At least one word in twenty is hit."""
    return (F.col(f"{column}.n_hit") > 0) & (20 * F.col(f"{column}.n_hit") >= F.col(f"{column}.n_words"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    found, column = find_passages(docs.select(F.col(key).alias("doc_id"), "text"), items, keep=["doc_id"], **options)
    return found.select(
        "doc_id",
        f"{column}.n_words",
        f"{column}.n_hit",
        F.size(f"{column}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{column}.items", ","), 256).alias("items_sha256"),
        is_contaminated(column).alias("contaminated"),
    )
