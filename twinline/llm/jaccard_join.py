"""Exact Jaccard join on word shingles by universe partition and pigeonhole.

Sets whose Jaccard similarity is at least 3/4 differ in at most ``(|x| + |y|) / 7`` elements. All shingles
are hashed into segments, as many for all sets of a size band, so that few differences touch few segments:
of segments that together count ``H + 1`` units, one at least must agree, where

* an equal subset in a segment counts one unit, and
* a segment that is indexed with all its one-deletion neighbours counts two, as it survives one difference.

A set walks over the segments in one order for all sets and indexes the first non-empty ones until it has
``H + 1`` units. Of two similar sets, the one that stops first has a unit that agrees and that the other has
indexed too. Costs decide the order and the kind: shingles that are frequent in a bounded sample of documents
come last, in wider segments with one-deletion neighbours; most sets have enough units before. The sample
moves only cost: a set that runs out of segments indexes single shingles as well, so no pair is ever lost.

A set indexes an eighth more units than it needs. Signatures of many sets are heavy: two sets that both keep
enough units without heavy ones meet in a light bucket anyway, so heavy buckets only compare pairs with a set that
doesn't, and go through the bucket's smallest class first: what is one component by then needs no further comparison.
A bitmap of each set holds the parities of its shingles' places: two that differ in a place differ in a shingle, so
bitmaps bound the difference of a pair from below, however often they are folded. 128 bits of it go beside each
signature and drop most pairs of small sets inside the bucket; pairs that the whole bitmap leaves are verified on their
whole sets, and linked sets become components. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bits import cells, filter_bits, filter_words, may_hold
from .components import components
from .words import NOT_SPACE, mix, shingle_sets, word_slices

SHINGLE = 5
# Documents looked at for shingles that are frequent; a shingle counts as such from this many of them on.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT_IN = 2000, 100_000, 4
# Size bands end at 64 and then at four times the band before. A band's segments number half its largest set.
FIRST_BAND = 64
FIRST_SEGMENTS_LOG2 = 20
# A bucket of more classes is heavy. All pairs of a light one are compared.
LIGHT_BUCKET = 8
# Bits of a set's bitmap: one or two for each shingle, between these powers of two.
LEAST_BITS_LOG2, MOST_BITS_LOG2, FOLDED_BITS = 9, 16, 512
# What a class takes in a block: its name, its size and a bitmap folded to these bits.
BESIDE_BITS = 128
ENTRY_BYTES = 8 + 4 + BESIDE_BITS // 8
# Classes of a heavy bucket's smallest class that are compared in one task; more are dealt into blocks.
HUB_BLOCK = 20_000
# Signatures are dealt into cells by hash, each for about so many bytes of text.
CELL_BYTES = 32 << 20
# A block of signatures leaves a task when it has so many.
BLOCK = 1 << 18

_HIGH = np.uint64(40)


def linked(common: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int):
    """Similarity of at least 3/4, in whole numbers."""
    return 100 * common >= 75 * (x + y - common)


def _band(size: int) -> int:
    band, top = 0, FIRST_BAND
    while size > top:
        band, top = band + 1, top * 4
    return band


def _segments_log2(band: int) -> int:
    """Half of the band's largest set; practically one shingle each in the first band."""
    return FIRST_SEGMENTS_LOG2 if band == 0 else (FIRST_BAND * 4**band).bit_length() - 2


def _subsets(tokens: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty segments of sorted tokens: their numbers, their starts, and a sum that stands for the subset."""
    segments = tokens >> np.uint64(64 - log2)
    starts = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1])))
    return segments[starts], starts, np.add.reduceat(mix(tokens), starts)


def _tag(segments: np.ndarray, space: int) -> np.ndarray:
    return mix(segments * np.uint64(1024) + np.uint64(space))


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The signatures a set is indexed with, and how many units it can spare."""
    n = len(tokens)
    units = (n + 4 * n // 3) // 7 + 1
    wanted = units + units // 8 + 2
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hot = frequent[at] == tokens
        rare, hot = tokens[~hot], tokens[hot]
    else:
        rare, hot = tokens, tokens[:0]
    out, spare = [], wanted - units
    # A set has partners in the next band only if a third more elements reach it.
    for band in range(_band(n), _band(4 * n // 3) + 1):
        left, log2 = wanted, _segments_log2(band)
        if len(rare):
            segments, _, sums = _subsets(rare, log2)
            out.append(sums[:left] ^ _tag(segments[:left], 4 * band))
            left -= len(segments)
        if left > 0 and len(hot):
            left = _one_deletions(hot, log2, band, left, out)
        if left > wanted - units:
            # Too few segments: all of them are indexed by now, and two such sets meet by single shingles.
            alone = tokens[:wanted]
            out.append(alone ^ _tag(np.zeros(len(alone), dtype=np.uint64), 4 * band + 2))
            spare = min(spare, len(alone) - units)
        else:
            spare = min(spare, wanted - units - max(left, 0))
    return mix(np.concatenate(out)), spare


def bitmap(tokens: np.ndarray) -> bytes:
    """For each value of a shingle's low bits, whether an odd number of shingles has it."""
    bits = 1 << min(MOST_BITS_LOG2, max(LEAST_BITS_LOG2, (len(tokens) - 1).bit_length()))
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def folded(bits: bytes, size: int = FOLDED_BITS) -> np.ndarray:
    """A bitmap as ``size`` bits in 64-bit words."""
    x = np.frombuffer(bits, dtype=np.uint8)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.uint64)


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has, from their bitmaps."""
    size = 8 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def least_differences(x: bytes, others: list[bytes], some: int = 2048) -> np.ndarray:
    """``least_difference`` of a bitmap and each of several; ``some`` are laid side by side at a time."""
    out, lengths = np.zeros(len(others), dtype=np.int64), np.array([len(o) for o in others], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        size, alike = min(length, len(x)), np.flatnonzero(lengths == length)
        own = folded(x, 8 * size)
        for at in (alike[i : i + some] for i in range(0, len(alike), some)):
            maps = np.frombuffer(b"".join(others[i] for i in at), dtype=np.uint64).reshape(len(at), length // 8)
            while maps.shape[1] > size // 8:
                half = maps.shape[1] // 2
                maps = maps[:, :half] ^ maps[:, half:]
            out[at] = np.bitwise_count(maps ^ own).sum(axis=1, dtype=np.int64)
    return out


def _one_deletions(hot: np.ndarray, log2: int, band: int, left: int, out: list[np.ndarray]) -> int:
    """Index segments of frequent shingles, four times as wide, with their one-deletion neighbours."""
    segments, starts, sums = _subsets(hot, max(1, log2 - 2) if band else log2)
    sizes = np.diff(np.append(starts, len(hot)))
    worth = np.cumsum(np.where(sizes > 1, 2, 1))
    used = int(np.searchsorted(worth, left)) + 1
    tags = _tag(segments, 4 * band + 1)
    out.append(sums[:used] ^ tags[:used])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = (owner < used) & (sizes[owner] > 1)
    out.append((sums[owner[inside]] - mix(hot[inside])) ^ tags[owner[inside]])
    return left - int(worth[min(used, len(worth)) - 1])


def set_class(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    name = mix(np.array([np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(tokens))]))
    return int(name.view(np.int64)[0])


def _sample(docs: DataFrame, key: str, text: str, n_docs: int) -> np.ndarray:
    """Shingles of at least ``FREQUENT_IN`` different texts among ``SAMPLE_DOCS`` documents of moderate length picked by hash."""
    picked = (
        docs.filter(F.length(text).between(1, SAMPLE_CHARS))
        .select(F.xxhash64(F.lit(1), F.col(key), F.length(text)).alias("draw"), F.col(text).alias("text"))
        # About four times as many compete for the sample.
        .filter(F.pmod("draw", F.lit(1 << 30)) < max(1, min(1.0, 4 * SAMPLE_DOCS / max(n_docs, 1)) * (1 << 30)))
        .orderBy("draw")
        .limit(SAMPLE_DOCS)
        .select("text")
        .distinct()
        .toArrow()
        .column("text")
    )
    sets = [s for words in word_slices(picked, NOT_SPACE) for s in shingle_sets(words, SHINGLE)]
    found, counts = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_counts=True)
    return found[counts >= FREQUENT_IN]


def _place_type(n: int) -> type:
    """Places of a block of ``n`` classes take two bytes where they can."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _index(docs: DataFrame, key: str, text: str, cells: int, frequent) -> DataFrame:
    """Two kinds of rows: a document with its class, or a block of a cell's signatures with their classes."""
    names = ["doc_id", "n_shingles", "class", "spare", "bits", "cell", "block"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    schema = "doc_id long, n_shingles long, class long, spare long, bits binary, cell int, block binary"

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        whole = [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(whole, names)

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]], known: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
        cell = (found >> _HIGH) % np.uint64(cells)
        order = np.argsort(cell, kind="stable")
        found, owners, cell = found[order], owners[order], cell[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        out = []
        for low, high in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            # Classes are named once in a block, and by short places after that.
            classes, places = np.unique(owners[low:high], return_inverse=True)
            entries = [known[c] for c in classes.tolist()]
            sizes = np.array([n for n, _ in entries], dtype=np.int32)
            maps = np.stack([m for _, m in entries])
            # The low 32 bits tell apart the signatures of a cell; a clash costs one more comparison.
            codes = [found[low:high].astype(np.uint32), places.astype(_place_type(len(classes)))]
            head = np.array([len(classes)], dtype=np.int64)
            out.append(b"".join(x.tobytes() for x in (head, classes, maps, sizes, *codes)))
        yield batch_of(len(out), cell=pa.array(cell[starts].astype(np.int32)), block=pa.array(out, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, {}
        for batch in batches:
            rows = []
            for words in word_slices(batch.column("text"), NOT_SPACE):
                for tokens in shingle_sets(words, SHINGLE):
                    if not len(tokens):
                        rows.append((0, None, None, None))
                        continue
                    name = set_class(tokens)
                    found, spare = signatures(tokens, frequent.value)
                    bits = bitmap(tokens)
                    rows.append((len(tokens), name, spare, bits))
                    if name not in seen:
                        seen[name] = len(tokens), folded(bits, BESIDE_BITS)
                        held.append((found, np.full(len(found), name, dtype=np.int64)))
                        size += len(found)
                if size >= BLOCK:
                    yield from blocks(held, seen)
                    held, size, seen = [], 0, {}
            columns = zip(names[1:5], kinds[1:5], zip(*rows, strict=True), strict=True) if rows else ()
            yield batch_of(len(rows), doc_id=batch.column("doc_id"), **{c: pa.array(x, k) for c, k, x in columns})
        if held:
            yield from blocks(held, seen)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _buckets(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes, set sizes and folded bitmaps of all signatures that more than one class has, a bucket after the
    other; and the buckets' starts and lengths."""
    found, owners, sizes, maps, named = [], [], [], [], 0
    places = []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
        kind = np.dtype(_place_type(n))
        codes = 8 + ENTRY_BYTES * n
        body = (len(blob) - codes) // (4 + kind.itemsize)
        owners.append(np.frombuffer(blob, dtype=np.int64, offset=8, count=n))
        maps.append(np.frombuffer(blob, dtype=np.uint64, offset=8 + 8 * n, count=n * BESIDE_BITS // 64))
        sizes.append(np.frombuffer(blob, dtype=np.int32, offset=8 + (ENTRY_BYTES - 4) * n, count=n))
        found.append(np.frombuffer(blob, dtype=np.uint32, offset=codes, count=body))
        places.append(np.frombuffer(blob, dtype=kind, offset=codes + 4 * body, count=body).astype(np.int32) + np.int32(named))
        named += n
    found, places, owners, sizes, maps = (np.concatenate(x) for x in (found, places, owners, sizes, maps))
    maps = maps.reshape(named, BESIDE_BITS // 64)
    order = np.argsort(found, kind="stable")
    found, places = found[order], places[order]
    # Signatures of one class only go first; what is left is small.
    same = found[1:] == found[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    found, places = found[shared], places[shared]
    order = np.lexsort((owners[places], found))
    found, places = found[order], places[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[places[1:]] != owners[places[:-1]])
    found, places = found[new], places[new]
    starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(found)))
    return owners[places], sizes[places].astype(np.int64), maps[places], starts, lengths


def _candidates(index: DataFrame) -> DataFrame:
    """Three kinds of rows: pairs ``u < v`` to compare; heavy buckets, ``u`` their smallest class and ``members``
    all; and how many heavy signatures, ``n``, class ``u`` has in a cell."""

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        owners, sizes, maps, starts, lengths = _buckets(list(frame["block"]))
        seen, heavy, counted = [np.zeros((2, 0), dtype=np.int64)], {}, []

        def add(a: np.ndarray, b: np.ndarray) -> None:
            near = 4 * np.minimum(sizes[a], sizes[b]) >= 3 * np.maximum(sizes[a], sizes[b])
            apart = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64)
            near &= apart <= (sizes[a] + sizes[b]) // 7
            seen.append(np.stack([owners[a[near]], owners[b[near]]]))

        for length in range(2, LIGHT_BUCKET + 1):
            own = starts[lengths == length]
            for i in range(length):
                for j in range(i + 1, length):
                    add(own + i, own + j)
        for low, length in zip(*(x[lengths > LIGHT_BUCKET] for x in (starts, lengths)), strict=True):
            members = owners[low : low + length]
            heavy[members.tobytes()] = members[0]
            counted.append(members)
            add(np.full(length - 1, low), np.arange(low + 1, low + length))
        both = np.unique(np.concatenate(seen, axis=1), axis=1)
        classes, counts = np.unique(np.concatenate([*counted, np.zeros(0, np.int64)]), return_counts=True)
        tail = len(classes)
        return pd.DataFrame(
            {
                "u": np.concatenate((both[0], np.array(list(heavy.values()), dtype=np.int64), classes)),
                "v": pd.array([*both[1].tolist(), *[None] * (len(heavy) + tail)], dtype="Int64"),
                "members": [*[None] * both.shape[1], *heavy, *[None] * tail],
                "n": pd.array([*[None] * (both.shape[1] + len(heavy)), *counts.tolist()], dtype="Int64"),
            }
        )

    blocks = index.filter("cell is not null").select("cell", "block")
    return blocks.groupBy("cell").applyInPandas(pairs, "u long, v long, members binary, n long")


def _members(heavy: DataFrame) -> DataFrame:
    """``u, v``: the smallest class of a bucket with every one of it, distinct in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros((2, 0), dtype=np.int64)]
            for blob in batch.column("members"):
                members = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                seen.append(np.stack([np.full(len(members), members[0]), members]))
            both = np.unique(np.concatenate(seen, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    return heavy.select("members").mapInArrow(run, "u long, v long")


def _open(members: DataFrame, roots: DataFrame, bare: DataFrame) -> DataFrame:
    """``u, v, root`` of the members of those ``u`` that have a ``bare`` member and members of several components by ``roots``."""
    known = members.select("u", "v").join(roots.select(F.col("node").alias("v"), "root"), "v", "left")
    known = known.join(bare.select(F.col("class").alias("v"), F.lit(True).alias("bare")), "v", "left")
    known = written(known.withColumn("root", F.coalesce("root", "v")), "known")
    spans = known.groupBy("u").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("bare").alias("bare"))
    several = spans.filter("least < most and bare").select("u")
    return written(known.select("u", "v", "root").join(several, "u", "left_semi"), "open")


def _rest(members: DataFrame, bare: DataFrame, classes: DataFrame, keep: str) -> DataFrame:
    """Pairs with a ``bare`` class among ``members(u, v, root)`` of the same heavy buckets, but for those of one
    component, and for those that sizes or small bitmaps tell apart. Of a bare class's partners in a
    task ``keep`` takes the ``nearest`` by bitmap (of several the smallest name), the nearest of ``each`` component, or ``all``.

    The classes of a ``u`` with more than ``HUB_BLOCK`` are dealt into blocks by hash, and a task compares the bare ones
    of one block with all of another.
    """
    known = classes.select(F.col("class").alias("v"), "n_shingles", "bits")
    flags = members.join(known, "v")
    flags = flags.join(bare.select(F.col("class").alias("v"), F.lit(True).alias("bare")), "v", "left")

    many = members.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / HUB_BLOCK).alias("blocks")).filter("blocks > 1")
    flags = flags.join(many, "u", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    flags = flags.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    answers = F.transform(every, lambda i: F.struct(i.alias("asking"), F.col("own").alias("answering")))
    asks = F.transform(every, lambda i: F.struct(F.col("own").alias("asking"), i.alias("answering")))
    flags = flags.withColumn("task", F.explode(F.when(F.col("bare"), F.array_union(answers, asks)).otherwise(answers)))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        task = group["task"].iloc[0]
        asked = (group["own"] == task["answering"]).to_numpy()
        asking = group["bare"].notna().to_numpy() & (group["own"] == task["asking"]).to_numpy()
        names = group["v"].to_numpy(dtype=np.int64)
        sizes = group["n_shingles"].to_numpy(dtype=np.int64)
        parts = group["root"].to_numpy(dtype=np.int64)
        maps = np.stack([folded(b) for b in group["bits"]])
        whole = list(group["bits"])
        seen = [np.zeros((2, 0), dtype=np.int64)]
        for one in np.flatnonzero(asking):
            fits = asked & (4 * np.minimum(sizes, sizes[one]) >= 3 * np.maximum(sizes, sizes[one])) & (parts != parts[one])
            other = np.flatnonzero(fits)
            apart = np.bitwise_count(maps[other] ^ maps[one]).sum(axis=1, dtype=np.int64)
            most = (sizes[other] + sizes[one]) // 7
            other, apart, most = other[apart <= most], apart[apart <= most], most[apart <= most]
            # Folded maps of large sets tell little: what they leave is compared by the whole ones before it becomes a row.
            if 8 * len(whole[one]) > FOLDED_BITS:
                apart = least_differences(whole[one], [whole[o] for o in other])
                other, apart = other[apart <= most], apart[apart <= most]
            if keep != "all" and len(other):
                other = other[np.lexsort((names[other], apart))]
                if keep == "nearest":
                    other = other[:1]
                else:
                    other = other[np.unique(parts[other], return_index=True)[1]]
            seen.append(np.stack([np.minimum(names[one], names[other]), np.maximum(names[one], names[other])]))
        both = np.unique(np.concatenate(seen, axis=1), axis=1)
        return pd.DataFrame({"u": both[0], "v": both[1]})

    return flags.groupBy("u", "task").applyInPandas(pairs, "u long, v long").distinct()


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave room for enough similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, m, n, x, y = (batch.column(c).to_pylist() for c in ("u", "v", "m", "n", "x", "y"))
            near = [least_difference(a, b) <= (i + j) // 7 for a, b, i, j in zip(x, y, m, n, strict=True)]
            kept = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"])
            yield kept.filter(pa.array(near, pa.bool_()))

    right = classes.select(F.col("class").alias("v"), F.col("n_shingles").alias("n"), F.col("bits").alias("y"))
    left = classes.select(F.col("class").alias("u"), F.col("n_shingles").alias("m"), F.col("bits").alias("x"))
    sized = pairs.join(right, "v").join(left, "u").filter("4 * least(m, n) >= 3 * greatest(m, n)")
    return sized.mapInArrow(run, "u long, v long")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``u, v, similar`` of the given pairs, from the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One pair of sets at a time, however long the texts of a batch are.
            x, y = ((s for w in word_slices(batch.column(c), NOT_SPACE) for s in shingle_sets(w, SHINGLE)) for c in "xy")
            similar = [
                bool(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))) for a, b in zip(x, y, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(similar, pa.bool_())], ["u", "v", "similar"]
            )

    held = pairs.join(texts.select(F.col("class").alias("v"), F.col("text").alias("y")), "v")
    held = held.join(texts.select(F.col("class").alias("u"), F.col("text").alias("x")), "u")
    return held.mapInArrow(run, "u long, v long, similar boolean")


def _texts(docs: DataFrame, key: str, text: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class, text`` for the classes of ``pairs``, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [
                set_class(found) if len(found) else None
                for words in word_slices(batch.column("text"), NOT_SPACE)
                for found in shingle_sets(words, SHINGLE)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("text")], ["class", "text"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    wanted = written(classes.join(ends, "class", "left_semi").select("class", "first"), "wanted")
    bits = filter_bits(wanted.count())
    cell = wanted.select(F.explode(F.array(*cells(bits, "first"))).alias("cell")).distinct()
    docs = docs.select(F.col(key).cast("long").alias("first"), F.col(text).alias("text"))
    # Only documents that the filter may hold are shuffled.
    docs = docs.filter(may_hold(filter_words(cell, bits), bits, "first"))
    first = wanted.select(F.col("first").alias("other")).distinct()
    held = docs.join(first, docs["first"].eqNullSafe(first["other"]), "left_semi").select("text").mapInArrow(run, "class long, text string")
    # Rows that share an id may bring sets of other classes, or one set twice.
    return held.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.max("text").alias("text"))


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``, and ``class``, equal for equal sets.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a set holds the distinct runs of five words, or
    the whole sequence of fewer. Sets link from a Jaccard similarity of 3/4; ``component_id`` is the smallest id
    that links reach. Null and empty texts have empty sets and are their own component; null ids count as no
    id; rows that share an id count each for themselves. Other columns are not read.
    """
    spark = docs.sparkSession
    size, n_docs = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    frequent = spark.sparkContext.broadcast(_sample(docs, key, text, n_docs))
    index = written(_index(docs, key, text, max(12, (size or 0) // CELL_BYTES), frequent), "signatures")
    rows = index.filter("cell is null").select("doc_id", "n_shingles", "class")
    classes = index.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("first"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("spare").alias("spare"),
        F.first("bits").alias("bits"),
    )
    classes = written(classes, "classes")

    found = written(_candidates(index), "candidates")
    pairs = found.filter("v is not null").select("u", "v").distinct()
    near = written(_near(pairs, classes), "near")
    checked = written(_verify(near, written(_texts(docs, key, text, classes, near), "texts")), "links")
    # Classes that heavy signatures leave with too few units, and the heavy buckets they are in.
    load = found.filter("n is not null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("n"))
    bare = written(load.join(classes, "class").filter("2 * n > spare").select("class"), "bare")
    members = _members(found.filter("members is not null")).distinct()
    members = written(_members(found.filter("members is not null")).distinct(), "members")
    roots = written(components(checked.filter("similar").select("u", "v")), "roots")
    # Nearest partners join most components, so that few pairs are left between those that are different after that.
    for keep in ("nearest", "each", "all"):
        members = _open(members, roots, bare)
        few = written(classes.join(members.select("v").distinct(), F.col("class") == F.col("v"), "left_semi"), "few")
        near = written(_rest(members, bare, few, keep), "rest")
        # Components only grow: a bare class that no bucket has a partner for by now has none later.
        ends = near.select(F.explode(F.array("u", "v")).alias("class")).distinct()
        bare = written(bare.join(ends, "class", "left_semi"), "bare")
        more = written(_near(near.join(checked.select("u", "v"), ["u", "v"], "left_anti"), few), "more")
        later = written(_verify(more, written(_texts(docs, key, text, classes, more), "texts")), "links")
        checked = checked.unionByName(later)
        edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = written(components(edges.unionByName(later.filter("similar").select("u", "v"))), "roots")

    named = classes.join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    least_id = named.filter("node is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least_id, "root", "left").select("class", F.coalesce("least", "first").alias("component_id"))
    return rows.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class"
    )
