"""Dictionary work on list columns inside Arrow batches: Python sees each distinct value once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Values of a batch that are worked on together.
SLICE_VALUES = 1 << 19


def _row_bounds(lists: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _rebuilt(bounds: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values, mask=mask)


def in_slices(lists: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` over runs of rows with about ``SLICE_VALUES`` values each, so its memory doesn't follow the batch's."""
    ends = _row_bounds(lists)[1:]
    cuts = np.flatnonzero(np.diff(ends // SLICE_VALUES)).tolist()
    if not cuts:
        return work(lists)
    bounds = [0, *(c + 1 for c in cuts), len(lists)]
    return pa.concat_arrays([work(lists.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])])


class Table:
    """Values and their numbers as two Arrow arrays, a fraction of a dictionary's size; of equal values the last counts."""

    def __init__(self, numbers: dict):
        self.values = pa.array(list(numbers), pa.string())
        self.numbers = pa.array(list(numbers.values()), pa.int32())

    def look_up(self, lists: pa.Array, default: int | None) -> pa.Array:
        """Each value replaced by its number."""
        coded = lists.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary.cast(pa.string()), self.values)
        found = pc.if_else(pc.is_null(at), pa.scalar(default, pa.int32()), self.numbers.take(at))
        return _rebuilt(_row_bounds(lists), found.take(coded.indices), lists)


def map_values(lists: pa.Array, table, default, kind: pa.DataType) -> pa.Array:
    """Each value replaced by its entry in ``table``."""
    coded = lists.flatten().dictionary_encode()
    found = pa.array([table.get(v, default) for v in coded.dictionary.to_pylist()], kind)
    return _rebuilt(_row_bounds(lists), found.take(coded.indices), lists)


def expand_values(lists: pa.Array, parts_of, names: pa.Array) -> pa.Array:
    """Each value replaced by ``names`` at the places ``parts_of(value)``, all in one flat list per row."""
    coded = lists.flatten().dictionary_encode()
    parts = [parts_of(v) for v in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter(chain.from_iterable(parts), np.int64, int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    index = coded.indices.to_numpy(zero_copy_only=False)
    counts = lengths[index]
    ends = np.cumsum(counts)
    places = np.arange(counts.sum()) + np.repeat(first[index] - (ends - counts), counts)
    bounds = np.concatenate([[0], ends])[_row_bounds(lists)]
    return _rebuilt(bounds, names.take(pa.array(flat[places])), lists)


def with_rest(lists: pa.Array, ids: pa.Array) -> pa.StructArray:
    """The ``ids`` of each list, and the ``places`` in it and ``words`` of those values that have none."""
    bounds = _row_bounds(lists)
    lacking = np.flatnonzero(ids.flatten().is_null().to_numpy(zero_copy_only=False))
    rest = np.searchsorted(lacking, bounds)
    places = pa.array((lacking - np.repeat(bounds[:-1], np.diff(rest))).astype(np.int32))
    words = lists.flatten().take(pa.array(lacking))
    ends = pa.array(rest.astype(np.int32))
    parts = [ids, pa.ListArray.from_arrays(ends, places), pa.ListArray.from_arrays(ends, words)]
    return pa.StructArray.from_arrays(parts, ["ids", "places", "words"])


def fill_nulls(lists: pa.Array, values: pa.Array) -> pa.Array:
    """The nulls inside of each list replaced, in order, by the row's ``values``, one for each null."""
    flat = lists.flatten()
    return _rebuilt(_row_bounds(lists), pc.replace_with_mask(flat, flat.is_null(), values.flatten()), lists)
