"""Bit filters of the package, for this subpackage's operators."""

from __future__ import annotations

from ..operators.bits import BITS_PER_KEY, MAX_BITS, cells, filter_bits, filter_words, may_hold  # noqa: F401
