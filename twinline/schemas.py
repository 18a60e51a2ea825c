"""Schemas and fixed text values shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


ALIGNED = strings("doc_id", "docv_input", "docv_output", "input", "output")
PAIRS = strings("input", "output")
SCORED_PAIRS = strings("input", "output", "matching")

# The texts a pandas reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

# The marker pieces of the word-piece vocabulary.
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIALS = [PAD, UNK, CLS, SEP, MASK]
PAD_ID = 0

# Sentences that hold nothing but markers.
EMPTY_MARKED = ["[CLS] nan [SEP]", "[CLS] [SEP]"]

# Version steps left out of the aligned corpus.
ADJACENT_VERSIONS = [("V0", "V1"), ("V1", "V2"), ("V2", "V3")]

# Fixed value: the longest tokenized sentence kept, markers included.
MAX_PIECES = 512

# Fixed value: least lengths are reported as at most this.
MIN_LENGTH_START = 100
