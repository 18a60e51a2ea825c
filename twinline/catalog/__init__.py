"""All queries over the given tables, by inventory number."""

from . import corpora, files, language, metrics, pieces, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
