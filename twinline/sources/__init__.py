"""Readers; every one declares its schema and returns a DataFrame."""

from .lines import (  # noqa: F401
    read_column,
    read_lines,
    read_parallel_lines,
    read_parallel_outer,
    read_raw_split,
    read_text_shards,
)
from .nested import flatten_articles, read_nested_articles  # noqa: F401
from .tabular import (  # noqa: F401
    read_aligned_pairs,
    read_article_metadata,
    read_pairs,
    read_prepared_aligned,
    read_prepared_pairs,
    read_scored_pairs,
)
