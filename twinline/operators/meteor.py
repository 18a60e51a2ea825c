"""METEOR per row.

A token of the hypothesis takes the last free equal token of the reference, going from the end; so the
k-th equal token from the end meets the k-th from the end. First equal texts, then equal stems, then
synonyms. All of it concerns one row only, so rows stay in place and go through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from .skew import collect_small

# Weights of the published metric.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def _pair_up(hyp: list, ref: list, name: Callable[[str], str], pairs: list) -> tuple[list, list]:
    """Move pairs of equal names from both lists of ``(place, word)`` to ``pairs``."""
    free: dict[str, list[int]] = {}
    for place, word in ref:
        free.setdefault(name(word), []).append(place)
    taken, left = set(), []
    for place, word in reversed(hyp):
        places = free.get(name(word))
        if places:
            other = places.pop()
            taken.add(other)
            pairs.append((place, other))
        else:
            left.append((place, word))
    return left[::-1], [(p, w) for p, w in ref if p not in taken]


def _pair_synonyms(hyp: list, ref: list, synonyms: dict[str, frozenset], pairs: list) -> None:
    """Like ``_pair_up`` for words that stand in each other's synonym list."""
    places: dict[str, list[int]] = {}
    for place, word in ref:
        places.setdefault(word, []).append(place)
    for place, word in reversed(hyp):
        options = [w for w in {word, *synonyms.get(word, ())} if places.get(w)]
        if options:
            best = max(options, key=lambda w: places[w][-1])
            pairs.append((place, places[best].pop()))


def _score(hyp: list[str], ref: list[str], stems: bool, synonyms: dict, alpha, beta, gamma) -> float:
    pairs: list[tuple[int, int]] = []
    rest_h, rest_r = _pair_up(list(enumerate(hyp)), list(enumerate(ref)), lambda w: w, pairs)
    if stems:
        rest_h, rest_r = _pair_up(rest_h, rest_r, stem, pairs)
    if synonyms:
        _pair_synonyms(rest_h, rest_r, synonyms, pairs)
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(pairs, pairs[1:]))
    precision, recall = len(pairs) / len(hyp), len(pairs) / len(ref)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return (1 - gamma * (chunks / len(pairs)) ** beta) * mean


def meteor(
    hypothesis: Column,
    reference: Column,
    stems: bool = True,
    synonyms: DataFrame | None = None,
    alpha: float = ALPHA,
    beta: float = BETA,
    gamma: float = GAMMA,
    max_bytes: int = 256 << 20,
) -> Column:
    """METEOR of two texts, cut at white space and lower-cased.

    ``reference`` may be a list of texts: the best of their scores counts, and 0 where there are none.

    ``synonyms`` is an optional table ``word, synonym`` (none is shipped). It is sent to every worker;
    ``max_bytes`` bounds its size as JSON, and a larger one is an error.
    """
    table: dict[str, frozenset] = {}
    if synonyms is not None:
        rows = collect_small(synonyms.select("word", "synonym"), max_bytes)
        if rows is None:
            raise ValueError(f"the synonym table takes more than {max_bytes} bytes")
        grouped: dict[str, set] = {}
        for row in rows:
            grouped.setdefault(row[0], set()).add(row[1])
        table = {w: frozenset(s) for w, s in grouped.items()}

    def best(hyp: str | None, refs) -> float:
        words = (hyp or "").lower().split()
        texts = [refs] if refs is None or isinstance(refs, str) else refs
        return max((_score(words, (r or "").lower().split(), stems, table, alpha, beta, gamma) for r in texts), default=0.0)

    @F.pandas_udf("double")
    def score(hyps: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([best(h, r) for h, r in zip(hyps, refs)], dtype="float64")

    return score(hypothesis, reference)
