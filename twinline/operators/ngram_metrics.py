"""SARI and BLEU from counts of n-grams.

A row's score needs its own texts only. Texts are moved once, to the row's key (not at all where rows lie there and
keys don't repeat); their grams, about a dozen per token, are counted for slices of an Arrow batch and never become rows.
``gram_counts`` gives them as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded, lower_tokens

ORDERS = (1, 2, 3, 4)


def _gram_columns(df: DataFrame, key: list[str], wanted: dict[str, tuple[str, bool]]) -> DataFrame:
    """``wanted`` maps new names to (token column, lower case?); adds ``<name>_1`` to ``<name>_4``.

    Every order is built from the one below it in a projection of its own, so each list is computed
    once and read as a column.
    """
    columns = []
    for name, (column, lower) in wanted.items():
        tokens = F.coalesce(F.col(column), F.array().cast("array<string>"))
        columns.append((lower_tokens(tokens) if lower else tokens).alias(f"{name}_1"))
    df = df.select(*key, *columns)
    for n in ORDERS[1:]:
        df = df.withColumns({f"{name}_{n}": _longer(f"{name}_{n - 1}", f"{name}_1", n) for name in wanted})
    return df


def _longer(shorter: str, tokens: str, n: int) -> Column:
    """Grams of order ``n``: each gram of order ``n - 1`` but the last and the token after it."""
    many = F.size(tokens) - (n - 1)
    grams = F.zip_with(
        F.slice(shorter, F.lit(1), many), F.slice(tokens, F.lit(n), many), lambda g, t: F.concat(g, F.lit(" "), t)
    )
    return F.when(many > 0, grams).otherwise(F.array().cast("array<string>"))


def _tagged(name: str, side: str, base: int) -> list[Column]:
    """One list of ``side, n, gram`` per order."""

    def order(n: int) -> Column:
        tag = [F.lit(side).alias("side"), F.lit(base + n).alias("n")]
        return F.transform(F.col(f"{name}_{n}"), lambda g: F.struct(*tag, g.alias("gram")))

    return [order(n) for n in ORDERS]


def gram_counts(
    df: DataFrame, key: list[str], sides: dict[str, str], lower: bool = True, partitioned: bool = False
) -> DataFrame:
    """``key, n, gram`` and one count column per side."""
    placed = df if partitioned else df.repartition(*key)
    ready = _gram_columns(placed, key, {f"__{s}": (c, lower) for s, c in sides.items()})
    parts = [p for side in sides for p in _tagged(f"__{side}", side, 0)]
    rows = exploded(ready, key, F.flatten(F.array(*parts)), "g")
    return _count(rows, key, list(sides))


def _count(rows: DataFrame, key: list[str], sides: list[str]) -> DataFrame:
    counts = [F.count(F.when(F.col("g.side") == s, 1)).alias(s) for s in sides]
    return rows.groupBy(*key, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(*counts)


# Token lists are counted together up to about so many tokens.
SLICE_TOKENS = 200_000
_SIDES = {"s": 0, "c": 1, "r": 2}


def _texts(origin: str, hypothesis: str, reference: str, references: str | None) -> Column:
    """A row's token lists as ``side, at, set, tokens``: ``at`` is the place among several references; grams of one key
    are counted together where ``set`` is the same, with several references the hypothesis's length."""
    none = F.array().cast("array<string>")
    own = F.size(F.coalesce(F.col(hypothesis), none)) if references else F.lit(0)

    def text(side: str, at: Column, tokens: Column) -> Column:
        return F.struct(
            F.lit(_SIDES[side]).alias("side"), at.cast("int").alias("at"), own.alias("set"), F.coalesce(tokens, none).alias("tokens")
        )

    first = [text("s", F.lit(0), F.col(origin)), text("c", F.lit(0), F.col(hypothesis))]
    if references is None:
        return F.array(*first, text("r", F.lit(0), F.col(reference)))
    refs = F.coalesce(F.col(references), F.array().cast("array<array<string>>"))
    return F.concat(F.array(*first), F.transform(refs, lambda r, i: text("r", i, r)))


def _reference_lengths(hypothesis: str, references: str) -> dict[str, Column]:
    """The number of references ``__m``, and the lengths of the nearest one, of equally near ones the shorter
    (``__near``) or first (``__first``)."""
    none = F.array().cast("array<string>")
    refs = F.coalesce(F.col(references), F.array().cast("array<array<string>>"))
    hyp = F.size(F.coalesce(F.col(hypothesis), none))
    sizes = F.transform(refs, lambda r, i: F.struct(F.size(F.coalesce(r, none)).alias("size"), i.alias("at")))
    away = lambda z: F.abs(z["size"] - hyp).alias("away")
    near = F.array_min(F.transform(sizes, lambda z: F.struct(away(z), z["size"].alias("size"))))["size"]
    first = F.array_min(F.transform(sizes, lambda z: F.struct(away(z), z["at"].alias("at"), z["size"].alias("size"))))["size"]
    zero = F.lit(0)
    return {"__m": F.size(refs), "__near": F.coalesce(near, zero), "__first": F.coalesce(first, zero)}


def _grams(tokens: pa.Array, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Per order the text of each gram and the grams, joined by blanks; one with a missing token is null."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts, grams = np.arange(len(text)), tokens
    for n in ORDERS:
        if n > 1:
            ends = starts + n - 1
            inside = ends < len(text)
            inside[inside] = text[ends[inside]] == text[starts[inside]]
            starts = starts[inside]
            grams = pc.binary_join_element_wise(grams.filter(pa.array(inside)), tokens.take(pa.array(starts + n - 1)), " ")
        yield text[starts], grams


def _ratios(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros(len(top)), where=bottom > 0)


def _f1s(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    return _ratios(2 * p * r, p + r)


def _order_values(
    unit, side, at, grams: pa.Array, row_of: np.ndarray, many: np.ndarray, sari: bool, bleu: bool
) -> dict[str, np.ndarray]:
    """Sums over the grams of one order: a value per row. ``unit``, ``side`` and ``at`` say where each gram stands; those
    of one unit are counted together, and ``row_of`` has each unit's row."""
    coded = grams.dictionary_encode(null_encoding="encode")
    code, width = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
    pairs = pa.array(unit * width + code).dictionary_encode()
    place, rows = pairs.indices.to_numpy(), row_of[pairs.dictionary.to_numpy() // width]
    counts = [np.bincount(place[side == i], minlength=len(rows)) for i in range(3)]

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values, len(many))

    found = {}
    if sari:
        # Grams of the source and hypothesis count once for each reference.
        s, c, r = counts[0] * many[rows], counts[1] * many[rows], counts[2]
        kept, deleted = np.minimum(s, c), np.maximum(s - c, 0)
        kept_good, kept_all = np.minimum(kept, r), np.minimum(s, r)
        new = counts[0] == 0
        added, added_all = new & (counts[1] > 0), new & (r > 0)
        shares = total(_ratios(np.maximum(deleted - r, 0), deleted))
        good = total(added & (r > 0))
        found["keep"] = _f1s(
            _ratios(total(_ratios(kept_good, kept)), total(kept > 0)),
            _ratios(total(_ratios(kept_good, kept_all)), total(kept_all > 0)),
        )
        # Deletion recall sums the precision shares over the recall count, as the scores to match do.
        found["delete"] = _f1s(_ratios(shares, total(deleted > 0)), _ratios(shares, total(s > r)))
        found["add"] = _f1s(_ratios(good, total(added)), _ratios(good, total(added_all)))
    if bleu:
        best = counts[2]
        wide = int(at.max(initial=0)) + 1
        if wide > 1:
            # Each reference is counted on its own; the one that has most of a gram clips it.
            mine = side == 2
            each = pa.array(place[mine].astype(np.int64) * wide + at[mine]).dictionary_encode()
            best = np.zeros(len(rows), np.int64)
            np.maximum.at(best, each.dictionary.to_numpy() // wide, np.bincount(each.indices.to_numpy(), minlength=len(each.dictionary)))
        found["clip"], found["total"], found["ref"] = total(np.minimum(counts[1], best)), total(counts[1]), total(counts[2])
    return found


def _slice_scores(texts: pa.ListArray, many: np.ndarray, sari: bool, bleu: bool, nulls: bool) -> dict[str, np.ndarray]:
    parts = texts.flatten()
    of_text = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy())
    sides, places, sets = (parts.field(name).to_numpy() for name in ("side", "at", "set"))
    wide = int(sets.max(initial=0)) + 1
    units = pa.array(of_text * wide + sets).dictionary_encode()
    unit, row_of = units.indices.to_numpy().astype(np.int64), units.dictionary.to_numpy() // wide
    scores: dict[str, np.ndarray] = {}
    for name, wanted in (("low", sari), ("tokens", bleu)):
        if not wanted:
            continue
        lists = parts.field(name)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        for n, (text, grams) in enumerate(_grams(lists.flatten(), bounds), 1):
            if not nulls and grams.null_count:
                text, grams = text[grams.is_valid().to_numpy(zero_copy_only=False)], grams.drop_null()
            got = _order_values(unit[text], sides[text], places[text], grams, row_of, many, name == "low", name == "tokens")
            if name == "low":
                for score, values in got.items():
                    scores[score] = scores.get(score, 0.0) + values / len(ORDERS)
            else:
                scores[f"clip_{n}"], scores[f"total_{n}"] = got["clip"], got["total"]
                if n == 1:
                    scores["ref_len"] = got["ref"]
    return scores


def _row_scores(parts: Column, sari: bool, bleu: bool, nulls: bool) -> Column:
    """The scores of each row from its ``parts``, each of ``many`` and texts ``side, at, set, tokens, low``, as a struct.

    A batch is cut into slices of bounded size, so memory doesn't follow the number of rows in it.
    """
    kinds = {name: "double" for name in ("keep", "delete", "add")} if sari else {}
    if bleu:
        kinds |= {f"{name}_{n}": "bigint" for n in ORDERS for name in ("clip", "total")} | {"ref_len": "bigint"}

    @F.arrow_udf("struct<" + ", ".join(f"{name}: {kind}" for name, kind in kinds.items()) + ">")
    def score(rows: pa.Array) -> pa.Array:
        of_part = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        parts = rows.flatten()
        many, texts = parts.field("many").to_numpy().astype(np.int64), parts.field("texts")
        sizes = texts.flatten().field("tokens").value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(texts.value_lengths().to_numpy())]
        cuts = np.flatnonzero(np.diff(ends // SLICE_TOKENS, prepend=0)).tolist()
        found: dict[str, list[np.ndarray]] = {name: [np.zeros(0)] for name in kinds}
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if a < b:
                for name, values in _slice_scores(texts.slice(a, b - a), many[a:b], sari, bleu, nulls).items():
                    found[name].append(values)
        arrays = []
        for name, kind in kinds.items():
            values = np.concatenate(found[name])
            if kind == "double":
                arrays.append(pa.array(np.bincount(of_part, values, len(rows))))
            else:
                most = np.zeros(len(rows), np.int64)
                np.maximum.at(most, of_part, values.astype(np.int64))
                arrays.append(pa.array(most))
        return pa.StructArray.from_arrays(arrays, names=list(kinds))

    return score(parts)


def sentence_scores(
    df: DataFrame,
    key: list[str],
    origin: str = "origin",
    hypothesis: str = "hypothesis",
    reference: str = "reference",
    sari: bool = True,
    bleu: bool = True,
    partitioned: bool = False,
    references: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Per row: ``keep, delete, add, sari`` and ``bleu`` with its pooled parts.

    ``references`` names a list of token lists that takes the place of ``reference``, any number of them per row. SARI then
    weighs source and hypothesis grams by that number and sums the references' grams; BLEU clips at the reference that
    has most of a gram and compares with the nearest length, ``ref_len`` (``ref_len_strict`` where the first of equally near ones
    counts). A row without references scores 0.

    Columns are token lists. The BLEU parts are ``clip_n`` and ``total_n`` for n = 1..4, ``hyp_len``
    and ``ref_len``; ``corpus_bleu`` adds them up. ``partitioned`` says that rows already lie by ``key``
    (or by part of it), which saves the one shuffle. Rows of one key are counted together; ``unique`` says that there
    are none, so rows are scored where they lie.
    """
    lengths = _reference_lengths(hypothesis, references) if references else {}
    rows = df.select(
        *key, *[c.alias(n) for n, c in lengths.items()], _texts(origin, hypothesis, reference, references).alias("__texts")
    )
    if not unique:
        placed = rows if partitioned else rows.repartition(*key)
        rows = placed.groupBy(*key, *lengths).agg(F.flatten(F.collect_list("__texts")).alias("__texts"))
    part = F.struct((F.col("__m") if references else F.lit(1)).alias("many"), F.col("__texts").alias("texts"))
    ends = ["__near", "__first"] if references else []
    if references and not unique:
        # Rows of one key whose references differ in number or length are counted apart.
        rows = rows.groupBy(*key).agg(F.collect_list(part).alias("__parts"), *[F.max(c).alias(c) for c in ends])
    else:
        rows = rows.select(*key, F.array(part).alias("__parts"), *ends)

    def with_low(text: Column) -> Column:
        names = [text[n].alias(n) for n in ("side", "at", "set", "tokens")]
        return F.struct(*names, *([lower_tokens(text["tokens"]).alias("low")] if sari else []))

    parts = F.transform("__parts", lambda p: F.struct(p["many"].alias("many"), F.transform(p["texts"], with_low).alias("texts")))
    found = _row_scores(parts, sari, bleu, nulls=not references)
    names = [*(["keep", "delete", "add"] if sari else []), *([f"{p}_{n}" for n in ORDERS for p in ("clip", "total")] if bleu else [])]
    nearest = [F.col(c).alias(n) for c, n in zip(ends, ("ref_len", "ref_len_strict"))]
    scores = rows.select(*key, *ends, found.alias("__scores")).select(
        *key, *[F.col(f"__scores.{n}") for n in names], *((nearest or [F.col("__scores.ref_len")]) if bleu else [])
    )
    if sari:
        scores = scores.withColumn("sari", (F.col("keep") + F.col("delete") + F.col("add")) / 3)
    if bleu:
        scores = scores.withColumn("hyp_len", F.col("total_1")).withColumn("bleu", smoothed_bleu())
    return scores


def corpus_sari(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("sari").alias("sari"))


def _brevity(hyp: Column, ref: Column) -> Column:
    return F.when(hyp > ref, 1.0).when(hyp == 0, 0.0).otherwise(F.exp(1 - ref / hyp))


def smoothed_bleu(pooled: bool = False) -> Column:
    """BLEU from ``clip_n, total_n, hyp_len, ref_len``; the k-th order without a match counts as
    ``1 / (2^k total)``, and a text without any matching token scores 0."""
    zeros = F.lit(0)
    logs = F.lit(0.0)
    for order in ORDERS:
        clip = F.col(f"clip_{order}")
        total = F.col(f"total_{order}") if pooled else F.greatest(F.col(f"total_{order}"), F.lit(1))
        zeros = zeros + F.when(clip == 0, 1).otherwise(0)
        share = F.when(clip == 0, 1 / (F.pow(F.lit(2.0), zeros) * total)).otherwise(clip / total)
        logs = logs + F.log(share) / 4
    score = _brevity(F.col("hyp_len"), F.col("ref_len")) * F.exp(logs)
    return F.when(F.col("clip_1") == 0, 0.0).otherwise(score)


def corpus_bleu(scores: DataFrame, sari: bool = False, also: list[Column] | None = None) -> DataFrame:
    """One row: pooled ``bleu_smoothed`` and ``bleu_strict`` (0 when some order never matches).

    The smoothed score counts at least one gram per row and order, the strict one counts as they are.
    ``sari`` adds the corpus SARI from the same pass, ``also`` further aggregates by their names.
    """
    strict_len = "ref_len_strict" if "ref_len_strict" in scores.columns else "ref_len"
    sums = scores.agg(
        *[F.sum(f"clip_{n}").alias(f"clip_{n}") for n in ORDERS],
        *[F.sum(F.greatest(f"total_{n}", F.lit(1))).alias(f"total_{n}") for n in ORDERS],
        *[F.sum(f"total_{n}").alias(f"plain_{n}") for n in ORDERS],
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("ref_len").alias("ref_len"),
        F.sum(strict_len).alias("strict_len"),
        *([F.avg("sari").alias("sari")] if sari else []),
        *([F.struct(*also).alias("also")] if also else []),
    )
    logs = F.lit(0.0)
    for n in ORDERS:
        logs = logs + F.log(F.col(f"clip_{n}") / F.col(f"plain_{n}")) / 4
    least = F.least(*[F.col(f"clip_{n}") for n in ORDERS])
    length = F.exp(F.least(F.lit(0.0), 1 - F.col("strict_len") / F.col("hyp_len")))
    strict = F.when(least > 0, length * F.exp(logs)).otherwise(0.0)
    extra = [*(["sari"] if sari else []), *([F.col("also.*")] if also else [])]
    return sums.select(smoothed_bleu(pooled=True).alias("bleu_smoothed"), strict.alias("bleu_strict"), *extra)
