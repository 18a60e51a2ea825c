"""Token-list functions as column expressions.

Functions that look into a list many times expect a column, not a composed expression: inside a
lambda Spark computes an expression anew for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLS, PAD_ID, SEP
from .clean import strip


def exploded(df: DataFrame, keep: list, values: Column | str, name: str, place: str | None = None) -> DataFrame:
    """One row per list element (and its ``place`` from 0); rows without elements vanish.

    Spark puts a filter on the list's size under a plain explode and so computes a composed list twice.
    The outer form, filtered afterwards, computes it once.
    """
    if place is None:
        return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(values).alias(place, name)).filter(F.col(place).isNotNull())


def mark_text(col: Column) -> Column:
    """``[CLS] text [SEP]``; a missing text gives the two markers only."""
    return F.concat_ws(" ", F.lit(CLS), col, F.lit(SEP))


def split_ws(col: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    return F.array_remove(F.split(col, r"(?U)[\s\x1c-\x1f]+"), "")


def _is_continuation(piece: Column) -> Column:
    return piece.startswith("##")


def word_starts(pieces: Column) -> Column:
    """Places (from 1) at which a word starts: the first piece and every piece without ``##``."""
    places = F.sequence(F.lit(1), F.size(pieces))
    starts = F.filter(places, lambda i: (i == 1) | ~_is_continuation(F.element_at(pieces, i)))
    return F.when(F.size(pieces) > 0, starts).when(pieces.isNotNull(), F.array().cast("array<int>"))


def group_by_word(values: Column, pieces: Column) -> Column:
    """``values`` (one per piece) cut into one list per word."""
    starts = word_starts(pieces)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(pieces) + 1))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    grouped = F.transform(spans, lambda s: F.slice(values, s["a"], s["b"] - s["a"]))
    return F.when(pieces.isNotNull(), F.slice(grouped, 1, F.size(starts)))


def pieces_per_word(pieces: Column) -> Column:
    return group_by_word(pieces, pieces)


def pieces_to_words(pieces: Column) -> Column:
    """Whole words; ``##`` is dropped inside a word of several pieces, a lone piece stays as it is."""
    words = pieces_per_word(pieces)
    return F.transform(
        words,
        lambda w: F.when(F.size(w) == 1, F.element_at(w, 1)).otherwise(
            F.array_join(F.transform(w, lambda p: F.replace(p, F.lit("##"), F.lit(""))), "")
        ),
    )


def word_numbers(pieces: Column) -> Column:
    """For every piece the running number (from 1) of its word."""
    return F.flatten(F.transform(pieces_per_word(pieces), lambda w, i: F.array_repeat(i + 1, F.size(w))))


def pad_right(ids: Column, length: int | Column, pad: Column | int = PAD_ID) -> Column:
    """Fill up to ``length``; longer lists stay whole."""
    length = length if isinstance(length, Column) else F.lit(length)
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    return F.concat(ids, F.array_repeat(pad, F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: F.when(i != PAD_ID, 1).otherwise(0))


def padding_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: i == PAD_ID)


def add_specials(ids: Column, cls_id: int, sep_id: int) -> Column:
    return F.concat(F.array(F.lit(cls_id)), ids, F.array(F.lit(sep_id)))


def encode_pad(ids: Column, max_len: int | Column, cls_id: int, sep_id: int) -> Column:
    """Markers around the ids, then padding; no truncation."""
    return pad_right(add_specials(ids, cls_id, sep_id), max_len)


def encode_word_pad(ids_per_word: Column, max_len: int | Column) -> Column:
    """Ids grouped per word, filled up with empty groups."""
    return pad_right(ids_per_word, max_len, F.array().cast("array<int>"))


def truncate_ids(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def field_encode(
    ids: Column, max_len: int, cls_id: int, sep_id: int, double_specials: bool = True
) -> Column:
    """Loader encoding: the body (which has its own markers already when ``double_specials``) is cut to
    ``max_len - 2``, marked once more and padded to ``max_len``."""
    body = add_specials(ids, cls_id, sep_id) if double_specials else ids
    return pad_right(add_specials(F.slice(body, 1, max_len - 2), cls_id, sep_id), max_len)


def decode_pieces(pieces: Column) -> Column:
    """Pieces to text: join at ``##``, remove padding marks, strip; the other markers stay."""
    text = F.replace(F.array_join(pieces, " "), F.lit(" ##"), F.lit(""))
    return strip(F.replace(text, F.lit("[PAD]"), F.lit("")))


def strip_markers(col: Column) -> Column:
    """Remove the sentence markers that ``decode_pieces`` leaves in place."""
    bare = F.replace(F.replace(col, F.lit(CLS), F.lit("")), F.lit(SEP), F.lit(""))
    return strip(F.regexp_replace(bare, " +", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens joined by blanks."""
    if n == 1:
        return tokens
    last = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def sentence_split(col: Column) -> Column:
    """Sentences of a line: a cut after ``.``, ``!`` or ``?`` (and closing marks) before white space.

    A rule in place of a trained boundary model, so cuts after abbreviations differ.
    """
    marked = F.regexp_replace(strip(col), r"(?U)([.!?]+[\"')\]]*)\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(s) > 0)


# Word patterns; French and Italian cut after an elided article.
WORD_PATTERNS = {
    "default": r"(?U)\w+(?:[-'’]\w+)*|[^\w\s]",
    "fr": r"(?U)\w+['’](?=\w)|\w+(?:-\w+)*|[^\w\s]",
    "en": r"(?U)\w+(?=n['’]t\b)|n['’]t\b|['’](?:s|re|ve|ll|d|m)\b|\w+(?:-\w+)*|[^\w\s]",
    "de": r"(?U)\w+(?:-\w+)*['’]?|[^\w\s]",
}


def word_tokenize(col: Column, language: Column) -> Column:
    """Words and punctuation marks by a pattern per language."""
    result = None
    for name, pattern in WORD_PATTERNS.items():
        if name != "default":
            tokens = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
            result = F.when(language == name, tokens) if result is None else result.when(language == name, tokens)
    return result.otherwise(F.regexp_extract_all(col, F.lit(WORD_PATTERNS["default"]), F.lit(0)))


def split_fields(col: Column, names: list[str], sep: str = "\t", rest: str | None = None) -> list[Column]:
    """The fields of a line as named columns; missing fields are null. ``rest`` names a list of all further ones."""
    parts = F.split(col, sep)
    fields = [F.get(parts, i).alias(name) for i, name in enumerate(names)]
    if rest:
        fields.append(F.slice(parts, F.lit(len(names) + 1), F.size(parts)).alias(rest))
    return fields


def unescape_newlines(col: Column) -> Column:
    """A written-out line break (backslash and n) becomes a blank."""
    return F.replace(col, F.lit("\\n"), F.lit(" "))
