"""Sentence boundaries learned from the corpus itself, after Kiss and Strunk (2006).

A word that stands before a period far oftener than periods are frequent is an abbreviation, and its period ends no
sentence unless one of the words follows that begin sentences far oftener than they occur. Both are log-likelihood
ratios over counts of the whole corpus, taken in one scan and one shuffle of distinct word pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import strip
from ..session import written
from .skew import collect_small

# Thresholds and the assumed share of periods after an abbreviation, as published.
ABBREVIATION, STARTER, CERTAIN = 0.3, 30.0, 0.99
# Marks that may stand around a word.
OPENING, CLOSING = "\"'([", "\"')],;:"
SPACES = "\t\n\x0b\x0c\r"
# White space that ends a sentence but no word.
_ODD_SPACES = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Up to so many learned words are looked up as a set of the plan.
SET_WORDS = 20_000
# A learned table larger than this isn't sent along with the texts.
MAX_BYTES = 32 << 20


def _bare(token: Column) -> Column:
    return F.ltrim(F.rtrim(token, F.lit(CLOSING)), F.lit(OPENING))


def _word(bare: Column) -> Column:
    """The word in lower case, without one final period."""
    cut = F.when(F.endswith(bare, F.lit(".")), F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare)
    return F.lower(cut)


def _ends_hard(bare: Column) -> Column:
    return F.endswith(bare, F.lit("!")) | F.endswith(bare, F.lit("?"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda t: t != "")


def _part(count: Column, share: Column) -> Column:
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.log(share))


def word_pairs(df: DataFrame, text: str) -> DataFrame:
    """``word, stop, hard, follower, n``: how often a word has a final period, or a ``!`` or ``?``, and which word
    follows one that has; ``follower`` is null elsewhere and at the end of a text."""
    # Two steps, so that the list of tokens is made once.
    tokens = df.select(F.transform(_tokens(F.col(text)), _bare).alias("t"))
    after = F.concat(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    pairs = tokens.filter(F.size("t") > 0).select(
        F.explode(F.arrays_zip(F.col("t").alias("one"), after.alias("next"))).alias("p")
    )
    one, following = F.col("p")["one"], F.col("p")["next"]
    stop, hard = F.endswith(one, F.lit(".")), _ends_hard(one)
    rows = pairs.select(
        _word(one).alias("word"), stop.alias("stop"), hard.alias("hard"), F.when(stop | hard, _word(following)).alias("follower")
    )
    return rows.groupBy("word", "stop", "hard", "follower").agg(F.count(F.lit(1)).alias("n"))


def abbreviations(pairs: DataFrame) -> DataFrame:
    """``word, n, score``: words of letters and inner periods that a final period belongs to; ``n`` of them have it."""
    stops = F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0))
    share = pairs.agg((stops / F.sum("n")).alias("share")).scalar()
    words = pairs.filter(F.col("word").rlike(r"^\p{L}[\p{L}.]*$")).groupBy("word").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n")
    )
    words = words.filter("n > 0")
    with_stop, without = F.col("n"), F.col("all") - F.col("n")
    chance = _part(with_stop, share) + _part(without, 1 - share)
    sure = _part(with_stop, F.lit(CERTAIN)) + _part(without, F.lit(1 - CERTAIN))
    letters = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.char_length("word") - letters
    # Long words, words without inner periods and words that also stand without one are less likely.
    score = 2 * (sure - chance) * F.exp(-letters) * (inner + 1) * F.exp(-without * F.log(letters))
    return words.select("word", "n", score.alias("score")).filter(F.col("score") >= ABBREVIATION)


def starters(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """``word, n, score``: words that follow sentence ends oftener than chance; ``n`` times. ``short`` are abbreviations."""
    ends = pairs.filter("stop or hard").join(short.select("word", F.lit(True).alias("short")), "word", "left")
    ends = ends.filter("hard or short is null")
    heads = ends.filter(F.col("follower").rlike(r"^\p{L}+$")).groupBy(F.col("follower").alias("word")).agg(F.sum("n").alias("n"))
    every = pairs.groupBy("word").agg(F.sum("n").alias("all"))
    size, head = (t.agg(F.sum("n").alias("n")).scalar() for t in (pairs, ends))
    rows = heads.join(every, "word")
    both, word = F.col("n"), F.col("all")
    rest = size - head - word + both
    mean, at_end, elsewhere = word / size, both / head, (word - both) / (size - head)
    apart = _part(both, at_end) + _part(head - both, 1 - at_end) + _part(word - both, elsewhere) + _part(rest, 1 - elsewhere)
    chance = _part(word, mean) + _part(size - word, 1 - mean)
    rows = rows.filter(size * both > word * head).select("word", "n", (2 * (apart - chance)).alias("score"))
    return rows.filter(F.col("score") >= STARTER)


def _listed(words: list[str]) -> Column:
    """Words of letters and periods as an array that is made once."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


@dataclass
class Boundaries:
    """Learned tables and the cut that follows from them."""

    abbreviations: DataFrame
    starters: DataFrame
    short: list[str]
    heads: list[str]

    def sentences(self, text: Column) -> Column:
        """Sentences of a text: cuts after ``.``, ``!`` or ``?`` (and closing marks) before white space, but not after
        an abbreviation whose follower is no capitalised sentence starter. Null stays null, an empty text has none."""
        if max(len(self.short), len(self.heads)) > SET_WORDS:
            return self._cut(text, False)
        # Where only plain white space stands, the words at a cut are words of the text, so a set needn't be narrowed to them.
        return F.when(text.rlike(_ODD_SPACES), self._cut(text, False)).otherwise(self._cut(text, True))

    def _cut(self, text: Column, sets: bool) -> Column:
        marked = F.regexp_replace(strip(text), r"(?U)([.!?]+[\"')\]]*)(\s+)", "$1\u0001$2")
        pieces = F.split(marked, "\u0001")
        # Only words of this text are looked for at its cuts; both lists are hashed once for it.
        words = F.transform(_tokens(text), lambda t: _word(_bare(t)))
        known, first = (F.array_intersect(words, _listed(t)) for t in (self.short, self.heads))

        def held(word: Column, learned: list[str], of_text: Column | None) -> Column:
            return word.isin(*learned) if of_text is None else F.array_contains(of_text, word)

        def joins(before: Column, after: Column, known: Column | None, first: Column | None) -> Column:
            plain = [F.translate(p, SPACES, " " * len(SPACES)) for p in (before, F.ltrim(after))]
            last = _bare(F.substring_index(plain[0], " ", -1))
            head = _bare(F.substring_index(F.ltrim(plain[1]), " ", 1))
            capital = F.substring(head, 1, 1) != F.lower(F.substring(head, 1, 1))
            stays = F.endswith(last, F.lit(".")) & held(_word(last), self.short, known)
            return stays & ~(capital & held(_word(head), self.heads, first))

        def glued(one: Column) -> Column:
            pieces = one["pieces"]
            before = F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
            own = (None, None) if sets else (one["known"], one["first"])
            mark = F.zip_with(before, pieces, lambda b, a: F.when(joins(b, a, *own), a).otherwise(F.concat(F.lit("\u0001"), a)))
            return F.array_join(mark, "")

        # The lambda's variable holds what is worked out once for a text.
        once = F.array(F.struct(pieces.alias("pieces"), *([] if sets else [known.alias("known"), first.alias("first")])))
        cut = F.transform(F.split(F.transform(once, glued)[0], "\u0001"), strip)
        return F.when(text.isNotNull(), F.filter(cut, lambda s: F.char_length(s) > 0))


def learn_boundaries(df: DataFrame, text: str = "text") -> Boundaries:
    """Learn abbreviations and sentence starters from all texts of a column.

    Null and empty texts count nothing; other columns are not read. Either table may be empty. A table above
    ``MAX_BYTES`` is an error, as its words are sent to every task.
    """
    pairs = written(word_pairs(df, text), "word-pairs")
    short = written(abbreviations(pairs), "abbreviations")
    heads = written(starters(pairs, short), "starters")
    lists = [collect_small(table.select("word"), MAX_BYTES) for table in (short, heads)]
    if None in lists:
        raise ValueError(f"a learned table takes more than {MAX_BYTES} bytes")
    return Boundaries(short, heads, *(sorted(row[0] for row in rows) for rows in lists))
