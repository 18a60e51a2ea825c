"""Sentence cleaning as column expressions.

Python's ``\\s`` and ``\\w`` are Unicode classes, hence ``(?U)``; its ``.`` stops at ``\\n`` only, hence
``(?d)``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WS = r"[\s\x1c-\x1f]"
# The same without the blank itself, spelled out.
_WS_BUT_BLANK = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)\A{_WS}+|{_WS}+\z", "")


def lower_strip(col: Column) -> Column:
    return strip(F.lower(col))


@lru_cache(maxsize=1)
def _unaccented() -> tuple[str, str]:
    """All single characters whose decomposition without marks is one other character."""
    sources, targets = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Cs", "Cn", "Co"):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != char:
            sources.append(char)
            targets.append(plain)
    return "".join(sources), "".join(targets)


def strip_accents(col: Column) -> Column:
    """Decompose and drop combining marks, for characters that come apart into one base and marks.

    Others (Korean syllables, mainly) stay composed; ``strip_accents_exact`` takes those apart too.
    """
    sources, targets = _unaccented()
    return F.regexp_replace(F.translate(col, sources, targets), r"\p{Mn}+", "")


@F.pandas_udf(T.StringType())
def strip_accents_exact(texts: pd.Series) -> pd.Series:
    def plain(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")

    return texts.map(plain)


def space_punct(col: Column) -> Column:
    return F.regexp_replace(col, r"([.!?])", " $1")


def remove_brackets(col: Column) -> Column:
    return F.regexp_replace(col, r"(?d)[\(\[].*?[\)\]]", "")


def keep_charset(col: Column) -> Column:
    return F.regexp_replace(col, r"[^a-zA-Z0-9%,.!?]+", " ")


def collapse_ws(col: Column) -> Column:
    return strip(F.regexp_replace(col, rf"(?U){_WS}+", " "))


def normalize_sentence(
    col: Column, lower: bool = True, drop_brackets: bool = True, regex_rules: bool = False
) -> Column:
    """All cleaning steps in their fixed order; the two rule sets run last and only on request."""
    text = strip(F.lower(col) if lower else col)
    text = space_punct(strip_accents(text))
    if drop_brackets:
        text = remove_brackets(text)
    text = collapse_ws(keep_charset(text))
    if regex_rules:
        text = concept_class(prenormalize(text))
    return text


# Abbreviations before a blank, what must follow, and their replacement, in order.
_NEXT = "[a-z0-9]"
PRENORMALIZE = [
    (r"[Cc]a\.", _NEXT, "ca  "),
    (r"[Ee]\.[Gg]\.", _NEXT, "e g  "),
    (r"[Ee][Gg]\.", _NEXT, "e g "),
    (r"[Ii]\.[Ee]\.", _NEXT, "i e  "),
    (r"[Ii][Ee]\.", _NEXT, "i e "),
    (r"[Aa]pprox\.", _NEXT, "approx  "),
    (r"[Nn]o\.", _NEXT, "no  "),
    (r"[Nn]o\.", r"\w\d", "no  "),
    (r"[Cc]onf\.", _NEXT, "conf  "),
    (r"et al\.", _NEXT, "et al  "),
    (r"[Rr]ef\.", _NEXT, "ref  "),
    (r"[Ff]ig\.", _NEXT, "fig  "),
    (r"y\.o\.", _NEXT, "y o  "),
    (r"yo\.", _NEXT, "y o "),
    (r"[Pp]\.o\.", _NEXT, "p o  "),
    (r"[Ii]\.v\.", _NEXT, "i v  "),
    (r"[Bb]\.i\.\d\.", _NEXT, "b i d  "),
    (r"[Tt]\.i\.\d\.", _NEXT, "t i d  "),
    (r"[Qq]\.i\.\d\.", _NEXT, "q i d  "),
    (r"J\.", "(Cell|Bio|Med)", "J  "),
]


# The same rules for lower-case abbreviations, those of one form together: what stands before a white-space character, from the
# first character that changes; its whole short form; what follows; the replacement. No short form is the end of another one.
_FORMS = [
    (r"\.", r"(?:ca|approx|no|conf|et al|ref|fig)\.", _NEXT, "  "),
    (r"\.", r"no\.", r"\w\d", "  "),
    (r"\.", r"J\.", "(?:Cell|Bio|Med)", "  "),
    (r"\.([gevo])\.", r"(?:e\.g|i\.e|y\.o|p\.o|i\.v)\.", _NEXT, " $1  "),
    (r"([geo])\.", r"(?:eg|ie|yo)\.", _NEXT, " $1 "),
    (r"\.i\.\d\.", r"[btq]\.i\.\d\.", _NEXT, " i d  "),
]
# Found in every text that the next one is found in, and faster to look for.
_MAY_BE_CAPITAL = r"[A-Z]\S{0,6}\."
_CAPITAL = (
    r"(?U)\.(?<=(?:Ca|E\.[Gg]|e\.G|E[Gg]|eG|I\.[Ee]|i\.E|I[Ee]|iE|Approx|No|Conf|Ref|Fig|P\.o|I\.v|[BTQ]\.i\.\d)\.)" + _WS
)


def prenormalize(col: Column) -> Column:
    """Spell out common abbreviations, then turn every white-space character into a blank.

    What stands before an abbreviation is looked at only where one is found. A rule that writes a capital small may let a later
    rule apply to the abbreviation before it, so the rules run one by one where such a capital is found. Elsewhere
    none of them changes what another one looks at, and those of one form run together.
    """
    one_by_one = together = col
    for short, following, replacement in PRENORMALIZE:
        one_by_one = F.regexp_replace(one_by_one, rf"(?U){short}(?<=\W{short}){_WS}(?={following})", replacement)
    for changed, short, following, replacement in _FORMS:
        together = F.regexp_replace(together, rf"(?U){changed}(?<=\W{short}){_WS}(?={following})", replacement)
    return F.regexp_replace(F.when(col.rlike(_MAY_BE_CAPITAL) & col.rlike(_CAPITAL), one_by_one).otherwise(together), _WS_BUT_BLANK, " ")


# Concept patterns and their class, in order of precedence.
CONCEPTS = [
    (r"\w+inib$", "_chemical_"),
    (r"\w+[ui]mab$", "_chemical_"),
    (r"->|-->", "_replacement_"),
    (r"^[Pp]([=<>≤≥]|</?=|>/?=)\d", "_p_val_"),
    (r"^((\d+-)?year-old|y\.?o\.?)$", "_age_"),
    (r"^~?-?\d*[·.]?\d+--?\d*[·.]?\d+$", "_range_"),
    (r"[a-zA-Z]?(~?[=<>≤≥]|</?=|>/?=)\d?|^(lt|gt|geq|leq)$", "_ineq_"),
    (r"^~?\d+-fold$", "_n_fold_"),
    (r"^~?\d+/\d+$|^\d+:\d+$", "_ratio_"),
    (r"^~?-?\d*[·.]?\d*%$", "_percent_"),
    (
        r"^~?\d*(((kg|\d+g|mg|ug|ng)|(\d+m|cm|mm|um|nm)|(\d+l|ml|cl|ul|mol|mmol|nmol|mumol|mo))/?)+$",
        "_unit_",
    ),
    (r"^[Rr][Ss]\d+$|^[Rr]\d+[A-Za-z]$", "_mutation_"),
    (r"^[a-zA-Z]\w*-?\w*\d+\w*$", "_abbrev_"),
    (
        r"^([jJ]an\.(uary)?|[fF]eb\.(ruary)?|[mM]ar\.(ch)?|[Aa]pr\.(il)?|[Mm]ay\.|[jJ]un\.(e)?|"
        r"[jJ]ul\.(y)?|[aA]ug\.(ust)?|[sS]ep\.(tember)?|[oO]ct\.(ober)?|[nN]ov\.(ember)?|[dD]ec\.(ember)?)$",
        "_month_",
    ),
    (r"^(19|20)\d\d$", "_year_"),
    (
        r"^(([Zz]ero(th)?|[Oo]ne|[Tt]wo|[Tt]hree|[Ff]our(th)?|[Ff]i(ve|fth)|[Ss]ix(th)?|[Ss]even(th)?|"
        r"[Ee]ight(th)?|[Nn]in(e|th)|[Tt]en(th)?|[Ee]leven(th)?|[Tt]went(y|ieth)?|[Tt]hirt(y|ieth)?|"
        r"[Ff]ort(y|ieth)?|[Ff]ift(y|ieth)?|[Ss]ixt(y|ieth)?|[Ss]event(y|ieth)?|[Ee]ight(y|ieth)?|"
        r"[Nn]inet(y|ieth)?|[Mm]illion(th)?|[Bb]illion(th)?|[Tt]welv(e|th)|[Hh]undred(th)?|"
        r"[Tt]housand(th)?|[Ff]irst|[Ss]econd|[Tt]hird|\d*1st|\d*2nd|\d*3rd|\d+-?th)-?)+$",
        "_num_",
    ),
    (r"^~?-?\d+(,\d\d\d)*$", "_num_"),
    (r"^~?-?((-?\d*[·.]\d+$|^-?\d+[·.]\d*)(\+/-)?)+$", "_num_"),
    (r"^[Vv]\.?[Ss]\.?$|^[Vv]ersus$", "vs"),
    (r"^[Ii]\.?[Ee]\.?$", "ie"),
    (r"^[Ee]\.?[Gg]\.?$", "eg"),
    (r"^[Ii]\.?[Vv]\.?$", "iv"),
    (r"^[Pp]\.?[Oo]\.?$", "po"),
]


def concept_class(col: Column) -> Column:
    """The class of the first pattern found in the text, else the text itself."""
    result = None
    for pattern, name in CONCEPTS:
        # Python's `$` also matches before a final line break; (?d) makes Java's `$` do just that.
        found = col.rlike(f"(?Ud){pattern}")
        result = F.when(found, name) if result is None else result.when(found, name)
    return result.otherwise(col)
