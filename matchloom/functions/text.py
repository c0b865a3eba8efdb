"""Column expressions for text: folding, normalising, tokenising, stemming.

A text is *folded* once per row (compatibility form, lower case, accents off, ``ñ`` kept, line breaks
kept) and every later step works on the folded column with built-in expressions. Punctuation inside
protected technical tokens is carried through the clean-up as private-use characters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordlists import MIN_STEM, PROTECTED_TOKENS, STEM_SUFFIXES

_PUNCT = ".#+/-"
_MARKS = "\ue000\ue001\ue002\ue003\ue004"
_MARK_TABLE = str.maketrans(_PUNCT, _MARKS)
# A plain letter is passed over before the class is asked.
_SEPARATORS = r"(?=[^a-z0-9])[[^\p{L}\p{Nd}" + _MARKS[0] + "-" + _MARKS[-1] + r"]\x{10000}-\x{10FFFF}]+"
_ANY_MARK = "[" + _MARKS[0] + "-" + _MARKS[-1] + "]"


def _strip_accents(text: str) -> str:
    kept = []
    for part in re.split("(ñ)", text):
        if part == "ñ":
            kept.append(part)
        else:
            plain = "".join(c for c in unicodedata.normalize("NFD", part) if unicodedata.category(c) != "Mn")
            kept.append(unicodedata.normalize("NFC", plain))
    return "".join(kept)


def fold_python(text: str | None) -> str | None:
    """Exact folding of one text; used inside tasks for rows outside the Latin ranges."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text).lower()
    text = re.sub(_ANY_MARK, " ", text)
    for token in PROTECTED_TOKENS:
        text = text.replace(token, token.translate(_MARK_TABLE))
    return _strip_accents(text)


def _latin_tables() -> tuple[str, str, str]:
    """Characters whose exact folding is one character, as ``translate`` arguments and a regex class."""
    source, target, safe = [], [], []
    blocks = [(0x00, 0x24F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x203A), (0x20A0, 0x20BF)]
    for first, last in blocks:
        for code in range(first, last + 1):
            char = chr(code)
            if len(char.lower()) != 1:
                continue
            folded = _strip_accents(unicodedata.normalize("NFKC", char).lower())
            if not any(c.isalnum() for c in folded) and not char.isalnum():
                safe.append(code)
            elif len(folded) == 1:
                safe.append(code)
                if code > 0x7F and folded != char.lower():
                    source.append(char)
                    target.append(folded)
                    if char.lower() != char and char.lower() not in source:
                        source.append(char.lower())
                        target.append(folded)
    ranges, start = [], safe[0]
    for prev, code in zip(safe, safe[1:] + [None]):
        if code != prev + 1:
            ranges.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
            start = code
    return "".join(source), "".join(target), "".join(ranges)


_FROM, _TO, _SAFE = _latin_tables()


def is_latin(col: Column) -> Column:
    """True when the built-in folding of the text is exact. The class of many ranges is asked about no ASCII character,
    all of which are in it."""
    return ~col.rlike(r"(?=[^\x00-\x7F])[^" + _SAFE + "]")


def fold_latin(col: Column) -> Column:
    """Built-in folding, exact for texts where :func:`is_latin` holds."""
    text = F.lower(col)
    for token in PROTECTED_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(token.translate(_MARK_TABLE)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _FROM, _TO)).otherwise(text)


@F.pandas_udf(T.StringType())
def _fold_exact(texts: pd.Series) -> pd.Series:
    return texts.map(fold_python, na_action="ignore")


def with_folded(df: DataFrame, col: str, out: str = "folded", unicode: str = "exact") -> DataFrame:
    """Add the folded text.

    ``unicode='exact'`` sends the texts outside the Latin ranges, and only those, through an Arrow function, in the same
    scan; ``unicode='latin'`` stays on built-ins, for corpora known to be Latin.
    """
    text = F.col(col)
    if unicode == "latin":
        return df.withColumn(out, fold_latin(text))
    plain = F.coalesce(is_latin(text), F.lit(True))
    return df.withColumn(out, F.coalesce(_fold_exact(F.when(~plain, text)), fold_latin(text)))


def normalized(folded: Column) -> Column:
    """Normal form of a folded text: words separated by one space, protected punctuation restored."""
    clean = F.trim(F.regexp_replace(folded, _SEPARATORS, " "))
    for mark, char in zip(_MARKS, _PUNCT):
        clean = F.replace(clean, F.lit(mark), F.lit(char))
    return clean


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``. Lambdas are evaluated per element without sharing common
    parts, so anything costly that a lambda needs is bound outside it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def evaluated(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df``, worked out once per row: a filter on them is not pushed below, where it would repeat them."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def words(norm: Column) -> Column:
    """Words of a normal form; empty array for an empty text."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def tokens(folded: Column) -> Column:
    return words(normalized(folded))


_STEM = "^(.{" + str(MIN_STEM) + ",}?)(?:" + "|".join(sorted(STEM_SUFFIXES, key=len, reverse=True)) + r")\z"


def stem(word: Column) -> Column:
    """Light stem: the longest suffix that leaves at least three characters is dropped."""
    return F.regexp_replace(word, _STEM, "$1")


def stem_python(word: str) -> str:
    for suffix in sorted(STEM_SUFFIXES, key=len, reverse=True):
        if len(word) - len(suffix) >= MIN_STEM and word.endswith(suffix):
            return word[: -len(suffix)]
    return word


def trim_space(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"(?U)\S")


def any_of(literals: list[str]) -> str:
    """Regex alternation of literal strings."""
    return "|".join(re.escape(x) for x in literals)
