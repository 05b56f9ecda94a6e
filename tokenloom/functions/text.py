"""Raw-text tokenising, case folding and value cleaning as built-in expressions."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.labels import _col

# Token patterns. A token is a run of letters and digits, with inner hyphens or apostrophes,
# or one other visible character; the underscore belongs to neither.
WORD_PATTERN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
TOKEN_PATTERN = (
    WORD_PATTERN
    + r"|[^\p{L}\p{N}_\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WORD_TEST = r"[\p{L}\p{N}]"


def tokenize(text: Column | str) -> Column:
    """Words and single symbols of ``text`` in order."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), F.lit(0))


def words_only(text: Column | str) -> Column:
    """The word tokens of :func:`tokenize`, without building the symbol tokens first."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_PATTERN), F.lit(0))


def is_word(token: Column | str) -> Column:
    return _col(token).rlike(WORD_TEST)


@cache
def _folds() -> dict[str, str]:
    """The characters whose full case folding is not their lower case, by the standard's table that ``str.casefold`` holds.

    The capital sigma is among them, as its lower case depends on what follows it.
    """
    every = (chr(at) for at in range(sys.maxunicode + 1) if not 0xD800 <= at < 0xE000)
    return {char: char.casefold() for char in every if char.casefold() != char.lower()} | {"Σ": "σ"}


def casefold(text: Column | str) -> Column:
    """Caseless form by full case folding. Most texts need lower case only; the others are folded in one pass."""
    text, folds = _col(text), _folds()
    odd = "".join(f"\\x{{{ord(char):X}}}" for char in folds)
    table = F.str_to_map(F.lit("\t".join(f"{char}={fold}" for char, fold in folds.items())), F.lit("\t"), F.lit("="))
    parts = F.regexp_extract_all(text, F.lit(f"[{odd}]|[^{odd}]+"), F.lit(0))
    folded = F.array_join(F.transform(parts, lambda part: F.coalesce(table[part], F.lower(part))), "")
    return F.when(text.rlike(f"[{odd}]"), folded).otherwise(F.lower(text))


def lower_all(terms: Column) -> Column:
    """Lower-case every element of a string array in one string call; elements are not empty and hold no tabs."""
    return F.array_remove(F.split(F.lower(F.array_join(terms, "\t")), "\t"), "")


def clean_cell(value: Column | str) -> Column:
    """One TSV cell: null and empty become ``_``; tabs and line breaks become spaces."""
    text = F.translate(_col(value).cast("string"), "\t\n\r", "   ")
    return F.when(text.isNull() | (text == ""), F.lit("_")).otherwise(text)


def clean_name(value: Column | str) -> Column:
    """Cluster name for labels: null becomes the empty string."""
    return F.coalesce(F.translate(_col(value).cast("string"), "\t\n\r", "   "), F.lit(""))


def clean_optional(value: Column | str) -> Column:
    """Header value: blanks become the empty string."""
    text = clean_cell(value)
    return F.when(text.isin("", "_", "nan"), F.lit("")).otherwise(text)
