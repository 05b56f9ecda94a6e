"""Validity rules for labels and terms, and token flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label and text values that count as missing.
MISSING_LABELS = ["", "_", "nan", "None"]
MISSING_TEXTS = ["", "_", "nan"]
MISSING_TERMS = ["", "_"]
BLANK = "_"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def has_valid_label(label: Column | str) -> Column:
    """Gold labels usable for scoring: the literal text ``None`` is missing too."""
    return ~F.coalesce(_col(label).cast("string"), F.lit("None")).isin(MISSING_LABELS)


def has_valid_text(value: Column | str) -> Column:
    """Values shown in summaries and maps: the literal text ``None`` is kept."""
    return ~F.coalesce(_col(value).cast("string"), F.lit("nan")).isin(MISSING_TEXTS)


def term_text(value: Column | str, *, lowercase: bool = True) -> Column:
    """Term used for counting; blanks become null."""
    text = _col(value).cast("string")
    return F.when(~text.isin(MISSING_TERMS), F.lower(text) if lowercase else text)


def is_punctuation(upos: Column | str = "UPOS") -> Column:
    return F.upper(_col(upos)) == "PUNCT"


def is_empty_node(token_id: Column | str = "ID", form: Column | str = "FORM") -> Column:
    return _col(token_id).contains(".") | (_col(form) == "#NULL")


def is_multiword(token_id: Column | str = "ID") -> Column:
    return _col(token_id).contains("-")


def has_semclass(label: Column | str = "SEMCLASS") -> Column:
    return ~_col(label).isin(MISSING_TERMS)


def is_surface(token_id: Column | str = "ID", form: Column | str = "FORM") -> Column:
    return ~is_empty_node(token_id, form) & ~is_multiword(token_id)


def with_token_flags(tokens: DataFrame) -> DataFrame:
    require_columns(tokens, ["ID", "FORM", "UPOS", "SEMCLASS"], "tokens")
    return tokens.withColumns(
        {
            "is_punctuation": is_punctuation(),
            "is_empty_node": is_empty_node(),
            "is_multiword_token": is_multiword(),
            "has_semclass": has_semclass(),
            "is_surface_token": is_surface(),
        }
    )
