"""Text normalisation for identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def casefolded(c: Column) -> Column:
    """Full case folding without a Python function: lower-casing what was upper-cased expands all that folds to several letters.

    Two letters go another way: the dotless i has no capital of its own and stands aside meanwhile, and sigma has two small
    forms, of which lower-casing alone would choose by place. Tested on every code point up to U+1FFFF; Cherokee folds to
    its small letters here, consistently.
    """
    aside = "\ue000"
    up = F.translate(F.upper(F.translate(c, "\u0131\u1e9e", f"{aside}\u00df")), "\u03a3", "\u03c3")
    return F.translate(F.lower(up), f"{aside}\u03c2", "\u0131\u03c3")


def identity_text(c: Column) -> Column:
    """Runs of Unicode white space made one space, trimmed, fully case-folded; null is ''. In the JVM, for whole tables."""
    return casefolded(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")))


#: Names are compared in this form.
folded_text = identity_text


def folded(text: str | None, nfkc: bool = False) -> str:
    """Full case folding, with compatibility normalisation first where asked."""
    if text is None:
        return ""
    text = unicodedata.normalize("NFKC", text) if nfkc else text
    return " ".join(text.split()).casefold()


@F.pandas_udf(T.StringType())
def catalog_text(s: pd.Series) -> pd.Series:
    """NFKC and full case folding: for the distinct names of a dimension, which Spark has no function for."""
    return s.map(lambda x: folded(x, True))


def clock_seconds(minutes: Column, seconds: Column) -> Column:
    """minutes * 60 + seconds; null if either is."""
    return minutes * 60 + seconds


def join_words(*parts: Column) -> Column:
    """Parts joined by spaces, without null and empty ones."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def result_state(own: Column, other: Column) -> Column:
    """win, loss or tie; null unless both are there."""
    return F.when(own > other, "win").when(own < other, "loss").when(own == other, "tie")

