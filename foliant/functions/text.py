"""Text normalisers, ratios and edit distances.

Exact NFKC and case folding need Python's tables, so they run as Arrow UDFs; the ``plain_`` forms
use lower-case and stay in the JVM.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from foliant.functions.arrays import let


def plain_metric_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def plain_annotation_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)\W+", "")


def plain_alignment_text(x: Column) -> Column:
    """Letters, digits, underscore and the Thai block."""
    return F.regexp_replace(F.lower(x), r"(?U)[^\w฀-๿]+", "")


def _folded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def metric_text(x: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed."""
    return _folded(x).map(lambda t: None if t is None else " ".join(t.split()))


@F.pandas_udf(StringType())
def annotation_text(x: pd.Series) -> pd.Series:
    """NFKC, case folded, word characters only."""
    return _folded(x).map(lambda t: None if t is None else re.sub(r"\W+", "", t))


@F.pandas_udf(StringType())
def alignment_text(x: pd.Series) -> pd.Series:
    """NFKC, case folded, word characters and the Thai block."""
    return _folded(x).map(lambda t: None if t is None else re.sub(r"[^\w฀-๿]+", "", t))


@functools.lru_cache(maxsize=1 << 19)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def text_score(source: Column, ocr: Column) -> Column:
    """Score of two normalised texts: equal 1, containing up to 0.98, else fuzzy."""
    a, b = F.length(source), F.length(ocr)
    # The function sees nulls where an earlier branch decides, for Spark runs it on every row.
    held = (source == ocr) | ((a >= 2) & ocr.contains(source)) | ((b >= 2) & source.contains(ocr))
    return (
        F.when(source == ocr, F.lit(1.0))
        .when((a >= 2) & ocr.contains(source), F.least(F.lit(0.98), a / F.greatest(F.lit(1), b) + 0.25))
        .when((b >= 2) & source.contains(ocr), F.least(F.lit(0.98), b / F.greatest(F.lit(1), a) + 0.25))
        .otherwise(fuzzy_ratio(F.when(~held, source), F.when(~held, ocr)))
    )


def plain_text_score(source: str, ocr: str) -> tuple[float, str]:
    """``text_score`` and ``match_type`` of two strings."""
    a, b = len(source), len(ocr)
    if source == ocr:
        return 1.0, "exact"
    if a >= 2 and source in ocr:
        return min(0.98, a / max(1, b) + 0.25), "ocr_contains_annotation"
    if b >= 2 and ocr in source:
        return min(0.98, b / max(1, a) + 0.25), "annotation_contains_ocr"
    return _ratio(source, ocr), "similarity"


def match_type(source: Column, ocr: Column) -> Column:
    a, b = F.length(source), F.length(ocr)
    return F.when(source == ocr, "exact").when((a >= 2) & ocr.contains(source), "ocr_contains_annotation").when((b >= 2) & source.contains(ocr), "annotation_contains_ocr").otherwise("similarity")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays: each distinct word becomes one character.

    Characters start at U+0100 and leave out the surrogates.
    """

    def distance(s: Column) -> Column:
        def coded(x: Column) -> Column:
            def char(w: Column) -> Column:
                at = F.array_position(s["words"], w).cast("int") + 256
                at = F.when(at >= 0xD800, at + 0x800).otherwise(at)
                return F.decode(F.unhex(F.lpad(F.hex(at), 4, "0")), "UTF-16BE")

            return F.array_join(F.transform(x, char), "")

        return F.levenshtein(coded(s["a"]), coded(s["b"]))

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("words")), distance)


def letters_share(x: Column, pattern: str, of: str | None = None) -> Column:
    """Characters that match over all characters (or over those that match ``of``)."""
    whole = F.length(x) if of is None else F.length(F.regexp_replace(x, f"(?U)[^{of}]", ""))
    return F.length(F.regexp_replace(x, f"(?U)[^{pattern}]", "")) / F.greatest(F.lit(1), whole)
