"""Tokens used to compare minutes with a transcript: bigrams and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip

# What counts as a number, a range with a unit, a year.
NUMBER = "\\p{Nd}+(?:\\.\\p{Nd}+)?"
UNIT = "[万亿%]"
DASH = "[-~～]+"
UNIT_NUMBER = NUMBER + WS + "*" + UNIT
UNIT_RANGE = NUMBER + WS + "*" + DASH + WS + "*" + NUMBER + WS + "*" + UNIT
YEAR = "(\\p{Nd}{2,4})" + WS + "*年"


def normalize_match(c: Column) -> Column:
    """Keep Han characters, ASCII letters, digits, ``%`` and ``-``."""
    return F.regexp_replace(c, "[^一-鿿A-Za-z0-9%\\-]+", "")


def match_codes(text: str) -> np.ndarray:
    """The code points that ``normalize_match`` keeps."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = c | 32
    return c[((c >= 0x4E00) & (c <= 0x9FFF)) | ((small >= 97) & (small <= 122)) | ((c >= 48) & (c <= 57)) | (c == 37) | (c == 45)]


def match_tokens(c: Column) -> Column:
    """Struct ``norm`` (the text by ``normalize_match``) and ``pairs``: its distinct bigrams as numbers, in no order."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            norms, sets = [], []
            for t in b.to_pylist():
                codes = None if t is None else match_codes(t)
                norms.append(None if t is None else codes.tobytes().decode("utf-32-le"))
                sets.append(None if t is None else np.unique(codes[:-1].astype(np.int64) << 21 | codes[1:]))
            yield pa.StructArray.from_arrays([pa.array(norms, pa.string()), pa.array(sets, pa.list_(pa.int64()))], ["norm", "pairs"])

    return F.arrow_udf(run, "struct<norm:string,pairs:array<bigint>>")(c)


def squeeze(c: Column) -> Column:
    """Drop all whitespace."""
    return F.regexp_replace(c, WS + "+", "")


def char_bigrams(c: Column) -> Column:
    """Distinct two-character shingles, by an empty match at every character."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=([^\\p{Cs}].))"), F.lit(1)))


def number_tokens(c: Column) -> Column:
    """Distinct number tokens: years with their alias, unit numbers, bare numbers."""
    def all_of(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))

    def year_forms(y: Column) -> Column:
        alias = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(
            F.length(y) == 4, F.right(y, F.lit(2)))
        return F.array_compact(F.array(y, alias))

    def range_ends(r: Column) -> Column:
        unit = F.right(r, F.lit(1))
        ends = F.split(F.substring(r, F.lit(1), F.length(r) - 1), DASH)
        return F.transform(F.filter(F.transform(ends, strip), lambda e: e != ""),
                           lambda e: F.concat(e, unit))

    tokens = F.concat(
        F.flatten(F.transform(all_of(YEAR, 1), year_forms)),
        F.flatten(F.transform(all_of(UNIT_RANGE), range_ends)),
        F.transform(all_of(UNIT_NUMBER), squeeze),
        all_of(NUMBER),
    )
    return F.when(c.rlike("\\p{Nd}"), F.array_distinct(tokens)).otherwise(
        F.array().cast("array<string>"))


def overlap_ratio(a: Column, b: Column, when_empty: float) -> Column:
    """``|A ∩ B| / |A|``, or ``when_empty`` if A is empty."""
    return F.when(F.size(a) == 0, F.lit(when_empty)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a))


def bigram_ratio(a: Column, b: Column) -> Column:
    return overlap_ratio(a, b, 1.0)


def number_ratio(a: Column, b: Column) -> Column:
    return overlap_ratio(a, b, 0.0)


def question_key(c: Column) -> Column:
    return F.lower(squeeze(c))
