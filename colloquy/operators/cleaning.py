"""The cleaning chain on a transcript table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (DEFAULT_FILLERS, citation_style, let, merge_speaker_text,
                              normalize_numbers, remove_fillers, size_tier, transcript_type)
from ..sources.exports import normalize_export_text


def clean_text(c: Column, fillers: Sequence[str] = DEFAULT_FILLERS) -> Column:
    """Export format, speaker blocks, fillers, numerals - in this order, each computed once."""
    return let(normalize_export_text(c), lambda plain: let(merge_speaker_text(plain), lambda merged: let(
        remove_fillers(merged, fillers), normalize_numbers)))


def clean(df: DataFrame, text: str = "text", fillers: Sequence[str] = DEFAULT_FILLERS) -> DataFrame:
    """Replace ``text`` by its cleaned form; one narrow stage, no shuffle."""
    return df.withColumn(text, clean_text(F.col(text), fillers))


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """Add citation style, transcript type and size tier of the raw text."""
    c = F.col(text)
    return df.withColumns({"citation_style": citation_style(c), "transcript_type": transcript_type(c),
                           "size_tier": size_tier(c)})
