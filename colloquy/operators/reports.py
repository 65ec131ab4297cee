"""Run summaries per meeting and over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_FILLERS, size_tier, transcript_type
from .cleaning import clean_text


def run_summary(transcripts: DataFrame, sections: DataFrame | None = None, qa_pairs: DataFrame | None = None,
                coverage: DataFrame | None = None, fillers=DEFAULT_FILLERS) -> DataFrame:
    """Characters before and after cleaning, tier, type, and counts of the minutes."""
    text = F.col("text")
    out = transcripts.select(
        "meeting_id", F.length(text).alias("raw_chars"), F.length(clean_text(text, fillers)).alias("cleaned_chars"),
        size_tier(text).alias("tier"), transcript_type(text).alias("type"))
    for df, name in ((sections, "sections"), (qa_pairs, "qa_pairs")):
        if df is not None:
            counts = df.groupBy("meeting_id").agg(F.count(F.lit(1)).alias(name))
            out = out.join(counts, "meeting_id", "left").na.fill(0, [name])
    if coverage is not None:
        out = out.join(coverage.select("meeting_id", F.col("ratio").alias("coverage")), "meeting_id", "left")
    return out


def corpus_summary(summary: DataFrame) -> DataFrame:
    """Meetings and characters by tier and type, with subtotals."""
    return summary.rollup("tier", "type").agg(
        F.count("*").alias("meetings"), F.sum("raw_chars").alias("raw_chars"),
        F.sum("cleaned_chars").alias("cleaned_chars"))
