"""Recogniser exports: JSON lines, subtitles, wrapped responses, segment payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import strict_json, typed_string
from ..functions.text import is_blank, let, strip

NO_SEGMENTS = "no_segments"


def json_lines_text(c: Column) -> Column:
    """Joined ``text`` fields if every non-blank line is such an object, else NULL."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    # One parse for the whole text: the lines as the items of one array.
    def parse(xs: Column) -> Column:
        whole = F.try_parse_json(F.concat(F.lit('{"v":['), F.array_join(xs, ","), F.lit("]}")))
        items = F.try_variant_get(whole, "$.v", "array<variant>")
        texts = F.when(F.forall(xs, lambda x: x.startswith("{") & x.endswith("}")),
                       F.transform(items, lambda v: typed_string(v, "text")))
        return let(texts, lambda ts: F.when(
            (F.size(ts) == F.size(xs)) & F.forall(ts, lambda t: t.isNotNull()), F.array_join(ts, "\n")))

    return F.when(strip(c).startswith("{"), let(lines, parse))


def subtitle_text(c: Column) -> Column:
    """Cue texts of SRT/VTT, recognised by an arrow in the first five lines, else NULL."""
    lines = F.split(c, "\n")

    def keep(x: Column) -> Column:
        return ~((x == "") | x.rlike("^\\p{Nd}+$") | F.contains(x, F.lit("-->"))
                 | x.startswith("WEBVTT") | x.startswith("NOTE"))

    def cues(xs: Column) -> Column:
        kept = F.filter(F.transform(xs, strip), keep)
        text = let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n")))
        return F.when(F.exists(F.slice(xs, 1, 5), lambda x: F.contains(x, F.lit("-->"))), text)

    return F.when(F.contains(c, F.lit("-->")), let(lines, cues))


def normalize_export_text(c: Column) -> Column:
    return F.when(is_blank(c), c).otherwise(F.coalesce(json_lines_text(c), subtitle_text(c), c))


def unwrap_json_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(json_lines_text(F.col(text)), F.col(text)))


def unwrap_subtitles(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(subtitle_text(F.col(text)), F.col(text)))


def normalize_export(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, normalize_export_text(F.col(text)))


def unwrap_asr_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Take the non-empty ``text`` of a response that is a JSON object, else keep it."""
    c = F.col(text)
    inner = F.when(strip(c).startswith("{"), typed_string(strict_json(c), "text"))
    return df.withColumn(text, F.coalesce(F.nullif(inner, F.lit("")), c))


def parse_asr_segments(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of ``verbose_json`` payloads and the payloads that have none.

    ``payloads`` has ``recording_id, offset, payload``. A payload without a
    non-empty ``segments`` list is rejected, never read as plain text.
    """
    shape = "segments array<struct<start:double,end:double,text:string>>"
    parsed = payloads.withColumn("_s", F.when(
        strip(F.col("payload")).startswith("{") & strict_json(F.col("payload")).isNotNull(),
        F.from_json("payload", shape)["segments"]))
    usable = F.coalesce(F.size("_s"), F.lit(0)) > 0
    segments = (
        parsed.where(usable)
        .select("recording_id", "offset", F.posexplode("_s").alias("seg_ord", "s"))
        .select("recording_id", "seg_ord", (F.col("s.start") + F.col("offset")).alias("start"),
                (F.col("s.end") + F.col("offset")).alias("end"),
                strip(F.coalesce("s.text", F.lit(""))).alias("text"))
        .where("start IS NOT NULL AND end IS NOT NULL AND text <> ''"))
    rejects = parsed.where(~usable).select("recording_id", F.lit(NO_SEGMENTS).alias("reason"))
    return segments, rejects
