"""Align time-stamped segments with speaker turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .ordered import (SPAN, islands, large_keys, neighbours, ordered_concat, ordinal_bucket,
                      prior_max, running_sum, settle, time_bucket_if_large)

MIN_TURN_SECONDS = 1.0
MAX_GAP_SECONDS = 0.5
DOMINANCE_WARN = 0.9
# Lengths of the levels of the interval join are powers of it, in seconds.
STEP = 8
UNNAMED_SPEAKER = "说话人"


def _level(start: Column, end: Column) -> Column:
    """The least power of STEP seconds, from 0, that is no shorter than an interval."""
    length = F.greatest(end - start, F.lit(1.0))
    rough = F.ceil(F.log(float(STEP), length)).cast("int")
    # The logarithm of a power may be rounded down.
    return F.when(F.pow(F.lit(float(STEP)), rough) < length, rough + 1).otherwise(rough)


def _node(time: Column, level: Column) -> Column:
    return F.floor(time / F.pow(F.lit(float(STEP)), level)).cast("long")


def touching(probe: DataFrame, stored: DataFrame, longer: bool = False) -> DataFrame:
    """Pairs of intervals of a recording that touch and of which the stored one has no lower level.

    Both have ``recording_id`` and an interval, ``p0, p1`` and ``q0, q1``; other
    columns must differ in name. An interval is stored once, at the node of its level
    where it starts; a probe looks at the nodes of each level where an interval that
    touches it can start, which are three at most. So neither a very long interval
    nor many short ones are copied often, and a pair meets once. ``longer`` leaves
    out stored intervals of the probe's own level.
    """
    own = _level(F.col("p0"), F.col("p1")) + int(longer)
    kept = stored.where("q0 <= q1").withColumn("_level", _level(F.col("q0"), F.col("q1")))
    kept = kept.withColumn("_node", _node(F.col("q0"), F.col("_level")))
    # A dozen levels at most: the thirteenth is longer than two thousand years.
    present = sorted(r[0] for r in kept.select("_level").distinct().collect())
    levels = F.array(*map(F.lit, present)) if present else F.array().cast("array<int>")
    seeking = probe.where("p0 <= p1").withColumn("_level", F.explode(F.filter(levels, lambda n: n >= own)))
    nodes = F.sequence(_node(F.col("p0"), F.col("_level")) - 1, _node(F.col("p1"), F.col("_level")))
    return seeking.withColumn("_node", F.explode(nodes)).join(kept, ["recording_id", "_level", "_node"]).where(
        "p0 <= q1 AND q0 <= p1").drop("_level", "_node")


def assign_speaker(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Speaker of the turn that overlaps each segment most; ties take the earliest turn.

    Segments meet turns at least as long, turns meet longer segments; both are
    equi-joins, whose hot nodes adaptive execution can split. The arg-max
    aggregates map-side. Texts do not take part.
    """
    s = segments.where("start < end").select("recording_id", "seg_ord", F.col("start").alias("p0"), F.col("end").alias("p1"))
    t = turns.where("start < end").select("recording_id", "turn_ord", "speaker", F.col("start").alias("q0"), F.col("end").alias("q1"))
    swapped = {"p0": "q0", "p1": "q1"}
    back = {"q0": "p0", "q1": "p1"}
    pairs = touching(s, t).unionByName(touching(t.withColumnsRenamed(back), s.withColumnsRenamed(swapped), longer=True))
    overlap = F.least("p1", "q1") - F.greatest("p0", "q0")
    best = pairs.where(overlap > 0).groupBy("recording_id", "seg_ord").agg(
        F.max_by("speaker", F.struct(overlap, -F.col("turn_ord"))).alias("speaker"))
    return segments.join(best, ["recording_id", "seg_ord"], "left")


def merge_short_turns(turns: DataFrame, min_duration: float = MIN_TURN_SECONDS, span: int = SPAN) -> DataFrame:
    """Give each fragment the speaker of a long turn; times do not change.

    A long turn that contains the fragment wins, the shortest first. Otherwise
    the long turn with the nearest end point wins: only the long turns next to
    the fragment's end points can be nearest, so two neighbour look-ups replace
    the all-pairs comparison. Ties take the earliest turn.
    """
    duration = F.col("end") - F.col("start")
    kept = turns.where(duration >= min_duration)
    fragments = turns.where(duration < min_duration)

    k = kept.select("recording_id", "speaker", F.col("start").alias("q0"), F.col("end").alias("q1"),
                    F.struct(duration.alias("d"), F.col("turn_ord").alias("o")).alias("rank"))
    f = fragments.select("recording_id", "turn_ord", F.col("start").alias("p0"), F.col("end").alias("p1"))
    inside = (
        touching(f, k).where("q0 <= p0 AND p1 <= q1")
        .groupBy("recording_id", "turn_ord").agg(F.min_by("speaker", "rank").alias("outer_speaker")))

    # End points of long turns ('S' starts, 'E' ends), earliest turn per point,
    # merged with the fragments that look for them.
    ends = F.explode(F.array(
        F.struct(F.lit("S").alias("side"), F.col("start").alias("t")),
        F.struct(F.lit("E").alias("side"), F.col("end").alias("t"))))
    seeks = F.explode(F.array(
        F.struct(F.lit("S").alias("side"), F.col("end").alias("t")),
        F.struct(F.lit("E").alias("side"), F.col("start").alias("t"))))
    points = (
        kept.select("recording_id", "turn_ord", "speaker", ends.alias("p"))
        .groupBy("recording_id", F.col("p.side").alias("side"), F.col("p.t").alias("t"))
        .agg(F.min(F.struct("turn_ord", "speaker")).alias("who"))
        .select("recording_id", "side", "t", F.lit(None).cast("int").alias("turn_ord"),
                F.struct(F.col("t").alias("t"), F.col("who.turn_ord").alias("ord"),
                         F.col("who.speaker").alias("speaker")).alias("ref")))
    asks = fragments.select("recording_id", "turn_ord", seeks.alias("p")).select(
        "recording_id", F.col("p.side").alias("side"), F.col("p.t").alias("t"), "turn_ord",
        F.lit(None).cast("struct<t:double,ord:int,speaker:int>").alias("ref"))
    near = neighbours(
        points.unionByName(asks), ["recording_id", "side"],
        [F.col("t"), F.coalesce(F.col("turn_ord"), F.lit(-1))], F.col("ref"),
        bucket=time_bucket_if_large(turns, ["recording_id"], "start", span, of="t"),
        before="b", after="a").where("ref IS NULL")
    candidate = near.select(
        "recording_id", "turn_ord", "t", F.explode(F.array("b", "a")).alias("c")).where("c IS NOT NULL")
    nearest = candidate.groupBy("recording_id", "turn_ord").agg(
        F.min_by("c.speaker", F.struct(F.abs(F.col("c.t") - F.col("t")), F.col("c.ord")))
        .alias("near_speaker"))

    keys = ["recording_id", "turn_ord"]
    return (
        turns.join(inside, keys, "left").join(nearest, keys, "left")
        .withColumn("speaker", F.coalesce("outer_speaker", "near_speaker", "speaker"))
        .drop("outer_speaker", "near_speaker"))


def coalesce_turns(turns: DataFrame, max_gap: float = MAX_GAP_SECONDS, span: int = SPAN) -> DataFrame:
    """Merge neighbouring turns of one speaker when the gap is at most ``max_gap``.

    Turns are taken by (start, longest first). A contained turn is absorbed by
    the same rule, as its gap to the running maximum end is not positive.
    Different speakers' overlaps stay. Needs ``start <= end``.
    """
    order = [F.col("start"), F.col("start") - F.col("end"), F.col("turn_ord")]
    narrow = turns.select("recording_id", "turn_ord", "start", "end", "speaker")
    bucket = time_bucket_if_large(narrow, ["recording_id"], "start", span)
    runs = islands(narrow, ["recording_id"], order, F.col("speaker"), bucket=bucket, out="run")
    if bucket is not None:
        runs = settle(runs)
    run = ["recording_id", "run"]
    reached = prior_max(runs, run, order, F.col("end"), bucket=bucket, out="reach")
    opens = (F.col("reach").isNull() | (F.col("start") - F.col("reach") > max_gap)).cast("int")
    parts = running_sum(reached, run, order, opens, bucket=bucket, out="part")
    return parts.groupBy("recording_id", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"))


def _spoken(segments: DataFrame, turns: DataFrame, span: int):
    """Segments with text and speaker, and the bucket to scan them by."""
    rows = assign_speaker(segments, turns).withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    if large_keys(segments, ["recording_id"], span) is None:
        return rows, None
    return settle(rows), ordinal_bucket("seg_ord", span)


def group_by_speaker(segments: DataFrame, turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Blocks of consecutive segments with one speaker (NULL counts as a speaker).

    One row per block; recordings of more than ``span`` segments are scanned in buckets.
    """
    rows, bucket = _spoken(segments, turns, span)
    numbered = islands(rows, ["recording_id"], [F.col("seg_ord")], F.col("speaker"),
                       bucket=bucket, out="block_ord")
    return ordered_concat(
        numbered, ["recording_id", "block_ord"], [F.col("seg_ord")], F.col("text"),
        also={"start": F.min_by("start", "seg_ord"), "end": F.max("end"), "speaker": F.first("speaker")})


def speaker_label(speaker: Column, names: Mapping[int, str] | None = None) -> Column:
    label = F
    for number, name in (names or {}).items():
        label = label.when(speaker == number, name)
    default = F.concat(F.lit(UNNAMED_SPEAKER), speaker.cast("string"))
    return label.otherwise(default) if names else default


def labeled_transcript(segments: DataFrame, turns: DataFrame, names: Mapping[int, str] | None = None,
                       span: int = SPAN) -> DataFrame:
    """Labelled blocks: a segment without speaker continues the block before it.

    Leading segments without a speaker are dropped. Joining the block texts of
    a recording by a blank line gives the labelled transcript.
    """
    rows, bucket = _spoken(segments, turns, span)
    named = rows.withColumn(
        "label", F.when(F.col("speaker").isNotNull(), speaker_label(F.col("speaker"), names)))
    blocks = islands(named, ["recording_id"], [F.col("seg_ord")], F.col("label"), inherit_null=True,
                     bucket=bucket, out="block_ord", filled="speaker_label")
    # The label goes in front of the text that opens a block.
    opening = prior_max(blocks.where("block_ord >= 0"), ["recording_id", "block_ord"], [F.col("seg_ord")],
                        F.col("seg_ord"), bucket=bucket, out="earlier")
    text = F.when(F.col("earlier").isNotNull(), F.col("text")).otherwise(
        F.concat(F.col("speaker_label"), F.lit(":\n"), F.col("text")))
    return ordered_concat(opening, ["recording_id", "block_ord", "speaker_label"],
                          [F.col("seg_ord")], text)


def merge_speakers(turns_text: DataFrame, span: int = SPAN) -> DataFrame:
    """Concatenate consecutive turns of one speaker, in table form."""
    rows = turns_text.withColumn("speaker", strip(F.col("speaker"))).withColumn("text", strip(F.col("text")))
    large = large_keys(turns_text, ["meeting_id"], span)
    bucket = None if large is None else ordinal_bucket("turn_ord", span)
    numbered = islands(rows, ["meeting_id"], [F.col("turn_ord")], F.col("speaker"),
                       bucket=bucket, out="block_ord")
    return ordered_concat(numbered, ["meeting_id", "block_ord", "speaker"],
                          [F.col("turn_ord")], F.col("text"))


def chunk_windows(recordings: DataFrame, chunk_seconds: float, overlap: float) -> DataFrame:
    """Windows of an audio cut: one row per chunk of ``(recording_id, total)``.

    A chunk starts every ``chunk_seconds`` as long as more than ``overlap``
    seconds remain; each but the last reaches ``overlap`` seconds further.
    """
    count = F.greatest(F.ceil((F.col("total") - overlap) / chunk_seconds), F.lit(1))
    return recordings.where("total > 0").select(
        "recording_id", "total",
        F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("chunk_ord")
    ).select(
        "recording_id", F.col("chunk_ord").cast("int").alias("chunk_ord"),
        (F.col("chunk_ord") * chunk_seconds).alias("chunk_start"),
        F.least(F.col("chunk_ord") * chunk_seconds + chunk_seconds + overlap, F.col("total"))
        .alias("chunk_end"),
        (F.col("chunk_ord") * chunk_seconds + chunk_seconds + overlap >= F.col("total")).alias("last"))


def stitch_segments(local: DataFrame, chunk_seconds: float, keep_tail: bool = False) -> DataFrame:
    """Put chunk-local segments on the recording's clock, each exactly once.

    ``local`` has ``recording_id, chunk_ord, start, end, text`` with times from
    the chunk's start. A segment belongs to the chunk whose first
    ``chunk_seconds`` hold its midpoint. The last chunk may be longer than
    that; ``keep_tail=True`` also keeps its late segments (needs ``last``).
    """
    core = (F.col("start") + F.col("end")) / 2 < chunk_seconds
    if keep_tail:
        core = core | F.col("last")
    offset = F.col("chunk_ord") * chunk_seconds
    return local.where(core).withColumn("start", F.col("start") + offset).withColumn(
        "end", F.col("end") + offset)


def dominant_share(turns: DataFrame) -> DataFrame:
    """Share of the speaker with the most time, per recording; flagged above 0.9."""
    per_speaker = turns.groupBy("recording_id", "speaker").agg(
        F.sum(F.col("end") - F.col("start")).alias("seconds"))
    share = F.when(F.sum("seconds") > 0, F.max("seconds") / F.sum("seconds")).otherwise(F.lit(0.0))
    return per_speaker.groupBy("recording_id").agg(share.alias("share")).withColumn(
        "dominated", F.col("share") > DOMINANCE_WARN)


def speaker_count(turns: DataFrame) -> DataFrame:
    """Distinct speakers per recording, by a two-level aggregate."""
    return turns.groupBy("recording_id", "speaker").agg(F.lit(1).alias("one")).groupBy(
        "recording_id").agg(F.count("one").alias("speakers"))
