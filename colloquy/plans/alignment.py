"""Queries on segments and turns: interval join, islands, forward fill, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align
from . import inputs
from .inputs import sql_strip, with_

NAMES = {0: "访谈方", 1: "项目方", 2: "项目方"}
CHUNK_SECONDS, CHUNK_OVERLAP = 600.0, 60.0


def assign_speaker(spark, sf):
    return align.assign_speaker(inputs.segments(spark, sf), inputs.turns(spark, sf)).select(
        "recording_id", "seg_ord", "speaker")


def merge_short_turns(spark, sf):
    return align.merge_short_turns(inputs.turns(spark, sf)).select("recording_id", "turn_ord", "speaker")


def coalesce_turns(spark, sf):
    return align.coalesce_turns(inputs.turns(spark, sf)).select(
        "recording_id", F.round("start", 6).alias("turn_start"), F.round("end", 6).alias("turn_end"), "speaker")


def group_by_speaker(spark, sf):
    return align.group_by_speaker(inputs.segments(spark, sf), inputs.turns(spark, sf)).select(
        "recording_id", "block_ord", "speaker", "text",
        F.round("start", 6).alias("block_start"), F.round("end", 6).alias("block_end"))


def labeled_transcript(spark, sf):
    return align.labeled_transcript(inputs.segments(spark, sf), inputs.turns(spark, sf), NAMES).select(
        "recording_id", "block_ord", "text")


def merge_speakers(spark, sf):
    return align.merge_speakers(inputs.turns_text(spark, sf)).select(
        "meeting_id", "block_ord", "speaker", "text")


def _local_segments(spark, sf):
    segs = inputs.segments(spark, sf)
    totals = segs.groupBy("recording_id").agg(F.max("end").alias("total"))
    windows = align.chunk_windows(totals, CHUNK_SECONDS, CHUNK_OVERLAP)
    # A segment is heard by the chunk it starts in and, in the overlap, by the one before.
    own = F.floor(F.col("start") / CHUNK_SECONDS).cast("int")
    heard = segs.withColumn("chunk_ord", F.explode(F.array(own, own - 1)))
    return (heard.join(windows, ["recording_id", "chunk_ord"])
            .where("start >= chunk_start AND start < chunk_end")
            .withColumn("end", F.least("end", "chunk_end") - F.col("chunk_start"))
            .withColumn("start", F.col("start") - F.col("chunk_start")))


def stitch_segments(spark, sf):
    return align.stitch_segments(_local_segments(spark, sf), CHUNK_SECONDS, keep_tail=True).select(
        "recording_id", "chunk_ord", "seg_ord", F.round("start", 4).alias("seg_start"), "text")


def stitch_segments_core(spark, sf):
    return align.stitch_segments(_local_segments(spark, sf), CHUNK_SECONDS).select(
        "recording_id", "chunk_ord", "seg_ord", F.round("start", 4).alias("seg_start"), "text")


def dominant_share(spark, sf):
    return align.dominant_share(inputs.turns(spark, sf)).select(
        "recording_id", F.round("share", 6).alias("share"), "dominated")


def speaker_count(spark, sf):
    return align.speaker_count(inputs.turns(spark, sf))


QUERIES = {f.__name__: f for f in (
    assign_speaker, merge_short_turns, coalesce_turns, group_by_speaker, labeled_transcript,
    merge_speakers, stitch_segments, stitch_segments_core, dominant_share, speaker_count)}

_ASSIGNED = f"""pairs AS (
    SELECT s.recording_id, s.seg_ord, t.speaker,
           row_number() OVER (PARTITION BY s.recording_id, s.seg_ord
               ORDER BY least(s1, t1) - greatest(s0, t0) DESC, turn_ord) AS rn
    FROM segments s JOIN turns t ON s.recording_id = t.recording_id AND s0 < t1 AND t0 < s1),
assigned AS (
    SELECT s.*, p.speaker FROM segments s
    LEFT JOIN pairs p ON p.recording_id = s.recording_id AND p.seg_ord = s.seg_ord AND rn = 1),
spoken AS (SELECT recording_id, seg_ord, s0, s1, speaker, {sql_strip('text')} AS text
           FROM assigned WHERE {sql_strip('text')} <> '')"""

ORACLE = {
    "assign_speaker": with_("segments", "turns", also=_ASSIGNED)
    + "SELECT recording_id, seg_ord, speaker FROM assigned",
    "merge_short_turns": with_("turns", also="""
        ranked AS (
            SELECT f.recording_id, f.turn_ord, k.speaker, row_number() OVER (
                PARTITION BY f.recording_id, f.turn_ord ORDER BY
                (k.t0 <= f.t0 AND f.t1 <= k.t1) DESC,
                CASE WHEN k.t0 <= f.t0 AND f.t1 <= k.t1 THEN k.t1 - k.t0
                     ELSE least(abs(k.t0 - f.t1), abs(f.t0 - k.t1)) END, k.turn_ord) AS rn
            FROM turns f JOIN turns k ON f.recording_id = k.recording_id
            WHERE f.t1 - f.t0 < 1.0 AND k.t1 - k.t0 >= 1.0)""") + """
        SELECT t.recording_id, t.turn_ord, coalesce(r.speaker, t.speaker) AS speaker FROM turns t
        LEFT JOIN ranked r ON r.recording_id = t.recording_id AND r.turn_ord = t.turn_ord AND rn = 1""",
    "coalesce_turns": with_("turns", also="""
        a AS (SELECT *, lag(speaker) OVER w IS DISTINCT FROM speaker AS changed FROM turns
              WINDOW w AS (PARTITION BY recording_id ORDER BY t0, t0 - t1, turn_ord)),
        b AS (SELECT *, sum(changed::INT) OVER (PARTITION BY recording_id ORDER BY t0, t0 - t1, turn_ord) AS run
              FROM a),
        c AS (SELECT *, max(t1) OVER (PARTITION BY recording_id, run ORDER BY t0, t0 - t1, turn_ord
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
        d AS (SELECT *, sum((reach IS NULL OR t0 - reach > 0.5)::INT) OVER (
                  PARTITION BY recording_id, run ORDER BY t0, t0 - t1, turn_ord) AS part FROM c)""") + """
        SELECT recording_id, round(min(t0), 6) AS turn_start, round(max(t1), 6) AS turn_end,
               min(speaker) AS speaker FROM d GROUP BY recording_id, run, part""",
    "group_by_speaker": with_("segments", "turns", also=_ASSIGNED + """,
        a AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                  ELSE (lag(speaker) OVER w IS DISTINCT FROM speaker)::INT END AS changed FROM spoken
              WINDOW w AS (PARTITION BY recording_id ORDER BY seg_ord)),
        b AS (SELECT *, sum(changed) OVER (PARTITION BY recording_id ORDER BY seg_ord)::BIGINT AS block_ord
              FROM a)""") + """
        SELECT recording_id, block_ord, any_value(speaker) AS speaker,
               string_agg(text, '' ORDER BY seg_ord) AS text, round(arg_min(s0, seg_ord), 6) AS block_start,
               round(max(s1), 6) AS block_end FROM b GROUP BY recording_id, block_ord""",
    "labeled_transcript": with_("segments", "turns", also=_ASSIGNED + """,
        a AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seg_ord)
                  AS known FROM spoken),
        b AS (SELECT *, CASE known WHEN 0 THEN '访谈方' WHEN 1 THEN '项目方' WHEN 2 THEN '项目方'
                  ELSE '说话人' || known END AS label FROM a WHERE known IS NOT NULL),
        c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                  ELSE (lag(label) OVER w <> label)::INT END AS changed FROM b
              WINDOW w AS (PARTITION BY recording_id ORDER BY seg_ord)),
        d AS (SELECT *, sum(changed) OVER (PARTITION BY recording_id ORDER BY seg_ord)::BIGINT AS block_ord
              FROM c)""") + """
        SELECT recording_id, block_ord,
               any_value(label) || ':' || chr(10) || string_agg(text, '' ORDER BY seg_ord) AS text
        FROM d GROUP BY recording_id, block_ord""",
    "merge_speakers": with_("turns_text", also="""
        a AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                  ELSE (lag(speaker) OVER w IS DISTINCT FROM speaker)::INT END AS changed FROM turns_text
              WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_ord)),
        b AS (SELECT *, sum(changed) OVER (PARTITION BY meeting_id ORDER BY turn_ord)::BIGINT AS block_ord
              FROM a)""") + f"""
        SELECT meeting_id, block_ord, any_value(speaker) AS speaker,
               string_agg({sql_strip('text')}, '' ORDER BY turn_ord) AS text
        FROM b GROUP BY meeting_id, block_ord""",
    "stitch_segments": with_("segments", also=f"""
        totals AS (SELECT recording_id, max(s1) AS total FROM segments GROUP BY recording_id),
        windows AS (
            SELECT recording_id, c AS chunk_ord, c * {CHUNK_SECONDS} AS w0,
                   least(c * {CHUNK_SECONDS} + {CHUNK_SECONDS + CHUNK_OVERLAP}, total) AS w1,
                   c * {CHUNK_SECONDS} + {CHUNK_SECONDS + CHUNK_OVERLAP} >= total AS is_last
            FROM (SELECT *, unnest(range(0, greatest(1,
                ceil((total - {CHUNK_OVERLAP}) / {CHUNK_SECONDS})::BIGINT))) AS c FROM totals)),
        heard AS (
            SELECT s.recording_id, chunk_ord, seg_ord, text, is_last, w0, s0 - w0 AS l0, least(s1, w1) - w0 AS l1
            FROM segments s JOIN windows w ON s.recording_id = w.recording_id AND s0 >= w0 AND s0 < w1)""")
    + f"""
        SELECT recording_id, chunk_ord::INTEGER AS chunk_ord, seg_ord, round(l0 + w0, 4) AS seg_start, text
        FROM heard WHERE (l0 + l1) / 2 < {CHUNK_SECONDS} OR is_last""",
    "dominant_share": with_("turns", also="""
        per AS (SELECT recording_id, speaker, sum(t1 - t0) AS seconds FROM turns GROUP BY ALL)""") + """
        SELECT recording_id, round(max(seconds) / sum(seconds), 6) AS share,
               max(seconds) / sum(seconds) > 0.9 AS dominated FROM per GROUP BY recording_id""",
    "speaker_count": with_("turns")
    + "SELECT recording_id, count(DISTINCT speaker) AS speakers FROM turns GROUP BY recording_id",
}
ORACLE["stitch_segments_core"] = ORACLE["stitch_segments"].removesuffix(" OR is_last")
