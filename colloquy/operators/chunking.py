"""Cut texts into chunks and stitch chunk texts together again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lstrip
from .ordered import previous, settle

# Preferred cut characters, best first, and the window they are sought in.
SENTENCE_BOUNDARIES = ("\n", "。", "！", "？")
SECONDARY_BOUNDARIES = ("；", "，", "、", ")")
CUT_WINDOW = 300
STITCH_SPAN = 200
STITCH_MIN = 10
TRIM_MIN = 6
TRIM_GUARD = 10


def cut_ranges(text: str, max_chars: int, overlap: int, boundaries: Sequence[str]) -> list[tuple[int, int]]:
    """Code-point ranges of the chunks of a text. Each cut depends on the one before, so they are made in order, in one pass."""
    n, start, out = len(text), 0, []
    if n <= max_chars:
        return [(0, n)]
    while start < n:
        if start + max_chars >= n:
            out.append((start, n))
            break
        backwards = text[max(start + max_chars - CUT_WINDOW, start):start + max_chars][::-1]
        cuts = (start + max_chars - d for d in map(backwards.find, boundaries) if d >= 0)
        cut = next((c for c in cuts if c - 1 > start), start + max_chars)
        out.append((start, cut))
        start = cut - overlap if cut - overlap > start else cut
    return out


def chunk_bounds(text: Column, max_chars: int = 2000, overlap: int = 200,
                 boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES) -> Column:
    """Array of ``(start, stop)`` code-point ranges of the chunks of ``text``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            yield pa.array([None if t is None else [{"start": s, "stop": e} for s, e in cut_ranges(t, max_chars, overlap, boundaries)]
                            for t in (x.as_py() for x in b)], kind)

    return F.arrow_udf(run, "array<struct<start:int,stop:int>>")(text)


def chunk_text(df: DataFrame, text: str = "text", max_chars: int = 2000, overlap: int = 200,
               boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES) -> DataFrame:
    """One row per chunk: ``chunk_ord``, ``chunk_start`` and the chunk as ``chunk``."""
    # Chunks are cut inside the row, so that no chunk carries the whole text; all of them in one pass over it.
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            offsets, starts, chunks = [0], [], []
            for t in (x.as_py() for x in b):
                for s, e in [] if t is None else cut_ranges(t, max_chars, overlap, boundaries):
                    starts.append(s)
                    chunks.append(t[s:e])
                offsets.append(len(starts))
            cut = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(chunks, pa.string())], ["start", "chunk"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cut)

    cut = F.arrow_udf(run, "array<struct<start:int,chunk:string>>")(F.col(text))
    return (
        df.select("*", F.posexplode(cut).alias("chunk_ord", "_b")).drop(text)
        .withColumn("chunk_start", F.col("_b.start")).withColumn("chunk", F.col("_b.chunk")).drop("_b"))


def edges_of(tail: str | None, head: str | None, longest: int, shortest: int) -> list[int]:
    """Lengths, the greatest first, at which the end of ``tail`` is the beginning of ``head``."""
    if tail is None or head is None or min(len(tail), len(head), longest) < shortest:
        return []
    out, start, opening = [], max(0, len(tail) - longest, len(tail) - len(head)), head[:shortest]
    while (at := tail.find(opening, start)) >= 0:
        if head.startswith(tail[at:]):
            out.append(len(tail) - at)
        start = at + 1
    return out


def shared_edges(tail: Column, head: Column, longest: int, shortest: int) -> Column:
    """Lengths, the greatest first, at which the end of ``tail`` is the beginning of ``head``."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tails, heads in batches:
            yield pa.array([edges_of(t, h, longest, shortest) for t, h in zip(tails.to_pylist(), heads.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(tail, head)


def stitch_text(chunks: DataFrame, min_overlap: int = STITCH_MIN, span: int = STITCH_SPAN) -> DataFrame:
    """Remove from each chunk text what repeats the end of the text before it.

    ``chunks`` has ``recording_id, chunk_ord, text``. The comparison is with the
    *trimmed* previous text. What is left of that is an end of it, so its length
    alone decides which of the raw texts' shared edges counts: the longest that
    fits. Nearly always the same one does, whatever was trimmed before; only the
    other chunks are looked at one after the other, by lengths alone.
    """
    text = F.col("text")
    edges = previous(chunks.select("recording_id", "chunk_ord", "text"), ["recording_id"], "chunk_ord", F.right(text, F.lit(span)), out="_p") \
        .withColumn("edges", shared_edges(F.col("_p.v"), F.left(text, F.lit(span)), span, min_overlap))
    # What is left for each choice: the whole text, or the rest behind an edge.
    left = F.concat(F.array(F.coalesce(F.length(text), F.lit(0))),
                    F.transform("edges", lambda k: F.length(lstrip(F.substring(text, k + 1, F.length(text))))))
    known = previous(edges.select("recording_id", "chunk_ord", "edges", left.alias("left")), ["recording_id"], "chunk_ord", F.col("left"), out="_l")
    fits = lambda n: F.coalesce(F.get(F.filter("edges", lambda k: k <= n), F.lit(0)), F.lit(0))
    choices = F.array_distinct(F.transform(F.coalesce("_l.v", F.array().cast("array<int>")), fits))
    rows = settle(known.select("recording_id", "chunk_ord", "edges", "left", F.when(F.size("edges") == 0, 0).when(
        F.size(choices) == 1, choices[0]).alias("shared")))
    before = rows.where("shared IS NOT NULL")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recording, length = None, 0
        for b in batches:
            take, out = [], []
            names = ("recording_id", "shared", "edges", "left")
            for i, (r, shared, fit, left) in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
                if r != recording:
                    recording, length = r, 0
                if shared is None:
                    shared = next((k for k in fit if k <= length), 0)
                    take.append(i)
                    out.append(shared)
                length = left[0 if shared == 0 else fit.index(shared) + 1]
            kept = b.select(["recording_id", "chunk_ord"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], ["recording_id", "chunk_ord", "shared"])

    # A chunk that is open follows the one before it, open or not.
    ahead = previous(rows.select("recording_id", (-F.col("chunk_ord")).alias("back"), "chunk_ord", "edges", "left", "shared"),
                     ["recording_id"], "back", F.col("shared").isNull(), out="_next").where("shared IS NULL OR _next.v")
    streamed = ahead.repartition("recording_id").sortWithinPartitions("recording_id", "chunk_ord").select(
        "recording_id", "chunk_ord", "shared", "edges", "left")
    kinds = chunks.schema
    solved = streamed.mapInArrow(follow, f"recording_id {kinds['recording_id'].dataType.simpleString()}, "
                                         f"chunk_ord {kinds['chunk_ord'].dataType.simpleString()}, shared int")
    both = before.select("recording_id", "chunk_ord", "shared").unionByName(solved)
    found = both.select(F.col("recording_id").alias("_r"), F.col("chunk_ord").alias("_c"), "shared")
    met = chunks.join(found, (F.col("recording_id") == F.col("_r")) & (F.col("chunk_ord") == F.col("_c")))
    kept = F.when(F.col("shared") > 0, lstrip(F.substring(text, F.col("shared") + 1, F.length(text)))).otherwise(text)
    return met.select("recording_id", "chunk_ord", kept.alias("text"))


def end_of_repeat(tail: str | None, text: str | None, longest: int, shortest: int, guard: int) -> int | None:
    """Where the longest end of ``tail`` that begins in ``text`` before its last ``guard`` characters ends there, if there is one."""
    if tail is None or text is None or (size := min(len(tail), len(text), longest)) < shortest:
        return None
    # An end is in the text if a longer one is: halve to the longest that is anywhere in it, then look where they begin.
    few, many = shortest - 1, size
    while few < many:
        half = (few + many + 1) // 2
        few, many = (half, many) if tail[len(tail) - half:] in text else (few, half - 1)
    for k in range(few, shortest - 1, -1):
        if 0 <= (at := text.find(tail[len(tail) - k:])) < len(text) - guard:
            return at + k
    return None


def trim_rewrite_overlap(chunks: DataFrame, longest: int = STITCH_SPAN, shortest: int = TRIM_MIN,
                         guard: int = TRIM_GUARD) -> DataFrame:
    """Drop from each chunk everything through the repeated end of the raw chunk before it.

    ``chunks`` has ``meeting_id, chunk_ord, text``, ordinals dense from 0. The
    longest suffix found anywhere but in the last characters counts; a chunk
    that would become empty stays whole. The previous chunk is reached by an
    equi-join on the ordinal, so a long meeting is no hot group; only its last
    characters travel.
    """
    ends = chunks.select("meeting_id", (F.col("chunk_ord") + 1).alias("chunk_ord"),
                         F.right("text", F.lit(longest)).alias("_tail"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tails, texts in batches:
            yield pa.array([end_of_repeat(e, t, longest, shortest, guard) for e, t in zip(tails.to_pylist(), texts.to_pylist(), strict=True)], pa.int32())

    text = F.col("text")
    behind = F.arrow_udf(run, "int")(F.col("_tail"), text)
    met = chunks.join(ends, ["meeting_id", "chunk_ord"], "left").withColumn("_behind", behind)
    rest = F.substring(text, F.col("_behind") + 1, F.length(text))
    return met.withColumn("text", F.when(F.col("_behind") < F.length(text), rest).otherwise(text)).drop("_tail", "_behind")
