"""Merge and deduplicate what models extracted."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import UNTITLED, normalize_topic
from ..functions.text import is_blank, strip
from ..functions.tokens import char_bigrams, question_key, squeeze
from .containment import POOL_SPAN, pool_hits, text_pool
from .ordered import numbered, ordered_concat, settle

# Fixed values.
REDUNDANT_FROM = 0.7
REDUNDANT_MIN_CHARS = 20
# Blocks of a stretch, as a power of two.
FOLD_SHIFT = 10
# Keeps bigrams of neighbouring sections apart; occurs in no text.
GAP = "\x00"


def similar_titles(a: str, b: str) -> bool:
    """One normalised title contains the other; an empty one is like none."""
    return bool(a and b) and (a in b or b in a)


def title_runs(titles: Sequence[str]) -> tuple[list[str], list[str], list[int]]:
    """What a stretch of blocks does to the running title, whatever that is.

    The first block that is not like the running title opens a section, and from
    there on all is settled. It is the first block with its title, so the different
    titles in their order, each with the running title at the end and the number of
    sections opened if that block opens one, tell all.
    """
    places: dict[str, list[int]] = {}
    for i, t in enumerate(titles):
        places.setdefault(t, []).append(i)
    firsts = {t: at[0] for t, at in places.items()}

    @cache
    def follower(title: str, at: int) -> int:
        """The next block that is not like this title."""
        unlike = (where for other, where in places.items() if not similar_titles(title, other))
        return min((where[k] for where in unlike if (k := bisect_right(where, at)) < len(where)), default=len(titles))

    ends: dict[int, tuple[str, int]] = {}
    for start in sorted(firsts.values(), reverse=True):
        chain = [start]
        while chain[-1] not in ends and (after := follower(titles[chain[-1]], chain[-1])) < len(titles):
            chain.append(after)
        last = chain[-1]
        ends.setdefault(last, (titles[last], 1))
        for at, after in zip(chain[-2::-1], chain[:0:-1], strict=True):
            ends[at] = (ends[after][0], ends[after][1] + 1)
    out = [(t, *ends[i]) for t, i in firsts.items()]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def merge_blocks(blocks: DataFrame, shift: int = FOLD_SHIFT) -> DataFrame:
    """Sections from topic blocks in order: neighbours on a similar topic are merged.

    Pairs and blank blocks are skipped. A block is compared with the *first*
    title of the running section. Titles in order are cut into stretches of
    ``2^shift``; each tells what it does to any running title (``title_runs``), one
    row per stretch hands the title on, and the stretches number their sections.
    """
    kept = blocks.where((F.coalesce("type", F.lit("narration")) != "qa") & ~is_blank(F.col("text")))
    title = normalize_topic(F.col("topic"))
    rows = kept.select("meeting_id", "chunk_ord", "block_ord", F.when(title == "", UNTITLED).otherwise(title).alias("title"),
                       strip(F.col("text")).alias("text"))
    place = ["meeting_id", "chunk_ord", "block_ord"]
    order = numbered(rows.select(*place, normalize_topic(F.col("title")).alias("key")), [F.col(c) for c in place])
    stretch = F.struct("g", "key")
    stretches = settle(order.groupBy("meeting_id", F.shiftright("g", shift).alias("stretch")).agg(F.array_sort(F.collect_list(stretch)).alias("rows"))
                       .select("meeting_id", F.col("rows")[0]["g"].alias("first"), F.transform("rows", lambda r: r["key"]).alias("titles")))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*(title_runs(t) for t in b.column(2).to_pylist()), strict=True) if b.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, pa.list_(k)) for c, k in zip(
                columns, (pa.string(), pa.string(), pa.int32()), strict=True))], ["meeting_id", "first", "titles", "ends", "opened"])

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, head, n = None, None, 0
        for b in batches:
            heads, counts = [], []
            for m, titles, ends, opened in zip(*(b.column(c).to_pylist() for c in ("meeting", "titles", "ends", "opened")), strict=True):
                if m != meeting:
                    meeting, head, n = m, None, 0
                heads.append(head)
                counts.append(n)
                at = next((i for i, t in enumerate(titles) if head is None or not similar_titles(head, t)), None)
                if at is not None:
                    head, n = ends[at], n + opened[at]
            yield pa.RecordBatch.from_arrays([b.column("first"), pa.array(heads, pa.string()), pa.array(counts, pa.int64())], ["first", "head", "n"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, titles, head, n in zip(*(b.column(c).to_pylist() for c in ("first", "titles", "head", "n")), strict=True):
                out = []
                for t in titles:
                    if head is None or not similar_titles(head, t):
                        head, n = t, n + 1
                    out.append(n - 1)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(out)), pa.int64()), pa.array(out, pa.int64())], ["g", "sec_ord"])

    kind = rows.schema["meeting_id"].dataType.simpleString()
    told = stretches.mapInArrow(summarise, f"meeting_id {kind}, first long, titles array<string>, ends array<string>, opened array<int>")
    # A null meeting is one, too.
    named = told.select(F.to_json(F.struct("meeting_id")).alias("meeting"), "first", "titles", "ends", "opened")
    heads = named.repartition("meeting").sortWithinPartitions("meeting", "first").mapInArrow(hand_on, "first long, head string, n long")
    sections = stretches.join(heads, "first").select("first", "titles", "head", "n").mapInArrow(number, "g long, sec_ord long")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    placed = order.join(sections, "g").select(*[F.col(c).alias(f"_{c}") for c in place], "sec_ord")
    joined = rows.join(placed, same[0] & same[1] & same[2]).select(*rows.columns, "sec_ord")
    return ordered_concat(joined, ["meeting_id", "sec_ord"], [F.col("chunk_ord"), F.col("block_ord")], F.col("text"),
                          sep="\n\n", out="content", also={"title": F.min_by("title", F.struct("chunk_ord", "block_ord"))})


def dedupe_questions(pairs: DataFrame) -> DataFrame:
    """First pair of each question within a meeting that was extracted in several chunks.

    ``pairs`` has ``chunk_ord`` besides the pair columns. The minimum is taken
    by aggregation, so copies of one question combine before the shuffle.
    """
    asked = pairs.where(~is_blank(F.col("question")))
    chunked = pairs.where("chunk_ord > 0").select("meeting_id").distinct()
    rest = [c for c in pairs.columns if c not in ("meeting_id", "chunk_ord", "qa_ord")]
    first = (
        asked.join(chunked, "meeting_id", "left_semi")
        .groupBy("meeting_id", question_key(F.col("question")).alias("_key"))
        .agg(F.min_by(F.struct("chunk_ord", "qa_ord", *rest), F.struct("chunk_ord", "qa_ord")).alias("p"))
        .select("meeting_id", "p.*"))
    whole = pairs.join(chunked, "meeting_id", "left_anti").select(first.columns)
    return first.unionByName(whole)


def drop_redundant_qa(pairs: DataFrame, sections: DataFrame, threshold: float = REDUNDANT_FROM,
                      span: int = POOL_SPAN) -> DataFrame:
    """Drop pairs whose bigrams lie mostly within the sections of their meeting."""
    parts = sections.select("meeting_id", F.col("sec_ord").cast("int").alias("ord"),
                            squeeze(F.coalesce("content", F.lit(""))).alias("text"))
    pieces, large = text_pool(parts, "meeting_id", [F.col("ord")], F.floor(F.col("ord") / span), sep=GAP, span=span)
    pool = pieces.select("meeting_id", F.lit(True).alias("nonblank"), char_bigrams(F.col("text")).alias("bigrams"))

    def expand(items: DataFrame) -> DataFrame:
        text = squeeze(F.concat(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
        return items.withColumn("_text", text).withColumn("_chars", F.length("_text")).withColumn(
            "bigrams", char_bigrams(F.col("_text"))).drop("_text")

    scored = pool_hits(pairs, pool, large, "meeting_id", expand=expand, ids=["qa_ord"], kinds=["bigrams"])
    redundant = ((F.col("_chars") >= REDUNDANT_MIN_CHARS) & (F.size("bigrams") > 0)
                 & (F.col("bigrams_hits") / F.greatest(F.size("bigrams"), F.lit(1)) >= threshold))
    return scored.where(~redundant).select(pairs.columns)
