"""Verify minutes against their transcript: citations, claims, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import citation_parse
from ..functions.text import TIME_OF_DAY, is_blank, let, strip
from ..functions.tokens import match_tokens, normalize_match, number_tokens
from .chunking import SECONDARY_BOUNDARIES, SENTENCE_BOUNDARIES, chunk_text
from .containment import POOL_SPAN, mend_seams, pool_hits, text_pool

# Fixed values of the coverage score.
COVERAGE_CHUNK, COVERAGE_OVERLAP = 1000, 100
COVERED_FROM = 0.5
OK_RATIO = 0.90
MIN_SCORED = 10
NO_SOURCE, EMPTY_NO_SOURCE = "无引用来源", "内容为空且无引用"


# ------------------------------------------------------------------ citations
def _looked_up(asked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``meeting_id, kind, ref, content`` of what ``asked`` (meeting_id, kind, ordinal, ref) points at.

    The different references of a meeting meet its transcript once and are looked
    up inside the row; transcripts that nothing cites stay out. A clock time
    points at the first line that holds it, overlapping times included.
    """
    refs = asked.groupBy("meeting_id").agg(F.collect_set(F.struct("kind", "ordinal", "ref")).alias("refs"))

    def content(shelf: Column, r: Column) -> Column:
        timed = F.filter(shelf["lines"], lambda x: F.contains(x, r["ref"]) & F.array_contains(
            F.regexp_extract_all(x, F.lit(f"(?=({TIME_OF_DAY}))"), F.lit(1)), r["ref"]))
        return (F.when(r["kind"] == "line", strip(F.get(shelf["lines"], r["ordinal"] - 1)))
                .when(r["kind"] == "paragraph", F.get(shelf["paragraphs"], r["ordinal"] - 1))
                .otherwise(strip(F.get(timed, F.lit(0)))))

    lines = F.split("text", "\n")
    paragraphs = let(F.filter(F.transform(F.split("text", "\n\n"), strip), lambda p: p != ""),
                     lambda p: F.when(F.size(p) > 0, p).otherwise(F.transform(lines, strip)))
    shelf = F.struct(lines.alias("lines"), paragraphs.alias("paragraphs"))
    found = let(shelf, lambda s: F.transform("refs", lambda r: F.struct(r["kind"].alias("kind"), r["ref"].alias("ref"), content(s, r).alias("content"))))
    return refs.join(transcripts.select("meeting_id", "text"), "meeting_id").select("meeting_id", F.explode(found).alias("f")).select(
        "meeting_id", "f.kind", "f.ref", "f.content")


def check_citations(sections: DataFrame, transcripts: DataFrame, styles: DataFrame | None = None,
                    style: str = "paragraph") -> DataFrame:
    """Resolve every citation; ``styles`` (meeting_id, citation_style) overrides ``style``.

    A recognised timestamp is valid whether or not the transcript holds it;
    ``found`` says if it does. ``×n`` is valid without any look-up.
    """
    cited = sections.select("meeting_id", "sec_ord", F.posexplode("citations").alias("cit_ord", "citation"))
    if styles is not None:
        cited = cited.join(styles, "meeting_id", "left")
        chosen = F.coalesce(F.col("citation_style"), F.lit(style))
    else:
        chosen = F.lit(style)
    parsed = cited.withColumn("_p", citation_parse(F.col("citation"), chosen)).select(
        "meeting_id", "sec_ord", "cit_ord", "citation", F.col("_p.kind").alias("kind"),
        F.col("_p.ordinal").alias("ordinal"),
        F.coalesce("_p.ts_start", F.col("_p.ordinal").cast("string")).alias("ref"))
    # Citations that refer to nothing skip the join: as one key they would pile up in one task.
    refers = F.col("kind").isin("timestamp", "paragraph", "line")
    asked = parsed.where(refers)
    looked_up = asked.join(_looked_up(asked, transcripts), ["meeting_id", "kind", "ref"], "left")
    resolved = looked_up.unionByName(
        parsed.where(~refers).withColumn("content", F.lit(None).cast("string")).select(looked_up.columns))
    kind = F.col("kind")
    hit = F.col("content").isNotNull()
    return resolved.select(
        "meeting_id", "sec_ord", "cit_ord", "citation",
        F.when(kind.isin("paragraph", "line"), F.col("ordinal")).when(kind == "unknown", 0)
        .otherwise(-1).alias("line_index"),
        F.when(kind == "unknown", "").when(kind == "timestamp", F.coalesce("content", F.lit("")))
        .otherwise(F.col("content")).alias("content"),
        (kind.isin("timestamp", "unknown") | (kind.isin("paragraph", "line") & hit)).alias("valid"),
        hit.alias("found"))


# --------------------------------------------------------------------- claims
def unsupported_claims(sections: DataFrame, qa_pairs: DataFrame) -> DataFrame:
    """Sections without a citation and every non-blank question-answer pair, with their whole texts."""
    content = F.coalesce("content", F.lit(""))
    bare = sections.where(F.coalesce(F.size("citations"), F.lit(0)) < 1).select(
        "meeting_id", F.col("sec_ord").alias("ord"), content.alias("claim_snippet"),
        F.lit("section").alias("claim_type"), "title",
        F.when(content == "", EMPTY_NO_SOURCE).otherwise(NO_SOURCE).alias("issue"))
    text = strip(F.concat("question", F.lit(" "), "answer"))
    pairs = qa_pairs.where(text != "").select(
        "meeting_id", F.col("qa_ord").alias("ord"), text.alias("claim_snippet"),
        F.lit("qa_pair").alias("claim_type"),
        F.concat(F.lit("Q: "), "question").alias("title"),
        F.lit(NO_SOURCE).alias("issue"))
    return bare.unionByName(pairs)


# ------------------------------------------------------------------- coverage
def _pool_parts(sections: DataFrame, qa_pairs: DataFrame) -> DataFrame:
    """Texts of the minutes in reading order: section contents, then questions and answers."""
    def part(df: DataFrame, kind: int, ordinal: str, sub: int, text: str) -> DataFrame:
        return df.select("meeting_id", F.lit(kind).alias("kind"), F.col(ordinal).cast("int").alias("ord"),
                         F.lit(sub).alias("sub"), F.coalesce(text, F.lit("")).alias("text"))

    return (part(sections, 0, "sec_ord", 0, "content")
            .unionByName(part(qa_pairs, 1, "qa_ord", 0, "question"))
            .unionByName(part(qa_pairs, 1, "qa_ord", 1, "answer")))


def _scored_chunks(transcripts: DataFrame, sections: DataFrame, qa_pairs: DataFrame,
                   boundaries: Sequence[str], span: int) -> DataFrame:
    parts = _pool_parts(sections, qa_pairs)
    order = [F.col("kind"), F.col("ord"), F.col("sub")]
    cut = F.col("kind").cast("long") * (1 << 40) + F.floor(F.col("ord") / span)
    pieces, large = text_pool(parts, "meeting_id", order, cut, sep="\n", span=span)
    flagged = pieces.withColumn("nonblank", ~is_blank(F.col("text")))
    if large is not None:  # tokens that cross a cut are mended in normalized text
        flagged = mend_seams(flagged.withColumn("text", normalize_match(F.col("text"))), large, "meeting_id")
    pool = flagged.withColumn("_m", match_tokens(F.col("text"))).select(
        "meeting_id", "nonblank", F.col("_m.pairs").alias("bigrams"), number_tokens(F.col("_m.norm")).alias("numbers"))

    def expand(items: DataFrame) -> DataFrame:
        chunks = chunk_text(items, "text", COVERAGE_CHUNK, COVERAGE_OVERLAP, boundaries)
        return (chunks.withColumn("_m", match_tokens(F.col("chunk")))
                .withColumn("norm_length", F.length("_m.norm"))
                .withColumn("bigrams", F.col("_m.pairs"))
                .withColumn("numbers", number_tokens(F.col("_m.norm"))).drop("_m"))

    scored = pool_hits(transcripts.select("meeting_id", "text"), pool, large, "meeting_id",
                       expand=expand, ids=["chunk_ord"], kinds=["bigrams", "numbers"])

    def ratio(kind: str, when_empty: float) -> Column:
        size = F.size(kind)
        return F.when(size == 0, F.lit(when_empty)).otherwise(F.col(f"{kind}_hits") / size)

    score = (F.when(~F.col("in_pool"), F.lit(0.0)).when(F.col("norm_length") < MIN_SCORED, F.lit(1.0))
             .otherwise(F.greatest(ratio("bigrams", 1.0), ratio("numbers", 0.0))))
    return scored.select("meeting_id", "chunk_ord", "chunk", "in_pool", (~is_blank(F.col("chunk"))).alias("counted"),
                         score.alias("score"))


def coverage_chunks(transcripts: DataFrame, sections: DataFrame, qa_pairs: DataFrame,
                    boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES,
                    span: int = POOL_SPAN) -> DataFrame:
    """Score of each transcript chunk against the minutes of its meeting.

    The score is the larger of the chunk's number and bigram containment. The
    transcript is shuffled once, as text; chunks and tokens exist only after
    the join.
    """
    scored = _scored_chunks(transcripts, sections, qa_pairs, boundaries, span).where("counted")
    return scored.select("meeting_id", "chunk_ord", "chunk", "score",
                         (F.col("score") >= COVERED_FROM).alias("covered"))


def coverage_report(transcripts: DataFrame, sections: DataFrame, qa_pairs: DataFrame,
                    ok_ratio: float = OK_RATIO,
                    boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES,
                    span: int = POOL_SPAN) -> DataFrame:
    """One row per transcript: chunk counts, mean score, verdict, uncovered chunks in order."""
    scored = _scored_chunks(transcripts, sections, qa_pairs, boundaries, span)
    counted = F.col("counted")
    missed = counted & (F.col("score") < COVERED_FROM)
    ratio = F.coalesce(F.sum(F.when(counted, F.col("score"))) / F.count_if(counted), F.lit(1.0))
    missing = F.transform(F.array_sort(F.collect_list(F.when(missed, F.struct("chunk_ord", "chunk")))),
                          lambda x: x["chunk"])
    return scored.groupBy("meeting_id").agg(
        F.count_if(counted).alias("total_chunks"), F.count_if(missed).alias("uncovered_chunks"),
        ratio.alias("ratio"), (ratio >= ok_ratio).alias("ok"), missing.alias("uncovered"))


def fact_check_report(coverage: DataFrame | None, sections: DataFrame, qa_pairs: DataFrame) -> DataFrame:
    """Counts, overall verdict and confidence per meeting of the minutes.

    A meeting is verified when its coverage is fine and it has no unsupported
    claim. Confidence is the coverage ratio, or the share of sections and pairs
    without an issue where coverage is unknown.
    """
    def marks(df: DataFrame, section: int, issue: Column) -> DataFrame:
        return df.select("meeting_id", F.lit(section).alias("section"), issue.cast("int").alias("issue"))

    bare = F.coalesce(F.size("citations"), F.lit(0)) < 1
    said = strip(F.concat("question", F.lit(" "), "answer")) != ""
    counts = marks(sections, 1, bare).unionByName(marks(qa_pairs, 0, F.coalesce(said, F.lit(False)))).groupBy("meeting_id").agg(
        F.sum("section").alias("sections_checked"), F.sum(1 - F.col("section")).alias("qa_pairs_checked"),
        F.coalesce(F.sum("issue"), F.lit(0)).alias("issues"))
    if coverage is not None:
        counts = counts.join(coverage.select("meeting_id", "ratio", "ok"), "meeting_id", "full")
    else:
        counts = counts.withColumns({"ratio": F.lit(None).cast("double"), "ok": F.lit(None).cast("boolean")})
    filled = counts.na.fill(0, ["sections_checked", "qa_pairs_checked", "issues"])
    total = F.col("sections_checked") + F.col("qa_pairs_checked")
    by_issues = F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("issues") / total))
    return filled.select(
        "meeting_id", "sections_checked", "qa_pairs_checked", "issues",
        (F.coalesce("ok", F.lit(True)) & (F.col("issues") == 0)).alias("verified_overall"),
        F.when(F.col("ratio").isNull(), by_issues)
        .otherwise(F.greatest(F.lit(0.0), F.least("ratio", F.lit(1.0)))).alias("confidence_score"))
