"""Documents as ordered lines, and their assembly.

A renderer returns rows ``meeting_id, part, ord, text``: the document is the
texts in order, joined by newlines. ``assemble`` turns them into one row per
document, which must fit into a row; ``laid_out`` gives each line its place in a
document of any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import asker_label, valid_timerange
from .glossary import hit_summary
from .ordered import SPAN, large_keys, numbered, ordered_concat, ordinal_bucket, running_sum

# Lines of a piece of the order, as a power of two.
PIECE_SHIFT = 16
# Fixed values of the documents.
TITLE, EMPTY = "# 会议纪要\n", "（无内容）"
QA_HEADING = "---\n\n## Q&A 环节\n"
REVIEW_TITLE, TOPICS_HEADING = "\n# 校验稿\n", "## 主题要点\n"
TERM_HEADING = "## 术语纠错\n"
HIT_KINDS = (("exact", "已自动纠正", "术语表精确命中，确定性替换"),
             ("variant", "疑似同音错写", "混淆集扩展命中，仅提示未改动正文"),
             ("phonetic", "疑似音近错词", "拼音近似，仅提示未改动正文"))


@dataclass(frozen=True)
class TemplateSection:
    title: str
    prompt: str = ""


@dataclass(frozen=True)
class Template:
    name: str
    description: str = ""
    sections: tuple[TemplateSection, ...] = ()


def _line(df: DataFrame, part: int, ordinal: Column | str | int, text: Column) -> DataFrame:
    ordinal = F.lit(ordinal) if isinstance(ordinal, int) else F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return df.select("meeting_id", F.lit(part).alias("part"), ordinal.cast("long").alias("ord"), text.alias("text"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _meetings(*frames: DataFrame) -> DataFrame:
    return _union([f.select("meeting_id").distinct() for f in frames]).distinct()


def assemble(lines: DataFrame) -> DataFrame:
    """``meeting_id, text``: the lines of each document in order, joined by newlines."""
    return ordered_concat(lines, ["meeting_id"], [F.col("part"), F.col("ord")], F.col("text"), sep="\n")


def laid_out(lines: DataFrame) -> DataFrame:
    """``meeting_id, text_start, text``: where in its document each line starts, in characters.

    The documents as ``assemble`` makes them, without being put together: a document
    may have any number of lines. All lines lie in one order that is cut at
    any place, and starts are summed by pieces of it first.
    """
    placed = numbered(lines, [F.col("meeting_id"), F.col("part"), F.col("ord")])
    ends = running_sum(placed, ["meeting_id"], [F.col("g")], F.length("text") + 1, bucket=F.shiftright("g", PIECE_SHIFT), out="_end")
    return ends.select("meeting_id", (F.col("_end") - F.length("text") - 1).alias("text_start"), "text")


def _numbered(sections: DataFrame, span: int = SPAN) -> DataFrame:
    large = large_keys(sections, ["meeting_id"], span)
    return running_sum(sections, ["meeting_id"], [F.col("sec_ord")], F.lit(1),
                       bucket=None if large is None else ordinal_bucket("sec_ord", span), out="number")


def _refs(citations: Column) -> Column:
    shown = F.concat(F.lit(" "), F.array_join(F.transform(citations, lambda c: F.concat(F.lit("("), c, F.lit(")"))), " "))
    return F.when(F.size(citations) > 0, shown).otherwise("")


def _or_empty(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", EMPTY).otherwise(c)


def _pair_lines(pairs: DataFrame, first_part: int) -> list[DataFrame]:
    answer = F.when(F.coalesce("answer", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n  - "), "answer"))
    head = F.concat(F.lit("- **"), asker_label(F.col("asker"), F.col("asker_role")), F.lit("**："), "question", answer, F.lit("\n"))
    return [_line(pairs.select("meeting_id").distinct(), first_part, 0, F.lit(QA_HEADING)),
            _line(pairs, first_part + 1, "qa_ord", head)]


def render_minutes(sections: DataFrame, pairs: DataFrame, report: DataFrame | None = None,
                   coverage: DataFrame | None = None, citations: DataFrame | None = None,
                   claims: DataFrame | None = None, ok_ratio: float = 0.90) -> DataFrame:
    """Numbered sections with references, questions and answers, validation report."""
    body = F.concat(F.lit("## "), F.col("number").cast("string"), F.lit(". "), "title", _refs(F.col("citations")),
                    F.lit("\n\n"), _or_empty(F.col("content")), F.lit("\n"))
    lines = [_line(_meetings(sections, pairs), 0, 0, F.lit(TITLE)),
             _line(_numbered(sections), 1, "sec_ord", body), *_pair_lines(pairs, 2)]
    if report is not None:
        lines += _report_lines(report, coverage, citations, claims, ok_ratio)
    return _union(lines)


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def _report_lines(report, coverage, citations, claims, ok_ratio) -> list[DataFrame]:
    status = F.concat(F.lit("---\n\n## 事实校验报告\n\n- **校验状态**："),
                      F.when(F.col("verified_overall"), "[通过]").otherwise("[异常]"))
    checked = F.concat(F.lit("- 共检查 "), F.col("sections_checked").cast("string"), F.lit(" 个章节、"),
                       F.col("qa_pairs_checked").cast("string"), F.lit(" 个问答\n"))
    lines = [_line(report, 4, 0, status), _line(report, 6, 0, checked)]
    if coverage is None:
        lines.append(_line(report, 5, 0, F.concat(F.lit("- **置信度**："), _percent(F.col("confidence_score")))))
    else:
        covered = F.col("total_chunks") - F.col("uncovered_chunks")
        snippets = F.array_join(F.transform("uncovered", lambda s: F.concat(
            F.lit('\n  - "'), s, F.lit('"'))), "")
        warning = F.when(F.col("ok"), "").otherwise(F.concat(
            F.lit(f"\n- ⚠️ 覆盖率低于阈值 {ok_ratio * 100:.0f}%，可能存在内容遗漏，请核对以下未覆盖片段："), snippets))
        lines.append(_line(coverage.join(report.select("meeting_id"), "meeting_id", "left_semi"), 5, 0, F.concat(
            F.lit("- **内容覆盖率**："), _percent(F.col("ratio")), F.lit("（"), covered.cast("string"), F.lit("/"),
            F.col("total_chunks").cast("string"), F.lit(" 段被提取内容覆盖）"), warning)))
    if citations is not None:
        cite = F.concat(F.lit("`"), "citation", F.lit("`"))
        text = F.when(~F.col("valid"), F.concat(F.lit("- [无效] "), cite, F.lit(" 引用格式不识别"))).when(
            F.coalesce("content", F.lit("")) == "", F.concat(F.lit("- [通过] "), cite, F.lit("（来源标记）"))).otherwise(
            F.concat(F.lit("- [通过] "), cite, F.lit(" 对应原文："), "content"))
        ends = citations.select("meeting_id").distinct()
        lines += [_line(ends, 7, 0, F.lit("### 引用检查")),
                  _line(citations, 8, F.col("sec_ord").cast("long") * (1 << 31) + F.col("cit_ord"), text), _line(ends, 9, 0, F.lit(""))]
    if claims is not None:
        text = F.concat(F.lit("- [待确认] ["), "claim_type", F.lit("] "), "title", F.lit("："), "issue", F.lit('（"'),
                        "claim_snippet", F.lit('"）'))
        ends = claims.select("meeting_id").distinct()
        kind = F.when(F.col("claim_type") == "section", 0).otherwise(1).cast("long")
        lines += [_line(ends, 10, 0, F.lit("### 无来源声明")),
                  _line(claims, 11, kind * (1 << 32) + F.col("ord"), text), _line(ends, 12, 0, F.lit(""))]
    return lines


def minutes_to_json(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines of one JSON document per meeting: sections and pairs, one item a line."""
    def items(df: DataFrame, part: int, ordinal: str, fields: Sequence[str]) -> list[DataFrame]:
        json = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        first = df.groupBy("meeting_id").agg(F.min(ordinal).alias("_first"))
        led = df.join(first, "meeting_id")
        return [_line(led, part, ordinal, F.concat(F.when(F.col(ordinal) == F.col("_first"), "").otherwise(","), json))]

    every = _meetings(sections, pairs)
    return _union([
        _line(every, 0, 0, F.lit('{"sections":[')),
        *items(sections, 1, "sec_ord", ["title", "content", "citations"]),
        _line(every, 2, 0, F.lit('],"qa_pairs":[')),
        *items(pairs, 3, "qa_ord", ["question", "answer", "asker", "asker_role", "timerange"]),
        _line(every, 4, 0, F.lit("]}"))])


def render_review(sections: DataFrame, pairs: DataFrame, term_report: DataFrame | None = None) -> DataFrame:
    """Review draft: front matter (JSON, a YAML subset), topics, pairs, term report lines."""
    every = _meetings(sections, pairs)
    front = minutes_to_json(sections, pairs).withColumn("part", F.col("part") + 1)
    topic = F.concat(F.when(F.coalesce("title", F.lit("")) == "", "").otherwise(F.concat(F.lit("### "), "title", F.lit("\n"))),
                     _or_empty(F.col("content")), F.lit("\n"))
    time = valid_timerange(F.col("timerange"))
    answer = F.when(F.coalesce("answer", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n**A**："), "answer"))
    asked = F.concat(F.coalesce(F.concat(F.lit("["), time, F.lit("]\n\n")), F.lit("")), F.lit("**Q**："), "question",
                     answer, F.lit("\n"))
    lines = [_line(every, 0, 0, F.lit("---")), front, _line(every, 6, 0, F.lit("---")),
             _line(every, 7, 0, F.lit(REVIEW_TITLE)),
             _line(sections.select("meeting_id").distinct(), 8, 0, F.lit(TOPICS_HEADING)),
             _line(sections, 9, "sec_ord", topic), _line(pairs, 10, "qa_ord", asked)]
    if term_report is not None:
        lines += [_line(term_report.select("meeting_id").distinct(), 11, 0, F.lit("---\n")),
                  term_report.withColumn("part", F.col("part") + 12)]
    return _union(lines)


def match_template_sections(template: Template, sections: DataFrame) -> DataFrame:
    """Best section of each meeting for each template section.

    Equal titles win, then containment either way, then order. The template
    travels as literals; the choice is an arg-min that combines map-side.
    """
    wanted = F.array(*[F.struct(F.lit(i).alias("tmpl_ord"), F.lit(s.title).alias("tmpl_title"))
                       for i, s in enumerate(template.sections)])
    near = F.filter(wanted, lambda t: F.contains(F.col("title"), t["tmpl_title"]) | F.contains(t["tmpl_title"], F.col("title")))
    pairs = sections.select("meeting_id", "sec_ord", "title", "content", "citations", F.explode(near).alias("t"))
    rank = F.struct((F.col("t.tmpl_title") != F.col("title")).alias("inexact"), "sec_ord")
    return pairs.groupBy("meeting_id", F.col("t.tmpl_ord").alias("tmpl_ord"), F.col("t.tmpl_title").alias("tmpl_title")).agg(
        F.min_by(F.struct("sec_ord", "title", "content", "citations"), rank).alias("s")).select(
        "meeting_id", "tmpl_ord", "tmpl_title", "s.*")


def render_formal(template: Template, sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Final draft in template order; unmatched sections stay, ``×`` references do not."""
    every = _meetings(sections, pairs)
    slots = every.select("meeting_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("tmpl_ord"), F.lit(s.title).alias("tmpl_title"))
        for i, s in enumerate(template.sections)])).alias("t")).select("meeting_id", "t.*")
    matched = match_template_sections(template, sections).drop("tmpl_title")
    filled = slots.join(matched, ["meeting_id", "tmpl_ord"], "left")
    shown = F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda c: ~c.startswith("×"))
    text = F.concat(F.lit("## "), (F.col("tmpl_ord") + 1).cast("string"), F.lit(". "), "tmpl_title", _refs(shown),
                    F.lit("\n\n"), _or_empty(F.col("content")), F.lit("\n"))
    lines = [_line(every, 0, 0, F.lit(f"# {template.description or '会议纪要'}\n")), _line(filled, 1, "tmpl_ord", text)]
    titles = " ".join(s.title for s in template.sections)
    if "Q&A" in titles or "问答" in titles:
        lines += _pair_lines(pairs, 2)
    return _union(lines)


def render_term_report(hits: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Corrections and warnings per kind, grouped by what was written.

    The first group of a kind brings the headings, the last one the remainder
    line, so the hits are read once.
    """
    rank, heading, arrow = F, F, F
    for n, (kind, title, note) in enumerate(HIT_KINDS):
        here = F.col("kind") == kind
        rank = rank.when(here, n)
        heading = heading.when(here, F.concat(
            F.lit(f"**{title} "), F.col("kind_hits").cast("string"), F.lit(f" 处**（{note}）\n")))
        arrow = arrow.when(here, "` → **" if kind == "exact" else "` 疑似 **")
    summary = hit_summary(hits, max_groups=max_groups).withColumn("rank", rank).where("rank IS NOT NULL")
    meeting, of_kind = Window.partitionBy("meeting_id"), Window.partitionBy("meeting_id", "kind")
    placed = summary.withColumns({"first_rank": F.min("rank").over(meeting), "last": F.max("group_ord").over(of_kind)})
    count = F.when(F.col("hits") > 1, F.concat(F.lit("（"), F.col("hits").cast("string"), F.lit(" 处）"))).otherwise("")
    opens, closes = F.col("group_ord") == 1, F.col("group_ord") == F.col("last")
    lines = F.array_compact(F.array(
        F.when(opens & (F.col("rank") == F.col("first_rank")), TERM_HEADING),
        F.when(opens, heading),
        F.concat(F.lit("- `"), "matched", arrow, "term", F.lit("**"), count, F.lit("　"), "context"),
        F.when(closes & (F.col("more_groups") > 0), F.concat(
            F.lit("- …… 另有 "), F.col("more_groups").cast("string"), F.lit(" 类"))),
        F.when(closes, "")))
    return placed.select("meeting_id", F.col("rank").alias("part"), "group_ord", F.posexplode(lines).alias("i", "text")).select(
        "meeting_id", "part", (F.col("group_ord").cast("long") * 8 + F.col("i")).alias("ord"), "text")
