"""Prompt tables, model hook and result import.

The model itself is not part of the library: prompts are rows, a caller's
function turns them into answers, and answers come back as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.model_output import parse_model_result
from .chunking import SECONDARY_BOUNDARIES, SENTENCE_BOUNDARIES, chunk_bounds, chunk_text
from .factcheck import coverage_report
from .glossary import Term
from .ordered import ordered_concat, settle

# Formats and limits.
NONE = "（无）"
RULE = ("- 当出现「", "」时，应纠正为「", "」（", "）")
BACKGROUND_LABELS = (("公司", "company"), ("行业", "industry"), ("参与者", "participants"), ("会议目的", "meeting_purpose"))
CONSENSUS_LABEL = "已知共识"
DEFAULT_BACKGROUND = {"company": "访谈对象", "industry": "未知", "participants": "访谈方与被访谈方",
                      "meeting_purpose": "调研访谈"}
HOTWORD_LEAD, HOTWORD_LIMIT = "本次访谈涉及以下专有名词，请准确转写：", 180
REWRITE_CHARS, QA_CHARS, REWRITE_OVERLAP, QA_OVERLAP = 4000, 8000, 200, 400
GLOSSARY_CHARS = 8000
COVERAGE_THRESHOLD = 0.80

# Prompt wording of this library; {…} are filled from columns.
KEEP_TIME = "相对时间（去年、本季度、下周等）照抄原文，不得换算成具体日期。"
PAIR_SHAPE = '{"qa_pairs": [{"question": "", "answer": "", "asker": "", "asker_role": "interviewer|interviewee|unknown", "timerange": ""}]}'
SECTION_SHAPE = '{"sections": [{"title": "", "content": ""}]}'
BLOCK_SHAPE = '[{"type": "narration|qa|mixed", "topic": "", "text": ""}]'
BOTH_SHAPE = SECTION_SHAPE[:-1] + ", " + PAIR_SHAPE[1:]
CONTEXT = "背景：\n{background}\n\n日期：{today}\n\n术语：\n{rules}\n\n"
TEMPLATES = {
    "rewrite": "将下面的转录片段改写为书面语，按话题分块，保留全部数字与事实。" + KEEP_TIME + "\n\n" + CONTEXT
               + "只输出 JSON：" + BLOCK_SHAPE + "\n\n片段：\n{text}",
    "block": "将下面的转录片段按话题分块，保留全部数字与事实。" + KEEP_TIME + "\n\n日期：{today}\n\n只输出 JSON："
             + BLOCK_SHAPE + "\n\n片段：\n{text}",
    "qa": "从下面的转录中按时间顺序提取全部问答。" + KEEP_TIME + "{type_note}\n\n" + CONTEXT + "只输出 JSON："
          + PAIR_SHAPE + "\n\n转录：\n{text}",
    "export_qa": "整理校验稿：提取全部问答。" + KEEP_TIME + "\n只输出 JSON：" + PAIR_SHAPE + "\n\n" + CONTEXT + "转录全文：\n{text}",
    "export_speech": "整理校验稿：按话题归纳陈述。" + KEEP_TIME + "\n只输出 JSON：" + SECTION_SHAPE + "\n\n" + CONTEXT + "转录全文：\n{text}",
    "export_both": "整理校验稿：陈述归入话题，问答单列。" + KEEP_TIME + "\n只输出 JSON：" + BOTH_SHAPE + "\n\n" + CONTEXT + "转录全文：\n{text}",
    "final": "依据下列问答与主题要点撰写成品稿，逐条保留。" + KEEP_TIME + "\n\n日期：{today}\n\n内容：\n{text}",
    "debug": "下列片段尚未被纪要覆盖，请补入现有内容并输出完整 JSON。\n\n现有内容：\n{current}\n\n未覆盖片段：\n{text}",
    "glossary": "从下面的材料中提取术语（term、context、corrections），只输出 YAML。\n\n材料：\n{text}",
}
TYPE_NOTES = {"narration": "以陈述为主，只取明确的问答。", "qa": "以问答为主，不得遗漏。"}


def rules_text(terms: Sequence[Term]) -> str:
    """Correction rules of a driver-side glossary."""
    lines = [f"{RULE[0]}{'、'.join(t.corrections)}{RULE[1]}{t.term}{RULE[2]}{t.context}{RULE[3]}"
             for t in terms if t.corrections]
    return "\n".join(lines) or NONE


def glossary_rules(glossary: DataFrame) -> DataFrame:
    """Correction rules per ``glossary_id``; （无） where no term has corrections."""
    line = F.concat(F.lit(RULE[0]), F.array_join("corrections", "、"), F.lit(RULE[1]), "term", F.lit(RULE[2]),
                    F.coalesce("context", F.lit("")), F.lit(RULE[3]))
    lines = glossary.withColumn("_line", F.when(F.size("corrections") > 0, line))
    joined = ordered_concat(lines, ["glossary_id"], [F.col("term_ord")], F.col("_line"), sep="\n", out="rules")
    return joined.withColumn("rules", F.when(F.col("rules") == "", NONE).otherwise(F.col("rules")))


def background_text(df: DataFrame) -> DataFrame:
    """``background``: one labelled line per non-empty field, then one per consensus item."""
    fields = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}："), c)) for label, c in BACKGROUND_LABELS]
    agreed = F.transform(F.coalesce("known_consensus", F.array().cast("array<string>")),
                         lambda x: F.concat(F.lit(f"{CONSENSUS_LABEL}："), x))
    text = F.array_join(F.concat(F.array_compact(F.array(*fields)), agreed), "\n")
    return df.select("meeting_id", F.when(text == "", NONE).otherwise(text).alias("background"))


def hotword_prompt(glossary: DataFrame, limit: int = HOTWORD_LIMIT) -> DataFrame:
    """Decoder hint per glossary: distinct terms in order, up to the first that overflows.

    A word costs its length and a separator, so only so many can ever fit;
    that rank limit applies before the shuffle.
    """
    budget = limit - len(HOTWORD_LEAD) - 1
    words = (
        glossary.select("glossary_id", strip(F.coalesce("term", F.lit(""))).alias("word"), "term_ord")
        .where("word <> ''").groupBy("glossary_id", "word").agg(F.min("term_ord").alias("ord")))
    by = Window.partitionBy("glossary_id").orderBy("ord")
    few = words.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= budget // 2 + 1)
    used = F.sum(F.length("word") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    picked = few.withColumn("_used", used).where(F.col("_used") <= budget)
    items = F.array_sort(F.collect_list(F.struct("ord", "word")))
    return picked.groupBy("glossary_id").agg(items.alias("_w")).select("glossary_id", F.concat(
        F.lit(HOTWORD_LEAD), F.array_join(F.transform("_w", lambda x: x["word"]), "、"), F.lit("。")).alias("prompt"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate literal stretches and columns; only names in ``values`` are places."""
    pieces, rest = [], template
    while rest:
        places = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        if not places:
            pieces.append(F.lit(rest))
            break
        at = min(places)
        pieces += [F.lit(rest[:at]), values[places[at]]]
        rest = rest[at + len(places[at]) + 2:]
    return F.concat(*pieces)


def build_prompts(df: DataFrame, kind: str, as_of: date, terms: Sequence[Term] = (),
                  backgrounds: DataFrame | None = None, transcript_type: str = "qa",
                  boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES) -> DataFrame:
    """Prompt rows of one kind for ``meeting_id, text`` (``debug`` also needs ``current``).

    Long texts of the model kinds are cut into chunks, one prompt each. The
    date is an argument; nothing depends on when the job runs.
    """
    sizes = {"rewrite": (REWRITE_CHARS, REWRITE_OVERLAP), "block": (REWRITE_CHARS, REWRITE_OVERLAP),
             "qa": (QA_CHARS, QA_OVERLAP), "glossary": (GLOSSARY_CHARS, QA_OVERLAP)}
    if kind in sizes:
        rows = chunk_text(df, "text", *sizes[kind], boundaries).withColumnRenamed("chunk", "text")
    else:
        rows = df.withColumn("chunk_ord", F.lit(0))
    if backgrounds is not None:
        rows = rows.join(background_text(backgrounds), "meeting_id", "left")
        background = F.coalesce("background", F.lit(_default_background()))
    else:
        background = F.lit(_default_background())
    values = {"background": background, "today": F.lit(f"{as_of.year}年{as_of.month}月{as_of.day}日"),
              "rules": F.lit(rules_text(terms)), "type_note": F.lit(TYPE_NOTES.get(transcript_type, "")),
              "text": F.col("text")}
    if kind == "debug":
        values["current"] = F.col("current")
    return rows.select(
        F.concat_ws(":", "meeting_id", F.lit(kind), "chunk_ord").alias("prompt_id"), "meeting_id", "chunk_ord",
        F.lit(kind).alias("kind"), _fill(TEMPLATES[kind], values).alias("prompt"))


def _default_background() -> str:
    return "\n".join(f"{label}：{DEFAULT_BACKGROUND[c]}" for label, c in BACKGROUND_LABELS)


def estimate_calls(df: DataFrame, fmt: str = "qa", qa_chars: int = QA_CHARS, rewrite_chars: int = REWRITE_CHARS,
                   text: str = "text",
                   boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES) -> DataFrame:
    """Model calls each transcript needs; the chunks are counted, not cut."""
    qa = F.size(chunk_bounds(F.col(text), qa_chars, QA_OVERLAP, boundaries))
    speech = F.size(chunk_bounds(F.col(text), rewrite_chars, REWRITE_OVERLAP, boundaries))
    calls = {"qa": qa, "speech": speech, "both": qa + speech}[fmt]
    return df.select("meeting_id", F.greatest(calls, F.lit(1)).alias("calls"))


# ----------------------------------------------------------------- model hook
def generate(prompts: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Answers of ``fn`` to every prompt; an exception becomes the row's ``error``."""
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    results.append(fn(prompt))
                    errors.append(None)
                except Exception as e:  # the caller's model may fail in any way
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[["prompt_id", "meeting_id", "chunk_ord"]].assign(result=results, error=errors)

    types = dict(prompts.dtypes)
    schema = (f"prompt_id string, meeting_id {types['meeting_id']}, chunk_ord {types['chunk_ord']}, "
              "result string, error string")
    return prompts.select("prompt_id", "meeting_id", "chunk_ord", "prompt").mapInPandas(answer, schema)


def echo(prompt: str) -> str:
    """Deterministic stand-in for a model: the prompt's last part as one section."""
    import json

    return json.dumps({"sections": [{"title": "echo", "content": prompt.rsplit("：\n", 1)[-1]}]}, ensure_ascii=False)


def failed_meetings(answers: DataFrame) -> DataFrame:
    """Meetings every prompt of which failed; a single failed chunk is only skipped."""
    return answers.groupBy("meeting_id").agg(
        F.count_if(F.col("error").isNull()).alias("answered"), F.max("error").alias("error")
    ).where("answered = 0").select("meeting_id", "error")


def import_results(transcripts: DataFrame, results: DataFrame, as_of: date,
                   ok_ratio: float = COVERAGE_THRESHOLD,
                   boundaries: Sequence[str] = SENTENCE_BOUNDARIES + SECONDARY_BOUNDARIES):
    """Minutes, coverage and follow-up prompts of imported results.

    ``results`` has ``meeting_id, result``. Only transcripts with a result are
    checked; those below the ratio get a prompt with what is missing.
    """
    sections, pairs = parse_model_result(results)
    checked = transcripts.join(results.select("meeting_id").distinct(), "meeting_id", "left_semi")
    coverage = settle(coverage_report(checked, sections, pairs, ok_ratio, boundaries))
    missing = F.array_join(F.transform("uncovered", lambda x, i: F.concat(
        F.lit("片段"), (i + 1).cast("string"), F.lit("：\n"), x)), "\n\n")
    short = coverage.where("NOT ok").select("meeting_id", missing.alias("text")).join(
        results.select("meeting_id", F.col("result").alias("current")), "meeting_id")
    return sections, pairs, coverage, build_prompts(short, "debug", as_of)
