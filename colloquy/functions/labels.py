"""Topic titles, asker roles, time ranges and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TIME_OF_DAY, WS, strip

# ---------------------------------------------------------------- fixed values
LEADING_ORDINAL = ("^(?:\\p{Nd}+[\\.、）)]" + WS + "*|（\\p{Nd}+）" + WS + "*"
                   "|[一二三四五六七八九十]+[、.．]?" + WS + "*)")
INTERVIEWER, INTERVIEWEE = "interviewer", "interviewee"
ROLE_ALIASES = {
    INTERVIEWER: ("interviewer", "asker", "investor", "访谈", "提问", "投资方", "投资人",
                  "买方", "调研", "尽调", "调研方", "访谈方", "访谈者"),
    INTERVIEWEE: ("interviewee", "answerer", "company", "项目方", "企业方", "公司方",
                  "被访", "受访", "回答方", "创始人", "管理层", "路演方"),
}
UNKNOWN_ROLES = ("unknown", "none", "null", "无", "未知", "不确定")
ROLE_LABELS = {INTERVIEWER: "访谈方", INTERVIEWEE: "项目方"}
NO_ASKER = "（未指明）"
CLOCK = "\\p{Nd}{1,2}:\\p{Nd}{2}(?::\\p{Nd}{2})?"
TIME_RANGE = "(?d)^" + CLOCK + "(?:" + WS + "*[-~～至]" + WS + "*" + CLOCK + ")?$"
UNTITLED = "未命名"


def normalize_topic(c: Column) -> Column:
    """Title without its leading ordinal."""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), LEADING_ORDINAL, ""))


def topics_similar(a: Column, b: Column) -> Column:
    """Equal or one contains the other, after normalisation; empty never matches."""
    a, b = normalize_topic(a), normalize_topic(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def normalize_asker_role(c: Column, longest_alias: bool = False) -> Column:
    """Role named by a free-text description; '' when it is not recognised.

    The interviewer aliases are tried first, so 被访谈方 counts as interviewer.
    ``longest_alias=True`` tries the interviewee aliases first instead.
    """
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    order = [INTERVIEWEE, INTERVIEWER] if longest_alias else [INTERVIEWER, INTERVIEWEE]
    expr = F.when((text == "") | text.isin(*UNKNOWN_ROLES), "")
    for role in order:
        expr = expr.when(text.rlike("|".join(ROLE_ALIASES[role])), role)
    return expr.otherwise("")


def asker_label(asker: Column, role: Column) -> Column:
    """Name, else the role's label, else （未指明）."""
    name = strip(F.coalesce(asker, F.lit("")))
    label = F
    key = strip(F.coalesce(role, F.lit("")))
    for r, text in ROLE_LABELS.items():
        label = label.when(key == r, text)
    return F.when(name != "", name).otherwise(label.otherwise(NO_ASKER))


def valid_timerange(c: Column) -> Column:
    """The trimmed value if it is a clock time or a range of two, else NULL."""
    t = strip(c)
    return F.when(t.rlike(TIME_RANGE), t)


def citation_parse(c: Column, style: Column) -> Column:
    """Typed citation: ``kind`` is timestamp, paragraph, line, unknown or invalid.

    Matching is by prefix, as a citation may carry trailing text.
    """
    def num(pattern: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast("int")

    def typed(kind: str, ordinal: Column, first: Column, last: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ordinal.cast("int").alias("ordinal"),
                        first.cast("string").alias("ts_start"), last.cast("string").alias("ts_end"))

    none = F.lit(None)
    ts_range = f"^({TIME_OF_DAY})-({TIME_OF_DAY})"
    ts_one = f"^({TIME_OF_DAY})"
    timestamp = (
        F.when(c.rlike(ts_range), typed("timestamp", none, F.regexp_extract(c, ts_range, 1),
                                        F.regexp_extract(c, ts_range, 2)))
        .when(c.rlike(ts_one), typed("timestamp", none, F.regexp_extract(c, ts_one, 1), none))
        .otherwise(typed("invalid", none, none, none)))
    paragraph = (
        F.when(c.rlike("^§\\p{Nd}+"), typed("paragraph", num("^§(\\p{Nd}+)"), none, none))
        .when(c.rlike("^[Ll]\\p{Nd}+"), typed("line", num("^[Ll](\\p{Nd}+)"), none, none))
        .when(c.rlike("^×\\p{Nd}+"), typed("unknown", num("^×(\\p{Nd}+)"), none, none))
        .otherwise(typed("invalid", none, none, none)))
    return F.when(style == "timestamp", timestamp).otherwise(paragraph)
