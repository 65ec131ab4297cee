"""Semi-structured model output: results, topic blocks, review drafts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.jsontext import elements, kind, strict_json, text_field
from ..functions.labels import normalize_asker_role
from ..functions.text import WHITESPACE, WS, let, strip

# Fixed values.
WHOLE_TITLE = "内容"
DEFAULT_TYPE = "narration"
TOPICS_HEADING = "## 主题要点"
FENCED_OBJECT = "(?s)```(?:json)?" + WS + "*(\\{.*?\\})" + WS + "*```"
# A letter or bracket that opens a question or an answer; the first group holds what opens a question.
LETTER_MARK = "(?U)(?:((?<!\\w)(?:\\*\\*)?Q)|(?:\\*\\*)?A)\\d*(?:\\*\\*)?[：:]"
BRACKET_MARK = "(【问】)|【答】"
BLANK_LINE = "(?:\\r?\\n){2}"
Q_LINE, A_LINE, Q_OPEN = "(?U)^Q\\d*[：:]\\s*(.+)", "(?U)^A\\d*[：:]\\s*(.+)", "(?U)^Q\\d*[：:]\\s*"


# -------------------------------------------------------------- model results
def _has(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant").isNotNull()


def _minutes(v: Column) -> Column:
    """Struct of section and pair lists if the document is minutes, else NULL."""
    none = F.array().cast("array<variant>")

    def lists(sections: Column, pairs: Column) -> Column:
        return F.struct(F.coalesce(sections, none).alias("sections"), F.coalesce(pairs, none).alias("pairs"))

    def all_have(a: str, b: str) -> Column:
        return F.forall(elements(v), lambda x: (kind(x) == "OBJECT") & (_has(x, a) | _has(x, b)))

    field = lambda name: elements(F.try_variant_get(v, f"$.{name}", "variant"))
    return (
        F.when((kind(v) == "OBJECT") & (_has(v, "qa_pairs") | _has(v, "sections")),
               lists(field("sections"), field("qa_pairs")))
        .when((kind(v) == "ARRAY") & all_have("question", "answer"), lists(none, elements(v)))
        .when((kind(v) == "ARRAY") & all_have("title", "content"), lists(elements(v), none)))


def parse_model_result(results: DataFrame, normalize_roles: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sections and pairs of imported results (``meeting_id, result``).

    The whole text is tried as JSON, then from its first ``{`` to its last
    ``}``. Text that is neither becomes one section.
    """
    text = strip(F.coalesce("result", F.lit("")))
    greedy = F.nullif(F.regexp_extract("_t", "(?s)\\{.*\\}", 0), F.lit(""))
    whole = F.struct(
        F.array(F.to_variant_object(F.struct(F.lit(WHOLE_TITLE).alias("title"), F.col("_t").alias("content"))))
        .alias("sections"), F.array().cast("array<variant>").alias("pairs"))
    parsed = (
        results.withColumn("_t", text)
        .withColumn("_m", F.coalesce(_minutes(strict_json(F.col("_t"))), _minutes(strict_json(greedy)), whole)))
    objects = lambda name: F.filter(F.col(f"_m.{name}"), lambda x: kind(x) == "OBJECT")
    s = F.col("s")
    sections = parsed.select("meeting_id", F.posexplode(objects("sections")).alias("sec_ord", "s")).select(
        "meeting_id", "sec_ord", text_field(s, "title").alias("title"), text_field(s, "content").alias("content"),
        F.array().cast("array<string>").alias("citations"))
    role = text_field(s, "asker_role")
    pairs = parsed.select("meeting_id", F.posexplode(objects("pairs")).alias("qa_ord", "s")).select(
        "meeting_id", "qa_ord", text_field(s, "question").alias("question"), text_field(s, "answer").alias("answer"),
        text_field(s, "asker").alias("asker"),
        (normalize_asker_role(role) if normalize_roles else role).alias("asker_role"),
        text_field(s, "timerange").alias("timerange"))
    return sections, pairs


def parse_topic_blocks(responses: DataFrame) -> DataFrame:
    """Topic blocks of rewrite responses (``meeting_id, chunk_ord, response``).

    A response that yields no block becomes one narration block: nothing is lost.
    """
    text = strip(F.coalesce("response", F.lit("")))
    inner = strict_json(F.nullif(F.regexp_extract("_t", "(?s)\\[.*\\]", 0), F.lit("")))

    def block(v: Column) -> Column:
        named = strip(text_field(v, "type"))
        return F.struct(F.when(named == "", DEFAULT_TYPE).otherwise(named).alias("type"),
                        strip(text_field(v, "topic")).alias("topic"), strip(text_field(v, "text")).alias("text"))

    items = F.filter(F.transform(F.filter(elements(F.col("_v")), lambda x: kind(x) == "OBJECT"), block),
                     lambda b: b["text"] != "")
    whole = F.array(F.struct(F.lit(DEFAULT_TYPE).alias("type"), F.lit("").alias("topic"), F.col("_t").alias("text")))
    return (
        responses.withColumn("_t", text).withColumn("_v", F.coalesce(strict_json(F.col("_t")), inner))
        .withColumn("_b", let(items, lambda b: F.when(F.size(b) > 0, b)))
        .select("meeting_id", "chunk_ord", F.posexplode(F.coalesce("_b", whole)).alias("block_ord", "b"))
        .select("meeting_id", "chunk_ord", "block_ord", "b.type", "b.topic", "b.text"))


def _closed_object(text: str | None) -> str | None:
    """The object that the first brace opens, up to its last whole member, and closed.

    One walk over the members: each member that decodes moves the end on. What
    follows the last whole member is dropped and a closing brace put there; right
    after the closing brace of a member none is added.
    """
    start = -1 if text is None else text.find("{")
    if start < 0:
        return None
    decode, blanks = json.JSONDecoder().raw_decode, re.compile(r"[ \t\n\r]*")

    def skip(i: int) -> int:
        return blanks.match(text, i).end()

    whole = at = skip(start + 1)
    opener = True
    try:
        while not (opener and text[at] == "}"):
            name, at = decode(text, at)
            at = skip(at)
            if not isinstance(name, str) or text[at] != ":":
                break
            at = skip(decode(text, skip(at + 1))[1])
            if text[at - 1] != "}":
                whole = at
            opener = text[at] == "}"
            if not opener:
                if text[at] != ",":
                    break
                at = skip(at + 1)
        else:
            return text[start:at + 1]
    except (ValueError, IndexError, RecursionError):  # the text ends or breaks off inside a member
        pass
    return text[start:whole] + "}"


@F.pandas_udf(StringType())
def _json_fragment(texts: pd.Series) -> pd.Series:
    return texts.map(_closed_object)


def parse_json_ladder(df: DataFrame, column: str = "result") -> DataFrame:
    """Add ``json`` and the ``rung`` it was found on: direct, fenced, fragment or none.

    Only what both built-in rungs miss is handed to the Python helper.
    """
    text = strip(F.col(column))
    fenced = F.nullif(F.regexp_extract(text, FENCED_OBJECT, 1), F.lit(""))
    native = F.when(strict_json(text).isNotNull(), F.struct(text.alias("json"), F.lit("direct").alias("rung"))).when(
        strict_json(fenced).isNotNull(), F.struct(fenced.alias("json"), F.lit("fenced").alias("rung")))
    found = df.withColumn("_n", native)
    fragment = _json_fragment(F.when(F.col("_n").isNull(), text))
    return (
        found.withColumn("_f", fragment)
        .withColumn("json", F.coalesce("_n.json", "_f"))
        .withColumn("rung", F.coalesce("_n.rung", F.when(F.col("_f").isNotNull(), "fragment"), F.lit("none")))
        .drop("_n", "_f"))


# -------------------------------------------------------------- review drafts
def front_matter(c: Column) -> Column:
    """Struct ``front`` (NULL without two ``---`` lines) and ``body``."""
    def cut(lines: Column) -> Column:
        rules = F.filter(F.transform(lines, lambda x, i: F.when(strip(x) == "---", i)), lambda i: i.isNotNull())

        def parts(r: Column) -> Column:
            a, b = F.get(r, F.lit(0)), F.get(r, F.lit(1))
            return F.when(b.isNotNull(), F.struct(
                F.array_join(F.slice(lines, a + 2, b - a - 1), "\n").alias("front"),
                F.array_join(F.slice(lines, b + 2, F.size(lines)), "\n").alias("body"))
            ).otherwise(F.struct(F.lit(None).cast("string").alias("front"), c.alias("body")))

        return let(rules, parts)

    return let(F.split(c, "\n"), cut)


def split_front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_p", front_matter(F.col(text))).withColumns(
        {"front": F.col("_p.front"), "body": F.col("_p.body")}).drop("_p")


def review_sections(c: Column) -> Column:
    """Array of (title, content) under the topics heading, up to the next chapter."""
    heading = "(?mdU)^[^\\S\\n]*### +[^\\S\\n]*([^\\n]*\\S)[^\\S\\n]*$"
    chapter = "(?mdU)^[^\\S\\n]*## (?!主题要点[^\\S\\n]*$)(?=[^\\n]*\\S)"
    at = F.instr(c, TOPICS_HEADING)
    region = F.get(F.split(F.substring(c, at + len(TOPICS_HEADING), F.length(c)), chapter, 2), F.lit(0))

    def blocks(r: Column) -> Column:
        titles = F.concat(F.array(F.lit("")), F.regexp_extract_all(r, F.lit(heading), F.lit(1)))
        # Both lists are made once; inside a lambda each would be made for every title.
        return F.filter(F.transform(F.arrays_zip(titles.alias("title"), F.split(r, heading).alias("content")), lambda b: F.struct(
            strip(b["title"]).alias("title"), strip(b["content"]).alias("content"))),
            lambda b: (b["title"] != "") | (b["content"] != ""))

    empty = F.array().cast("array<struct<title:string,content:string>>")
    return F.when(at > 0, let(region, blocks)).otherwise(empty)


def _pairs_of(marks: list[str], asks: list[str], texts: list[str]) -> list[dict[str, str]]:
    """Question and answer pairs of one text, from its marks, what opens a question in each, and the stretches between."""
    question = answer = None
    out: list[dict[str, str]] = []

    def close() -> None:
        said = "".join(answer or ())
        if said:
            said = re.split(BLANK_LINE, said.lstrip(WHITESPACE), maxsplit=1)[0].strip(WHITESPACE)
            out.append({"question": "".join(question).strip(WHITESPACE), "answer": said})

    for mark, ask, text in zip(marks, asks, texts[1:]):
        if question is None:
            question = [text] if ask else None
        elif answer is None:
            if ask or not any(question):
                question += [mark, text]
            else:
                answer = [text]
        elif ask and any(answer):
            close()
            question, answer = [text], None
        else:
            answer += [mark, text]
    close()
    return out


def _marked_pairs(c: Column, mark: str) -> Column:
    """Array of (question, answer) from opening marks, in one pass over the stretches that they open.

    A question lasts until an answer opens; an answer lasts until the next
    question opens, and ends at a blank line. A stretch without any character
    goes on through the next mark.
    """
    kind = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string())]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if None in row else _pairs_of(*row) for row in zip(*(x.to_pylist() for x in batch), strict=True)], kind)

    c = F.when(c.rlike(mark), c)  # without a mark there is no pair: null here, none for the caller
    marks, asks = (F.regexp_extract_all(c, F.lit(mark), F.lit(g)) for g in (0, 1))
    # Called nondeterministic, it is computed once where it stands: a filter on its pairs does not move it.
    pairs = F.arrow_udf(run, "array<struct<question:string,answer:string>>").asNondeterministic()
    return pairs(marks, asks, F.split(c, mark))


def review_pairs(c: Column) -> Column:
    """Array of (question, answer); the first of four formats that yields any wins."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip),
                     lambda x: x.rlike(Q_OPEN) | x.rlike(A_LINE))

    def by_line(marks: Column) -> Column:
        asked = F.transform(marks, lambda x, i: F.when(x.rlike(Q_LINE), F.struct(
            strip(F.regexp_extract(x, Q_LINE, 1)).alias("question"),
            strip(F.regexp_extract(F.coalesce(F.get(marks, i + 1), F.lit("")), A_LINE, 1)).alias("answer"))))
        return F.filter(asked, lambda p: p.isNotNull())

    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")

    def by_paragraph(p: Column) -> Column:
        def pair(xs: Column) -> Column:
            q = F.get(xs, F.lit(0))
            label = F.get(F.split(F.get(F.split(q, "："), F.lit(0)), ":"), F.lit(0))
            usable = (F.length(q) >= 4) & ~q.startswith("#") & ~label.rlike("^([A-Za-z\\u4e00-\\u9fff])\\1+$")
            return F.when(usable, F.struct(q.alias("question"), F.array_join(
                F.slice(xs, F.lit(2), F.size(xs)), "\n").alias("answer")))

        return let(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), pair)

    heuristic = F.filter(F.transform(paragraphs, by_paragraph), lambda p: p.isNotNull())
    nonempty = lambda a: let(a, lambda x: F.when(F.size(x) > 0, x))
    empty = F.array().cast("array<struct<question:string,answer:string>>")
    return F.coalesce(nonempty(_marked_pairs(c, LETTER_MARK)), nonempty(let(lines, by_line)),
                      nonempty(_marked_pairs(c, BRACKET_MARK)), nonempty(heuristic), empty)


def parse_review_qa(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("meeting_id", review_pairs(F.col(text)).alias("_pairs")).select("meeting_id", F.posexplode("_pairs").alias("qa_ord", "p")).select(
        "meeting_id", "qa_ord", "p.question", "p.answer")


def parse_review_sections(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("meeting_id", F.posexplode(review_sections(F.col(text))).alias("sec_ord", "s")).select(
        "meeting_id", "sec_ord", "s.title", "s.content")


def resolve_review(reviews: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sections and pairs of edited drafts: the body wins over the front matter.

    The two fall back separately. Front matter is read as JSON, which is how
    drafts are written here.
    """
    parts = reviews.withColumn("_p", front_matter(F.col(text)))
    front = parts.withColumn("_front", strict_json(F.col("_p.front")))

    def listed(name: str, fields: tuple[str, str]) -> Column:
        items = elements(F.try_variant_get("_front", f"$.{name}", "variant"))
        return F.transform(F.filter(items, lambda v: kind(v) == "OBJECT"), lambda v: F.struct(
            *[text_field(v, f).alias(f) for f in fields]))

    body = F.col("_p.body")
    nonempty = lambda a: let(a, lambda x: F.when(F.size(x) > 0, x))
    both = front.select(
        "meeting_id",
        F.coalesce(nonempty(review_pairs(body)), listed("qa_pairs", ("question", "answer"))).alias("pairs"),
        F.coalesce(nonempty(review_sections(body)), listed("sections", ("title", "content"))).alias("sections"))
    sections = both.select("meeting_id", F.posexplode("sections").alias("sec_ord", "s")).select(
        "meeting_id", "sec_ord", "s.title", "s.content")
    pairs = both.select("meeting_id", F.posexplode("pairs").alias("qa_ord", "p")).select(
        "meeting_id", "qa_ord", "p.question", "p.answer")
    return sections, pairs
