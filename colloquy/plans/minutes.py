"""Queries on model output, review drafts, merging and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions.tokens import question_key as key_of
from ..operators import minutes
from ..sources import model_output as mo
from . import inputs
from .factcheck import sql_bigrams
from .inputs import WS_RE, sql_strip, with_

ROLES = {"user": "投资方代表", "assistant": "被访谈方", "system": " Unknown "}


def _results(spark, sf):
    """Each turn as an imported result, in the four shapes people paste."""
    text = F.col("text")
    pair = F.struct(text.alias("question"), F.concat(F.lit("A. "), text).alias("answer"), F.lit("张总").alias("asker"))
    section = F.struct(F.col("speaker").alias("title"), text.alias("content"))
    shape = F.col("turn_ord") % 4
    return inputs.turns_text(spark, sf).select(
        (F.col("meeting_id") * 2147483648 + F.col("turn_ord")).alias("meeting_id"), F.col("turn_ord").alias("chunk_ord"),
        F.when(shape == 0, F.to_json(F.struct(F.array(pair).alias("qa_pairs"))))
        .when(shape == 1, F.concat(F.lit("Result:\n"), F.to_json(F.struct(F.array(section, section).alias("sections"))),
                                   F.lit("\ndone")))
        .when(shape == 2, F.to_json(F.array(section))).otherwise(text).alias("result"))


def parse_model_result(spark, sf):
    sections, pairs = mo.parse_model_result(_results(spark, sf))
    return sections.select("meeting_id", F.lit("section").alias("part"), F.col("sec_ord").alias("ord"),
                           F.col("title").alias("head"), F.col("content").alias("body"), F.lit("").alias("asker")
                           ).unionByName(pairs.select(
                               "meeting_id", F.lit("pair").alias("part"), F.col("qa_ord").alias("ord"),
                               F.col("question").alias("head"), F.col("answer").alias("body"), "asker"))


def parse_topic_blocks(spark, sf):
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.when(i == 0, "qa").alias("type"), F.concat(F.lit(" 1、"), F.left(x, F.lit(5))).alias("topic"), x.alias("text")))
    responses = inputs.turns_text(spark, sf).select(
        "meeting_id", F.col("turn_ord").alias("chunk_ord"),
        F.when(F.col("speaker") == "user", F.concat(F.lit("```json\n"), F.to_json(line), F.lit("\n```")))
        .when(F.col("speaker") == "assistant", F.to_json(line)).otherwise(F.col("text")).alias("response"))
    return mo.parse_topic_blocks(responses)


def parse_json_ladder(spark, sf):
    body = F.to_json(F.struct(F.col("text").alias("t")))
    # A truncated answer misses its last brace; a chatty one is fenced.
    results = inputs.turns_text(spark, sf).select(
        "meeting_id", "turn_ord", F.when(F.col("speaker") == "user", body)
        .when(F.col("turn_ord") % 3 == 1, F.concat(F.lit("ok ```json\n"), body, F.lit("\n``` bye")))
        .when(F.col("turn_ord") % 3 == 0, F.concat(F.lit("ok "), F.regexp_replace(body, "\\}$", "")))
        .otherwise(F.col("text")).alias("result"))
    got = mo.parse_json_ladder(results)
    return got.select("meeting_id", "turn_ord", "rung", F.get_json_object("json", "$.t").alias("text"))


def _reviews(spark, sf):
    """A review draft per document: topics in the body, pairs in the body or in the front matter."""
    para = F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    topics = F.array_join(F.transform(para, lambda x, i: F.concat(
        F.lit("### "), F.left(x, F.lit(8)), F.lit("\n"), x)), "\n\n")
    pairs = F.array_join(F.transform(para, lambda x, i: F.concat(
        F.lit("**Q"), (i + 1).cast("string"), F.lit("**："), F.left(x, F.lit(20)), F.lit("\n**A**："), x)), "\n\n")
    front = F.to_json(F.struct(F.array(F.struct(F.col("lang").alias("question"), F.col("source").alias("answer")))
                               .alias("qa_pairs")))
    # English drafts have no topics, Spanish ones no pairs in the body.
    return inputs.table(spark, sf, "documents").select(
        F.col("doc_id").alias("meeting_id"), F.concat(
            F.lit("---\n"), front, F.lit("\n---\n\n# 校验稿\n"),
            F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("\n## 主题要点\n\n"), topics, F.lit("\n\n## 问答\n"))),
            F.lit("\n"), F.when(F.col("lang") == "de", "").otherwise(pairs)).alias("text"))


def split_front_matter(spark, sf):
    return mo.split_front_matter(_reviews(spark, sf)).select("meeting_id", "front", "body")


def parse_review_sections(spark, sf):
    return mo.parse_review_sections(_reviews(spark, sf))


def parse_review_qa(spark, sf):
    return mo.parse_review_qa(mo.split_front_matter(_reviews(spark, sf)).select("meeting_id", F.col("body").alias("text")))


def resolve_review(spark, sf):
    sections, pairs = mo.resolve_review(_reviews(spark, sf))
    return sections.select("meeting_id", F.lit("section").alias("part"), F.col("sec_ord").alias("ord"),
                           F.col("title").alias("head"), F.col("content").alias("body")).unionByName(
        pairs.select("meeting_id", F.lit("pair").alias("part"), F.col("qa_ord").alias("ord"),
                     F.col("question").alias("head"), F.col("answer").alias("body")))


def merge_blocks(spark, sf):
    return minutes.merge_blocks(inputs.blocks(spark, sf)).select(
        "meeting_id", "sec_ord", "title", "content")


def _chunked_pairs(spark, sf):
    """Pairs asked again in a second chunk, in other spacing."""
    pairs = inputs.qa_pairs(spark, sf)
    again = pairs.withColumns({"chunk_ord": F.lit(1), "question": F.concat(F.lit(" "), F.replace("question", F.lit(" "), F.lit("  ")))})
    return pairs.withColumn("chunk_ord", F.lit(0)).unionByName(again.where("meeting_id % 2 = 0"))


def dedupe_questions(spark, sf):
    return minutes.dedupe_questions(_chunked_pairs(spark, sf)).select("meeting_id", "chunk_ord", "qa_ord", "question")


def drop_redundant_qa(spark, sf):
    return minutes.drop_redundant_qa(inputs.qa_pairs(spark, sf), inputs.sections(spark, sf)).select(
        "meeting_id", "qa_ord", "question")


def normalize_topic(spark, sf):
    return inputs.blocks(spark, sf).select(
        "meeting_id", "chunk_ord", "block_ord", lb.normalize_topic(F.concat(F.lit(" "), "topic", F.lit(" "), F.left("text", F.lit(4)))).alias("topic"))


def topics_similar(spark, sf):
    b = inputs.sections(spark, sf)
    return b.select("meeting_id", "sec_ord", lb.topics_similar(
        F.concat(F.lit("（3）"), F.left("title", F.lit(4))), F.col("title")).alias("similar"))


def question_key(spark, sf):
    return inputs.qa_pairs(spark, sf).select("meeting_id", "qa_ord", key_of(F.col("question")).alias("key"))


def _role():
    role = F
    for name, text in ROLES.items():
        role = role.when(F.col("speaker") == name, text)
    return role.otherwise(None)


def normalize_asker_role(spark, sf):
    return inputs.turns_text(spark, sf).select("meeting_id", "turn_ord", lb.normalize_asker_role(_role()).alias("role"))


def asker_label(spark, sf):
    name = F.when(F.col("turn_ord") % 3 == 0, F.concat(F.lit(" "), F.col("speaker"), F.lit(" "))).otherwise(" ")
    return inputs.turns_text(spark, sf).select("meeting_id", "turn_ord", lb.asker_label(
        name, lb.normalize_asker_role(_role())).alias("label"))


def valid_timerange(spark, sf):
    clock = F.date_format("ts", "HH:mm")
    value = F.when(F.col("event_type") == "click", clock).when(
        F.col("event_type") == "view", F.concat(clock, F.lit(" ～ "), F.date_format("ts", "HH:mm:ss"))).when(
        F.col("event_type") == "error", F.date_format("ts", "yyyy-MM")).otherwise(F.concat(F.lit("上午"), clock))
    return inputs.table(spark, sf, "events").select("event_id", lb.valid_timerange(value).alias("timerange"))


QUERIES = {f.__name__: f for f in (
    parse_model_result, parse_topic_blocks, parse_json_ladder, split_front_matter, parse_review_sections,
    parse_review_qa, resolve_review, merge_blocks, dedupe_questions, drop_redundant_qa, normalize_topic,
    topics_similar, question_key, normalize_asker_role, asker_label, valid_timerange)}

# ------------------------------------------------------------------------ oracle
_ORD_RE = (f"^(?:[0-9]+[\\.、）)]{WS_RE}*|（[0-9]+）{WS_RE}*|[一二三四五六七八九十]+[、.．]?{WS_RE}*)")


def sql_topic(expr: str) -> str:
    return sql_strip(f"regexp_replace({sql_strip(expr)}, '{_ORD_RE}', '')")


def sql_similar(a: str, b: str) -> str:
    a, b = sql_topic(a), sql_topic(b)
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"


# Drafts are built from a document's lines with a letter or digit: what they say is known.
_PARAS = f"""
    paras AS (SELECT meeting_id, lang, source, line, row_number() OVER (PARTITION BY meeting_id ORDER BY line_ord) - 1 AS n
              FROM doc_lines l JOIN documents d ON d.doc_id = l.meeting_id WHERE regexp_matches(line, '[A-Za-z0-9]'))"""
_TOPICS = f"""SELECT meeting_id, n::INTEGER AS sec_ord, {sql_strip('left(line, 8)')} AS title,
    {sql_strip('line')} AS content FROM paras WHERE lang <> 'en'"""
_ASKED = f"""SELECT meeting_id, n::INTEGER AS qa_ord, {sql_strip('left(line, 20)')} AS question,
    {sql_strip('line')} AS answer FROM paras WHERE lang <> 'de'"""

ORACLE = {
    "parse_model_result": with_("turns_text", also="""
        t AS (SELECT meeting_id * 2147483648 + turn_ord AS meeting_id, turn_ord % 4 AS shape, speaker, text FROM turns_text)""") + f"""
        SELECT meeting_id, 'pair' AS part, 0 AS ord, text AS head, 'A. ' || text AS body, '张总' AS asker FROM t WHERE shape = 0
        UNION ALL SELECT meeting_id, 'section', unnest([0, 1]), speaker, text, '' FROM t WHERE shape = 1
        UNION ALL SELECT meeting_id, 'section', 0, speaker, text, '' FROM t WHERE shape = 2
        UNION ALL SELECT meeting_id, 'section', 0, '{mo.WHOLE_TITLE}', {sql_strip('text')}, '' FROM t WHERE shape = 3""",
    "parse_topic_blocks": with_("turns_text", also=f"""
        l AS (SELECT *, {sql_strip('line')} AS said FROM (
            SELECT meeting_id, turn_ord, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(0, len(string_split(text, chr(10))))) AS i FROM turns_text WHERE speaker <> 'system')),
        k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, turn_ord ORDER BY i) - 1 AS n FROM l WHERE said <> '')""") + f"""
        SELECT meeting_id, turn_ord AS chunk_ord, n::INTEGER AS block_ord,
               CASE WHEN i = 0 THEN 'qa' ELSE 'narration' END AS type, {sql_strip("' 1、' || left(line, 5)")} AS topic,
               said AS text FROM k
        UNION ALL SELECT meeting_id, turn_ord, 0, 'narration', '', {sql_strip('text')} FROM turns_text WHERE speaker = 'system'""",
    "parse_json_ladder": with_("turns_text") + """SELECT meeting_id, turn_ord,
        CASE WHEN speaker = 'user' THEN 'direct' WHEN turn_ord % 3 = 1 THEN 'fenced' WHEN turn_ord % 3 = 0 THEN 'fragment'
             ELSE 'none' END AS rung,
        CASE WHEN speaker = 'user' OR turn_ord % 3 < 2 THEN text END AS text FROM turns_text""",
    "parse_review_sections": with_("doc_lines", also=_PARAS) + _TOPICS,
    "split_front_matter": with_("doc_lines", also=_PARAS + """,
        said AS (SELECT meeting_id, string_agg('### ' || left(line, 8) || chr(10) || line, chr(10) || chr(10) ORDER BY n) AS topics,
                     string_agg('**Q' || (n + 1) || '**：' || left(line, 20) || chr(10) || '**A**：' || line,
                                chr(10) || chr(10) ORDER BY n) AS pairs FROM paras GROUP BY meeting_id)""") + """
        SELECT doc_id AS meeting_id, '{"qa_pairs":[{"question":"' || lang || '","answer":"' || source || '"}]}' AS front,
            chr(10) || '# 校验稿' || chr(10) || CASE WHEN lang = 'en' THEN '' ELSE chr(10) || '## 主题要点' || chr(10) || chr(10)
                || coalesce(topics, '') || chr(10) || chr(10) || '## 问答' || chr(10) END || chr(10)
                || CASE WHEN lang = 'de' THEN '' ELSE coalesce(pairs, '') END AS body
        FROM documents LEFT JOIN said ON meeting_id = doc_id""",
    "parse_review_qa": with_("doc_lines", also=_PARAS) + _ASKED,
    "resolve_review": with_("doc_lines", also=_PARAS + f",sec AS ({_TOPICS}), ask AS ({_ASKED})") + """
        SELECT meeting_id, 'section' AS part, sec_ord AS ord, title AS head, content AS body FROM sec
        UNION ALL SELECT meeting_id, 'pair', qa_ord, question, answer FROM ask
        UNION ALL SELECT doc_id, 'pair', 0, lang, source FROM documents
            WHERE doc_id NOT IN (SELECT meeting_id FROM ask)""",
    "merge_blocks": with_("blocks", recursive=True, also=f"""
        kept AS (SELECT meeting_id, chunk_ord, block_ord, coalesce(nullif({sql_topic('topic')}, ''), '{lb.UNTITLED}') AS title,
                     {sql_strip('text')} AS text, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_ord, block_ord) AS n
                 FROM blocks WHERE type <> 'qa' AND {sql_strip('text')} <> ''),
        walk AS (SELECT meeting_id, n, title AS head, 0 AS sec FROM kept WHERE n = 1
            UNION ALL
            SELECT k.meeting_id, k.n, CASE WHEN {sql_similar('w.head', 'k.title')} THEN w.head ELSE k.title END,
                   CASE WHEN {sql_similar('w.head', 'k.title')} THEN w.sec ELSE w.sec + 1 END
            FROM walk w JOIN kept k ON k.meeting_id = w.meeting_id AND k.n = w.n + 1)""") + """
        SELECT w.meeting_id, sec::BIGINT AS sec_ord, arg_min(title, w.n) AS title,
               string_agg(text, chr(10) || chr(10) ORDER BY w.n) AS content
        FROM walk w JOIN kept k ON k.meeting_id = w.meeting_id AND k.n = w.n GROUP BY w.meeting_id, sec""",
    "dedupe_questions": with_("qa_pairs", also=f"""
        p AS (SELECT meeting_id, 0 AS chunk_ord, qa_ord, question FROM qa_pairs UNION ALL
              SELECT meeting_id, 1, qa_ord, ' ' || replace(question, ' ', '  ') FROM qa_pairs WHERE meeting_id % 2 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(regexp_replace(question, '{WS_RE}+', '', 'g'))
                  ORDER BY chunk_ord, qa_ord) AS rn FROM p WHERE {sql_strip('question')} <> '' OR meeting_id % 2 = 1)""")
    + "SELECT meeting_id, chunk_ord, qa_ord, question FROM r WHERE rn = 1 OR meeting_id % 2 = 1",
    "drop_redundant_qa": with_("sections", "qa_pairs", also=f"""
        sb AS (SELECT meeting_id, flatten(list({sql_bigrams('t')})) AS bs FROM (
            SELECT meeting_id, regexp_replace(content, '{WS_RE}+', '', 'g') AS t FROM sections) GROUP BY meeting_id),
        q AS (SELECT meeting_id, qa_ord, question, regexp_replace(question || answer, '{WS_RE}+', '', 'g') AS t FROM qa_pairs),
        b AS (SELECT *, {sql_bigrams('t')} AS qb FROM q)""") + """
        SELECT b.meeting_id, qa_ord, question FROM b LEFT JOIN sb ON sb.meeting_id = b.meeting_id
        WHERE NOT (length(t) >= 20 AND len(qb) > 0 AND coalesce(len(list_intersect(qb, list_distinct(bs))), 0) / len(qb) >= 0.7)""",
    "normalize_topic": with_("blocks") + f"""SELECT meeting_id, chunk_ord, block_ord,
        {sql_topic("' ' || topic || ' ' || left(text, 4)")} AS topic FROM blocks""",
    "topics_similar": with_("sections") + f"""SELECT meeting_id, sec_ord,
        {sql_similar("'（3）' || left(title, 4)", "title")} AS similar FROM sections""",
    "question_key": with_("qa_pairs") + f"""SELECT meeting_id, qa_ord,
        lower(regexp_replace(question, '{WS_RE}+', '', 'g')) AS key FROM qa_pairs""",
    "normalize_asker_role": with_("turns_text") + """SELECT meeting_id, turn_ord, CASE speaker WHEN 'user' THEN 'interviewer'
        WHEN 'assistant' THEN 'interviewer' ELSE '' END AS role FROM turns_text""",
    "asker_label": with_("turns_text") + """SELECT meeting_id, turn_ord, CASE WHEN turn_ord % 3 = 0 THEN speaker
        WHEN speaker IN ('user', 'assistant') THEN '访谈方' ELSE '（未指明）' END AS label FROM turns_text""",
    "valid_timerange": """SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts, '%H:%M')
        WHEN 'view' THEN strftime(ts, '%H:%M') || ' ～ ' || strftime(ts, '%H:%M:%S') END AS timerange FROM events""",
}
