"""Queries on prompts, results, rendering, summaries and stream jobs."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..operators import factcheck, prompts, rendering, reports
from ..operators import glossary as gl
from ..operators.ordered import settle, shared_folder
from ..operators.rendering import Template, TemplateSection
from ..sources import files
from ..streaming import jobs
from . import inputs
from .cleaning import FILLERS, sql_fillers
from .factcheck import BOUNDARIES, CHECKED_CITATIONS, CLAIMS, POOL_CTES, chunk_ctes
from .inputs import with_
from .terms import _HITS, LATIN

AS_OF = date(2026, 1, 31)
TEMPLATE = Template("demo", "演示纪要", (TemplateSection("The"), TemplateSection("De"), TemplateSection("Un"), TemplateSection("Q&A")))
QA_CHARS, REWRITE_CHARS = 2000, 1000
FILES_OF_PART = 10_000
KINDS = ("rewrite", "block", "qa", "export_qa", "export_speech", "export_both", "final", "glossary")


def glossary_rules(spark, sf):
    return prompts.glossary_rules(_brands(spark, sf))


def _brands(spark, sf):
    """Part names as terms, one glossary per brand."""
    return inputs.table(spark, sf, "part").select(
        F.col("p_brand").alias("glossary_id"), F.col("p_partkey").cast("int").alias("term_ord"),
        F.col("p_name").alias("term"), F.col("p_type").alias("context"),
        F.when(F.col("p_size") < 25, F.array(F.upper("p_name"), F.col("p_type"))).otherwise(
            F.array().cast("array<string>")).alias("corrections"))


def hotword_prompt(spark, sf):
    return prompts.hotword_prompt(_brands(spark, sf))


def background_text(spark, sf):
    p = inputs.table(spark, sf, "part")
    return prompts.background_text(p.select(
        F.col("p_partkey").alias("meeting_id"), F.col("p_brand").alias("company"), F.col("p_type").alias("industry"),
        F.when(F.col("p_size") < 20, "").otherwise(F.col("p_name")).alias("participants"),
        F.when(F.col("p_size") > 30, F.array("p_name", "p_type")).alias("known_consensus"),
        F.lit("").alias("meeting_purpose")))


def build_prompts(spark, sf):
    t = inputs.transcripts(spark, sf)
    out = None
    for kind in KINDS:
        rows = prompts.build_prompts(t, kind, AS_OF, LATIN, boundaries=BOUNDARIES)
        out = rows if out is None else out.unionByName(rows)
    return out.select("prompt_id", "meeting_id", "chunk_ord", "kind", F.md5("prompt").alias("digest"))


def estimate_calls(spark, sf):
    t = inputs.transcripts(spark, sf)
    kinds = [prompts.estimate_calls(t, fmt, QA_CHARS, REWRITE_CHARS, boundaries=BOUNDARIES).withColumn("fmt", F.lit(fmt))
             for fmt in ("qa", "speech", "both")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def generate(spark, sf):
    turns = inputs.turns_text(spark, sf).select(
        (F.col("meeting_id") * 2147483648 + F.col("turn_ord")).alias("meeting_id"), "text")
    answers = prompts.generate(prompts.build_prompts(turns, "export_speech", AS_OF), prompts.echo)
    return answers.select("meeting_id", F.get_json_object("result", "$.sections[0].content").alias("content"), "error")


def import_results(spark, sf):
    t = inputs.transcripts(spark, sf)
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(",")))
    results = t.select("meeting_id", F.to_json(F.struct(F.transform(lines, lambda x: F.struct(
        F.left(x, F.lit(12)).alias("title"), x.alias("content"))).alias("sections"))).alias("result"))
    _, _, coverage, follow = prompts.import_results(t, results, AS_OF, boundaries=BOUNDARIES)
    return coverage.join(follow.select("meeting_id", F.lit(True).alias("asked")), "meeting_id", "left").select(
        "meeting_id", "total_chunks", "uncovered_chunks", F.round("ratio", 6).alias("ratio"), "ok",
        F.coalesce("asked", F.lit(False)).alias("asked"))


def render_minutes(spark, sf):
    return rendering.assemble(rendering.render_minutes(inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)))


def render_report(spark, sf):
    """Minutes with citations, coverage and claims: the full validation report."""
    t, s, q = inputs.transcripts(spark, sf), inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)
    coverage = settle(factcheck.coverage_report(t, s, q, boundaries=BOUNDARIES))
    report = factcheck.fact_check_report(coverage, s, q)
    return rendering.assemble(rendering.render_minutes(
        s, q, report, coverage, factcheck.check_citations(s, t), factcheck.unsupported_claims(s, q)))


def minutes_lines(spark, sf):
    """Lines of the minutes with their places, through the sink."""
    lines = rendering.laid_out(rendering.render_minutes(inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)))
    path = files.write_lines(lines, shared_folder(spark), f"lines-{uuid.uuid4().hex}")
    return spark.read.schema("meeting_id bigint, text_start bigint, text string").json(path)


def minutes_to_json(spark, sf):
    return rendering.assemble(rendering.minutes_to_json(inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)))


def _timed_pairs(spark, sf):
    return inputs.qa_pairs(spark, sf).withColumn("timerange", F.when(F.col("qa_ord") == 0, " 09:32-09:35").otherwise("上午"))


def render_review(spark, sf):
    return rendering.assemble(rendering.render_review(
        inputs.sections(spark, sf), _timed_pairs(spark, sf),
        rendering.render_term_report(gl.exact_hits(inputs.transcripts(spark, sf), LATIN))))


def match_template_sections(spark, sf):
    return rendering.match_template_sections(TEMPLATE, inputs.sections(spark, sf)).select(
        "meeting_id", "tmpl_ord", "sec_ord", "title")


def render_formal(spark, sf):
    return rendering.assemble(rendering.render_formal(TEMPLATE, inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)))


def render_term_report(spark, sf):
    return rendering.assemble(rendering.render_term_report(
        gl.exact_hits(inputs.transcripts(spark, sf), LATIN)))


def document_round_trip(spark, sf):
    """Texts written by the sink and read back."""
    root = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    return files.read_documents(spark, files.write_documents(inputs.transcripts(spark, sf), root, "texts"))


def read_transcripts(spark, sf):
    """Every document as a file in a folder of its own, all of the same name but for what the writer adds, cleaned and keyed by the folder."""
    root = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    texts = inputs.transcripts(spark, sf).where("meeting_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    parts = max(files.PARTS, texts.count() // FILES_OF_PART)
    # Spark reads some thirty small files a task; so many tasks would cost more than the files.
    read = files.read_transcripts(spark, files.write_transcripts(texts, root, parts)).coalesce(parts)
    return read.select(F.regexp_extract("meeting_id", "^part=\\d+/meeting_id=([^/]+)/part-", 1).cast("long").alias("meeting_id"), "text")


def run_summary(spark, sf):
    return reports.run_summary(inputs.transcripts(spark, sf), inputs.sections(spark, sf),
                               inputs.qa_pairs(spark, sf), fillers=FILLERS)


def corpus_summary(spark, sf):
    return reports.corpus_summary(reports.run_summary(inputs.transcripts(spark, sf), fillers=FILLERS))


def _folder(spark):
    """A fresh folder next to the session's checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


# A stream reads a folder or a pattern; the pattern names the one file of the table.
def stream_clean(spark, sf):
    schema = inputs.table(spark, sf, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]").select(
        F.col("doc_id").alias("meeting_id"), "text")
    folder = _folder(spark)
    jobs.write_available(jobs.stream_clean(arriving, LATIN, FILLERS), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_turns(spark, sf):
    schema = inputs.table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("speaker"), F.col("ts").cast("timestamp").alias("ts"))
    folder = _folder(spark)
    jobs.write_available(jobs.stream_turns(arriving, "ts", "12 hours", "1 day"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return jobs.sessions_of(spark.read.schema(jobs.SESSION_LOG).parquet(f"{folder}/out")).drop("open")


QUERIES = {f.__name__: f for f in (
    glossary_rules, hotword_prompt, background_text, build_prompts, estimate_calls, generate, import_results,
    render_minutes, minutes_lines, render_report, minutes_to_json, render_review, match_template_sections, render_formal,
    render_term_report, run_summary, corpus_summary, document_round_trip, read_transcripts,
    stream_clean, stream_turns)}

# ------------------------------------------------------------------------ oracle
_RULES = """- 当出现「tion、tions」时，应纠正为「TION」（a suffix）
- 当出现「that、thth、hat」时，应纠正为「That」（a pronoun）
- 当出现「schein、einein、Schein」时，应纠正为「Schein」（a noun）
- 当出现「the、tion」时，应纠正为「The」（an article）"""
_TODAY = "2026年1月31日"
_DEFAULT = "公司：访谈对象\n行业：未知\n参与者：访谈方与被访谈方\n会议目的：调研访谈"


def _prompt_sql(kind: str) -> str:
    filled = (prompts.TEMPLATES[kind].replace("{background}", _DEFAULT).replace("{today}", _TODAY)
              .replace("{rules}", _RULES).replace("{type_note}", prompts.TYPE_NOTES["qa"]))
    before, after = filled.split("{text}")
    return f"'{before}' || chunk || '{after}'"


def _renamed(ctes: str, n: int) -> str:
    return ctes.replace("cutting", f"cutting{n}").replace("chunks AS", f"chunks{n} AS")


def _prompts_sql() -> str:
    long, qa = _renamed(chunk_ctes("transcripts", 4000, 200), 1), _renamed(chunk_ctes("transcripts", 8000, 400), 2)
    whole = "(SELECT meeting_id, 0 AS chunk_ord, {} AS chunk FROM transcripts)"
    source = {"rewrite": "chunks1", "block": "chunks1", "qa": "chunks2", "glossary": "chunks2"}
    selects = [f"SELECT meeting_id || ':{k}:' || chunk_ord AS prompt_id, meeting_id, chunk_ord, '{k}' AS kind, "
               f"md5({_prompt_sql(k)}) AS digest FROM {source.get(k, whole.format('text'))}" for k in KINDS]
    return with_("transcripts", recursive=True, also=long.strip() + "," + qa) + " UNION ALL ".join(selects)


_REFS = ("CASE WHEN len({c}) > 0 THEN ' ' || array_to_string(list_transform({c}, lambda c: '(' || c || ')'), ' ') ELSE '' END")
_PAIR_BODY = "string_agg('- **访谈方**：' || question || chr(10) || '  - ' || answer || chr(10), chr(10) ORDER BY qa_ord)"
_QA_DOC = f"""qa AS (SELECT meeting_id, chr(10) || '---' || chr(10) || chr(10) || '## Q&A 环节' || chr(10) || chr(10) || {_PAIR_BODY} AS qa
        FROM qa_pairs GROUP BY meeting_id)"""
_IDS = "ids AS (SELECT meeting_id FROM sections UNION SELECT meeting_id FROM qa_pairs)"
_TMPL = "(VALUES " + ", ".join(f"({i}, '{s.title}')" for i, s in enumerate(TEMPLATE.sections)) + ")"
_MATCHED = f"""
    tmpl AS (SELECT * FROM {_TMPL} t(tmpl_ord, tmpl_title)),
    best AS (SELECT s.*, tmpl_ord, row_number() OVER (PARTITION BY meeting_id, tmpl_ord
                 ORDER BY title <> tmpl_title, sec_ord) AS rn
             FROM sections s JOIN tmpl ON contains(title, tmpl_title) OR contains(tmpl_title, title))"""
_JSON = """
    js AS (SELECT meeting_id, string_agg('{"title":' || to_json(title) || ',"content":' || to_json(content) || ',"citations":'
               || to_json(citations) || '}', chr(10) || ',' ORDER BY sec_ord) AS s FROM sections GROUP BY meeting_id),
    jq AS (SELECT meeting_id, string_agg('{"question":' || to_json(question) || ',"answer":' || to_json(answer)
               || ',"asker":"","asker_role":"interviewer","timerange":' || to_json(timerange) || '}', chr(10) || ','
               ORDER BY qa_ord) AS q FROM qa_pairs GROUP BY meeting_id),
    docs AS (SELECT i.meeting_id, '{"sections":[' || chr(10) || coalesce(s || chr(10), '') || '],"qa_pairs":[' || chr(10)
                 || coalesce(q || chr(10), '') || ']}' AS text
             FROM ids i LEFT JOIN js ON js.meeting_id = i.meeting_id LEFT JOIN jq ON jq.meeting_id = i.meeting_id)"""


def _term_report() -> str:
    return """
        g AS (SELECT meeting_id, matched, term, count(*) AS hits, arg_min(context, hit_start) AS context, min(hit_start) AS seen
              FROM hits GROUP BY meeting_id, matched, term),
        r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seen) AS n,
                  sum(hits) OVER (PARTITION BY meeting_id)::BIGINT AS total, count(*) OVER (PARTITION BY meeting_id) AS kinds FROM g),
        report AS (SELECT meeting_id, '## 术语纠错' || chr(10) || chr(10) || '**已自动纠正 ' || any_value(total)
                || ' 处**（术语表精确命中，确定性替换）' || chr(10) || chr(10)
                || string_agg('- `' || matched || '` → **' || term || '**' || CASE WHEN hits > 1 THEN '（' || hits || ' 处）' ELSE '' END
                    || '　' || context, chr(10) ORDER BY n) || chr(10) AS text
              FROM r GROUP BY meeting_id)"""


_CLEANED = sql_fillers("text", FILLERS)
_SUMMARY = f"""SELECT meeting_id, length(text)::INTEGER AS raw_chars, length({_CLEANED})::INTEGER AS cleaned_chars,
    CASE WHEN length(text) < 1000 THEN 'small' WHEN length(text) < 5000 THEN 'medium' ELSE 'large' END AS tier,
    CASE WHEN len(regexp_extract_all(text, '[?？]')) * 1000.0 / greatest(length(text), 1) < 1.5 THEN 'narration' ELSE 'qa' END AS type
    FROM transcripts"""

_CITED = CHECKED_CITATIONS[CHECKED_CITATIONS.index("cited AS"):]
_CITE_CTES, _CITE_SELECT = _CITED.rsplit("\n        SELECT meeting_id, sec_ord", 1)
_REPORT_SQL = with_("transcripts", "sections", "qa_pairs", recursive=True, also=(
    chunk_ctes("transcripts", 1000, 100).strip() + "," + POOL_CTES + "," + _CITE_CTES + f""",
    cites AS (SELECT meeting_id, sec_ord{_CITE_SELECT}),
    claims AS ({CLAIMS}),
    {_IDS}, {_QA_DOC},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sec_ord) AS i FROM sections),
    sec AS (SELECT meeting_id, count(*) AS n, string_agg('## ' || i || '. ' || title || {_REFS.format(c='citations')} || chr(10) || chr(10)
                || CASE WHEN content = '' THEN '（无内容）' ELSE content END || chr(10), chr(10) ORDER BY i) AS s
            FROM numbered GROUP BY meeting_id),
    asked AS (SELECT meeting_id, count(*) AS n FROM qa_pairs GROUP BY meeting_id),
    cover AS (SELECT t.meeting_id, count(chunk) AS total, count(*) FILTER (score < 0.5) AS missed,
                  coalesce(sum(score) / count(chunk), 1.0::DOUBLE) AS ratio,
                  coalesce(string_agg(chr(10) || '  - "' || chunk || '"', '' ORDER BY chunk_ord) FILTER (score < 0.5), '') AS snippets
              FROM transcripts t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY meeting_id, score < 0.5 ORDER BY chunk_ord) AS m
                                            FROM scored) s ON s.meeting_id = t.meeting_id GROUP BY t.meeting_id),
    cl AS (SELECT meeting_id, count(*) AS issues, string_agg('- [待确认] [' || claim_type || '] ' || title || '：' || issue || '（"'
               || claim_snippet || '"）', chr(10) ORDER BY claim_type DESC, ord) AS lines FROM claims GROUP BY meeting_id),
    ci AS (SELECT meeting_id, string_agg(CASE WHEN NOT valid THEN '- [无效] `' || citation || '` 引用格式不识别'
               WHEN coalesce(content, '') = '' THEN '- [通过] `' || citation || '`（来源标记）'
               ELSE '- [通过] `' || citation || '` 对应原文：' || content END, chr(10) ORDER BY sec_ord, cit_ord) AS lines
           FROM cites GROUP BY meeting_id),
    every AS (SELECT meeting_id FROM ids UNION SELECT meeting_id FROM transcripts)""")) + """
    SELECT e.meeting_id, concat_ws(chr(10), CASE WHEN i.meeting_id IS NOT NULL THEN '# 会议纪要' || chr(10) END,
        s, substr(qa, 2), '---' || chr(10) || chr(10) || '## 事实校验报告' || chr(10) || chr(10) || '- **校验状态**：'
            || CASE WHEN coalesce(ratio >= 0.9, true) AND coalesce(issues, 0) = 0 THEN '[通过]' ELSE '[异常]' END,
        '- **内容覆盖率**：' || round_even(ratio * 100, 0)::BIGINT || '%（' || (total - missed) || '/' || total || ' 段被提取内容覆盖）'
            || CASE WHEN ratio >= 0.9 THEN '' ELSE chr(10) || '- ⚠️ 覆盖率低于阈值 90%，可能存在内容遗漏，请核对以下未覆盖片段：' || snippets END,
        '- 共检查 ' || coalesce(sec.n, 0) || ' 个章节、' || coalesce(asked.n, 0) || ' 个问答' || chr(10),
        '### 引用检查' || chr(10) || ci.lines || chr(10), '### 无来源声明' || chr(10) || cl.lines || chr(10)) AS text
    FROM every e LEFT JOIN ids i ON i.meeting_id = e.meeting_id LEFT JOIN sec ON sec.meeting_id = e.meeting_id
    LEFT JOIN qa ON qa.meeting_id = e.meeting_id LEFT JOIN asked ON asked.meeting_id = e.meeting_id
    LEFT JOIN cover ON cover.meeting_id = e.meeting_id LEFT JOIN ci ON ci.meeting_id = e.meeting_id
    LEFT JOIN cl ON cl.meeting_id = e.meeting_id"""

ORACLE = {
    "render_report": _REPORT_SQL,
    "glossary_rules": """SELECT p_brand AS glossary_id, coalesce(string_agg('- 当出现「' || upper(p_name) || '、' || p_type
        || '」时，应纠正为「' || p_name || '」（' || p_type || '）', chr(10) ORDER BY p_partkey) FILTER (p_size < 25), '（无）') AS rules FROM part GROUP BY p_brand""",
    "hotword_prompt": f"""WITH w AS (SELECT p_brand, p_name, min(p_partkey) AS o FROM part GROUP BY ALL),
        u AS (SELECT *, sum(length(p_name) + 1) OVER (PARTITION BY p_brand ORDER BY o) AS used FROM w)
        SELECT p_brand AS glossary_id, '{prompts.HOTWORD_LEAD}' || string_agg(p_name, '、' ORDER BY o) || '。' AS prompt
        FROM u WHERE used <= {prompts.HOTWORD_LIMIT - len(prompts.HOTWORD_LEAD) - 1} GROUP BY p_brand""",
    "background_text": """SELECT p_partkey AS meeting_id, '公司：' || p_brand || chr(10) || '行业：' || p_type
        || CASE WHEN p_size < 20 OR p_name = '' THEN '' ELSE chr(10) || '参与者：' || p_name END
        || CASE WHEN p_size > 30 THEN chr(10) || '已知共识：' || p_name || chr(10) || '已知共识：' || p_type ELSE '' END
        AS background FROM part""",
    "build_prompts": _prompts_sql(),
    "estimate_calls": with_("transcripts", recursive=True, also=_renamed(chunk_ctes("transcripts", QA_CHARS, 400), 1).strip()
                            + "," + _renamed(chunk_ctes("transcripts", REWRITE_CHARS, 200), 2) + """,
        a AS (SELECT meeting_id, count(*)::INTEGER AS q FROM chunks1 GROUP BY 1),
        b AS (SELECT meeting_id, count(*)::INTEGER AS s FROM chunks2 GROUP BY 1)""") + """
        SELECT meeting_id, unnest([q, s, q + s]) AS calls, unnest(['qa', 'speech', 'both']) AS fmt FROM a JOIN b USING (meeting_id)""",
    "generate": with_("turns_text") + """SELECT meeting_id * 2147483648 + turn_ord AS meeting_id, text AS content, NULL AS error
        FROM turns_text""",
    "import_results": with_("transcripts", "sections", recursive=True, also="""
        qa_pairs AS (SELECT 0 AS meeting_id, 0 AS qa_ord, '' AS question, '' AS answer WHERE false),""" +
        chunk_ctes("transcripts", 1000, 100) + "," + POOL_CTES) + """
        SELECT t.meeting_id, count(chunk) AS total_chunks, count(*) FILTER (score < 0.5) AS uncovered_chunks,
               round(coalesce(sum(score) / count(chunk), 1.0::DOUBLE), 6) AS ratio,
               coalesce(sum(score) / count(chunk), 1.0::DOUBLE) >= 0.8 AS ok,
               coalesce(sum(score) / count(chunk), 1.0::DOUBLE) < 0.8 AS asked
        FROM transcripts t LEFT JOIN scored s ON s.meeting_id = t.meeting_id GROUP BY t.meeting_id""",
    "render_minutes": with_("sections", "qa_pairs", also=f"""
        {_IDS}, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sec_ord) AS i FROM sections),
        sec AS (SELECT meeting_id, string_agg('## ' || i || '. ' || title || {_REFS.format(c='citations')} || chr(10) || chr(10)
                    || CASE WHEN content = '' THEN '（无内容）' ELSE content END || chr(10), chr(10) ORDER BY i) AS s
                FROM n GROUP BY meeting_id), {_QA_DOC}""") + """
        SELECT i.meeting_id, '# 会议纪要' || chr(10) || coalesce(chr(10) || s, '') || coalesce(qa, '') AS text
        FROM ids i LEFT JOIN sec ON sec.meeting_id = i.meeting_id LEFT JOIN qa ON qa.meeting_id = i.meeting_id""",
    "minutes_to_json": with_("sections", "qa_pairs", also=f"{_IDS}, {_JSON.strip()}")
    + "SELECT meeting_id, text FROM docs",
    "render_review": with_("transcripts", "sections", also=f"""
        pairs AS ({inputs.SQL['qa_pairs']}),
        qa_pairs AS (SELECT * REPLACE (CASE WHEN qa_ord = 0 THEN ' 09:32-09:35' ELSE '上午' END AS timerange) FROM pairs),
        {_IDS}, {_JSON.strip()}, {_HITS.strip()}, {_term_report().strip()},
        sec AS (SELECT meeting_id, string_agg('### ' || title || chr(10) || content || chr(10), chr(10) ORDER BY sec_ord) AS s
                FROM sections GROUP BY meeting_id),
        ask AS (SELECT meeting_id, string_agg(CASE WHEN qa_ord = 0 THEN '[09:32-09:35]' || chr(10) || chr(10) ELSE '' END
                    || '**Q**：' || question || chr(10) || '**A**：' || answer || chr(10), chr(10) ORDER BY qa_ord) AS q
                FROM qa_pairs GROUP BY meeting_id),
        every AS (SELECT meeting_id FROM ids UNION SELECT meeting_id FROM report)""") + """
        SELECT e.meeting_id, concat_ws(chr(10), CASE WHEN d.text IS NOT NULL THEN
            '---' || chr(10) || d.text || chr(10) || '---' || chr(10) || chr(10) || '# 校验稿' || chr(10) END,
            '## 主题要点' || chr(10) || chr(10) || s, q, '---' || chr(10) || chr(10) || r.text) AS text
        FROM every e LEFT JOIN docs d ON d.meeting_id = e.meeting_id LEFT JOIN sec ON sec.meeting_id = e.meeting_id
        LEFT JOIN ask ON ask.meeting_id = e.meeting_id LEFT JOIN report r ON r.meeting_id = e.meeting_id""",
    "match_template_sections": with_("sections", also=_MATCHED)
    + "SELECT meeting_id, tmpl_ord, sec_ord, title FROM best WHERE rn = 1",
    "render_formal": with_("sections", "qa_pairs", also=f"""
        {_IDS}, {_MATCHED.strip()}, {_QA_DOC},
        slots AS (SELECT i.meeting_id, t.tmpl_ord, t.tmpl_title, content,
                      list_filter(coalesce(citations, []), lambda c: NOT starts_with(c, '×')) AS cites
                  FROM ids i CROSS JOIN tmpl t LEFT JOIN best b ON b.meeting_id = i.meeting_id AND b.tmpl_ord = t.tmpl_ord AND rn = 1),
        body AS (SELECT meeting_id, string_agg('## ' || (tmpl_ord + 1) || '. ' || tmpl_title || {_REFS.format(c='cites')}
                     || chr(10) || chr(10) || coalesce(nullif(content, ''), '（无内容）') || chr(10), chr(10) ORDER BY tmpl_ord) AS b
                 FROM slots GROUP BY meeting_id)""") + f"""
        SELECT i.meeting_id, '# {TEMPLATE.description}' || chr(10) || chr(10) || b || coalesce(qa, '') AS text
        FROM ids i JOIN body ON body.meeting_id = i.meeting_id LEFT JOIN qa ON qa.meeting_id = i.meeting_id""",
    "render_term_report": with_("transcripts", also=_HITS.strip() + "," + _term_report())
    + "SELECT meeting_id, text FROM report",
    "run_summary": with_("transcripts", "sections", "qa_pairs", also=f"base AS ({_SUMMARY})") + """
        SELECT b.*, (SELECT count(*) FROM sections s WHERE s.meeting_id = b.meeting_id) AS sections,
               (SELECT count(*) FROM qa_pairs q WHERE q.meeting_id = b.meeting_id) AS qa_pairs FROM base b""",
    "corpus_summary": with_("transcripts", also=f"base AS ({_SUMMARY})") + """
        SELECT tier, type, count(*) AS meetings, sum(raw_chars)::BIGINT AS raw_chars, sum(cleaned_chars)::BIGINT AS cleaned_chars
        FROM base GROUP BY ROLLUP (tier, type)""",
    # Closed sessions and open ones.
    "stream_turns": """WITH e AS (SELECT user_id AS recording_id, event_type AS speaker, ts,
            coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOURS, true)::INT AS opens FROM events
            WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY recording_id, speaker ORDER BY ts) AS n FROM e)
        SELECT recording_id, speaker, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS turns
        FROM s GROUP BY recording_id, speaker, n""",
    "stream_clean": with_("transcripts", also=f"""
        quiet AS (SELECT meeting_id, {_CLEANED} AS text FROM transcripts),"""
        + _HITS.split("hits AS")[0].rstrip().rstrip(",").replace("FROM transcripts", "FROM quiet")) + """
        SELECT meeting_id, string_agg(coalesce(correct, run), '' ORDER BY i) AS text FROM mapped GROUP BY meeting_id""",
}
ORACLE["document_round_trip"] = inputs.SQL["transcripts"]
ORACLE["read_transcripts"] = "SELECT doc_id AS meeting_id, coalesce(text, '') || chr(10) AS text FROM documents WHERE doc_id IS NOT NULL"
ORACLE["minutes_lines"] = with_("sections", "qa_pairs", also=f"""
    {_IDS}, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sec_ord) AS i FROM sections),
    ls AS (SELECT meeting_id, 0 AS part, 0 AS ord, '# 会议纪要' || chr(10) AS text FROM ids
        UNION ALL SELECT meeting_id, 1, sec_ord, '## ' || i || '. ' || title || {_REFS.format(c='citations')} || chr(10) || chr(10)
            || CASE WHEN content = '' THEN '（无内容）' ELSE content END || chr(10) FROM n
        UNION ALL SELECT DISTINCT meeting_id, 2, 0, '---' || chr(10) || chr(10) || '## Q&A 环节' || chr(10) FROM qa_pairs
        UNION ALL SELECT meeting_id, 3, qa_ord, '- **访谈方**：' || question || chr(10) || '  - ' || answer || chr(10) FROM qa_pairs)""") + """
    SELECT meeting_id, (sum(length(text) + 1) OVER (PARTITION BY meeting_id ORDER BY part, ord) - length(text) - 1)::BIGINT AS text_start, text FROM ls"""
