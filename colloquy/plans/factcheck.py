"""Queries on tokens, chunks, citations, claims and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.labels import citation_parse as parse_citation
from ..operators import chunking, factcheck
from . import inputs
from .cleaning import _stamped, clock
from .inputs import WS_RE, sql_strip, with_

# Cut characters of the invented Latin prose.
BOUNDARIES = ("\n", ".", "!", ",", ";")
STITCH_CHARS, STITCH_OVERLAP = 400, 60


def normalize_match(spark, sf):
    return inputs.cjk_transcripts(spark, sf).select(
        "meeting_id", tokens.normalize_match(F.col("text")).alias("norm"))


def char_bigrams(spark, sf):
    """Document frequency of every bigram."""
    norm = tokens.normalize_match(F.col("text"))
    return (inputs.transcripts(spark, sf).select(F.explode(tokens.char_bigrams(norm)).alias("bigram"))
            .groupBy("bigram").agg(F.count("*").alias("meetings")))


def _figures():
    """A sentence of figures about an order."""
    price = F.col("o_totalprice").cast("bigint").cast("string")
    year = F.date_format("o_orderdate", "yyyy")
    return F.concat(
        F.lit("营收"), price, F.lit("万，毛利"), (F.col("o_custkey") % 100).cast("string"), F.lit(" %，"),
        F.when(F.col("o_orderstatus") == "F", F.substring(year, 3, 2)).otherwise(year), F.lit("年上市，扩产至"),
        (F.col("o_orderkey") % 50).cast("string"), F.lit(".5-"), (F.col("o_orderkey") % 50 + 10).cast("string"),
        F.lit("亿"))


def number_tokens(spark, sf):
    o = inputs.table(spark, sf, "orders")
    return o.select("o_orderkey", F.explode(tokens.number_tokens(_figures())).alias("token"))


def token_ratios(spark, sf):
    """Each pair's answer measured against its question."""
    q, a = tokens.normalize_match(F.col("question")), tokens.normalize_match(F.col("answer"))
    pairs = inputs.qa_pairs(spark, sf).withColumns({"q": q, "a": a})
    return pairs.select(
        "meeting_id", "qa_ord",
        F.round(tokens.bigram_ratio(tokens.char_bigrams(F.col("a")), tokens.char_bigrams(F.col("q"))), 6).alias("bigram_ratio"),
        F.round(tokens.number_ratio(tokens.number_tokens(F.col("a")), tokens.number_tokens(F.col("q"))), 6).alias("number_ratio"))


def chunk_text(spark, sf):
    return chunking.chunk_text(inputs.transcripts(spark, sf), "text", 1000, 100, BOUNDARIES)


def stitch_text(spark, sf):
    cut = chunking.chunk_text(inputs.transcripts(spark, sf), "text", STITCH_CHARS, STITCH_OVERLAP, BOUNDARIES)
    return chunking.stitch_text(cut.select(
        F.col("meeting_id").alias("recording_id"), "chunk_ord", F.col("chunk").alias("text")))


def trim_rewrite_overlap(spark, sf):
    cut = chunking.chunk_text(inputs.transcripts(spark, sf), "text", STITCH_CHARS, STITCH_OVERLAP, BOUNDARIES)
    return chunking.trim_rewrite_overlap(cut.select("meeting_id", "chunk_ord", F.col("chunk").alias("text")))


def citation_parse(spark, sf):
    cited = inputs.sections(spark, sf).select(F.explode("citations").alias("citation")).distinct()
    p = parse_citation(F.col("citation"), F.lit("paragraph"))
    return cited.select("citation", p["kind"].alias("kind"), p["ordinal"].alias("ordinal"))


def citation_parse_timestamps(spark, sf):
    """Clock times and ranges of every section, read in the timestamp style."""
    n = F.col("sec_ord") * 7
    cites = F.explode(F.array(clock(n), F.concat(clock(n), F.lit("-"), clock(n + 7)), F.lit("§3")))
    cited = inputs.sections(spark, sf).select(cites.alias("citation")).distinct()
    p = parse_citation(F.col("citation"), F.lit("timestamp"))
    return cited.select("citation", p["kind"].alias("kind"), p["ts_start"].alias("ts_start"), p["ts_end"].alias("ts_end"))


def check_citations(spark, sf):
    return factcheck.check_citations(inputs.sections(spark, sf), inputs.transcripts(spark, sf))


def check_timestamp_citations(spark, sf):
    n = F.col("sec_ord") * 7
    cites = F.array(clock(n), F.concat(clock(n), F.lit("-"), clock(n + 7)), clock(n + 3), F.lit("L1"))
    sections = inputs.sections(spark, sf).withColumn("citations", cites)
    stamped = inputs.transcripts(spark, sf).withColumn("text", _stamped(F.col("text")))
    return factcheck.check_citations(sections, stamped, style="timestamp")


def unsupported_claims(spark, sf):
    return factcheck.unsupported_claims(inputs.sections(spark, sf), inputs.qa_pairs(spark, sf))


def coverage_chunks(spark, sf):
    return factcheck.coverage_chunks(
        inputs.transcripts(spark, sf), inputs.sections(spark, sf), inputs.qa_pairs(spark, sf), BOUNDARIES
    ).withColumn("score", F.round("score", 6))


def _coverage(spark, sf):
    return factcheck.coverage_report(
        inputs.transcripts(spark, sf), inputs.sections(spark, sf), inputs.qa_pairs(spark, sf),
        boundaries=BOUNDARIES)


def coverage_report(spark, sf):
    return _coverage(spark, sf).select(
        "meeting_id", "total_chunks", "uncovered_chunks", F.round("ratio", 6).alias("ratio"), "ok",
        F.array_join("uncovered", "|").alias("snippets"))


def fact_check_report(spark, sf):
    return factcheck.fact_check_report(
        _coverage(spark, sf), inputs.sections(spark, sf), inputs.qa_pairs(spark, sf)
    ).withColumn("confidence_score", F.round("confidence_score", 6))


QUERIES = {f.__name__: f for f in (
    normalize_match, char_bigrams, number_tokens, token_ratios, chunk_text, stitch_text,
    trim_rewrite_overlap, citation_parse, citation_parse_timestamps, check_citations, check_timestamp_citations,
    unsupported_claims, coverage_chunks, coverage_report, fact_check_report)}

# ------------------------------------------------------------------------ oracle
NORM_RE = "[^\\x{4e00}-\\x{9fff}A-Za-z0-9%\\-]"


def sql_norm(expr: str) -> str:
    return f"regexp_replace({expr}, '{NORM_RE}', '', 'g')"


def sql_bigrams(expr: str) -> str:
    return f"list_distinct(list_transform(range(1, length({expr})), lambda i: ({expr})[i:i + 1]))"


_NUM, _UNIT = "[0-9]+(?:\\.[0-9]+)?", "[万亿%]"
_RANGE = f"{_NUM}{WS_RE}*[-~～]+{WS_RE}*{_NUM}{WS_RE}*{_UNIT}"


def sql_numbers(expr: str) -> str:
    years = f"regexp_extract_all({expr}, '([0-9]{{2,4}}){WS_RE}*年', 1)"
    ends = (f"flatten(list_transform(regexp_extract_all({expr}, '{_RANGE}'), lambda r: list_transform("
            f"list_filter(string_split_regex(left(r, length(r) - 1), '[-~～]+'), lambda e: {sql_strip('e')} <> ''),"
            f" lambda e: {sql_strip('e')} || right(r, 1))))")
    return f"""list_distinct(flatten([{years},
        list_transform(list_filter({years}, lambda y: length(y) = 2), lambda y: '20' || y),
        list_transform(list_filter({years}, lambda y: length(y) = 4), lambda y: right(y, 2)),
        {ends},
        list_transform(regexp_extract_all({expr}, '{_NUM}{WS_RE}*{_UNIT}'),
                       lambda u: regexp_replace(u, '{WS_RE}+', '', 'g')),
        regexp_extract_all({expr}, '{_NUM}')]))"""


def chunk_ctes(source: str, size: int, overlap: int, key: str = "meeting_id", marks=BOUNDARIES) -> str:
    """Sequential cuts by recursion: CTE ``chunks(key, chunk_ord, chunk_start, chunk)``."""
    cuts = ", ".join(
        f"CASE WHEN strpos(rev, {_lit(m)}) > 0 AND c0 + {size} - strpos(rev, {_lit(m)}) > c0 "
        f"THEN c0 + {size} + 1 - strpos(rev, {_lit(m)}) END" for m in marks)
    return f"""
    cutting AS (
        SELECT {key}, -1 AS n, 0 AS c0, 0 AS c1, 0 AS following, length(text) AS total FROM {source}
        UNION ALL
        SELECT {key}, n + 1, c0, cut, CASE WHEN cut = total THEN total
                   WHEN cut - {overlap} > c0 THEN cut - {overlap} ELSE cut END, total
        FROM (SELECT {key}, n, c0, total, CASE WHEN c0 + {size} >= total THEN total
                         ELSE coalesce({cuts}, c0 + {size}) END AS cut
              FROM (SELECT c.{key}, c.n, c.following AS c0, c.total, reverse(s.text[
                        greatest(c.following + {size - 300}, c.following) + 1 : c.following + {size}]) AS rev
                    FROM cutting c JOIN {source} s ON c.{key} = s.{key}
                    WHERE c.following < c.total OR (c.n = -1)))),
    chunks AS (SELECT c.{key}, n AS chunk_ord, c0 AS chunk_start, s.text[c0 + 1 : c1] AS chunk
               FROM cutting c JOIN {source} s ON c.{key} = s.{key} WHERE n >= 0)"""


def _lit(ch: str) -> str:
    return "chr(10)" if ch == "\n" else f"'{ch}'"


POOL_CTES = f"""
    parts AS (SELECT meeting_id, 0 AS kind, sec_ord AS o, 0 AS sub, content AS text FROM sections
        UNION ALL SELECT meeting_id, 1, qa_ord, 0, question FROM qa_pairs
        UNION ALL SELECT meeting_id, 1, qa_ord, 1, answer FROM qa_pairs),
    joined AS (SELECT meeting_id, string_agg(text, chr(10) ORDER BY kind, o, sub) AS raw FROM parts GROUP BY meeting_id),
    pooln AS (SELECT meeting_id, {sql_strip('raw')} <> '' AS nonblank, {sql_norm('raw')} AS norm FROM joined),
    pool AS (SELECT meeting_id, nonblank, {sql_bigrams('norm')} AS pb, {sql_numbers('norm')} AS pn FROM pooln),
    normed AS (SELECT meeting_id, chunk_ord, chunk, {sql_norm('chunk')} AS norm FROM chunks
               WHERE {sql_strip('chunk')} <> ''),
    tokened AS (SELECT *, {sql_bigrams('norm')} AS b, {sql_numbers('norm')} AS m FROM normed),
    scored AS (
        SELECT t.meeting_id, chunk_ord, chunk, CASE WHEN NOT coalesce(nonblank, false) THEN 0.0::DOUBLE
            WHEN length(norm) < 10 THEN 1.0::DOUBLE ELSE greatest(
                CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(b, pb)) / len(b) END,
                CASE WHEN len(m) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(m, pn)) / len(m) END) END AS score
        FROM tokened t LEFT JOIN pool p ON p.meeting_id = t.meeting_id)"""
_COVER = with_("transcripts", "sections", "qa_pairs", recursive=True,
               also=chunk_ctes("transcripts", 1000, 100).strip() + "," + POOL_CTES)
_REPORT = """,
    report AS (
        SELECT t.meeting_id, count(chunk) AS total_chunks, count(*) FILTER (score < 0.5) AS uncovered_chunks,
               coalesce(sum(score) / count(chunk), 1.0::DOUBLE) AS ratio,
               array_to_string(list(chunk ORDER BY chunk_ord) FILTER (score < 0.5), '|') AS snippets
        FROM transcripts t LEFT JOIN scored s ON s.meeting_id = t.meeting_id GROUP BY t.meeting_id)"""
_STITCH = chunk_ctes("transcripts", STITCH_CHARS, STITCH_OVERLAP).strip()
CLAIMS = f"""
    SELECT meeting_id, sec_ord AS ord, content AS claim_snippet, 'section' AS claim_type, title,
           CASE WHEN content = '' THEN '{factcheck.EMPTY_NO_SOURCE}' ELSE '{factcheck.NO_SOURCE}' END AS issue
    FROM sections WHERE len(citations) = 0
    UNION ALL SELECT meeting_id, qa_ord, {sql_strip("question || ' ' || answer")}, 'qa_pair',
           'Q: ' || question, '{factcheck.NO_SOURCE}' FROM qa_pairs
           WHERE {sql_strip("question || ' ' || answer")} <> ''"""
_FIGURES = """'营收' || o_totalprice_whole || '万，毛利' || (o_custkey % 100) || ' %，'
    || CASE WHEN o_orderstatus = 'F' THEN right(year(o_orderdate)::VARCHAR, 2) ELSE year(o_orderdate)::VARCHAR END
    || '年上市，扩产至' || (o_orderkey % 50) || '.5-' || (o_orderkey % 50 + 10) || '亿'"""
_STAMP = "strftime(make_timestamp({} * 1000000), '%H:%M:%S')"

ORACLE = {
    "normalize_match": with_("cjk") + f"SELECT meeting_id, {sql_norm('text')} AS norm FROM cjk",
    "char_bigrams": with_("transcripts", also=f"n AS (SELECT {sql_norm('text')} AS norm FROM transcripts)")
    + f"""SELECT bigram, count(*) AS meetings FROM (SELECT unnest({sql_bigrams('norm')}) AS bigram FROM n)
        GROUP BY bigram""",
    "number_tokens": f"""WITH o AS (SELECT *, trunc(o_totalprice)::BIGINT AS o_totalprice_whole FROM orders),
        f AS (SELECT o_orderkey, {_FIGURES} AS text FROM o)
        SELECT o_orderkey, unnest({sql_numbers('text')}) AS token FROM f""",
    "token_ratios": with_("qa_pairs", also=f"""
        n AS (SELECT meeting_id, qa_ord, {sql_norm('question')} AS q, {sql_norm('answer')} AS a FROM qa_pairs),
        t AS (SELECT meeting_id, qa_ord, {sql_bigrams('q')} AS qb, {sql_bigrams('a')} AS ab,
                     {sql_numbers('q')} AS qn, {sql_numbers('a')} AS an FROM n)""") + """
        SELECT meeting_id, qa_ord,
            round(CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ab, qb)) / len(ab) END, 6) AS bigram_ratio,
            round(CASE WHEN len(an) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(an, qn)) / len(an) END, 6) AS number_ratio
        FROM t""",
    "chunk_text": with_("transcripts", recursive=True, also=chunk_ctes("transcripts", 1000, 100))
    + "SELECT meeting_id, chunk_ord, chunk_start, chunk FROM chunks",
    "stitch_text": with_("transcripts", recursive=True, also=_STITCH + f""",
        sewn AS (
            SELECT meeting_id, chunk_ord, chunk AS text FROM chunks WHERE chunk_ord = 0
            UNION ALL
            SELECT c.meeting_id, c.chunk_ord, CASE WHEN k > 0 THEN ltrim(c.chunk[k + 1:], '{inputs.WS_SQL}')
                ELSE c.chunk END
            FROM (SELECT c.*, coalesce(list_max(list_filter(range(10, least(length(s.text), length(c.chunk), 200) + 1),
                             lambda k: right(s.text, k) = left(c.chunk, k))), 0) AS k
                  FROM sewn s JOIN chunks c ON c.meeting_id = s.meeting_id AND c.chunk_ord = s.chunk_ord + 1) c)""")
    + "SELECT meeting_id AS recording_id, chunk_ord::BIGINT AS chunk_ord, text FROM sewn",
    "trim_rewrite_overlap": with_("transcripts", recursive=True, also=_STITCH + """,
        p AS (SELECT *, lag(chunk) OVER (PARTITION BY meeting_id ORDER BY chunk_ord) AS prev FROM chunks),
        k AS (SELECT *, list_max(list_filter(range(6, least(length(prev), length(chunk), 200) + 1), lambda k:
                  strpos(chunk, right(prev, k)) > 0
                  AND strpos(chunk, right(prev, k)) - 1 < length(chunk) - 10)) AS n FROM p)""") + """
        SELECT meeting_id, chunk_ord, CASE WHEN n IS NULL OR chunk[strpos(chunk, right(prev, n)) + n:] = ''
            THEN chunk ELSE chunk[strpos(chunk, right(prev, n)) + n:] END AS text FROM k""",
    "citation_parse": with_("sections", also="c AS (SELECT DISTINCT unnest(citations) AS citation FROM sections)") + """
        SELECT citation, CASE WHEN regexp_matches(citation, '^§[0-9]+') THEN 'paragraph'
            WHEN regexp_matches(citation, '^[Ll][0-9]+') THEN 'line'
            WHEN regexp_matches(citation, '^×[0-9]+') THEN 'unknown' ELSE 'invalid' END AS kind,
            nullif(regexp_extract(citation, '^[§Ll×]([0-9]+)', 1), '')::INTEGER AS ordinal FROM c""",
    "citation_parse_timestamps": with_("sections", also=f"""
        c AS (SELECT DISTINCT unnest([{_STAMP.format('sec_ord * 7')},
            {_STAMP.format('sec_ord * 7')} || '-' || {_STAMP.format('(sec_ord * 7 + 7)')}, '§3']) AS citation FROM sections)""") + """
        SELECT citation, CASE WHEN starts_with(citation, '§') THEN 'invalid' ELSE 'timestamp' END AS kind,
            CASE WHEN NOT starts_with(citation, '§') THEN left(citation, 8) END AS ts_start,
            CASE WHEN contains(citation, '-') THEN right(citation, 8) END AS ts_end FROM c""",
    "check_citations": with_("transcripts", "sections", also=f"""
        cited AS (SELECT meeting_id, sec_ord, i - 1 AS cit_ord, citations[i] AS citation FROM (
            SELECT *, unnest(range(1, len(citations) + 1)) AS i FROM sections)),
        shelf AS (SELECT meeting_id, string_split(text, chr(10)) AS ls, list_filter(list_transform(
            string_split(text, chr(10) || chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '') AS ps FROM transcripts),
        r AS (SELECT c.*, nullif(regexp_extract(citation, '^[§Ll×]([0-9]+)', 1), '')::INTEGER AS n,
                     left(citation, 1) AS mark, ls, CASE WHEN len(ps) = 0 THEN ls ELSE ps END AS ps
              FROM cited c JOIN shelf s ON s.meeting_id = c.meeting_id)""") + f"""
        SELECT meeting_id, sec_ord, cit_ord::INTEGER AS cit_ord, citation,
            CASE WHEN n IS NULL THEN -1 WHEN mark = '×' THEN 0 ELSE n END AS line_index,
            CASE WHEN n IS NULL THEN NULL WHEN mark = '×' THEN '' WHEN mark = '§' THEN {sql_strip('ps[n]')}
                 ELSE {sql_strip('ls[n]')} END AS content,
            n IS NOT NULL AND (mark = '×' OR (mark = '§' AND n BETWEEN 1 AND len(ps))
                OR (mark <> '§' AND n BETWEEN 1 AND len(ls))) AS valid,
            n IS NOT NULL AND ((mark = '§' AND n BETWEEN 1 AND len(ps))
                OR (mark IN ('L', 'l') AND n BETWEEN 1 AND len(ls))) AS found FROM r""",
    "check_timestamp_citations": with_("doc_lines", "sections", also=f"""
        cites AS (SELECT meeting_id, sec_ord, unnest([{_STAMP.format('sec_ord * 7')},
            {_STAMP.format('sec_ord * 7')} || '-' || {_STAMP.format('(sec_ord * 7 + 7)')},
            {_STAMP.format('(sec_ord * 7 + 3)')}, 'L1']) AS citation, unnest([0, 1, 2, 3]) AS cit_ord FROM sections),
        stamped AS (SELECT meeting_id, line_ord, {_STAMP.format('line_ord * 7')} || ' ' || line AS line FROM doc_lines),
        hits AS (SELECT c.meeting_id, sec_ord, cit_ord, arg_min(line, line_ord) AS line
                 FROM cites c JOIN stamped s ON s.meeting_id = c.meeting_id AND contains(line, left(citation, 8))
                 WHERE cit_ord < 3 GROUP BY ALL)""") + f"""
        SELECT c.meeting_id, c.sec_ord, c.cit_ord, citation, -1 AS line_index,
               CASE WHEN c.cit_ord < 3 THEN coalesce({sql_strip('line')}, '') END AS content,
               c.cit_ord < 3 AS valid, line IS NOT NULL AS found
        FROM cites c LEFT JOIN hits h ON h.meeting_id = c.meeting_id AND h.sec_ord = c.sec_ord
             AND h.cit_ord = c.cit_ord""",
    "unsupported_claims": with_("sections", "qa_pairs") + CLAIMS,
    "coverage_chunks": _COVER + """SELECT meeting_id, chunk_ord, chunk, round(score, 6) AS score, score >= 0.5 AS covered
        FROM scored""",
    "coverage_report": _COVER.rstrip() + _REPORT + """
        SELECT meeting_id, total_chunks, uncovered_chunks, round(ratio, 6) AS ratio, ratio >= 0.9 AS ok,
               coalesce(snippets, '') AS snippets FROM report""",
    "fact_check_report": _COVER.rstrip() + _REPORT + f""",
        claims AS ({CLAIMS}),
        ids AS (SELECT meeting_id FROM report UNION SELECT meeting_id FROM sections
                UNION SELECT meeting_id FROM qa_pairs),
        c AS (SELECT meeting_id, count(*) AS issues FROM claims GROUP BY meeting_id),
        s AS (SELECT meeting_id, count(*) AS n FROM sections GROUP BY meeting_id),
        q AS (SELECT meeting_id, count(*) AS n FROM qa_pairs GROUP BY meeting_id)
        SELECT i.meeting_id, coalesce(s.n, 0) AS sections_checked, coalesce(q.n, 0) AS qa_pairs_checked,
               coalesce(issues, 0) AS issues, coalesce(ratio >= 0.9, true) AND coalesce(issues, 0) = 0 AS verified_overall,
               round(coalesce(least(greatest(ratio, 0), 1), CASE WHEN coalesce(s.n, 0) + coalesce(q.n, 0) = 0 THEN 1.0::DOUBLE
                   ELSE greatest(0, 1 - coalesce(issues, 0) / (coalesce(s.n, 0) + coalesce(q.n, 0))) END), 6)
                   AS confidence_score
        FROM ids i LEFT JOIN report r ON r.meeting_id = i.meeting_id LEFT JOIN c ON c.meeting_id = i.meeting_id
        LEFT JOIN s ON s.meeting_id = i.meeting_id LEFT JOIN q ON q.meeting_id = i.meeting_id""",
}

CHECKED_CITATIONS = ORACLE["check_citations"]
