"""Queries on transcript cleaning and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cleaning
from ..sources import exports
from . import inputs
from .inputs import WS_RE, sql_strip, with_

# Fillers of the invented Latin prose; an early short one eats part of a later one.
FILLERS = ("the ", "th", "thing", "eau", "und ")
# Fillers of the derived Han text.
CJK_FILLERS = ("示事", "示事一例", "百例", "例垫")


def unwrap_json_lines(spark, sf):
    return exports.unwrap_json_lines(inputs.exports(spark, sf))


def unwrap_subtitles(spark, sf):
    return exports.unwrap_subtitles(inputs.exports(spark, sf))


def normalize_export(spark, sf):
    return exports.normalize_export(inputs.exports(spark, sf))


def _responses(spark, sf):
    """Every turn as a recogniser's response: wrapped, wrapped without text, or plain."""
    wrapped = F.to_json(F.struct(F.col("text"), F.col("turn_ord").alias("n")))
    return inputs.turns_text(spark, sf).withColumn("text", F.when(
        F.col("speaker") == "user", wrapped).when(
        F.col("speaker") == "system", F.concat(F.lit("{"), F.col("text"))).otherwise(F.col("text")))


def unwrap_asr_text(spark, sf):
    return exports.unwrap_asr_text(_responses(spark, sf)).select("meeting_id", "turn_ord", "text")


def _payloads(spark, sf):
    """One recogniser payload per conversation turn: each of its lines is a segment."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.cast("double").alias("start"), (i + 1).cast("double").alias("end"), x.alias("text")))
    return inputs.turns_text(spark, sf).select(
        (F.col("meeting_id") * 2147483648 + F.col("turn_ord")).alias("recording_id"),
        F.lit(600.0).alias("offset"),
        F.when(F.col("speaker") == "user", F.col("text"))
        .otherwise(F.to_json(F.struct(line.alias("segments")))).alias("payload"))


def parse_asr_segments(spark, sf):
    segments, rejects = exports.parse_asr_segments(_payloads(spark, sf))
    none = F.lit(None)
    return segments.select("recording_id", "seg_ord", F.col("start").alias("seg_start"),
                           F.col("end").alias("seg_end"), "text", none.cast("string").alias("reason")
                           ).unionByName(rejects.select(
                               "recording_id", none.cast("int").alias("seg_ord"),
                               none.cast("double").alias("seg_start"), none.cast("double").alias("seg_end"),
                               none.cast("string").alias("text"), "reason"))


def remove_fillers(spark, sf):
    return inputs.transcripts(spark, sf).select(
        "meeting_id", tx.remove_fillers(F.col("text"), FILLERS).alias("text"))


def _numeral_runs(spark, sf):
    runs = F.regexp_extract_all("text", F.lit(f"[{tx.CN_NUMERAL_CHARS}]+"), F.lit(0))
    return inputs.cjk_transcripts(spark, sf).select(F.explode(runs).alias("run"))


def chinese_numeral(spark, sf):
    runs = _numeral_runs(spark, sf).groupBy("run").agg(F.count("*").alias("n"))
    return runs.select("run", "n", tx.chinese_numeral(F.col("run")).alias("value"))


def normalize_numbers(spark, sf):
    return inputs.cjk_transcripts(spark, sf).select(
        "meeting_id", tx.normalize_numbers(F.col("text")).alias("text"))


def clean(spark, sf):
    labelled = inputs.exports(spark, sf)
    han = F.translate(F.lower("text"), inputs.CJK_FROM, inputs.CJK_TO)
    # Plain texts become Han text with labels; wrapped ones stay readable for the parsers.
    plain = ~(F.col("text").startswith("{") | F.contains("text", F.lit("-->")))
    lines = F.transform(F.split(han, "\n"), lambda x, i: F.concat(
        F.when(i % 3 == 2, "乙:\n").otherwise("甲:\n"), x))
    return cleaning.clean(
        labelled.withColumn("text", F.when(plain, F.array_join(lines, "\n")).otherwise(F.col("text"))),
        fillers=CJK_FILLERS + FILLERS)


def merge_speaker_text(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when(i % 3 == 2, "B:  \n").otherwise("A:\n"), x))
    return inputs.transcripts(spark, sf).select("meeting_id", tx.merge_speaker_text(
        F.array_join(lines, "\n")).alias("text"))


def clock(seconds):
    """``HH:MM:SS`` of a number of seconds, whatever the session's time zone."""
    parts = [F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60]
    return F.concat_ws(":", *[F.lpad(p.cast("int").cast("string"), 2, "0") for p in parts])


def _stamped(c):
    """Every line led by a running clock time."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x, i: F.concat(
        clock(i * 7), F.lit(" "), x)), "\n")


def citation_style(spark, sf):
    d = inputs.table(spark, sf, "documents")
    text = F.when(F.col("lang") == "en", _stamped(F.col("text"))).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("meeting_id"), tx.citation_style(text).alias("citation_style"))


def transcript_type(spark, sf):
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit("?\n"))
    return inputs.transcripts(spark, sf).select(
        "meeting_id", tx.transcript_type(text).alias("transcript_type"))


def size_tier(spark, sf):
    return inputs.transcripts(spark, sf).select("meeting_id", tx.size_tier(F.col("text")).alias("size_tier"))


def context_snippet(spark, sf):
    at = F.instr("text", ",")
    return inputs.transcripts(spark, sf).where(at > 0).select(
        "meeting_id", tx.context_snippet(F.col("text"), at - 1, at + 4).alias("snippet"))


def scripts(spark, sf):
    word = F.explode(F.split("text", " "))
    words = inputs.cjk_transcripts(spark, sf).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", tx.is_han(F.col("word")).alias("han"), tx.has_cjk(F.col("word")).alias("cjk"),
                        tx.same_script(F.col("word"), F.lit("示例")).alias("same"))


def edit_distance(spark, sf):
    p = inputs.table(spark, sf, "part")
    return p.select("p_partkey", tx.edit_distance(F.col("p_name"), F.lit("Blue bolt")).alias("distance"))


def redact_secrets(spark, sf):
    d = inputs.table(spark, sf, "documents")
    key = F.concat(F.lit("\nAPI_KEY = '"), F.md5(F.col("doc_id").cast("string")), F.lit("' sk-"),
                   F.md5("lang"))
    return d.select("doc_id", tx.redact_secrets(F.concat(F.col("text"), key)).alias("text"))


def mask_key(spark, sf):
    o = inputs.table(spark, sf, "orders")
    head = F.when(F.col("o_orderstatus") == "F", "gsk_").when(F.col("o_orderstatus") == "O", "sk-or-").when(
        F.col("o_orderpriority") == "5-LOW", "").otherwise("sk-")
    return o.select("o_orderkey", tx.mask_key(F.concat(head, F.col("o_custkey").cast("string"))).alias("masked"))


def truncate_text(spark, sf):
    return inputs.transcripts(spark, sf).select("meeting_id", tx.truncate_text(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (
    unwrap_json_lines, unwrap_subtitles, normalize_export, unwrap_asr_text, parse_asr_segments,
    remove_fillers, chinese_numeral, normalize_numbers, clean, merge_speaker_text, citation_style,
    transcript_type, size_tier, context_snippet, scripts, edit_distance, redact_secrets, mask_key,
    truncate_text)}

# ------------------------------------------------------------------------ oracle
_DIGIT = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.CN_DIGITS.items()) + " END"
_SMALL = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.CN_SMALL_UNITS.items()) + " END"
_LARGE = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.CN_LARGE_UNITS.items()) + " END"

# Value of every distinct numeral run, one character per recursion level.
NUMERAL_CTES = f"""
    fold AS (
        SELECT run, 0 AS i, 0::BIGINT AS total, 0::BIGINT AS section, 0::BIGINT AS cur FROM runs
        UNION ALL
        SELECT run, i + 1,
            total + CASE WHEN large IS NULL THEN 0
                         WHEN section + cur = 0 THEN large ELSE (section + cur) * large END,
            CASE WHEN small IS NOT NULL THEN section + greatest(cur, 1) * small
                 WHEN large IS NOT NULL THEN 0 ELSE section END,
            CASE WHEN digit IS NOT NULL THEN digit ELSE 0 END
        FROM (SELECT *, {_DIGIT}::BIGINT AS digit, {_SMALL}::BIGINT AS small, {_LARGE}::BIGINT AS large
              FROM (SELECT *, substr(run, i + 1, 1) AS c FROM fold WHERE i < length(run)))),
    numerals AS (SELECT run, nullif(total + section + cur, 0) AS value FROM fold WHERE i = length(run))"""
_RUN2 = f"[{tx.CN_NUMERAL_CHARS}]{{2,}}"


def sql_fillers(expr: str, fillers) -> str:
    for f in fillers:
        expr = f"replace({expr}, '{f}', '')"
    expr = f"regexp_replace({expr}, '  +', ' ', 'g')"
    expr = f"regexp_replace({expr}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(expr)


def numbers_ctes(source: str, extra: str = "meeting_id") -> str:
    """Annotated texts of CTE ``source``: pieces are matched to run values by position."""
    return f"""
    split AS (SELECT {extra}, string_split_regex(text, '{_RUN2}') AS rest,
                     regexp_extract_all(text, '{_RUN2}') AS found FROM {source}),
    runs AS (SELECT DISTINCT unnest(found) AS run FROM split),
    {NUMERAL_CTES.strip()},
    marks AS (SELECT {extra}, i, rest[i] || coalesce(
                  CASE WHEN value IS NULL THEN found[i] ELSE value || '[原:' || found[i] || ']' END, '') AS part
              FROM (SELECT *, unnest(range(1, len(rest) + 1)) AS i FROM split) LEFT JOIN numerals ON run = found[i]),
    numbered AS (SELECT {extra}, string_agg(part, '' ORDER BY i) AS text FROM marks GROUP BY {extra})"""


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: " + sql_strip("x") + "), lambda x: x <> '')"
_JSONL = f"""jsonl AS (
    SELECT meeting_id, text, CASE WHEN len(lines) > 0 AND len(list_filter(lines, lambda x:
            NOT (starts_with(x, '{{') AND json_valid(x)))) = 0
        THEN array_to_string(list_transform(lines, lambda x: CASE WHEN json_valid(x)
            THEN json_extract_string(x, '$.text') END), chr(10)) END AS unwrapped
    FROM (SELECT *, {_LINES} AS lines FROM exports))"""
_SRT = f"""CASE WHEN contains(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '-->') THEN
    array_to_string(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^[0-9]+$')
        AND NOT contains(x, '-->') AND NOT starts_with(x, 'WEBVTT') AND NOT starts_with(x, 'NOTE')), chr(10)) END"""
_EXPORTED = _JSONL + f""",
    exported AS (SELECT meeting_id, CASE WHEN {sql_strip('text')} = '' THEN text
        ELSE coalesce(unwrapped, {_SRT}, text) END AS text FROM jsonl)"""


def speaker_ctes(source: str) -> str:
    """Speaker blocks of labelled texts, by exploding lines (labels are line 1, 3, … here)."""
    return f"""
    ll AS (SELECT meeting_id, i, line, regexp_matches(line, '^[^:]+:{WS_RE}*$') AS is_label
           FROM (SELECT meeting_id, string_split(text, chr(10)) AS ls,
                        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, ls[i] AS line FROM {source})),
    lb AS (SELECT *, sum(is_label::INT) OVER (PARTITION BY meeting_id ORDER BY i) AS b FROM ll),
    bodies AS (SELECT meeting_id, b, {sql_strip("any_value(regexp_replace(line, ':.*$', '')) FILTER (is_label)")} AS name,
                      {sql_strip("string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_label)")} AS body,
                      string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_label) AS raw FROM lb GROUP BY meeting_id, b),
    chained AS (SELECT *, lag(name) OVER (PARTITION BY meeting_id ORDER BY b) IS NOT DISTINCT FROM name AS again
                FROM bodies),
    spoken AS (SELECT meeting_id, string_agg(CASE WHEN b = 0 THEN raw WHEN again THEN coalesce(body, '')
                   WHEN b = 1 THEN name || ':' || chr(10) || coalesce(body, '')
                   ELSE chr(10) || chr(10) || name || ':' || chr(10) || coalesce(body, '') END, '' ORDER BY b) AS text
               FROM chained GROUP BY meeting_id)"""


_KEY_RE = "(?i)(api[_-]?key[''\"]?\\s*[:=]\\s*[''\"]?)[A-Za-z0-9_-]{16,}"

ORACLE = {
    "unwrap_json_lines": with_("exports", also=_JSONL)
    + "SELECT meeting_id, coalesce(unwrapped, text) AS text FROM jsonl",
    "unwrap_subtitles": with_("exports") + f"SELECT meeting_id, coalesce({_SRT}, text) AS text FROM exports",
    "normalize_export": with_("exports", also=_EXPORTED) + "SELECT meeting_id, text FROM exported",
    # The wrapping is undone by construction: every response carries the turn's text.
    "unwrap_asr_text": with_("turns_text") + """SELECT meeting_id, turn_ord,
        CASE WHEN speaker = 'system' THEN '{' || text WHEN speaker = 'user' THEN
        json_extract_string(json_object('text', text, 'n', turn_ord), '$.text') ELSE text END AS text
        FROM turns_text""",
    "parse_asr_segments": with_("turns_text", also=f"""
        l AS (SELECT meeting_id * 2147483648 + turn_ord AS recording_id, i - 1 AS n, {sql_strip('ls[i]')} AS text
              FROM (SELECT *, string_split(text, chr(10)) AS ls,
                    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
                    FROM turns_text WHERE speaker <> 'user'))""") + """
        SELECT recording_id, n::INTEGER AS seg_ord, n + 600.0::DOUBLE AS seg_start, n + 601.0::DOUBLE AS seg_end,
               text, NULL AS reason FROM l WHERE text <> ''
        UNION ALL SELECT meeting_id * 2147483648 + turn_ord, NULL, NULL, NULL, NULL, 'no_segments'
        FROM turns_text WHERE speaker = 'user'""",
    "remove_fillers": with_("transcripts")
    + f"SELECT meeting_id, {sql_fillers('text', FILLERS)} AS text FROM transcripts",
    "chinese_numeral": with_("cjk", recursive=True, also=f"""
        found AS (SELECT unnest(regexp_extract_all(text, '[{tx.CN_NUMERAL_CHARS}]+')) AS run FROM cjk),
        runs AS (SELECT DISTINCT run FROM found),{NUMERAL_CTES},
        counted AS (SELECT run, count(*) AS n FROM found GROUP BY run)""")
    + "SELECT run, n, value FROM counted JOIN numerals USING (run)",
    "normalize_numbers": with_("cjk", recursive=True, also=numbers_ctes("cjk"))
    + "SELECT meeting_id, text FROM numbered",
    "clean": with_("exports", recursive=True, also=(
        f"""labelled AS (SELECT meeting_id, CASE WHEN starts_with(text, '{{') OR contains(text, '-->') THEN text
            ELSE array_to_string(list_transform(string_split(translate(lower(text), '{inputs.CJK_FROM}',
                '{inputs.CJK_TO}'), chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN '乙:' ELSE '甲:' END
                || chr(10) || x), chr(10)) END AS text FROM exports),
        {_EXPORTED.replace("FROM exports)", "FROM labelled)")},
        {speaker_ctes('exported').strip()},
        quiet AS (SELECT meeting_id, {sql_fillers('text', CJK_FILLERS + FILLERS)} AS text FROM spoken),
        {numbers_ctes('quiet').strip()}"""))
    + "SELECT meeting_id, text FROM numbered",
    "merge_speaker_text": with_("transcripts", also="""
        labelled AS (SELECT meeting_id, array_to_string(list_transform(string_split(text, chr(10)),
            lambda x, i: CASE WHEN i % 3 = 0 THEN 'B:  ' ELSE 'A:' END || chr(10) || x), chr(10)) AS text
            FROM transcripts),""" + speaker_ctes("labelled")) + "SELECT meeting_id, text FROM spoken",
    "citation_style": """SELECT doc_id AS meeting_id, CASE WHEN lang = 'en'
        OR regexp_matches(text, '[0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'timestamp' ELSE 'paragraph' END
        AS citation_style FROM documents""",
    "transcript_type": with_("transcripts") + """SELECT meeting_id, CASE WHEN
        len(regexp_extract_all(replace(text, '.' || chr(10), '?' || chr(10)), '[?？]')) * 1000.0
        / greatest(length(text), 1) < 1.5 THEN 'narration' ELSE 'qa' END AS transcript_type FROM transcripts""",
    "size_tier": with_("transcripts") + """SELECT meeting_id, CASE WHEN length(text) < 1000 THEN 'small'
        WHEN length(text) < 5000 THEN 'medium' ELSE 'large' END AS size_tier FROM transcripts""",
    "context_snippet": with_("transcripts") + """SELECT meeting_id, replace(
        text[greatest(p - 12, 1):p - 1] || '【' || text[p:p + 4] || '】' || text[p + 5:p + 16], chr(10), ' ') AS snippet
        FROM (SELECT *, strpos(text, ',') AS p FROM transcripts) WHERE p > 0""",
    "scripts": with_("cjk", also="w AS (SELECT unnest(string_split(text, ' ')) AS word FROM cjk)") + """
        SELECT word, count(*) AS n, regexp_full_match(word, '[\\x{4e00}-\\x{9fff}]+') AS han,
        regexp_matches(word, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{2e80}-\\x{2eff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]') AS cjk,
        regexp_matches(word, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{2e80}-\\x{2eff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]') AS same
        FROM w GROUP BY word""",
    "edit_distance": """SELECT p_partkey, CASE WHEN abs(length(p_name) - 9) > 2 THEN 3
        ELSE levenshtein(lower(p_name), 'blue bolt') END::INTEGER AS distance FROM part""",
    "redact_secrets": f"""SELECT doc_id, regexp_replace(regexp_replace(text || chr(10) || 'API_KEY = ''' ||
        md5(doc_id::VARCHAR) || ''' sk-' || md5(lang), 'sk-[A-Za-z0-9]{{20,}}', 'sk-***', 'g'),
        '{_KEY_RE}', '\\1***', 'g') AS text FROM documents""",
    "mask_key": """SELECT o_orderkey, CASE WHEN head = '' THEN '***' WHEN length(tail) <= 3 THEN head || '***'
        ELSE head || '***' || right(tail, 3) END AS masked FROM (SELECT o_orderkey, o_custkey::VARCHAR AS tail,
        CASE WHEN o_orderstatus = 'F' THEN 'gsk_' WHEN o_orderstatus = 'O' THEN 'sk-or-'
             WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'sk-' END AS head FROM orders)""",
    "truncate_text": with_("transcripts") + """SELECT meeting_id, CASE WHEN length(text) > 100
        THEN left(text, 100) || '... (truncated ' || (length(text) - 100) || ' chars)' ELSE text END AS text
        FROM transcripts""",
}
