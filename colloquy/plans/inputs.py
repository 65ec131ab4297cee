"""Library inputs derived from the given tables, in Spark and as DuckDB CTEs.

The given tables hold no Chinese text, no recordings and no minutes. Each
function derives one input table by a deterministic expression over a whole
given table; ``SQL`` holds the same derivation as common table expressions for
the oracle. ``with_(...)`` composes the CTEs a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE

# Letters turned into Han characters: numerals, and homophones of the pinyin rows.
CJK_FROM = "aeiouthnrlsdm"
CJK_TO = "一三百千万示事例立力电垫子"

# Inline dimension: a few homophone groups.
PINYIN_GROUPS = {"shi": "示事世市", "li": "例立力利", "dian": "电垫店点", "zi": "子字资紫",
                 "liu": "流留六刘", "pian": "片篇偏便"}
SPEAKERS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


# Tables whose rows are long texts, with the key they are spread by if need be.
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A local session spreads a text table over its threads, as
    its small files are one row group each; a cluster reads it as it is split.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_KEYS and spark.sparkContext.master.startswith("local["):
        turn = ["turn"] if name == "conversations" else []
        df = df.repartition(spark.sparkContext.defaultParallelism, TEXT_KEYS[name], *turn)
    return df


def transcripts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), "text")


def cjk_transcripts(spark, sf_dir) -> DataFrame:
    return transcripts(spark, sf_dir).withColumn(
        "text", F.translate(F.lower("text"), CJK_FROM, CJK_TO))


def exports(spark, sf_dir) -> DataFrame:
    """Documents as recognisers export them: JSON lines, subtitles or plain text."""
    lines = F.split("text", "\n")
    as_json = F.array_join(F.transform(lines, lambda x: F.to_json(F.struct(x.alias("text")))), "\n")
    as_srt = F.array_join(F.transform(lines, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), x, F.lit("\n"))), "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("meeting_id"),
        F.when(F.col("lang") == "en", as_json).when(F.col("lang") == "de", as_srt)
        .when(F.col("lang") == "es", F.concat(as_json, F.lit("\nnot json")))
        .otherwise(F.col("text")).alias("text"))


def turns_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("turn_ord"),
        F.col("role").alias("speaker"), "text")


def _event_seconds():
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.lit("2024-01-01").cast("timestamp"))
    return micros / F.lit(6.0e8)


def segments(spark, sf_dir) -> DataFrame:
    """Events as recognised segments; a user is a recording, time runs 600 times faster."""
    t = _event_seconds()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_id").cast("int").alias("seg_ord"),
        t.alias("start"), (t + 5.0 + F.col("value") / 10.0).alias("end"),
        F.when(F.col("value") < 5.0, " ").otherwise(
            F.concat(F.lit(" "), "event_type", F.lit("."))).alias("text"))


def turns(spark, sf_dir) -> DataFrame:
    """Events as diarization turns, a little later than the segments."""
    t = _event_seconds() + 3.0
    speaker = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_id").cast("int").alias("turn_ord"),
        t.alias("start"), (t + F.col("value") / 5.0).alias("end"),
        F.element_at(speaker, F.col("event_type")).alias("speaker"))


def doc_lines(spark, sf_dir) -> DataFrame:
    return transcripts(spark, sf_dir).select(
        "meeting_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))


def sections(spark, sf_dir) -> DataFrame:
    """Lines with a comma become the sections of their document's minutes."""
    n = F.col("line_ord")
    cites = F.when(F.length("line") < 200, F.array().cast("array<string>")).otherwise(F.array(
        F.concat(F.lit("§"), (n + 1).cast("string")), F.concat(F.lit("L"), (n * 2 + 1).cast("string")),
        F.lit("×2"), F.concat(F.lit("line "), n.cast("string"))))
    return doc_lines(spark, sf_dir).where(F.contains("line", F.lit(","))).select(
        "meeting_id", n.alias("sec_ord"), F.substring("line", 1, 12).alias("title"),
        F.col("line").alias("content"), cites.alias("citations"))


def qa_pairs(spark, sf_dir) -> DataFrame:
    """A user turn and the assistant turn that follows it."""
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("int"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("qa_ord"), "question", "answer",
        F.lit("").alias("asker"), F.lit("interviewer").alias("asker_role"), F.lit("").alias("timerange"))


def blocks(spark, sf_dir) -> DataFrame:
    """Lines of a document as topic blocks named after the line's first letters."""
    return doc_lines(spark, sf_dir).select(
        "meeting_id", F.floor(F.col("line_ord") / 4).cast("int").alias("chunk_ord"),
        (F.col("line_ord") % 4).alias("block_ord"),
        F.when(F.col("line").endswith(".") & (F.length("line") < 60), "qa").otherwise("narration").alias("type"),
        F.concat((F.col("line_ord") + 1).cast("string"), F.lit(". "), F.lower(F.substring("line", 1, 1)))
        .alias("topic"),
        F.col("line").alias("text"))


def pinyin(spark) -> DataFrame:
    rows = [(ch, syl, True, ord(ch)) for syl, group in PINYIN_GROUPS.items() for ch in group]
    return spark.createDataFrame(rows, "ch string, syllable string, common boolean, cp int")


# --------------------------------------------------------------------- oracle
WS_SQL = WHITESPACE  # contains no quote: safe inside a SQL string
WS_RE = ("[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
         "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def sql_strip(expr: str) -> str:
    return f"trim({expr}, '{WS_SQL}')"


_T = "(epoch_us(ts) - 1704067200000000) / 6.0e8::DOUBLE"

SQL = {
    "transcripts": "SELECT doc_id AS meeting_id, text FROM documents",
    "cjk": f"SELECT doc_id AS meeting_id, translate(lower(text), '{CJK_FROM}', '{CJK_TO}') AS text "
           "FROM documents",
    "exports": """SELECT doc_id AS meeting_id, CASE
        WHEN lang IN ('en', 'es') THEN array_to_string(list_transform(string_split(text, chr(10)),
            lambda x: '{"text":' || to_json(x)::VARCHAR || '}'), chr(10))
            || CASE WHEN lang = 'es' THEN chr(10) || 'not json' ELSE '' END
        WHEN lang = 'de' THEN array_to_string(list_transform(string_split(text, chr(10)),
            lambda x, i: i::VARCHAR || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || x || chr(10)),
            chr(10))
        ELSE text END AS text FROM documents""",
    "turns_text": "SELECT conv_id AS meeting_id, turn::INTEGER AS turn_ord, role AS speaker, text "
                  "FROM conversations",
    "segments": f"""SELECT user_id AS recording_id, event_id::INTEGER AS seg_ord, {_T} AS s0,
        {_T} + 5.0::DOUBLE + value / 10.0::DOUBLE AS s1,
        CASE WHEN value < 5.0 THEN ' ' ELSE ' ' || event_type || '.' END AS text FROM events""",
    "turns": f"""SELECT user_id AS recording_id, event_id::INTEGER AS turn_ord,
        {_T} + 3.0::DOUBLE AS t0, {_T} + 3.0::DOUBLE + value / 5.0::DOUBLE AS t1,
        CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SPEAKERS.items())} END AS speaker
        FROM events""",
    "doc_lines": """SELECT meeting_id, i - 1 AS line_ord, lines[i] AS line FROM (
        SELECT doc_id AS meeting_id, string_split(text, chr(10)) AS lines,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
    "sections": """SELECT meeting_id, line_ord::INTEGER AS sec_ord, left(line, 12) AS title, line AS content,
        CASE WHEN length(line) < 200 THEN []::VARCHAR[] ELSE
        ['§' || (line_ord + 1), 'L' || (line_ord * 2 + 1), '×2', 'line ' || line_ord] END AS citations
        FROM doc_lines WHERE contains(line, ',')""",
    "qa_pairs": """SELECT q.conv_id AS meeting_id, q.turn::INTEGER AS qa_ord, q.text AS question,
        a.text AS answer, '' AS asker, 'interviewer' AS asker_role, '' AS timerange
        FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
        WHERE q.role = 'user' AND a.role = 'assistant'""",
    "blocks": """SELECT meeting_id, (line_ord // 4)::INTEGER AS chunk_ord, (line_ord % 4)::INTEGER AS block_ord,
        CASE WHEN suffix(line, '.') AND length(line) < 60 THEN 'qa' ELSE 'narration' END AS type,
        (line_ord + 1) || '. ' || lower(left(line, 1)) AS topic, line AS text FROM doc_lines""",
    "pinyin": "SELECT * FROM (VALUES " + ", ".join(
        f"('{ch}', '{syl}', {ord(ch)})" for syl, g in PINYIN_GROUPS.items() for ch in g)
        + ") p(ch, syllable, cp)",
}
_NEEDS = {"sections": ["doc_lines"], "blocks": ["doc_lines"]}


def with_(*names: str, recursive: bool = False, also: str = "") -> str:
    """``WITH`` clause of the named derivations, then of ``also``."""
    ordered: list[str] = []
    for n in names:
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in ordered:
                ordered.append(dep)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered]
    if also:
        parts.append(also.strip().rstrip(","))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
