r"""Conversations as training texts, by Spark expressions only.

The turns of a conversation are collected, sorted and written as

    <turn>role<says>text</turn>

one after the other. Adjacent turns of the same role share one block, in which
``<also>`` parts their texts. A backslash in a role or text is doubled and one is
put behind the ``<`` of what reads like a control string, so that a control
string in the output is always the template's own.

A long conversation is collected by pieces of ``PIECE`` turn numbers first. A
piece has no end marks: they depend on its neighbours and are put in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURN, SAYS, ALSO, END = "<turn>", "<says>", "<also>", "</turn>"
LOSS_ROLES = ("assistant",)
PIECE = 256


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(turn|says|also|/turn)>", r"<\\$1>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def blocks_of(turns: Column) -> Column:
    """Sorted turns (``role, text``) as blocks of ``role, texts``: adjacent turns of a role are one."""
    role = lambda i: F.get(turns, i)["role"]
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(at, lambda i: (i == 0) | ~role(i).eqNullSafe(role(i - 1)))
    return F.transform(starts, lambda i, k: F.struct(role(i).alias("role"), F.transform(
        F.slice(turns, i + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - i), lambda t: t["text"]).alias("texts")))


def parts_of(blocks: Column, loss_roles: tuple[str, ...]) -> Column:
    """Blocks as parts ``text, loss`` of the output, without the mark before the first and after the last text."""
    learnt = lambda b: b["role"].isin(*loss_roles)
    mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    opening = lambda b, k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit(END + TURN), escaped(b["role"]), F.lit(SAYS)))
    said = lambda b, k: F.transform(b["texts"], lambda t, i: F.array(
        mark(F.when(i == 0, opening(b, k)).otherwise(F.lit(ALSO))), F.struct(escaped(t).alias("text"), learnt(b).alias("loss"))))
    return F.filter(F.flatten(F.flatten(F.transform(blocks, said))), lambda p: (p["text"] != "") | p["loss"])


def pieces(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, piece, first_role, last_role, n_turns, parts``: conversations cut at every ``PIECE`` turn numbers.

    ``parts`` joined give the piece's text; it begins in the block of its first
    and ends in that of its last role.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Null turns come first, so do their pieces.
    piece = F.floor(F.col("turn") / PIECE)
    turns = rows.groupBy("conv_id", piece.alias("piece")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    blocked = turns.select("conv_id", "piece", F.size("turns").cast("long").alias("n_turns"), blocks_of(F.col("turns")).alias("blocks"))
    return blocked.select("conv_id", "piece", F.col("blocks")[0]["role"].alias("first_role"),
                          F.element_at("blocks", -1)["role"].alias("last_role"), "n_turns", parts_of(F.col("blocks"), loss_roles).alias("parts"))


def formatted(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, n_turns, parts, formatted``, one row per conversation.

    ``formatted`` is the text, ``parts`` its parts in order with their loss mask:
    escaped texts of ``loss_roles`` carry it, marks and other texts don't. Turns
    are ordered by turn (nulls first), equal ones by role and text. Null roles and
    texts are empty ones; rows without conv_id are one conversation. Other columns
    are not read. A conversation has to fit into a row; ``pieces`` need not.
    """
    parts = pieces(conversations, loss_roles).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("piece", "first_role", "last_role", "parts"))).alias("pieces"))
    p = F.col("pieces")
    opening = lambda x: F.concat(F.lit(TURN), escaped(x["first_role"]), F.lit(SAYS))
    seam = lambda x, i: (F.when(i == 0, opening(x)).when(x["first_role"] == F.get(p, i - 1)["last_role"], F.lit(ALSO))
                         .otherwise(F.concat(F.lit(END), opening(x))))
    mark = lambda s: F.array(F.struct(s.alias("text"), F.lit(False).alias("loss")))
    joined = F.concat(F.flatten(F.transform(p, lambda x, i: F.concat(mark(seam(x, i)), x["parts"]))), mark(F.lit(END)))
    out = parts.select("conv_id", "n_turns", joined.alias("parts"))
    return out.withColumn("formatted", F.array_join(F.transform("parts", lambda x: x["text"]), ""))


def read_back(text: Column) -> Column:
    """Turns (``role, text``) of a formatted text."""
    def turns(block):
        role = F.split_part(block, F.lit(SAYS), F.lit(1))
        texts = F.split(F.substring(block, F.length(role) + len(SAYS) + 1, F.length(block)), ALSO, -1)
        role = unescaped(F.substring(role, len(TURN) + 1, F.length(role)))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split(text, END, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def digests(out: DataFrame) -> DataFrame:
    """Counts and digests of ``formatted`` conversations, read back from their texts and masks."""
    read = out.select("conv_id", "parts", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    learnt = F.array_join(F.transform(F.filter("parts", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       learnt.alias("learnt"), "formatted_chars")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op12_chat(spark, sf_dir) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(formatted(given.unionByName(trap)))


QUERIES = {"op12_chat": op12_chat}
ORACLE = {"op12_chat": r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    l AS (SELECT *, lag(role) OVER w AS above,
        length(regexp_replace(replace(text, '\', '\\'), '<(turn|says|also|/turn)>', '<x\1>', 'g')) AS n_text,
        length(regexp_replace(replace(role, '\', '\\'), '<(turn|says|also|/turn)>', '<x\1>', 'g')) AS n_role,
        row_number() OVER w AS pos
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
        sum(n_text + CASE WHEN above = role THEN 6 ELSE 19 + n_role END)::BIGINT AS formatted_chars
    FROM l GROUP BY conv_id"""}
