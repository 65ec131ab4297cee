"""Fill-in-middle examples: a text is cut at two code points and its parts change places.

The cuts are found by arithmetic on words of eight bytes. A word's bytes that end
a code point are marked, the marks are counted per word, a search in the running
counts finds the word of a cut, and a product of the marks finds the byte in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
PORTION = 4 << 20  # bytes that are marked at a time

LOW = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
BYTE, TOP = np.uint64(8), np.uint64(56)


class Units:
    """Counts and finds the code points of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
        padded[:len(data)] = data
        w = padded.view("<u8")
        first = ~((w >> np.uint64(7)) & ~(w >> np.uint64(6))) & LOW  # bytes that don't continue a code point
        # A byte ends a code point if the next byte starts one; zeros follow the last.
        self.ends = (first >> BYTE) | (np.append(first[1:], np.uint64(1)) & np.uint64(1)) << TOP
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before each byte offset."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7).astype(np.uint64) * BYTE)) - np.uint64(1)
        here = self.ends[word]
        return self.upto[word] - np.bitwise_count(here) + np.bitwise_count(here & below)

    def end_of(self, nth: np.ndarray) -> np.ndarray:
        """Byte offset after the nth code point, counted from 1."""
        word = np.searchsorted(self.upto, nth)
        here = self.ends[word]
        rank = (nth - self.upto[word] + np.bitwise_count(here)).astype(np.uint64)
        # Byte i of the product has the marks of bytes 0 to i; its high bit stays set where they reach the rank.
        reached = ((here * LOW | HIGH) - rank * LOW) & HIGH
        return word * 8 + 9 - np.bitwise_count(reached)


def cut_points(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: number of code points, and of the two cuts code points and byte offsets.

    The cuts come after ``one`` and ``two`` modulo the number plus one, the smaller first.
    """
    units = Units(data)
    ended = units.before(offsets)
    n = np.diff(ended)
    a, b = one % (n + 1), two % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    places = [np.where(k > 0, units.end_of(np.maximum(ended[:-1] + k, 1)), offsets[:-1]) for k in (low, high)]
    return n, low, high, *places


def portions(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PORTION bytes; a longer text is one by itself."""
    i, last = 0, len(offsets) - 1
    while i < last:
        j = min(last, max(i + 1, int(np.searchsorted(offsets, offsets[i] + PORTION, side="right")) - 1))
        yield i, j
        i = j


def cut_array(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> pa.StructArray:
    """``n, low, high, prefix, middle, suffix`` of each text; the three parts share the bytes of the texts."""
    texts = texts.cast(pa.large_string())
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + size + 1] if size else np.zeros(1, np.int64)
    bytes_ = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(bytes_, np.uint8)
    n, low, high = (np.zeros(size, np.int64) for _ in range(3))
    marks = np.empty(3 * size + 1, np.int64)
    marks[0::3] = offsets
    for i, j in portions(offsets):
        base = offsets[i]
        n[i:j], low[i:j], high[i:j], first, second = cut_points(
            data[base:offsets[j]], offsets[i:j + 1] - base, one[i:j], two[i:j])
        marks[3 * i + 1:3 * j:3], marks[3 * i + 2:3 * j:3] = first + base, second + base
    parts = pa.LargeStringArray.from_buffers(3 * size, pa.py_buffer(marks), bytes_)
    columns = [pa.array(x) for x in (n, low, high)] + [parts.take(pa.array(np.arange(k, 3 * size, 3))).cast(pa.string()) for k in range(3)]
    return pa.StructArray.from_arrays(columns, ["n", "low", "high", "prefix", "middle", "suffix"])


def cut(text: Column, one: Column, two: Column) -> Column:
    """``cut_array`` as a column; none of the three may be null."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            yield cut_array(texts, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "n long, low long, high long, prefix string, middle string, suffix string")(text, one, two)


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2^32 by the hash of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, *, seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with ``fim_n``, ``fim_form``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_output``.

    ``fim_form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). Empty texts and those that hold a marker stay plain.
    A null text is an empty one. Equal ids are cut at equal draws. Columns of these
    names are replaced, all others stay; no row moves to another machine.
    """
    names = ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    p, s, m = MARKERS
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two, plain, order = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m))
    form = (F.when((text == "") | marked | (plain % 100 >= plain_from), "plain")
            .when(order % 100 < spm_below, "spm").otherwise("psm"))
    # One struct, so that no column of docs can clash with a column that only serves here.
    out = docs.select(F.struct(*kept, form.alias("fim_form")).alias("d"), text.alias("t"), cut(text, one, two).alias("c"))
    kind, whole = F.col("d.fim_form"), F.col("d.fim_form") == "plain"
    output = (F.when(whole, F.col("t"))
              .when(kind == "psm", F.concat(F.lit(p), "c.prefix", F.lit(s), "c.suffix", F.lit(m), "c.middle"))
              .otherwise(F.concat(F.lit(s), "c.suffix", F.lit(p), "c.prefix", F.lit(m), "c.middle")))
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns if c not in names], F.col("c.n").alias("fim_n"), kind.alias("fim_form"),
                      F.when(~whole, F.col("c.low")).alias("fim_prefix_chars"),
                      F.when(~whole, F.col("c.high") - F.col("c.low")).alias("fim_middle_chars"), output.alias("fim_output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "|".join(MARKERS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op13_infill(spark, sf_dir) -> DataFrame:
    out = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
                      F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"))


QUERIES = {"op13_infill": op13_infill}
ORACLE = {"op13_infill": """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    d AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
               ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p"""}
