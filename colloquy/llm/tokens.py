"""Token counts of sections by the character spans of a document's tokens.

A document is encoded once, as a whole. Each token's span of characters meets
the sections' intervals, and a token that crosses a boundary is allocated by a
rule that the caller names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, RANKS, codec_of, ship
from .common import portions, table

RULES = ("start", "majority", "split")


def characters(raw: np.ndarray) -> np.ndarray:
    """The character that each byte of a text is of."""
    return np.cumsum((raw & 0xC0) != 0x80) - 1


def token_spans(char: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the end (exclusive) of each token, given the tokens' lengths in bytes.

    A character of several bytes may belong to several tokens; each has it in its span.
    """
    end = np.cumsum(lengths)
    return char[end - lengths], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and those of none; sections are ascending and don't overlap.

    start: a token belongs to the section of its first character. majority: to
    the section with most of its characters, the earlier one of equals, and to
    none if more of them lie outside all sections than in any one. split: to each
    section, and to none, by the share of the token's characters.
    """
    n = len(left)
    if not n:
        return np.zeros(0), float(len(start))
    at = np.searchsorted(left, start, side="right") - 1
    k = np.maximum(at, 0)
    inside = (at >= 0) & (start < right[k])
    if rule == "start":
        return np.bincount(at[inside], minlength=n).astype(float), float((~inside).sum())
    last = np.searchsorted(left, end, side="left") - 1  # the last section that starts before the token's end
    whole = inside & (end <= right[k])
    free = ~inside & (last == at)
    counts, outside = np.bincount(at[whole], minlength=n).astype(float), float(free.sum())
    rest = np.flatnonzero(~whole & ~free)
    if not len(rest):
        return counts, outside
    # Each other token with every section that it may touch.
    s, e, k = start[rest], end[rest], k[rest]
    width = last[rest] - k + 1
    row = np.repeat(np.arange(len(rest)), width)
    first = np.cumsum(width) - width
    section = np.arange(len(row)) - first[row] + k[row]
    shared = np.maximum(np.minimum(e[row], right[section]) - np.maximum(s[row], left[section]), 0)
    beyond = (e - s) - np.add.reduceat(shared, first)
    if rule == "split":
        counts += np.bincount(section, shared / (e - s)[row], n)
        return counts, outside + float((beyond / (e - s)).sum())
    most = np.maximum.reduceat(shared, first)
    best = np.flatnonzero(shared == most[row])
    best = best[np.unique(row[best], return_index=True)[1]]
    in_one = most >= beyond
    counts += np.bincount(section[best[in_one]], minlength=n)
    return counts, outside + float((~in_one).sum())


def line_sections(raw: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line with the newline that ends it, in characters."""
    right = np.append(char[np.flatnonzero(raw == 10)] + 1, char[-1] + 1 if len(char) else 0)
    return np.append(0, right[:-1]), right


def attribute(docs: DataFrame, sections: str | None = None, rule: str = "majority", *,
              path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, section, start, end, n_tokens``: one row per section, and one (section -1) for what is in none.

    ``sections`` names a column of ``docs`` with an array of ``start, end`` in
    characters, of sections that don't overlap, in any order; without it the lines
    are the sections. The row of section -1 is there if its count is not 0. The
    rows of a document add up to its tokens. A null text is empty: its lines are
    one empty section. Sections beyond the text have no tokens, null ones are left
    out. A row of ``docs`` that is repeated is counted each time, one without id
    has rows without id; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    key, shipped = ship(docs.sparkSession, path, pattern)

    def of_text(codec, sizes, text: str, given):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = characters(raw)
        left, right = line_sections(raw, char) if given is None else given
        ids = np.frombuffer(codec.encode(text), "<u4")
        counts, outside = allocate(*token_spans(char, sizes[ids]), left, right, rule)
        number = np.arange(len(left))
        return (np.append(number, -1), np.append(left, 0), np.append(right, 0), np.append(counts, outside)) if outside \
            else (number, left, right, counts)

    def lists(texts: pa.Array, given) -> pa.Array:
        codec = codec_of(key, shipped)
        sizes = np.array([len(t) for t in codec.tokens], np.int64)
        found = [of_text(codec, sizes, t, g) for t, g in zip(texts.to_pylist(), given, strict=True)]
        ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
        flat = [np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in range(4)]
        columns = [pa.array(x.astype(np.int32)) for x in flat[:3]] + [pa.array(flat[3].astype(float))]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["section", "start", "end", "n_tokens"]))

    def of_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in portions(texts):
                yield lists(part, [None] * len(part))

    def of_given(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *bounds in batches:
            yield lists(texts, list(zip(*([np.array(x, np.int64) for x in b.to_pylist()] for b in bounds), strict=True)))

    kind = "array<struct<section:int,start:int,end:int,n_tokens:double>>"
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.arrow_udf(of_lines, kind)(text) if sections is None else F.arrow_udf(of_given, kind)(text, *bounds_of(F.col(sections)))
    out = docs.select("doc_id", F.explode(spans).alias("s"))
    count = F.col("s.n_tokens") if rule == "split" else F.col("s.n_tokens").cast("long")
    return out.select("doc_id", "s.section", "s.start", "s.end", count.alias("n_tokens"))


def bounds_of(sections: Column) -> list[Column]:
    """Starts and ends of sections, ascending."""
    plain = F.transform(F.filter(sections, lambda s: s.isNotNull()),
                        lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    known = F.coalesce(F.array_sort(plain), F.array().cast("array<struct<start:long,end:long>>"))
    return [F.transform(known, lambda s: s["start"]), F.transform(known, lambda s: s["end"])]


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, text, sections`` of texts and a table of ``doc_id, start, end``; a document may have none.

    Rows without id belong together.
    """
    own = sections.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("sections"))
    return docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")


def op8_tokens(spark, sf_dir) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_tokens": op8_tokens}
