"""Deletion of repeated runs of lines by winnowing over line hashes.

A gram is the shortest run of lines from a line on that has GRAM words. Each
run of lines with WINDOW words selects the gram with the smallest hash inside
it; both depend on the run alone, so that every repeated run of WINDOW words has
a selected gram in all its places. A selected gram meets the first place of its
hash, the match is extended both ways, and the run is deleted in the later place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, packed, settled, table, unpacked

GRAM = 40
WINDOW = 50


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line; white space at its ends doesn't count."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.strip()) for x in lines), np.uint64, len(lines))
    return h.view(np.int64), np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def ends(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end of the shortest run from it with ``least`` words; beyond the last line if there is none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(upto, upto[:-1] + least, side="left")


def winnow(hashes: np.ndarray, words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """``position, hash`` of the selected grams."""
    n = len(hashes)
    gram_end, window_end = ends(words, gram).tolist(), ends(words, window).tolist()
    data, grams = memoryview(hashes.tobytes()), [0] * n
    out, nearest, added, last = [], deque(), 0, -1
    for i in range(n):
        if window_end[i] > n:
            break
        while added < n and gram_end[added] <= window_end[i]:
            grams[added] = xxhash.xxh3_64_intdigest(data[8 * added:8 * gram_end[added]])
            # of equal grams the later one is selected
            while nearest and grams[nearest[-1]] >= grams[added]:
                nearest.pop()
            nearest.append(added)
            added += 1
        while nearest[0] < i:
            nearest.popleft()
        if nearest[0] != last:
            last = nearest[0]
            out.append((last, grams[last] - (1 << 64) if grams[last] >> 63 else grams[last]))
    return out


def extended(own: np.ndarray, other: np.ndarray, places: list[tuple[int, int]], same: bool) -> list[tuple[int, int]]:
    """Runs of ``own`` that go on equal to ``other`` from matching places, each once.

    Within one document a run may overlap the earlier one that it repeats.
    """
    out, covered = [], {}
    for p, q in sorted(places):
        if covered.get(p - q, -1) > p:  # inside the last run of this shift
            continue
        a, b = p, p
        while a > 0 and a - 1 - p + q >= 0 and own[a - 1] == other[a - 1 - p + q]:
            a -= 1
        while b < len(own) and b - p + q < len(other) and own[b] == other[b - p + q]:
            b += 1
        covered[p - q] = b
        if b > a and not (same and p <= q):
            out.append((a, b))
    return out


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, h, runs``: for documents with repeated runs, the lines from ``start`` to before ``end``.

    A document is a doc_id with the hash ``h`` of its text. Documents are ordered by
    doc_id (null first), then ``h``. Every line deleted has an equal line in an
    earlier place that is part of an equal run of at least ``gram`` words.
    """

    def fingerprint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["text"]:
                hashes, words = line_hashes(t.split("\n"))
                chosen = winnow(hashes, words, gram, window)
                rows.append((hashes if chosen else hashes[:0], [{"pos": p, "gram": g} for p, g in chosen]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "h": f["h"], "lines": [r[0] for r in rows], "grams": [r[1] for r in rows]})

    # doc_id stays null where it is null
    named = docs.where("text is not null").select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    marked = settled(named.mapInPandas(fingerprint, "doc_id string, h long, lines array<long>, grams array<struct<pos:int,gram:long>>")
                     .where("size(grams) > 0").withColumn("key", F.struct(F.col("doc_id").cast("long").alias("d"), "h"))
                     .select("key", "lines", "grams"))
    places = marked.select("key", F.explode("grams").alias("g")).select("key", "g.pos", "g.gram")
    first = places.groupBy("gram").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = places.join(first, "gram").where(F.struct("key", "pos") > F.col("first"))
    pairs = later.groupBy("key", F.col("first.key").alias("other")).agg(
        F.collect_list(F.struct("pos", F.col("first.pos").alias("from"))).alias("places"))
    hashes = marked.select("key", "lines").dropDuplicates(["key"])
    both = pairs.join(hashes, "key").join(hashes.select(F.col("key").alias("other"), F.col("lines").alias("source")), "other")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            runs = [[{"start": a, "end": b} for a, b in extended(own, src, [(p["pos"], p["from"]) for p in places], bool(same))]
                    for own, src, places, same in zip(f["lines"], f["source"], f["places"], f["same"], strict=True)]
            yield pd.DataFrame({"d": f["d"], "h": f["h"], "runs": runs})

    flat = both.select(F.col("key.d").cast("string").alias("d"), F.col("key.h").alias("h"), "lines", "source", "places",
                       F.col("key").eqNullSafe(F.col("other")).alias("same"))
    runs = flat.mapInPandas(extend, "d string, h long, runs array<struct<start:int,end:int>>")
    return runs.groupBy("d", "h").agg(F.flatten(F.collect_list("runs")).alias("runs")) \
        .select(F.col("d").cast("long").alias("doc_id"), "h", "runs").where("size(runs) > 0")


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` without later repeated runs, and ``n_lines``, ``n_removed``.

    ``text`` loses the lines of the runs; other columns stay (columns with these
    two names are replaced). A null text stays null, with no lines. Rows that
    repeat a doc_id and its text are one document and get the same result.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), gram, window).select(
        F.col("doc_id").alias("run_doc"), F.col("h").alias("run_h"), "runs")
    joined = packed(docs).join(
        runs, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("run_doc")) & (F.col("h") == F.col("run_h")), "left")
    text = F.col("doc.text")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["end"])))
    out = joined.withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    cut = F.col("kept").isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(cut, F.size(lines) - F.size("kept")).otherwise(0).cast("long")
    columns = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    return out.select(*unpacked(columns, text=F.when(cut, F.array_join("kept", "\n")).otherwise(text)),
                      n_lines.alias("n_lines"), removed.alias("n_removed"))


def without_repeats(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` without later repeated runs. A document of which no word is left goes too; ``n_chars`` follows the text."""
    # Its counts go by the text, so that a column of the same name stays.
    out = dedup_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text"), gram, window)
    out = out.where((F.col("n_removed") == 0) | F.rlike("text", F.lit(WORD)))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(length, F.col("doc.n_chars"))
    return out.select(*unpacked(docs, **changed))


def op9_lines(spark, sf_dir) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op9_lines": op9_lines}
