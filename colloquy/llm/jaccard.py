"""Similarity join of documents on word shingles by chosen paths.

A document's set of shingles is represented by min-hash values, one for each
coordinate. A run of the join chooses a few coordinates and puts documents with
the same value there into a bucket; a bucket that is too large chooses
coordinates again, by its own path, and is split further. Small buckets compare
their members by sketches. The runs repeat until pairs at the least similarity
are found with the target recall. What the runs connect is then compared
exactly on the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, components, packed, roots, settled, table, unpacked

SHINGLE = 5
LEAST = 0.8
RECALL = 0.999
COORDINATES = 64
# Larger buckets are split; after DEPTH choices a bucket's members are candidates of its first one.
BUCKET = 32
DEPTH = 3
BLOCK = 1024
SEED = 6
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, remembered; the memory is emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of ``size`` neighbouring words; a shorter text is one shingle, an empty one none."""
    # Of bytes, split() knows just the six separators of ASCII.
    parts = text.encode("utf-8", "surrogatepass").split()
    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = min(size, len(w))
    if n == 0:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i:i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(sh: np.ndarray) -> np.ndarray:
    """The least permuted hash for each coordinate."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), 4096):
        best = np.minimum(best, ((sh[None, at:at + 4096] ^ _XOR) * _ODD).min(axis=1))
    return best & np.uint64(0xFFFFFFFF)


def sketch(mins: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, 16 in a word."""
    nibbles = (mins & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)


def print_of(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_intdigest(sh.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(d >> 64), signed(d & ((1 << 64) - 1))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp1, fp2, mins, sk`` of each document, ``h`` the hash of its text; one without words has nulls."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for f in frames:
            rows = []
            for t in f["text"]:
                sh = shingles(t, known) if isinstance(t, str) else ()
                if len(sh):
                    m = minima(sh)
                    rows.append((*print_of(sh), m.astype(np.uint32).view(np.int32), sketch(m)))
                else:
                    rows.append((None, None, None, None))
            # As nullable integers from the start: next to a null, plain ones would lose digits.
            fp1, fp2 = (pd.array([r[i] for r in rows], dtype="Int64") for i in (0, 1))
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "h": f["h"].array, "fp1": fp1, "fp2": fp2,
                                "mins": [r[2] for r in rows], "sk": [r[3] for r in rows]})

    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    out = named.mapInPandas(sign, "doc_id string, h long, fp1 long, fp2 long, mins array<int>, sk array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def runs_for(recall: float, least: float) -> int:
    """How many coordinates in all leave at most 1 - recall of the pairs at the least similarity without a shared bucket.

    A pair shares a coordinate's bucket with probability ``least``, and stays
    together on a path of up to DEPTH choices with at least a third of that.
    """
    together = least / 3
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def differing(a: Column, b: Column) -> Column:
    """In how many coordinates two sketches differ."""
    total = F.lit(0)
    for i in range(COORDINATES // 16):
        x = a[i].bitwiseXOR(b[i])
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        total = total + F.bit_count(y.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def candidates(sets: DataFrame, least: float, recall: float) -> DataFrame:
    """``a, b``: pairs of ``id`` that connect all whose sets are similar; ``sets`` has ``id, mins, sk``."""
    first = np.random.default_rng(SEED + 1).choice(COORDINATES, min(COORDINATES, runs_for(recall, least)), replace=False)
    nodes = sets.select("id", F.explode(F.array(*[
        F.xxhash64(F.lit(int(c)), F.get("mins", F.lit(int(c)))) for c in first])).alias("node"))
    # Sketches of pairs at the least similarity differ in more coordinates than this once in 30 000 times.
    mean = COORDINATES * (1 - least) * 15 / 16
    far = math.ceil(mean + 4 * math.sqrt(mean))
    out = None
    for depth in range(1, DEPTH + 1):
        size = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
        members = settled(nodes.join(size, "node"))
        small = members.where(F.col("n") <= BUCKET).select("id", "node").join(sets.select("id", "sk"), "id")
        pair = small.alias("x").join(small.alias("y"), "node").where("x.id < y.id") \
            .where(differing(F.col("x.sk"), F.col("y.sk")) <= far).select(F.col("x.id").alias("b"), F.col("y.id").alias("a"))
        out = pair if out is None else out.unionByName(pair)
        large = members.where(F.col("n") > BUCKET)
        if depth == DEPTH:
            return out.unionByName(large.where("id <> head").select(F.col("head").alias("b"), F.col("id").alias("a"))).distinct()
        # On average 1 / least coordinates for each path, chosen by the path; one at least. The
        # minima of a document travel once, to all its paths.
        odds = int((1 << 20) / (least * COORDINATES))
        chosen = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
                          lambda c: F.pmod(F.xxhash64("node", c), F.lit(1 << 20)) < odds)
        one = F.array(F.pmod(F.xxhash64("node"), F.lit(COORDINATES)).cast("int"))
        paths = large.groupBy("id").agg(F.collect_list("node").alias("paths")).join(sets.select("id", "mins"), "id")
        nodes = paths.select("id", "mins", F.explode("paths").alias("node")) \
            .select("id", "mins", "node", F.explode(F.when(F.size(chosen) > 0, chosen).otherwise(one)).alias("c")) \
            .select("id", F.xxhash64("node", "c", F.get("mins", F.col("c"))).alias("node"))


def verified(docs: DataFrame, members: DataFrame, least: float, total: int) -> DataFrame:
    """``a, b, n, whole`` of exact comparisons within groups.

    ``members`` has ``id, doc_id, fp1, fp2, times, grp, rows``, and ``total`` rows. Links of ``a``
    come to ``n`` more documents, and ``b`` is linked with it; if ``whole``, the
    group was in one task, and ``b`` is the smallest id that links reach.
    """
    named = members.withColumnRenamed("doc_id", "_doc")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(named, F.col("doc_id").eqNullSafe(F.col("_doc")))
    dealt = block_pairs(rows.select("id", "text", "fp1", "fp2", "times", "grp", "rows"), "grp", "id", "rows", BLOCK, total)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        known, out = WordHashes(), []
        for (_, i, j), part in g.groupby(["grp", "i", "j"], sort=False):
            ids, times, blk, sets, seen = [], [], [], [], set()
            for r in part.sort_values("id", kind="stable").itertuples():
                if r.id in seen or not isinstance(r.text, str):
                    continue
                sh = shingles(r.text, known)
                if print_of(sh) == (r.fp1, r.fp2):  # not another text under the same doc_id
                    seen.add(r.id), ids.append(r.id), times.append(r.times), blk.append(r.blk), sets.append(sh)
            if len(ids) < 2:
                continue
            size = np.array([len(s) for s in sets])
            _, column, times_seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, both = np.repeat(np.arange(len(ids)), size), np.zeros((len(ids), len(ids)))
            # A shingle that one set alone has is in no intersection.
            shared = times_seen > 1
            keep, place = shared[column], np.cumsum(shared) - 1
            row, column = row[keep], place[column[keep]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            for at in range(0, int(shared.sum()), 4096):
                lo, hi = np.searchsorted(column, [at, at + 4096])
                has = np.zeros((len(ids), 4096), np.float32)
                has[row[lo:hi], column[lo:hi] - at] = 1
                both += has @ has.T
            near = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(near, False)
            blk, ids = np.array(blk), np.array(ids)
            counted = near & (blk[:, None] != blk[None, :]) if i != j else near
            some = near.any(axis=1)
            out.append(pd.DataFrame({"a": ids, "b": ids[roots(near)], "n": counted @ np.array(times), "whole": part["rows"].iloc[0] <= size_of_task})[some])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": [], "whole": []}).astype(
            {"a": "int64", "b": "int64", "n": "int64", "whole": bool})

    size_of_task = BLOCK

    return dealt.select("task", "grp", "i", "j", "blk", "id", "text", "fp1", "fp2", "times", "rows").groupBy("task").applyInPandas(
        compare, "a long, b long, n long, whole boolean")


def similar(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``doc_id, h, class_id, n_links, kept``, one row per row of ``docs``; ``h`` is the hash of the text.

    Documents link when the Jaccard similarity of their shingles is ``least`` or
    more. ``n_links`` counts the other documents linked directly; ``class_id`` is
    the smallest doc_id reached by links, and that document is kept. Documents
    with equal sets are one set that counts several times. Texts without words
    link with nothing. Of rows that repeat a doc_id and text each is kept or none.
    """
    signed = settled(signatures(docs.select("doc_id", "text")))
    sets = settled(signed.where("fp1 is not null").groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), F.first("mins").alias("mins"), F.first("sk").alias("sk"))
        .withColumn("id", F.monotonically_increasing_id()))
    group = components(candidates(sets, least, recall))
    grouped = settled(group.unionByName(group.select(F.col("component").alias("node"), "component").distinct()))
    sized = grouped.join(grouped.groupBy("component").agg(F.count("*").alias("rows")), "component")
    members = sets.select("id", "doc_id", "fp1", "fp2", "times").join(
        sized.select(F.col("node").alias("id"), F.col("component").alias("grp"), "rows"), "id")
    found = settled(verified(docs, members, least, grouped.count()))
    direct = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    reached = found.where("whole and a <> b").select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        components(found.where("not whole").select("a", "b")).withColumnRenamed("node", "id"))
    info = sets.select("id", "fp1", "fp2", "doc_id", "times").join(direct, "id", "left") \
        .join(reached, "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    first = info.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = info.join(first, "component").select(
        F.col("fp1").alias("_1"), F.col("fp2").alias("_2"), "class_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = signed.select("doc_id", "h", "fp1", "fp2").join(named, (F.col("fp1") == F.col("_1")) & (F.col("fp2") == F.col("_2")), "left")
    return out.select("doc_id", "h", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      (F.col("fp1").isNull() | F.col("doc_id").eqNullSafe(F.coalesce("class_id", "doc_id"))).alias("kept"))


def without_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest doc_id.

    Rows that repeat a doc_id and text become one. Texts without words stay.
    """
    gone = similar(docs, least).where("not kept").select(F.col("doc_id").alias("gone_doc"), F.col("h").alias("gone_h")).distinct()
    rows = packed(docs).withColumn("key", F.col("doc.doc_id"))
    kept = rows.join(gone, F.col("key").eqNullSafe(F.col("gone_doc")) & (F.col("h") == F.col("gone_h")), "left_anti")
    return kept.dropDuplicates(["key", "h"]).select(*unpacked(docs))


def op6_jaccard(spark, sf_dir) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


QUERIES = {"op6_jaccard": op6_jaccard}
ORACLE = {"op6_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= {LEAST} * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0) AS n_links, d.doc_id = c.class_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""}
