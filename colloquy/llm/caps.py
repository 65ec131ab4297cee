"""Near-duplicate vectors by spherical-cap filters.

A filter is the cap around a direction. The directions are a random product
code: half vectors of two codes, joined in all combinations. A vector is
list-decoded to all directions with which its product exceeds a threshold, and
vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, components, roots, settled, table

LEAST_COSINE = 0.95
# Each half code has at least so many vectors, and the square root of the number of vectors: with as many directions
# as vectors, a direction has a bounded number of them on average.
LEAST_CODE = 256
# A vector lies in about so many caps; a finer code has narrower caps, of which a pair shares fewer.
FILTERS = 24
FINER = 0.05
# A vector in fewer caps takes its nearest directions instead.
LEAST_FILTERS = 12
BLOCK = 1024
SEED = 20


def code_size(vectors: int) -> int:
    return max(LEAST_CODE, math.isqrt(max(vectors, 1) - 1) + 1)


def usable(vector: Column) -> Column:
    """The vector; null unless all components are finite and one is not zero."""
    d = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.when(finite & F.exists(d, lambda x: x != 0), vector)


def codes(width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit half vectors of the two codes."""
    rng, half = np.random.default_rng(SEED), (width + 1) // 2
    out = []
    for w in (half, max(1, width - half)):
        c = rng.standard_normal((size, w))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out[0], out[1]


def threshold(width: int, size: int) -> float:
    """The product that a random unit vector exceeds with about FILTERS of the directions."""
    rng, (a, b) = np.random.default_rng(SEED + 1), codes(width, size)
    x = rng.standard_normal((max(16, min(400, 100_000 // size)), width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h, pad = a.shape[1], b.shape[1]
    s1, s2 = np.sort(x[:, :h] @ a.T, axis=1), np.pad(x, ((0, 0), (0, max(0, h + pad - width))))[:, h:h + pad] @ b.T
    wanted = FILTERS * (size / LEAST_CODE) ** (2 * FINER) * len(x)
    low, high = -2.0, 2.0
    for _ in range(40):
        middle = (low + high) / 2
        above = sum(size * size - int(np.searchsorted(p, middle - q).sum()) for p, q in zip(s1, s2, strict=True))
        low, high = (middle, high) if above > wanted else (low, middle)
    return low


def decode(x: np.ndarray, width: int, size: int, least: float) -> list[np.ndarray]:
    """For each unit vector the ascending numbers of its filters.

    Only the nearest half vectors of each code can add up to the threshold;
    their combinations are tried, which is complete.
    """
    a, b = codes(width, size)
    h = a.shape[1]
    x = np.pad(x, ((0, 0), (0, max(0, h + b.shape[1] - width))))
    s1, s2 = x[:, :h] @ a.T, x[:, h:] @ b.T
    o1, o2 = np.argsort(-s1, axis=1, kind="stable"), np.argsort(-s2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(s1, o1, 1), np.take_along_axis(s2, o2, 1)
    out = []
    for i in range(len(x)):
        n1, n2 = int((s1[i] >= least - s2[i, 0]).sum()), int((s2[i] >= least - s1[i, 0]).sum())
        p, q = np.nonzero(s1[i, :n1, None] + s2[i, None, :n2] >= least)
        if len(p) < LEAST_FILTERS:
            near = s1[i, :LEAST_FILTERS, None] + s2[i, None, :LEAST_FILTERS]
            p, q = np.unravel_index(np.argsort(-near, axis=None, kind="stable")[:LEAST_FILTERS], near.shape)
        out.append(np.sort(o1[i, p].astype(np.int64) * size + o2[i, q]))
    return out


def in_filters(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """``id, v, times`` with the filters of each vector in ``fs``."""
    least = threshold(width, size)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at:at + 512].reset_index(drop=True)
                x = unit(g["v"], width)
                yield g.assign(fs=decode(x, width, size, least))

    return vectors.mapInPandas(assign, f"id long, v {dict(vectors.dtypes)['v']}, times long, fs array<long>")


def unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of length one, in double precision; shorter ones are continued by zeros."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(vectors: DataFrame, width: int, least: float = LEAST_COSINE) -> DataFrame:
    """``a, b, n``: rows linked within a task; ``a`` has ``n`` more links and ``b`` is linked with it.

    A pair that shares several filters counts in the first of them alone.
    """
    listed = settled(in_filters(vectors, width, code_size(vectors.count())))
    rows = listed.select("id", F.explode("fs").alias("f"))
    sizes = settled(rows.groupBy("f").agg(F.count("*").alias("rows")).where("rows > 1"))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
    # The sizes come to a vector as a list, so that vectors are multiplied just before they are compared.
    met = rows.join(sizes, "f").groupBy("id").agg(F.collect_list(F.struct("f", "rows")).alias("met"))
    spread = listed.join(met, "id").select("id", "v", "times", "fs", F.explode("met").alias("m")).select("id", "v", "times", "fs", "m.*")
    dealt = block_pairs(spread, "f", "id", "rows", BLOCK, total)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (f, i, j), part in g.groupby(["f", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            x, ids, times = unit(part["v"], width), part["id"].to_numpy(), part["times"].to_numpy()
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            some = np.flatnonzero(near.any(axis=1))
            near, ids, times, blk = near[np.ix_(some, some)], ids[some], times[some], part["blk"].to_numpy()[some]
            order = np.argsort(ids, kind="stable")
            near, ids, times, blk = near[np.ix_(order, order)], ids[order], times[order], blk[order]
            lists = part["fs"].to_numpy()[some][order]
            lengths = [len(x) for x in lists]
            flat, row = np.concatenate(lists), np.repeat(np.arange(len(ids)), lengths)
            earlier = flat < f
            names, column = np.unique(flat[earlier], return_inverse=True)
            has = np.zeros((len(ids), len(names)), np.float32)
            has[row[earlier], column] = 1
            counted = near & (has @ has.T == 0)
            if i != j:
                counted &= blk[:, None] != blk[None, :]
            out.append(pd.DataFrame({"a": ids, "b": ids[roots(near)], "n": counted @ times}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    return dealt.select("task", "f", "i", "j", "blk", "id", "v", "times", "fs").groupBy("task").applyInPandas(
        compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vec_id, embedding``.

    Equal vectors are one vector that counts several times. Vectors that are
    null, zero, or hold null or non-finite components link with nothing and are
    their own component. Vectors of different lengths are continued by zeros.
    Rows with equal vec_id count as different vectors. A row without vec_id links
    like any other; a component's id is null if no row of it has one, and of rows
    without id those of such components are kept.
    """
    rows = settled(vectors.select(F.col("vec_id").cast("long"), usable(F.col("embedding")).alias("v")))
    width = rows.agg(F.max(F.size("v"))).head()[0]
    alone = rows.where("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if width is None or width < 1:
        return alone
    good = rows.where("v is not null").withColumn("h", F.xxhash64("v"))
    # Classes have numbers of their own, as ids may be null.
    classes = settled(good.groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
                      .withColumn("id", F.monotonically_increasing_id()))
    found = settled(links(classes.select("id", "v", "times"), width, least))
    direct = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = components(found.select("a", "b"))
    info = classes.join(direct, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "h", F.col("v").alias("v2"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"), "least")
    named = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(named, "component").select(F.col("h").alias("h2"), "v2", "n_links", "component_id")
    out = good.join(info, (F.col("h") == F.col("h2")) & (F.col("v") == F.col("v2")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def op5_caps(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_caps": op5_caps}
ORACLE = {"op5_caps": f"""
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""}
