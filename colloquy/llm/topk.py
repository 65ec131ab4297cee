"""Exact top-k search by inner product over a bit-sliced index.

Rows are kept in blocks. For each component a block has bit slices: bitmaps with
one bit per row, one bitmap for each binary digit of the quantised component. A
query's scores arise as bit slices too, by adding the slices of its components
with bitmap arithmetic, shifted by the digits of the query's component. The top
rows are then selected from the most significant slice downward; rows left at
the boundary have equal scores, and the smallest ids among them are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, table

K = 20
SCALE = 64
QUERY_STEP = 20
# Rows of an index block, and queries that a task compares with one block.
BLOCK = 32_768
QUERIES_A_TASK = 8_192
# Queries whose slices are added at a time.
BATCH = 64
LEAST_TASKS = 24


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    d = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.when(finite, F.transform(d, lambda x: F.floor(x * scale).cast("long")))


def digits(x: int) -> int:
    return max(1, int(x).bit_length())


class Block:
    """The bit slices of a block of rows; rows are in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low = int(values.min()) if values.size else 0
        self.width = digits(int(values.max()) - self.low if values.size else 0)
        self.words = -(-len(ids) // 64)
        pad = self.words * 64 - len(ids)
        shifted = np.pad((values - self.low).astype(np.uint64), ((0, pad), (0, 0)))
        # slices[d, b]: bit b of component d, for all rows
        self.slices = np.stack([self.pack((shifted >> np.uint64(b)) & np.uint64(1)) for b in range(self.width)], axis=1) \
            if values.shape[1] else np.zeros((0, self.width, self.words), np.uint64)
        self.valid = self.pack((np.arange(self.words * 64) < len(ids))[:, None].astype(np.uint64))[0]

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Rows by columns of 0 and 1 as columns by 64-bit words."""
        return np.ascontiguousarray(np.packbits(bits.T.astype(np.uint8), axis=1, bitorder="little")).view(np.uint64)

    def scores(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices of the scores, each queries by words, and what to add to each query's scores.

        A component below zero meets the complement of the slices, so that only
        sums of numbers from zero on occur.
        """
        size, full = np.abs(queries), (1 << self.width) - 1
        most = digits(int(size.sum(axis=1).max(initial=0)) * full)
        total = [np.zeros((len(queries), self.words), np.uint64) for _ in range(most)]
        for d in range(queries.shape[1]):
            flip = np.where(queries[:, d] < 0, ~np.uint64(0), np.uint64(0))[:, None]
            operand = [self.slices[d, b][None, :] ^ flip for b in range(self.width)]
            for e in range(digits(int(size[:, d].max(initial=0)))):
                has = ((size[:, d] >> e) & 1).astype(bool)
                if not has.any():
                    continue
                rows = np.flatnonzero(has)
                carry = None
                for at in range(e, most):
                    b = at - e
                    if b < self.width:
                        x, t = operand[b][rows], total[at][rows]
                        s = x ^ t
                        if carry is None:
                            total[at][rows], carry = s, x & t
                        else:
                            total[at][rows], carry = s ^ carry, (x & t) | (s & carry)
                    elif carry is None or not carry.any():
                        break
                    else:
                        t = total[at][rows]
                        total[at][rows], carry = t ^ carry, t & carry
        # sum q(u + low) = sum |q|(u or its complement) - full * sum of |q| below zero + low * sum q
        offset = [int(a) for a in queries.sum(axis=1) * self.low - full * np.where(queries < 0, size, 0).sum(axis=1)]
        return total, np.array(offset, dtype=np.int64)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """The k best rows of the block for each query, without the query's own."""
        total, offset = self.scores(queries)
        open_ = np.repeat(self.valid[None, :], len(queries), axis=0)
        first, last = np.searchsorted(self.ids, query_ids), np.searchsorted(self.ids, query_ids, side="right")
        for q in np.flatnonzero(last > first):
            for r in range(first[q], last[q]):
                open_[q, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        taken = np.zeros_like(open_)
        count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        for s in reversed(total):
            above = taken | (open_ & s)
            n = count(above)[:, None]
            # too many: look among those with the bit; too few: take them and look among the rest
            open_, taken = np.where(n > k, open_ & s, open_ & ~s), np.where(n > k, taken, above)
        out_n, out_v, out_s = [], [], []
        unpack = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        for q in range(len(queries)):
            rows = unpack(taken[q])
            rows = np.concatenate([rows, unpack(open_[q])[:k - len(rows)]]) if len(rows) < k else rows
            word, bit = rows >> 6, (rows & 63).astype(np.uint64)
            score = np.zeros(len(rows), np.int64)
            for at, s in enumerate(total):
                score += ((s[q, word] >> bit) & np.uint64(1)).astype(np.int64) << at
            out_n.append(np.full(len(rows), q)), out_v.append(self.ids[rows]), out_s.append(score + offset[q])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        n = cat(out_n).astype(np.int64)
        return pd.DataFrame({"n": n, "query_id": query_ids[n], "vec_id": cat(out_v), "score": cat(out_s)})


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows.

    ``rows`` has ``vec_id`` and integer ``q``, ``queries`` has ``query_id`` and
    ``q``. A row with the query's id is no candidate. Ties go to the smaller
    vec_id. Shorter vectors count as continued by zeros. Equal rows (of the same id
    and vector) are one; rows of one id with different vectors are different
    queries, each with ranks of its own, and different candidates. If a score could
    exceed 62 bits, a ValueError is raised. An index block and a bounded share of
    the queries meet in a task, which returns k rows a query; the k best of all
    blocks follow by rank.
    """
    rows = settled(rows.select(F.col("vec_id").cast("long"), "q").distinct())
    queries = settled(queries.select(F.col("query_id").cast("long"), "q").distinct().withColumn("number", F.monotonically_increasing_id()))
    # Sums of 38 digits, so that the test itself cannot overflow.
    size = F.transform("q", lambda x: F.abs(x.cast("decimal(20,0)")))
    added = F.aggregate(size, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    n, width, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(F.array_max(size)), F.lit(0))).head()
    asked, wide, sums = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(added), F.lit(0))).head()
    if int(most) * int(sums) >= 1 << 62:
        raise ValueError("components so large that a score may exceed 62 bits")
    width, blocks = max(width, wide), max(1, -(-n // BLOCK))
    shares = max(1, -(-asked // QUERIES_A_TASK), min(-(-asked // BATCH), -(-LEAST_TASKS // blocks)))
    index = rows.select("vec_id", "q", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    spread = queries.select("number", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"number": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        block = Block(left["vec_id"].to_numpy(), matrix(left["q"], width))
        numbers, ids, q = right["number"].to_numpy(), right["query_id"].to_numpy(), matrix(right["q"], width)
        found = [block.top(ids[a:a + BATCH], q[a:a + BATCH], k) for a in range(0, len(ids), BATCH)]
        return pd.concat([f.assign(number=numbers[f["n"] + BATCH * i]) for i, f in enumerate(found)])[["number", "query_id", "vec_id", "score"]]

    met = index.groupBy("block", "share").cogroup(spread.groupBy("block", "share")).applyInPandas(
        compare, "number long, query_id long, vec_id long, score long")
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_topk(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("q")) \
        .where("q is not null and vec_id is not null")
    return search(rows, rows.where(f"vec_id % {QUERY_STEP} = 0").withColumnRenamed("vec_id", "query_id"))


QUERIES = {"op1_topk": op1_topk}
ORACLE = {"op1_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""}
