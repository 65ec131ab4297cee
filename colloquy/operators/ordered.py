"""Ordered operators that stay balanced when one group holds most of the rows.

A window partitioned by a hot key runs in a single task. That is fine while
every group is small, so the group sizes are looked at first (one count over the
key columns). If some group is larger than a span, each group is split into
consecutive *buckets* of its order column: the operator works inside
``(keys, bucket)``, reduces each bucket to one row, scans those few rows per
group and joins the carried state back. The wide data is then shuffled by
``(keys, bucket)``, and only bucket totals ever meet in one task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of an ordinal that share a bucket.
SPAN = 1 << 16
# Least width of a time bucket, in seconds.
SHORTEST_BUCKET = 1e-3

# Longest key list that becomes a local relation.
KEY_LIST = 10_000

_B = "_bucket"


def ordinal_bucket(ordinal: str | Column, span: int = SPAN) -> Column:
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(c / span).cast("long")


def time_bucket(seconds: str | Column, width: float) -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(c / width).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder.

    A cluster must name it in ``spark.checkpoint.dir``; only a local session,
    whose tasks share the driver's disk, gets one of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-ckpt-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder.

    Used where an expensive intermediate feeds several branches.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def large_keys(df: DataFrame, keys: Sequence[str], span: int = SPAN) -> DataFrame | None:
    """Keys of the groups of more than ``span`` rows, or None if there are none.

    Looked up now, so that plans without large groups stay simple. There are at
    most ``rows / span`` of them; a short list becomes a local relation that
    joins can broadcast, a longer one stays a query.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = counted.where(F.col("_n") > span).select(*keys)
    some = large.limit(KEY_LIST + 1).collect()
    if not some:
        return None
    return large if len(some) > KEY_LIST else df.sparkSession.createDataFrame(some, large.schema)


def time_bucket_if_large(df: DataFrame, keys: Sequence[str], time: str, span: int = SPAN,
                         of: str | None = None) -> Column | None:
    """Bucket of time ``of`` (default ``time``) if some group needs splitting, else None.

    The width follows the densest large group: at its mean density a bucket
    holds ``span`` rows, however many rows a second the group has.
    """
    large = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(time) - F.min(time)).alias("_length")).where(F.col("_n") > span)
    width = large.agg(F.min(F.col("_length") * span / F.col("_n"))).head()[0]
    return None if width is None else time_bucket(of or time, max(width, SHORTEST_BUCKET))


def _over(keys: Sequence[str], bucket: Column | None, order: Sequence[Column]):
    """Window over a bucket of a group, or over the group."""
    return Window.partitionBy(*keys, *([] if bucket is None else [_B])).orderBy(*order)


def _tag(df: DataFrame, bucket: Column | None) -> DataFrame:
    return df if bucket is None else df.withColumn(_B, bucket)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, *,
            bucket: Column | None, out: str = "island", filled: str | None = None,
            inherit_null: bool = False) -> DataFrame:
    """Number the runs of equal consecutive ``value`` within ``keys``, from 0.

    With ``inherit_null`` a NULL takes the value before it (forward fill) and
    never starts a run; rows before the first value get run -1. Otherwise NULL
    is a value like any other. ``filled`` names the column for the value used.
    Order columns sort ascending: write a descending one as its negative.
    """
    boxed = F.struct(value.alias("v"))
    if inherit_null:
        boxed = F.when(value.isNotNull(), boxed)
    w = _over(keys, bucket, order)
    detail = (
        _tag(df, bucket).withColumn("_v", boxed)
        .withColumn("_prev", F.last("_v", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_step", (F.col("_v").isNotNull() & F.col("_prev").isNotNull()
                              & ~F.col("_v.v").eqNullSafe(F.col("_prev.v"))).cast("long"))
        .withColumn("_local", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    seen = F.coalesce(F.col("_v"), F.col("_prev"))
    if bucket is None:
        result = detail.withColumns({"_carry": F.lit(None).cast(detail.schema["_v"].dataType),
                                     "_edge": F.lit(1), "_base": F.lit(-1)})
    else:
        by = [*keys, _B]
        at = F.when(F.col("_v").isNotNull(), _position(order))
        totals = detail.groupBy(*by).agg(
            F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last"),
            F.max("_local").alias("_n"))
        wb = Window.partitionBy(*keys).orderBy(_B)
        carry = (
            totals
            .withColumn("_carry", F.last("_last", ignorenulls=True).over(
                wb.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_edge", (F.col("_first").isNotNull() & (
                F.col("_carry").isNull()
                | ~F.col("_first.v").eqNullSafe(F.col("_carry.v")))).cast("long"))
            .withColumn("_base", F.sum(F.col("_n") + F.col("_edge")).over(
                wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_edge") - 1)
            .select(*by, "_carry", "_edge", "_base"))
        result = detail.join(carry, by, "left")
    result = result.withColumn(out, (F.col("_base") + F.col("_local") + F.when(
        seen.isNotNull(), F.col("_edge")).otherwise(0)).cast("long"))
    if filled:
        result = result.withColumn(filled, F.coalesce(seen, F.col("_carry"))["v"])
    return result.drop(_B, "_v", "_prev", "_step", "_local", "_carry", "_edge", "_base")


def _position(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, *,
                bucket: Column | None, out: str) -> DataFrame:
    """Inclusive running sum of ``value``."""
    w = _over(keys, bucket, order).rowsBetween(Window.unboundedPreceding, 0)
    tagged = _tag(df, bucket).withColumn("_x", value)
    summed = tagged.withColumn(out, F.sum("_x").over(w))
    if bucket is None:
        return summed.drop("_x")
    by = [*keys, _B]
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = tagged.groupBy(*by).agg(F.sum("_x").alias("_t")).select(*by, F.sum("_t").over(wb).alias("_c"))
    return (summed.join(carry, by, "left")
            .withColumn(out, F.col(out) + F.coalesce(F.col("_c"), F.lit(0))).drop(_B, "_x", "_c"))


def prior_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, *,
              bucket: Column | None, out: str) -> DataFrame:
    """Maximum of ``value`` over the strictly earlier rows; NULL on the first."""
    w = _over(keys, bucket, order).rowsBetween(Window.unboundedPreceding, -1)
    tagged = _tag(df, bucket).withColumn("_x", value)
    known = tagged.withColumn(out, F.max("_x").over(w))
    if bucket is None:
        return known.drop("_x")
    by = [*keys, _B]
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = tagged.groupBy(*by).agg(F.max("_x").alias("_t")).select(*by, F.max("_t").over(wb).alias("_c"))
    return (known.join(carry, by, "left")
            .withColumn(out, F.greatest(F.col(out), F.col("_c"))).drop(_B, "_x", "_c"))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, *,
               bucket: Column | None, before: str, after: str) -> DataFrame:
    """Nearest non-NULL ``value`` at or before, and at or after, each row."""
    w = _over(keys, bucket, order)
    tagged = _tag(df, bucket).withColumn("_x", value)
    scanned = (
        tagged.withColumn(before, F.last("_x", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(after, F.first("_x", ignorenulls=True).over(
            w.rowsBetween(0, Window.unboundedFollowing))))
    if bucket is None:
        return scanned.drop("_x")
    by = [*keys, _B]
    at = F.when(F.col("_x").isNotNull(), _position(order))
    totals = tagged.groupBy(*by).agg(
        F.min_by("_x", at).alias("_first"), F.max_by("_x", at).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(_B)
    carry = totals.select(
        *by,
        F.last("_last", ignorenulls=True).over(
            wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
        F.first("_first", ignorenulls=True).over(
            wb.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"))
    return (scanned.join(carry, by, "left")
            .withColumn(before, F.coalesce(F.col(before), F.col("_cb")))
            .withColumn(after, F.coalesce(F.col(after), F.col("_ca"))).drop(_B, "_x", "_cb", "_ca"))


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Column, *,
                   sep: str = "", out: str = "text", also: Mapping[str, Column] | None = None) -> DataFrame:
    """Concatenate ``text`` in order, one row per group at every size; ``also`` adds aggregates."""
    items = F.array_sort(F.collect_list(F.struct(_position(order).alias("_o"), text.alias("_t"))))
    extra = [c.alias(n) for n, c in (also or {}).items()]
    grouped = df.groupBy(*keys).agg(items.alias("_l"), *extra)
    return grouped.withColumn(out, F.array_join(F.transform("_l", lambda x: x["_t"]), sep)).drop("_l")


def numbered(df: DataFrame, order: Sequence[Column], out: str = "g") -> DataFrame:
    """``df`` with a number that ascends in the given order, settled.

    A range partitioning cuts a large group at any place, so rows of one group
    have consecutive numbers except where a partition ends; equal rows get their
    numbers in any order.
    """
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))


def previous(df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, *, out: str) -> DataFrame:
    """``value`` of the row before, in a struct ``out.v``; ``out`` is null on the first row of a group.

    Windows run over ``SPAN`` ordinals; what is left of them, a row each, follows.
    """
    by = [*keys, _B]
    tagged = df.withColumn(_B, ordinal_bucket(ordinal, SPAN)).withColumn("_x", F.struct(value.alias("v")))
    inside = tagged.withColumn(out, F.lag("_x").over(Window.partitionBy(*by).orderBy(ordinal)))
    last = tagged.groupBy(*by).agg(F.max_by("_x", F.col(ordinal)).alias("_x"))
    carried = last.select(*by, F.lag("_x").over(Window.partitionBy(*keys).orderBy(_B)).alias("_c"))
    return inside.join(carried, by, "left").withColumn(out, F.coalesce(out, "_c")).drop(_B, "_x", "_c")
