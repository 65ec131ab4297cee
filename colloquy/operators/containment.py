"""How much of each item's token set lies in its group's pool of tokens.

Two exact ways, chosen per group by size. An ordinary group's pool is one row:
items join it once, before they are expanded, and sets are intersected in the
row. The pool of a large group stays in rows: its tokens are joined one by one
on ``(key, token)``, which spreads a hot key over as many tasks as it has
tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import large_keys, ordered_concat

POOL_SPAN = 4096
# Characters that a number token may go on with, at the start of a text.
SEAM_RUN = "^[0-9A-Za-z%~～\\-万亿年]*"


def text_pool(parts: DataFrame, key: str, order: Sequence[Column], cut: Column, *, sep: str,
              span: int = POOL_SPAN) -> tuple[DataFrame, DataFrame | None]:
    """Pool texts per key and ``piece_ord``, and the large keys, if any.

    The parts of a large key stay in pieces by ``cut``, monotone in the order;
    every other key is one piece.
    """
    large = large_keys(parts, [key], span)
    zero = F.lit(0).cast("long")
    if large is None:
        rows = parts.withColumn("piece_ord", zero)
    else:
        rows = parts.withColumn("_cut", cut.cast("long")).join(large.withColumn("_large", F.lit(True)), key, "left").withColumn(
            "piece_ord", F.when(F.col("_large"), F.col("_cut")).otherwise(zero))
    return ordered_concat(rows, [key, "piece_ord"], order, F.col("text"), sep=sep), large


def pool_hits(items: DataFrame, pool: DataFrame, large: DataFrame | None, key: str, *,
              expand: Callable[[DataFrame], DataFrame], ids: Sequence[str],
              kinds: Sequence[str]) -> DataFrame:
    """Expanded items with ``<kind>_hits`` per kind and ``in_pool``.

    ``pool`` has ``key, nonblank`` and one token array per kind, one row per
    ordinary key. ``expand`` turns items into rows with ``ids`` and one token
    array per kind; other columns it adds are kept.
    """
    boxed = pool.select(key, F.struct("nonblank", *kinds).alias("_pool"))
    light = items if large is None else items.join(large, key, "left_anti")
    ordinary = expand(light.join(boxed, key, "left")).withColumns({
        **{f"{k}_hits": F.when(F.col("_pool").isNull(), 0).otherwise(
            F.size(F.array_intersect(F.col(k), F.col("_pool")[k]))) for k in kinds},
        "in_pool": F.coalesce(F.col("_pool.nonblank"), F.lit(False)),
    }).drop("_pool")
    if large is None:
        return ordinary

    hot_items = expand(items.join(large, key, "left_semi"))
    hot_pool = pool.join(large, key, "left_semi")

    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda t: F.struct(F.lit(kind).alias("kind"), t.cast("string").alias("token")))

    tagged = F.explode_outer(F.flatten(F.array(*map(of_kind, kinds))))
    tokens = hot_pool.select(key, tagged.alias("t")).select(key, "t.kind", "t.token").distinct()
    nonblank = hot_pool.groupBy(key).agg(F.max("nonblank").alias("in_pool"))
    wanted = hot_items.select(key, *ids, tagged.alias("t")).select(key, *ids, "t.kind", "t.token")
    counts = (
        wanted.join(tokens.withColumn("_hit", F.lit(1)), [key, "kind", "token"], "left")
        .groupBy(key, *ids)
        .agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("_hit"))), F.lit(0)).cast("int")
               .alias(f"{k}_hits") for k in kinds]))
    # One verdict per large key: as short as the key list itself.
    hot = hot_items.join(counts, [key, *ids]).join(nonblank, key)
    return ordinary.unionByName(hot.select(ordinary.columns))


def mend_seams(pieces: DataFrame, large: DataFrame | None, key: str) -> DataFrame:
    """Let tokens cross the cuts of large pools, however long they are.

    A piece that does not consist of one run of letters and digits is an anchor.
    Each anchor hands its leading run to the anchor before it, with one character
    more to read, and the pieces between them go there whole. So every run lies
    in one row. Empty pieces are passed over. Ordinary keys have no cuts.
    """
    if large is None:
        return pieces
    hot = pieces.join(large, key, "left_semi")
    head = F.regexp_extract("text", SEAM_RUN, 0)
    w = Window.partitionBy(key).orderBy("piece_ord")
    marked = hot.withColumn("_run", head).withColumn("_anchor", (F.length("_run") < F.length("text")).cast("int")).withColumn(
        "_at", F.sum("_anchor").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gifts = marked.where("text <> ''").select(
        key, (F.col("_at") - F.col("_anchor")).alias("_at"), "piece_ord",
        F.when(F.col("_anchor") == 1, F.concat("_run", F.substring("text", F.length("_run") + 1, F.lit(1))))
        .otherwise(F.col("text")).alias("text"))
    given = ordered_concat(gifts, [key, "_at"], [F.col("piece_ord")], F.col("text"), out="_given")
    # What comes before the first anchor belongs to place 0, where no anchor is.
    own = marked.select(key, "piece_ord", "nonblank", F.when(F.col("_anchor") == 1, F.col("_at")).alias("_place"),
                        F.when(F.col("_anchor") == 1, F.substring("text", F.length("_run") + 1, F.length("text")))
                        .otherwise(F.lit("")).alias("text"))
    mended = own.alias("o").join(given.alias("g"), (F.col(f"o.{key}") == F.col(f"g.{key}")) & (F.col("_place") == F.col("_at")), "left") \
        .select(f"o.{key}", "piece_ord", F.concat("text", F.coalesce("_given", F.lit(""))).alias("text"), "nonblank")
    opening = given.where("_at = 0").select(
        key, F.lit(-1).cast("long").alias("piece_ord"), F.col("_given").alias("text"), F.lit(False).alias("nonblank"))
    whole = pieces.join(large, key, "left_anti").select(key, "piece_ord", "text", "nonblank")
    return whole.unionByName(mended).unionByName(opening)
