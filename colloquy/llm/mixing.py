"""Mixing sources to target weights by a low-discrepancy source schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, settled, table, unpacked

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# Blocks that all sources have together, and those that each has at least unless they would be shorter than a word.
SLOTS = 1 << 18
LEAST_BLOCKS = 1 << 10
# In so many times the wanted slots every source finds its own: the golden ratio returns to an interval of length x within 2.62 / x points.
ROUNDS = 3
GOLDEN = 0.6180339887498949
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size``; one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total. A target stops at ``most`` times its source's size and the excess is
    shared by weight among the others. In the order of size against weight the
    sources that stop come first, so the number that stops is the first k for
    which the next source does not stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("stop", F.col("source_size") * float(most))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "n": F.row_number().over(order),
        "total": F.sum("source_size").over(every).cast("double"),
        "w_left": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "stopped": F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    s = s.withColumn("rate", (F.col("total") - F.col("stopped")) / F.col("w_left"))
    s = s.withColumn("first_free", F.min(F.when(F.col("stop") >= F.col("rate") * F.col("w"), F.col("n"))).over(every))
    s = s.withColumn("free_rate", F.min(F.when(F.col("n") == F.col("first_free"), F.col("rate"))).over(every))
    target = F.when(F.col("n") < F.col("first_free"), F.col("stop")).otherwise(F.col("free_rate") * F.col("w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, *, carry=(), weights=WEIGHTS, most: int = MOST_REPEATS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per document.

    Slot i holds the golden-ratio point frac(i * phi). The source into whose
    share of the unit interval the point falls fills the slot with its next
    block, until it has as many slots as its target has blocks. A source's blocks
    are cut from its documents in an order shuffled by the md5 of doc_id, have
    equally many words, and start again when they are used up, but no block is
    taken more than ``most`` times.

    The length of a source's blocks is its target by its part of ``slots``, at
    least a word; shares are by numbers of blocks. So a source of any size comes
    within a few thousandths of its target, and a tiny one to the word.
    A null text has size 0, a null source is a source. Documents of size 0 take
    nothing. Rows with equal doc_id are laid out in the order of their sizes, then of
    a hash of their texts. Columns named in ``carry`` come along.
    """
    sized = settled(docs.select(
        "doc_id", *carry, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # One row per source in these windows.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    part = F.greatest(F.floor(F.lit(slots) / F.count("*").over(every)), F.lit(LEAST_BLOCKS))
    shares = targets.withColumns({"sid": F.row_number().over(by_name), "block": F.greatest(F.ceil(F.col("target") / part), F.lit(1)).cast("long")})
    shares = shares.withColumn("wanted", F.round(F.col("target") / F.col("block")).cast("long"))
    shares = settled(shares.withColumn("upto", F.sum("wanted").over(by_name) / F.sum("wanted").over(every))
                     .withColumn("since", F.coalesce(F.lag("upto").over(by_name), F.lit(0.0))))
    total = shares.agg(F.coalesce(F.sum("wanted"), F.lit(0))).head()[0]

    # Points meet shares in cells of the unit interval: an equi-join however many sources there are.
    cells = 1 << 12
    points = docs.sparkSession.range(ROUNDS * total).withColumn("p", F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN))
    points = points.withColumn("cell", F.floor(F.col("p") * cells).cast("int"))
    spans = shares.where("upto > since").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("since") * cells).cast("int"), F.least(F.floor(F.col("upto") * cells), F.lit(cells)).cast("int"))))
    slot = points.join(spans, "cell").where("p >= since and p < upto")
    # The rank of a source's slot is the number of its slots in earlier stretches and before it in its own.
    stretch = 1 << 10
    slot = slot.select("sid", "id", "source_size", "block", "wanted", F.floor(F.col("id") / stretch).alias("part"))
    per_part = slot.groupBy("sid", "part").agg(F.count("*").alias("n"))
    before = per_part.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("off"))
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("id")) - 1
    ranked = slot.withColumn("r", rank).join(before, ["sid", "part"]).withColumn("r", F.col("r") + F.col("off"))
    n_blocks = F.ceil(F.col("source_size") / F.col("block"))
    takes = ranked.where((F.col("r") < F.col("wanted")) & (F.col("r") < n_blocks * most)).groupBy("sid", F.pmod(F.col("r"), n_blocks).cast("long").alias("blk")) \
        .agg(F.count("*").alias("times"))

    # Where each document starts in its source's shuffled order: sums of buckets of the order, then inside a bucket.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    laid = sized.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    names = shares.select(F.col("source").alias("name"), "sid", "source_size", "target", "block")
    laid = laid.join(names, F.col("source").eqNullSafe(F.col("name")))
    filled = laid.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = filled.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "size", "tie")
    laid = laid.join(starts, ["sid", "bucket"]).withColumn("row", F.row_number().over(inside)).withColumn(
        "start", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    pieces = laid.where("size > 0").withColumn("blk", F.explode(F.sequence(first, last))).withColumn(
        "words", F.least(F.col("start") + F.col("size"), (F.col("blk") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("blk") * F.col("block")))
    taken = pieces.join(takes, ["sid", "blk"]).groupBy("sid", "bucket", "row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return laid.join(taken, ["sid", "bucket", "row"], "left").select(
        "doc_id", *carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` with each document as often as it is taken.

    The blocks of a source are taken in one order, so that within a source only
    the document at the end of the last round is taken in part: its last copy
    has its first words. A document that is not taken is left out, and so is one
    without words. Rows of the same id and text share what they take, rounded down.
    ``n_chars``, if there, is that of the text.
    """
    takes = mix(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("h")), carry=("h",))
    takes = takes.groupBy(F.col("doc_id").alias("take_doc"), F.col("h").alias("take_h")).agg(
        F.max("size").alias("size"), F.floor(F.sum("taken") / F.count("*")).alias("taken")).where("taken > 0")
    both = packed(docs).join(takes, F.col("doc.doc_id").eqNullSafe(F.col("take_doc")) & (F.col("h") == F.col("take_h")))
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    text = F.when(words == F.col("size"), F.col("doc.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words), " "))
    out = copies.withColumn("text", text)
    return out.select(*unpacked(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))


def op10_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}


def mixing_sql(docs: str = "documents") -> str:
    """DuckDB SQL of ``mix`` over a relation with doc_id, text and source."""
    return rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM per),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS w, source_size * 3.0::DOUBLE AS stop FROM named),
ordered AS (SELECT *, row_number() OVER (ORDER BY stop / w, sid) AS n, (sum(source_size) OVER ())::DOUBLE AS total,
  sum(w) OVER (ORDER BY stop / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
  coalesce(sum(stop) OVER (ORDER BY stop / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS stopped FROM weighed),
rated AS (SELECT *, (total - stopped) / w_left AS rate FROM ordered),
free AS (SELECT min(n) AS n FROM rated WHERE stop >= rate * w),
targets AS (SELECT sid, source, source_size, total, CASE WHEN n < (SELECT n FROM free) THEN stop
  ELSE (SELECT rate FROM rated WHERE n = (SELECT n FROM free)) * w END AS target FROM rated),
blocked AS (SELECT *, greatest(ceil(target / greatest({SLOTS} // count(*) OVER (), {LEAST_BLOCKS})), 1)::BIGINT AS block FROM targets),
wanting AS (SELECT *, round(target / block)::BIGINT AS wanted FROM blocked),
shares AS (SELECT *, (sum(wanted) OVER (ORDER BY sid))::DOUBLE / (sum(wanted) OVER ())::DOUBLE AS upto FROM wanting),
spans AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY sid), 0.0::DOUBLE) AS since FROM shares),
points AS (SELECT i, i * {GOLDEN}::DOUBLE - floor(i * {GOLDEN}::DOUBLE) AS p
  FROM (SELECT unnest(range((SELECT {ROUNDS} * sum(wanted)::BIGINT FROM wanting))) AS i)),
ranked AS (SELECT sid, wanted, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS r, ceil(source_size / block::DOUBLE)::BIGINT AS nb
  FROM points JOIN spans ON p >= since AND p < upto),
takes AS (SELECT sid, r % nb AS blk, count(*) AS times FROM ranked WHERE r < wanted AND r < 3 * nb GROUP BY ALL),
laid AS (SELECT d.*, s.sid, s.source_size, s.target, s.block, row_number() OVER () AS rid,
  sum(size) OVER (PARTITION BY s.sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized d JOIN spans s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT sid, rid, start, size, block, unnest(range((start // block)::BIGINT, ((start + size - 1) // block)::BIGINT + 1)) AS blk
  FROM laid WHERE size > 0),
taken AS (SELECT rid, sum((least(start + size, (p.blk + 1) * block) - greatest(start, p.blk * block)) * times)::BIGINT AS taken
  FROM pieces p JOIN takes t ON p.sid = t.sid AND p.blk = t.blk GROUP BY rid)
SELECT doc_id, size, source_size, coalesce(target, 0.0) AS target, coalesce(taken, 0) AS taken FROM laid LEFT JOIN taken USING (rid)"""


ORACLE = {"op10_mixing": mixing_sql()}
