"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Characters that separate words, and the runs between them.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
# With this setting the shuffle files of an execution go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is that of ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; a cluster must name a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends, and its shuffle files go."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        # The setting counts when a frame is made; this one is executed here only.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def packed(docs: DataFrame) -> DataFrame:
    """``doc``, a struct of all columns, and ``h``, the hash of the text: no name of ``docs`` can clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("h"))


def unpacked(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``docs`` from a packed row, some of them replaced."""
    return [replaced.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]


def portions(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes, so that a batch of long texts is not held several times; a longer text is one by itself."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield texts.slice(i, j - i)
        i = j


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that is not its own component's smallest.

    ``edges`` has two long columns ``a`` and ``b``. Large-star and small-star
    rounds alternate until the edges no longer change; each is an aggregate and
    an equi-join, so that a hub is pre-aggregated and its join can be split. The
    number of rounds grows with the logarithm of the longest path. An edge leads
    from its larger node ``a`` to its smaller node ``b``.
    """

    def marked(e):
        mark = Observation()
        e = settled(e.distinct().observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        return e, mark.get

    e, before = marked(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while before["n"]:
        back = [F.col("b").alias("a"), F.col("a").alias("b")]
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(*back))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Two branches read it.
        large = settled(e.select(*back).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        # A node keeps its edge to its smallest neighbour, and its other neighbours get one to that.
        e, now = marked(large.join(root, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")))
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(df: DataFrame, key: str, id_col: str, rows: str, block: int, total: int) -> DataFrame:
    """Deal groups out to tasks: columns ``task, i, j, blk`` are added.

    ``rows`` names the column with the group's size; all have ``total`` rows. Groups of up to ``block``
    rows share tasks. A larger one is cut into blocks, and a task has two
    blocks of it, so that all pairs meet and no task has more than two blocks.
    """
    cuts = F.ceil(F.col(rows) / F.lit(block)).cast("int")
    blk = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.col("_cuts")).cast("int")
    out = df.withColumn("_cuts", cuts).withColumn("blk", F.when(F.col("_cuts") > 1, blk).otherwise(0))
    met = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    out = out.withColumn("_other", met).withColumn("i", F.least("blk", "_other")).withColumn("j", F.greatest("blk", "_other"))
    tasks = max(32, total // (4 * block))
    alone = F.pmod(F.xxhash64(F.col(key)), F.lit(tasks)).cast("long")
    cut = F.xxhash64(F.col(key), F.col("i"), F.col("j"))
    return out.withColumn("task", F.when(F.col("_cuts") > 1, cut).otherwise(alone)).drop("_cuts", "_other")
