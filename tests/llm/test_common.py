"""Frames that are settled, and components of graphs."""

import os
import random
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.llm.common import CLEANUP, components, settled


def shuffle_files(spark):
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir") or tempfile.gettempdir()
    return {str(p) for x in local.split(",") for p in Path(x).glob("**/blockmgr-*/*/shuffle_*")}


def test_settled_frames_leave_no_shuffle_files(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    kept = settled(df)
    until = time.time() + 20  # they go in the background
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    for x in (kept, df, settled(df)):
        assert {(r["k"], r["count"]) for r in x.collect()} == {(k, 100) for k in range(100)}


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root if find(x) != x}


some = random.Random(5)
GRAPHS = {
    "empty": [], "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "path": [(i, i + 1) for i in range(200)], "mixed path": list(zip((p := some.sample(range(300), 300)), p[1:], strict=False)),
    "hub": [(0, i) for i in range(1, 500)], "hub of the largest": [(500, i) for i in range(500)],
    "random": [(some.randrange(400), some.randrange(400)) for _ in range(350)] * 2, "negative": [(-3, 5), (5, -9), (2 ** 62, -(2 ** 62))],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_those_of_a_plain_union(spark, name):
    rows = components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(got) == len(rows) and got == plain(GRAPHS[name])
