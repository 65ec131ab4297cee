"""Folders of many small files are written by tasks and listed by parts."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy.plans import catalog
from colloquy.sources import files


def test_every_transcript_has_a_folder_and_parts_are_listed(spark, tmp_path):
    rows = [(i, None if i == 7 else "" if i == 8 else f"é{i}\nx") for i in range(1500)] + [(3, "again"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.sparkContext.setJobGroup("files", "files")
    try:
        got = sorted(tuple(r) for r in catalog.queries()["read_transcripts"](spark, str(tmp_path)).select("meeting_id", "text").collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {i: (t or "") + "\n" for i, t in rows[:1500]} | {3: "again\né3\nx\n"}
    assert got == sorted(want.items())
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds}
    # A task a folder would be 1500 tasks.
    assert max(i.numTasks for i in map(tracker.getStageInfo, stages) if i) <= files.PARTS


@pytest.mark.parametrize("store", ["file:", ""])
def test_written_transcripts_are_whole_files(spark, tmp_path, store):
    texts = spark.range(0, 40, 1, 4).select(F.col("id").alias("meeting_id"), F.concat(F.lit("t"), "id").alias("text"))
    root = files.write_transcripts(texts, f"{store}{tmp_path}/out", 5)
    found = {os.path.relpath(os.path.join(d, n), f"{tmp_path}/out") for d, _, names in os.walk(f"{tmp_path}/out") for n in names if n.startswith("part-")}
    assert len({os.path.dirname(f) for f in found}) == len(found) == 40 and {f.split("/")[0] for f in found} <= {f"part={i}" for i in range(5)}
    got = files.read_transcripts(spark, root).select(F.regexp_extract("meeting_id", "meeting_id=(\\d+)/", 1).cast("int"), "text").collect()
    assert sorted(map(tuple, got)) == [(i, f"t{i}\n") for i in range(40)]
    assert not [n for d, _, names in os.walk(f"{tmp_path}/out") for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_the_driver_holds_no_names_of_files(spark, tmp_path):
    """Spark's list took 1.4 KB of the driver for each file; tasks list and read what Spark's reader does."""
    root = tmp_path / "a b=%20/in"
    named = {"one.txt": b"1", "x/two.MD": "﻿é".encode(), "x/y/z/deep/three.txt": b"3\n", "x/bad.txt": b"\xff\xfe", "x/none.txt": b"", "x/no.csv": b"n",
             "_skip/a.txt": b"s", ".hid/a.txt": b"h", "_k=1/kept.txt": b"k", "x/_not.txt": b"u", "x/.dot.txt": b"d", "x/c.txt._COPYING_": b"c",
             "_metadata/in.txt": b"m", "_metadata.txt": b"f", "é/ü.txt": b"u"}
    for name, content in named.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    os.symlink(root / "nothing", root / "x" / "lost.txt")
    os.symlink(root / "x" / "y", root / "linked")
    rows = lambda place: sorted(map(repr, files.transcript_files(spark, place).collect()))
    assert rows(f"file:{root}") == rows(str(root)) == rows(f"file://{root}/") and len(rows(f"file:{root}")) == 8
    assert files.read_transcripts(spark, f"file:{root}").inputFiles() == []


def test_sums_that_hadoop_wrote_are_compared(spark, tmp_path):
    spark.createDataFrame([("text " * 300,)], "t string").coalesce(1).write.text(f"{tmp_path}/in")
    assert [r.text for r in files.read_transcripts(spark, f"file:{tmp_path}/in").collect()] == ["text " * 300 + "\n"]
    (name,) = (tmp_path / "in").glob("part-*.txt")
    name.write_bytes(name.read_bytes().replace(b"text", b"tent", 1))
    with pytest.raises(Exception, match="checksum"):
        files.read_transcripts(spark, f"file:{tmp_path}/in").collect()
