"""Sessions come from the stream alone, whatever the batches; late turns are told apart."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import jobs

HOUR = 3600


def run(spark, folder, batches):
    """Each batch of ``(recording, speaker, seconds)`` arrives as a file, and is processed by a run of its own."""
    schema = "recording_id long, speaker string, seconds long"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("ts", F.timestamp_seconds("seconds"))
        jobs.write_available(jobs.stream_turns(arriving, "ts", "1 hour", "6 hours"), f"{folder}/out", f"{folder}/state").awaitTermination(120)
    return spark.read.schema(jobs.SESSION_LOG).parquet(f"{folder}/out")


def seconds(df, *columns):
    return sorted(tuple(r) for r in df.select("recording_id", "speaker", *[F.unix_seconds(c).alias(c) for c in columns[:-1]], columns[-1]).collect())


def plain(turns):
    out = []
    for t in sorted(turns):
        if out and t <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], t + HOUR), out[-1][2] + 1)
        else:
            out.append((t, t + HOUR, 1))
    return out


def test_a_late_turn_and_a_bridge(spark, tmp_path):
    batches = [
        [(1, "a", 0), (1, "a", 2 * HOUR), (1, "b", 0)],
        [(1, "a", HOUR), (1, "a", 40 * HOUR)],  # closes the gap between two sessions that are open
        [(1, "a", 100), (1, "b", 50 * HOUR)],  # the first is too late by now
        [(1, "b", 50 * HOUR + 60)],
    ]
    log = run(spark, tmp_path, batches)
    assert seconds(jobs.sessions_of(log), "session_start", "session_end", "turns") == [
        (1, "a", 0, 3 * HOUR, 3), (1, "a", 40 * HOUR, 41 * HOUR, 1), (1, "b", 0, HOUR, 1), (1, "b", 50 * HOUR, 51 * HOUR + 60, 2)]
    assert seconds(jobs.late_turns(log).withColumn("n", F.lit(1)), "ts", "n") == [(1, "a", 100, 1)]


@pytest.mark.parametrize("seed", [1])
def test_any_batches_give_the_sessions_of_the_whole(spark, tmp_path, seed):
    rng = random.Random(seed)
    turns = [(rng.randrange(3), rng.choice("ab"), rng.randrange(4 * HOUR)) for _ in range(60)]  # none can be late
    cuts = sorted(rng.sample(range(60), 2))
    log = run(spark, tmp_path, [turns[:cuts[0]], turns[cuts[0]:cuts[1]], turns[cuts[1]:]])
    want = sorted((r, s, *x) for r in range(3) for s in "ab" for x in plain([t for a, b, t in turns if (a, b) == (r, s)]))
    assert seconds(jobs.sessions_of(log), "session_start", "session_end", "turns") == want
    assert jobs.late_turns(log).count() == 0


def test_speakers_are_followed_together(spark, tmp_path):
    turns = [(r % 4000, "ab"[r % 2], 7 * r % (9 * HOUR)) for r in range(9000)] + [(None, "a", 5), (0, "a", 5), (0, None, 5), (0, "", 5), (1 << 62, "a", 5), ((1 << 62) + 1, "a", 6)]
    schema = "recording_id long, speaker string, seconds long"
    spark.createDataFrame(turns, schema).withColumn("ts", F.timestamp_seconds("seconds")).coalesce(2).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("recording_id long, speaker string, ts timestamp").parquet(f"{tmp_path}/in")
    query = jobs.write_available(jobs.stream_turns(arriving, "ts", "1 hour", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    # A group a speaker would be 4006.
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= jobs.BUCKETS
    by = {}
    for r, s, t in turns:
        by.setdefault((r, s), []).append(t)
    log = spark.read.schema(jobs.SESSION_LOG).parquet(f"{tmp_path}/out")
    got = jobs.sessions_of(log).select("recording_id", "speaker", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "turns").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*k, *x)) for k, ts in by.items() for x in plain(ts))


def test_a_bucket_of_all_speakers_in_many_batches(spark, tmp_path):
    rng = random.Random(2)
    turns = [(rng.randrange(4), rng.choice("ab"), rng.randrange(60 * HOUR)) for _ in range(120)]
    turns.sort(key=lambda x: x[2])  # in order of time: sessions are closed, and none is late
    schema = "recording_id long, speaker string, seconds long"
    for i in range(0, 120, 40):
        spark.createDataFrame(turns[i:i + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("seconds"))
        jobs.write_available(jobs.stream_turns(arriving, "ts", "1 hour", "6 hours", buckets=1), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    log = spark.read.schema(jobs.SESSION_LOG).parquet(f"{tmp_path}/out")
    want = sorted((r, s, *x) for r in range(4) for s in "ab" for x in plain([t for a, b, t in turns if (a, b) == (r, s)]))
    assert seconds(jobs.sessions_of(log), "session_start", "session_end", "turns") == want
    assert log.where("kind = 'closed'").count() > 0 and jobs.late_turns(log).count() == 0
