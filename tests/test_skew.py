"""A hot group split into buckets must give what one window over it gives."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import align, chunking, factcheck, minutes, ordered, rendering
from colloquy.schemas import BLOCKS, QA_PAIRS, SECTIONS, SEGMENTS, TRANSCRIPTS, TURNS
from colloquy.sources import files

SMALL = 16


@pytest.fixture(scope="module")
def recording(spark):
    """Recording 1 holds most rows; 2 and 3 are small."""
    rng = random.Random(3)
    segs, turns = [], []
    for rec, n in ((1, 400), (2, 9), (3, 1)):
        at = 0.0
        for i in range(n):
            at += rng.choice([0.1, 0.7, 5.0, 40.0])
            length = rng.choice([0.3, 0.8, 2.0, 60.0])
            turns.append((rec, i, round(at, 3), round(at + length, 3), rng.randrange(3)))
            segs.append((rec, i, round(at + rng.random() * 9, 3), round(at + 10.0, 3), rng.choice(["x", "y", " ", "z"])))
    rng.shuffle(turns)
    return spark.createDataFrame(segs, SEGMENTS).cache(), spark.createDataFrame(turns, TURNS).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_coalesce_turns(recording):
    _, turns = recording
    columns = ("recording_id", "start", "end", "speaker")
    assert rows(align.coalesce_turns(turns, span=SMALL), *columns) == rows(align.coalesce_turns(turns), *columns)


def reference_coalesce(turns, gap=0.5):
    out = []
    for t in sorted(turns, key=lambda t: (t[0], t[0] - t[1])):
        if out and out[-1][2] == t[2]:
            if t[1] <= out[-1][1]:
                continue
            if t[0] - out[-1][1] <= gap:
                out[-1][1] = t[1]
                continue
        out.append(list(t))
    return out


def test_coalesce_turns_brute_force(recording):
    _, turns = recording
    data = [(r.start, r.end, r.speaker) for r in turns.where("recording_id = 1").orderBy("turn_ord").collect()]
    got = align.coalesce_turns(turns, span=SMALL).where("recording_id = 1")
    assert rows(got, "start", "end", "speaker") == sorted(map(tuple, reference_coalesce(data)), key=repr)


def test_merge_short_turns(recording):
    _, turns = recording
    columns = ("recording_id", "turn_ord", "speaker")
    split, whole = align.merge_short_turns(turns, span=SMALL), align.merge_short_turns(turns)
    assert rows(split, *columns) == rows(whole, *columns)
    data = [tuple(r) for r in turns.where("recording_id = 1").select("start", "end", "speaker", "turn_ord").orderBy("turn_ord").collect()]
    kept = [t for t in data if t[1] - t[0] >= 1.0]
    want = []
    for t in data:
        if t[1] - t[0] >= 1.0:
            want.append((t[3], t[2]))
            continue
        inside = [k for k in kept if k[0] <= t[0] and t[1] <= k[1]]
        best = (min(inside, key=lambda k: k[1] - k[0]) if inside
                else min(kept, key=lambda k: min(abs(k[0] - t[1]), abs(t[0] - k[1]))))
        want.append((t[3], best[2]))
    assert rows(whole.where("recording_id = 1"), "turn_ord", "speaker") == sorted(want, key=repr)


def most_overlapped(seg, turns):
    best, most = None, 0.0
    for t in turns:
        both = min(seg[1], t[1]) - max(seg[0], t[0])
        if both > most:
            best, most = t[2], both
    return best


def test_assign_speaker_at_every_level(spark):
    rng = random.Random(11)
    length = lambda: rng.choice([0.0, 0.01, 1.0, 7.99, 8.0, 8.01, 64.0, 512.0, 31_536_000.0, rng.random() * 100])
    at = lambda: rng.choice([rng.random() * 200 - 50, rng.randrange(0, 640, 8) * 1.0, 0.0])
    make = lambda n: [(lambda a: (a, a + length()))(at()) for _ in range(n)]
    segs, turns = make(300), [(*x, rng.randrange(5)) for x in make(200)]
    s = spark.createDataFrame([(1, i, *x, "") for i, x in enumerate(segs)] + [(2, 0, 0.0, 9.0, "")], SEGMENTS)
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], TURNS)
    got = {(r.recording_id, r.seg_ord): r.speaker for r in align.assign_speaker(s, t).collect()}
    assert got == {(2, 0): None, **{(1, i): most_overlapped(x, turns) for i, x in enumerate(segs)}}


def test_assign_speaker_of_a_dense_minute_and_a_year(spark):
    """A hundred thousand overlapping segments in one minute, under a few turns and one of a year."""
    n = 100_000
    minute = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").cast("int").alias("seg_ord"),
                                   (F.col("id") % 5000 / 100).alias("start"), (F.col("id") % 5000 / 100 + 10 + F.col("id") % 7).alias("end"), F.lit("").alias("text"))
    year = spark.createDataFrame([(1, n, 0.0, 31_536_000.0, "")], SEGMENTS)
    turns = [(0.0, 20.0, 0), (18.5, 40.0, 1), (39.0, 41.0, 2), (41.0, 31_000_000.0, 3)]
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], TURNS)
    found = align.assign_speaker(minute.unionByName(year), t).groupBy("start", "end", "speaker").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == n + 1
    assert all(r.speaker == most_overlapped((r.start, r.end), turns) for r in found)
    pairs = align.touching(minute.select("recording_id", "seg_ord", F.col("start").alias("p0"), F.col("end").alias("p1")),
                           t.select("recording_id", "speaker", F.col("start").alias("q0"), F.col("end").alias("q1")))
    assert pairs.count() == pairs.distinct().count() <= len(turns) * n


@pytest.mark.parametrize("operator", [align.group_by_speaker, align.labeled_transcript])
def test_block_texts(recording, operator):
    segs, turns = recording

    def texts(span):
        got = operator(segs, turns, span=span)
        return sorted((r.recording_id, r.block_ord, r.text) for r in got.collect())

    assert texts(SMALL) == texts(1 << 16)


def test_ordered_helpers(recording):
    _, turns = recording
    order, keys = [F.col("start"), F.col("turn_ord")], ["recording_id"]
    bucket = ordered.time_bucket("start", 20.0)
    value = F.when(F.col("speaker") > 0, F.col("speaker"))
    for inherit in (False, True):
        make = lambda b: ordered.islands(turns, keys, order, value, bucket=b, out="i", filled="f", inherit_null=inherit)
        columns = ("recording_id", "turn_ord", "i", "f")
        assert rows(make(bucket), *columns) == rows(make(None), *columns)
    for helper in (ordered.running_sum, ordered.prior_max):
        make = lambda b: helper(turns, keys, order, F.col("speaker"), bucket=b, out="o")
        assert rows(make(bucket), "recording_id", "turn_ord", "o") == rows(make(None), "recording_id", "turn_ord", "o")


def test_merge_blocks_fixed_point(spark):
    rng = random.Random(5)
    data = [(1, i // 3, i % 3, "narration", rng.choice(["a", "ab", "b", "bc", "abc"]), f"t{i}") for i in range(200)]
    df = spark.createDataFrame(data + [(2, 0, 0, "narration", "z", "only")], BLOCKS)
    columns = ("meeting_id", "sec_ord", "title", "content")
    got = rows(minutes.merge_blocks(df, shift=2), *columns)
    assert got == rows(minutes.merge_blocks(df), *columns) == rows(minutes.merge_blocks(df, shift=0), *columns)
    head, sections = None, 0
    for row in data:
        if head is None or not (head in row[4] or row[4] in head):
            head, sections = row[4], sections + 1
    assert sum(r[0] == 1 for r in got) == sections


def test_stitch_text_fixed_point(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(4000))
    data = [(1, i, text[i * 40:i * 40 + rng.choice([12, 60, 90])]) for i in range(90)]
    df = spark.createDataFrame(data, "recording_id bigint, chunk_ord int, text string")
    previous, want = None, []
    for _, i, t in data:
        if previous is not None:
            shared = next((k for k in range(min(len(previous), len(t), 200), 9, -1) if previous[-k:] == t[:k]), 0)
            t = t[shared:].lstrip() if shared else t
        want.append((i, t))
        previous = t
    assert rows(chunking.stitch_text(df), "chunk_ord", "text") == sorted(want, key=repr)


def test_title_runs_tell_every_fold():
    rng = random.Random(2)
    for _ in range(400):
        titles = [rng.choice(["", "a", "ab", "b", "bc", "abc", "c"]) for _ in range(rng.randrange(1, 12))]
        firsts, ends, opened = minutes.title_runs(titles)
        for head in (None, "", "a", "ab", "b", "bc", "abc", "c", "zz"):
            now, n = head, 0
            for t in titles:
                if now is None or not minutes.similar_titles(now, t):
                    now, n = t, n + 1
            at = next((i for i, t in enumerate(firsts) if head is None or not minutes.similar_titles(head, t)), None)
            assert (now, n) == ((head, 0) if at is None else (ends[at], opened[at]))


def test_merge_blocks_of_one_long_chunk_on_one_topic(spark):
    df = spark.range(100_000).select(
        F.lit(1).cast("long").alias("meeting_id"), F.lit(0).alias("chunk_ord"), F.col("id").cast("int").alias("block_ord"), F.lit("narration").alias("type"),
        F.when(F.col("id") % 3 == 0, "topic").otherwise("topics").alias("topic"), F.col("id").cast("string").alias("text"))
    df = df.unionByName(spark.createDataFrame([(2, 5, 0, "narration", "b", "x"), (2, 1, 7, "narration", "a", "y"), (None, 0, 0, "narration", "c", "z")], BLOCKS))
    got = {(r.meeting_id, r.sec_ord): (r.title, r.n) for r in minutes.merge_blocks(df).select(
        "meeting_id", "sec_ord", "title", F.length("content").alias("n")).collect()}
    size = sum(len(str(i)) for i in range(100_000)) + 2 * 99_999
    assert got == {(1, 0): ("topic", size), (2, 0): ("a", 1), (2, 1): ("b", 1), (None, 0): ("c", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_stitch_text_of_short_chunks(spark, monkeypatch, seed):
    """Chunks that are shorter than their overlaps, so that what was trimmed before decides."""
    monkeypatch.setattr(ordered, "SPAN", 8)
    rng = random.Random(seed)
    data = []
    for rec in range(6):
        text = "".join(rng.choice("ab ") for _ in range(60)) if rec % 2 else "ab " * 30
        at = 0
        for i in range(40):
            data.append((rec, 3 * i, text[at:at + rng.choice([2, 4, 7, 20])]))
            at = (at + rng.choice([0, 1, 3])) % 50
    df = spark.createDataFrame(data, "recording_id bigint, chunk_ord int, text string")
    want, previous, of = [], None, None
    for rec, i, t in data:
        if rec != of:
            previous, of = None, rec
        if previous is not None:
            shared = next((k for k in range(min(len(previous), len(t), 6), 0, -1) if previous[-k:] == t[:k]), 0)
            t = t[shared:].lstrip() if shared else t
        want.append((rec, i, t))
        previous = t[-6:]
    assert rows(chunking.stitch_text(df, min_overlap=1, span=6), "recording_id", "chunk_ord", "text") == sorted(want, key=repr)


def minutes_of(spark):
    rng = random.Random(9)
    words = ["营收12", "亿元", "产能", "良率95", "%", "2026年", "客户", "abc", "de", "3"]
    said = lambda n: "".join(rng.choice(words) for _ in range(n))
    transcripts = spark.createDataFrame([(m, said(900)) for m in (1, 2, 3)], TRANSCRIPTS)
    sections = spark.createDataFrame([(1, i, "t", said(3), []) for i in range(60)] + [(2, 0, "t", said(30), [])], SECTIONS)
    pairs = spark.createDataFrame([(m, i, said(4), said(4), "", "", "") for m in (1, 2) for i in range(20)], QA_PAIRS)
    return transcripts, sections, pairs


def test_coverage_token_join(spark):
    t, s, q = minutes_of(spark)
    columns = ("meeting_id", "chunk_ord", "score")
    assert rows(factcheck.coverage_chunks(t, s, q, span=8), *columns) == rows(factcheck.coverage_chunks(t, s, q), *columns)
    plain, split = factcheck.coverage_report(t, s, q), factcheck.coverage_report(t, s, q, span=8)
    assert rows(plain, "meeting_id", "total_chunks", "uncovered_chunks") == rows(split, "meeting_id", "total_chunks", "uncovered_chunks")


def test_drop_redundant_token_join(spark):
    _, s, q = minutes_of(spark)
    assert rows(minutes.drop_redundant_qa(q, s, span=8), "meeting_id", "qa_ord") == rows(
        minutes.drop_redundant_qa(q, s), "meeting_id", "qa_ord")


@pytest.mark.parametrize("span", [1, 2, 3, 7])
def test_pieces_of_any_size_give_the_same_coverage(spark, span):
    rng = random.Random(span)
    part = lambda: rng.choice(["", "。。", "收入1", "2", "3", "万元", "甲", "乙丙", "12.5", "%", "-", "年", "123456789" * 12, "ab", "，"])
    sections = [(m, i, "t", part(), []) for m in range(12) for i in range(rng.randrange(1, 25))]
    said = [(m, "".join(part() for _ in range(40)) + "收入123万元，123万，共123万计123万") for m in range(12)]
    t, s = spark.createDataFrame(said, TRANSCRIPTS), spark.createDataFrame(sections, SECTIONS)
    q = spark.createDataFrame([(m, i, part(), part(), "", "", "") for m in range(0, 12, 2) for i in range(9)], QA_PAIRS)
    columns = ("meeting_id", "chunk_ord", "score", "covered")
    assert rows(factcheck.coverage_chunks(t, s, q, span=span), *columns) == rows(factcheck.coverage_chunks(t, s, q), *columns)


def test_a_document_of_many_lines_is_laid_out(spark, tmp_path):
    n = 200_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("meeting_id"), (F.col("id") % 3).cast("int").alias("part"), F.col("id").alias("ord"),
                                  F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")).alias("text"))
    lines = lines.unionByName(spark.createDataFrame([(2, 0, 0, "ab"), (2, 0, 1, "c"), (2, 1, 0, "")], "meeting_id long, part int, ord long, text string"))
    path = files.write_lines(rendering.laid_out(lines), str(tmp_path), "lines")
    got = spark.read.schema("meeting_id long, text_start long, text string").json(path)
    assert [tuple(r) for r in got.where("meeting_id = 2").orderBy("text_start").collect()] == [(2, 0, "ab"), (2, 3, "c"), (2, 5, "")]
    at = 0
    for r in got.where("meeting_id = 1").orderBy("text_start").select("text_start", F.length("text").alias("n")).toLocalIterator():
        assert r.text_start == at
        at += r.n + 1
    want = "\n".join("é" * (i % 5) for part in range(3) for i in range(part, n, 3))
    assert at == len(want) + 1
    # Files hold stretches of the order.
    spans = spark.read.schema("meeting_id long, text_start long").json(path).groupBy(F.input_file_name()).agg(
        F.min(F.struct("meeting_id", "text_start")).alias("a"), F.max(F.struct("meeting_id", "text_start")).alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))
