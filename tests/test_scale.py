"""Plans and steps that must not grow faster than their tables."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions import tokens
from colloquy.operators import chunking, dictionary, factcheck
from colloquy.operators import glossary as gl
from colloquy.plans import inputs
from colloquy.sources import model_output as mo


def test_expansion_broadcasts_no_glossary(spark, tmp_path):
    rows = [("g", i, "示例电子", "", ["市例电子", None]) for i in range(3)]
    spark.createDataFrame(rows, "glossary_id string, term_ord int, term string, context string, corrections array<string>") \
        .write.parquet(f"{tmp_path}/terms")
    glossary = spark.read.parquet(f"{tmp_path}/terms")
    for positions in (1, 2):
        found = gl.expand_glossary(glossary, inputs.pinyin(spark), max_positions=positions)
        # So small a file is below the threshold, as a large one that compresses well is.
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "term_ord" in x]
        rows = found.collect()
        assert "市例电子" not in {r["variant"] for r in rows}
        assert {r["term_ord"] for r in rows} == {0, 1, 2}
        for n in range(3):
            ordinals = [r["variant_ord"] for r in rows if r["term_ord"] == n]
            assert len(set(ordinals)) == len(ordinals)


def _folded_cuts(text, size, overlap, marks):
    """The cuts as one definition step after the other, on code points."""
    out, start = [], 0
    if len(text) <= size:
        return [(0, len(text))]
    while start < len(text):
        stop = len(text)
        if start + size < len(text):
            low = max(start + size - chunking.CUT_WINDOW, start)
            places = [i + 1 for m in marks for i in sorted((i for i in range(low, start + size) if text[i] == m and i > start), reverse=True)[:1]]
            stop = places[0] if places else start + size
        out.append((start, stop))
        if stop == len(text) and start + size >= len(text):
            break
        start = stop - overlap if stop - overlap > start else stop
    return out


def test_cuts_of_long_texts_take_one_pass(spark):
    """A text 300 times the usual length: cuts by offsets from its beginning took minutes."""
    pick = random.Random(3)
    texts = ["".join(pick.choice("ab, .\U0001F600示\n") for _ in range(n)) for n in (0, 1, 99, 400, 401, 2000, 5000)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "meeting_id int, text string")
    for size, overlap in ((400, 60), (120, 50), (1000, 100)):
        bounds = rows.select("meeting_id", chunking.chunk_bounds(F.col("text"), size, overlap, (".", ",")).alias("b")).collect()
        pieces = chunking.chunk_text(rows, "text", size, overlap, (".", ",")).collect()
        for i, t in enumerate(texts):
            want = None if t is None else _folded_cuts(t, size, overlap, (".", ","))
            assert next(r.b for r in bounds if r.meeting_id == i) == want
            assert sorted((r.chunk_ord, r.chunk_start, r.chunk) for r in pieces if r.meeting_id == i) == [
                (j, s, t[s:e]) for j, (s, e) in enumerate(want or [])]
    long = spark.range(1).select(F.lit(1).alias("meeting_id"), F.expr("repeat('示 the, ', 1000000)").alias("text"))
    begun = time.monotonic()
    assert chunking.chunk_text(long, "text", 400, 60, (".", ",")).count() > 15_000
    assert time.monotonic() - begun < 30


def test_shared_edges_and_repeats_as_by_trying_every_length():
    pick = random.Random(5)
    for _ in range(3000):
        tail, text = ("".join(pick.choice("ab") for _ in range(pick.randrange(14))) for _ in range(2))
        longest, shortest, guard = pick.randrange(3, 12), pick.randrange(1, 4), pick.randrange(4)
        sizes = range(min(len(tail), len(text), longest), shortest - 1, -1)
        assert chunking.edges_of(tail[-longest:], text[:longest], longest, shortest) == [k for k in sizes if tail[len(tail) - k:] == text[:k]]
        found = ((text.find(tail[len(tail) - k:]), k) for k in sizes)
        assert chunking.end_of_repeat(tail, text, longest, shortest, guard) == next((at + k for at, k in found if 0 <= at < len(text) - guard), None)


def test_trimming_a_repeat_takes_no_longer_than_its_chunk(spark):
    """A chunk in which no end of the one before it is found: every length was sought, from the greatest."""
    rows = spark.range(40_000).select(F.lit(1).alias("meeting_id"), F.col("id").cast("int").alias("chunk_ord"),
                                      F.concat(F.repeat(F.lit("the "), F.lit(400)), F.lpad("id", 9, "0")).alias("text"))
    begun = time.monotonic()
    trimmed = chunking.trim_rewrite_overlap(rows)
    assert trimmed.where(F.length("text") < 1609).count() == 0
    assert time.monotonic() - begun < 20


def test_tokens_of_a_score_are_those_of_the_expressions(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice("aZ09%-示 ,é\U0001F600\n年") for _ in range(n)) for n in (0, 1, 2, 3, 50, 800)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        tokens.match_tokens(F.col("text")).alias("m"), tokens.normalize_match(F.col("text")).alias("norm")).withColumn(
        "bigrams", tokens.char_bigrams(F.col("norm")))
    for r in rows.collect():
        assert r.m.norm == r.norm
        assert (r.bigrams and {ord(b[0]) << 21 | ord(b[1]) for b in r.bigrams}) == (r.m.pairs and set(r.m.pairs))
        assert r.bigrams is None or len(r.bigrams) == len(r.m.pairs)


def test_scoring_a_long_meeting_takes_seconds(spark):
    """Eight million characters, whose marks and bigrams were a match of an expression each."""
    text = F.expr("repeat('the and, of it - ', 500000)")
    t = spark.range(8).select(F.col("id").alias("meeting_id"), text.alias("text"))
    s = spark.range(8).select(F.col("id").alias("meeting_id"), F.lit(0).alias("sec_ord"), F.lit("a").alias("title"), text.alias("content"),
                              F.array().cast("array<string>").alias("citations"))
    q = inputs.qa_pairs(spark, "/root/testdata/sf0.001").where("false")
    begun = time.monotonic()
    assert {r.covered for r in factcheck.coverage_chunks(t, s, q, (".", ",")).select("covered").distinct().collect()} == {True}
    assert time.monotonic() - begun < 20


def test_a_long_draft_takes_seconds(spark):
    """20 000 topics and pairs in one draft: each topic and each pair split the whole text again."""
    n = 20_000
    text = "---\n{}\n---\n## 主题要点\n" + "".join(f"### t{i}\nc{i}\n\n" for i in range(n)) + "## 问答\n" + "".join(
        f"**Q{i}**：q{i}\n**A**：a{i}\n\n" for i in range(n))
    begun = time.monotonic()
    sections, pairs = mo.resolve_review(spark.createDataFrame([(1, text)], "meeting_id int, text string"))
    assert [(r.title, r.content) for r in sections.orderBy("sec_ord").collect()] == [(f"t{i}", f"c{i}") for i in range(n)]
    assert [(r.question, r.answer) for r in pairs.orderBy("qa_ord").collect()] == [(f"q{i}", f"a{i}") for i in range(n)]
    assert time.monotonic() - begun < 30


def test_marks_open_and_close_as_told(spark):
    texts = ["Q：\nQ1：a\nA：\nA：x\n\ny Q：b", "A：x Q：q A： \n Q：r\nA：s\r\n\r\nt", "Q：q", "no mark", None, "【问】 u【答】v\n\nw【答】【问】z【答】"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(
        "id", mo._marked_pairs(F.col("text"), mo.LETTER_MARK).alias("l"), mo._marked_pairs(F.col("text"), mo.BRACKET_MARK).alias("b")).orderBy("id").collect()
    pairs = [[tuple(p) for p in r.l or []] for r in rows]
    assert pairs == [[("Q1：a", "A：x")], [("q", ""), ("r", "s")], [], [], [], []]
    assert [tuple(p) for p in rows[5].b] == [("u", "v")]


def test_hits_of_many_forms_stay_with_their_texts(spark):
    """30 000 forms: the windows were written to disk, shuffled to their forms and shuffled back to their texts."""
    terms = spark.range(30_000).select(F.lit("g").alias("glossary_id"), F.col("id").cast("int").alias("term_ord"), F.concat(F.lit("T"), "id").alias("term"),
                                       F.lit("").alias("context"), F.array(F.concat(F.lit("w"), "id")).alias("corrections"),
                                       F.array(F.concat(F.lit("v"), "id")).alias("auto_variants"))
    texts = spark.createDataFrame([(1, "w1 v22 w22 v22"), (2, "w333 v4"), (None, "w5")], "meeting_id int, text string")
    twice = texts.union(texts)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    hits = gl.exact_hits(texts, terms)
    assert "Repartition" not in plan(hits) and "Exchange" not in plan(hits) and "SortMergeJoin" not in plan(hits)
    rows = lambda df: sorted((r.meeting_id or 0, r.start, r.term) for r in df.collect())
    assert rows(hits) == [(0, 0, "T5"), (1, 0, "T1"), (1, 7, "T22"), (2, 0, "T333")]
    assert rows(gl.exact_hits(twice, terms)) == rows(hits)
    assert sorted((r.meeting_id or 0, r.term, r.occurrences) for r in gl.term_frequency(texts, terms).collect()) == [
        (r.meeting_id or 0, r.term, r.occurrences) for r in gl.term_frequency(twice, terms).orderBy(F.coalesce("meeting_id", F.lit(0)), "term").collect()]


def test_short_texts_are_looked_through_together(spark):
    """A pass for each of many short texts took a hundred times as long; what is found lies within one text."""
    texts = ["ab", None, "", "cab", "b" * dictionary.PIECE, "a", "b"] + ["xa", "bx"] * 500
    pieces = list(dictionary._joined(pa.array(texts, pa.string())))
    assert [(first, len(bounds) - 1) for first, _, bounds in pieces] == [(0, 4), (4, 1), (5, len(texts) - 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "meeting_id int, text string").coalesce(1)
    form = spark.createDataFrame([("ab",), ("b" * 9,)], "key string")
    found = dictionary.matches(df, form, surround=5).where("matched = 'ab'").collect()
    assert sorted((r.meeting_id, r.start, r.before, r.after) for r in found) == [(0, 0, "", ""), (3, 1, "c", "")]


def test_a_window_is_compared_once(spark):
    """However often and in however many texts it occurs, and by whatever open place it passes."""
    df = spark.createDataFrame([(i, "例力子百" * 300) for i in range(20)], "meeting_id int, text string")
    forms = spark.createDataFrame([("例" + dictionary.WILD + "子",), (dictionary.WILD + "力子",), ("子百" + dictionary.WILD,)], "key string")
    assert sorted(r.matched for r in dictionary.windows(df, forms).collect()) == ["例力子", "子百例"]
    hits = gl.scan_phonetic(df, gl.glossary_table(spark, [gl.Term("立力子"), gl.Term("例立子")]), {"例": "li", "力": "li", "立": "li"})
    assert {(r.term, r.matched, r["count"]) for r in hits.groupBy("term", "matched").count().collect()} == {
        ("立力子", "例力子", 6000), ("例立子", "例力子", 6000)}
