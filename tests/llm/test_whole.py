"""Results that must not depend on a bound: samples, slots and ways of writing a token."""

import random

from pyspark.sql import functions as F

from colloquy.llm import mixing, secrets, toxicity


def test_the_sample_keeps_the_rate_of_rejected_documents(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeioubdfglmnrst") for _ in range(7)) for _ in range(400)]
    rows, labels = [], []
    for i in range(6000):
        mark = "zzyvurk" if i % 12 == 0 else "wrempyx" if i % 20 == 1 else None
        toxic = mark is not None and rnd.random() < (0.3 if mark == "zzyvurk" else 0.95)
        text = [rnd.choice(words) for _ in range(12)]
        rows.append((i, " ".join(text[:6] + [mark] * bool(mark) + text[6:])))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rate = lambda: toxicity.score_documents(docs, marks).agg(F.avg("predicted")).head()[0]
    whole = rate()
    assert 0.04 < whole < 0.06
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 400, 0: 600})
    assert abs(rate() - whole) < 0.01


def test_tiny_sources_beside_a_huge_one_reach_their_targets(spark):
    # One source of 100 000 words, 40 of 10 words each in two documents; a block has 101 words.
    rows = [(i, "word " * 1000, "a") for i in range(100)]
    rows += [(1000 + i, "tiny " * (4 + 2 * (i % 2)), f"b{i // 2:02}") for i in range(80)] + [(5000, "no source", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, carry=("source",), slots=1000).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(got) == 42
    for r in got:
        assert abs(r["taken"] - r["target"]) <= (0.5 if r["source"] != "a" else 0.01 * r["target"])
        assert r["taken"] <= 3 * r["size"]
    # A target between whole rounds: the first words of the shuffled order once more, none other.
    few = mixing.mix(docs, carry=("source",), weights=(4000, 1, 2), slots=1000).where("source = 'b00'").collect()
    assert sum(r["taken"] for r in few) == round(few[0]["target"]) and len({r["target"] for r in few}) == 1


def test_the_schedule_is_that_of_the_oracle_with_tiny_and_huge_sources(spark):
    import duckdb

    rows = [(i, "word " * (50 + 7 * i % 90), "huge") for i in range(3000)] + [(10_000 + i, "few words " * (i % 3), f"tiny{i % 4}") for i in range(20)]
    rows += [(20_000, "no source at all", None), (20_001, None, None), (20_002, "alone", "one"), (20_003, "", "empty")]
    rows += [(30_000 + i, "middling " * 40, "middle") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    given = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE d AS SELECT doc_id::BIGINT AS doc_id, text, source FROM given")
    want = sorted(con.execute(mixing.mixing_sql("d")).fetchall())
    assert [r[:3] + (round(r[3], 6), r[4]) for r in got] == [r[:3] + (round(r[3], 6), r[4]) for r in want]
    by = {}
    for (_, _, source), r in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        by.setdefault(source, [0, r[3]])[0] += r[4]
    assert all(abs(t - target) <= max(1, 0.003 * target) for t, target in by.values()), by


def test_rows_of_one_id_share_what_they_take(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f", "x"), (2, "g h i", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(tuple(r) for r in mixing.mix(d, carry=("text",)).collect()) for d in (docs, docs.repartition(3), docs.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2]
    assert sorted(r["text"] for r in mixing.mixed(docs).collect()) == sorted(t for _, t, _ in rows)


def test_values_behind_names_and_paths_are_found(spark):
    rnd = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda more="", n=44: "".join(rnd.choice(letters + more) for _ in range(n))
    ways = [("ACCESS_KEY_OF_THE_SERVICE={}", ""), ("https://example.org/a?client_id={}", "-_"), ("&sig={}==", "+/"), ("a_name=={}", ""),
            ("/hooks/services/workspace/incoming/{}/messages", "-_"), ("prefix_of_the_service_live_{}", "+/"), ("one-service-or-another-{}", "")]
    prose = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(140).collect()]
    rows = []
    for i, p in enumerate(prose):
        way, more = ways[i % len(ways)]
        v = value(more)
        rows.append((i, f"{p[:1500]} see {way.format(v)} and incomprehensibilities-notwithstanding=counterrevolutionaries/internationalisation "
                        "words_that_are_written_like_this are ordinary", v))
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    got = {r["doc_id"]: r["added"] for r in secrets.find_secrets(docs).collect()}
    for w in range(len(ways)):
        mine = [r for r in rows if r[0] % len(ways) == w]
        assert sum(any(v in t[a["start"]:a["end"]] for a in got[i]) for i, t, v in mine) >= 0.85 * len(mine), ways[w]
    assert not any(x in t[a["start"]:a["end"]] for i, t, _ in rows for a in got[i] for x in ("incompreh", "counterrev", "internat", "written"))
    for spans in got.values():
        assert not any(a != b and a["start"] <= b["start"] and b["end"] <= a["end"] for a in spans for b in spans)
