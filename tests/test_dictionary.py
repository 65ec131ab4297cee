"""Forms of a table in texts, against plain loops."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import dictionary as d
from colloquy.operators import glossary as gl
from colloquy.operators import lookup
from colloquy.operators.glossary import Term
from colloquy.schemas import TRANSCRIPTS

LETTERS = ["a", "b", "A", "é", "例", "力", "\U0001f600", " ", "\n", "1"]


def texts_of(rnd, n, longest=60):
    return [(i, "".join(rnd.choices(LETTERS, k=rnd.randrange(longest)))) for i in range(n)]


def forms_of(rnd, n, longest=5):
    return sorted({"".join(rnd.choices(LETTERS, k=rnd.randrange(1, longest))) for _ in range(n)})


def starts(text, form):
    return [i for i in range(len(text) - len(form) + 1) if text[i:i + len(form)] == form]


@pytest.mark.parametrize(("broadcast", "bits"), [(20_000, 16), (0, 16), (20_000, 6)])
def test_matches_are_all_occurrences(spark, monkeypatch, broadcast, bits):
    """Joined in both ways, and with a filter so full that it passes nearly every window."""
    monkeypatch.setattr(d, "BROADCAST_FORMS", broadcast)
    monkeypatch.setattr(d, "LEAST_BITS", bits)
    monkeypatch.setattr(d, "MOST_BITS", max(bits, 7))
    monkeypatch.setattr(d, "HOT_ROWS", 5)
    rnd = random.Random(bits)
    texts, forms = texts_of(rnd, 80) + [(90, None), (91, ""), (92, "ab" * 500)], forms_of(rnd, 60) + ["ab", "bab"]
    df = spark.createDataFrame(texts, TRANSCRIPTS)
    table = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(forms))] + [("", -1), (None, -2)], "key string, n int")
    got = sorted((r.meeting_id, r.start, r.n, r.matched, r.before, r.after) for r in d.matches(df, table, surround=3).collect())
    want = sorted((m, s, i, f, t[max(0, s - 3):s], t[s + len(f):s + len(f) + 3])
                  for m, t in texts if t for i, f in enumerate(dict.fromkeys(forms)) for s in starts(t, f))
    assert got == want and len(got) > 500
    assert d.matches(df, table.where("false")).collect() == []


def test_pieces_of_a_long_text_and_open_places(monkeypatch):
    monkeypatch.setattr(d, "PIECE", 16)
    rnd = random.Random(5)
    text = "".join(rnd.choices("abc例", k=300))
    shapes = [(3, 1), (3, 3), (4, 0), (1, 0), (7, 2)]
    keys = []
    for n, place in shapes:
        for s in rnd.sample(range(290), 4):
            w = text[s:s + n]
            keys.append(w[:place - 1] + d.WILD + w[place:] if place else w)
    h = d.form_hashes(keys, shapes, 0)
    words = np.zeros(1 << 14, np.uint64)
    for at in np.concatenate(d.Filter.places(h, 20)).tolist():
        words[at >> 6] |= np.uint64(1) << np.uint64(at & 63)
    found = {(n, place, int(s)) for n, place, at in d.candidates_in(d.codes_of(text, None), shapes, 0, d.Filter(words, 20)) for s in at}
    for key in keys:
        place = key.find(d.WILD) + 1
        for s in range(len(text) - len(key) + 1):
            if all(a in (b, d.WILD) for a, b in zip(key, text[s:s + len(key)])):
                assert (len(key), place, s) in found


def test_a_table_corrects_as_a_list_does(spark):
    """Leftmost, then longest, and ASCII forms only by themselves."""
    rnd = random.Random(8)
    texts = [(i, t) for i, t in texts_of(rnd, 150)]
    terms = [Term(f"T{i}", "", tuple(rnd.sample(forms_of(rnd, 12), 3))) for i in range(25)]
    df = spark.createDataFrame(texts, TRANSCRIPTS)
    table = gl.glossary_table(spark, terms)
    one = sorted(tuple(r) for r in gl.apply_exact(df, terms).collect())
    assert sorted(tuple(r) for r in gl.apply_exact(df, table).collect()) == one
    assert one != sorted(texts)
    by = dict(texts)
    hits = gl.exact_hits(df, table).collect()
    assert all(by[h.meeting_id][h.start:h.end] == h.matched for h in hits)
    spans = sorted((h.meeting_id, h.start, h.end) for h in hits)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def greedy(text, form):
    out, free = [], 0
    for s in starts(text, form):
        if s >= free:
            out.append(s)
            free = s + len(form)
    return out


def test_variants_and_frequencies_of_many_forms(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choices("例力立电垫子", k=rnd.randrange(80)))) for i in range(60)]
    word = lambda n: "".join(rnd.choices("例力立电垫子", k=n))
    terms = [Term(word(3), "", (), tuple({word(rnd.choice([2, 3])) for _ in range(3)})) for _ in range(150)]
    df, table = spark.createDataFrame(texts, TRANSCRIPTS), gl.glossary_table(spark, terms)
    claimed = {}
    for t in terms:
        for v in t.auto_variants:
            if v != t.term:
                claimed.setdefault(v, t.term)
    want = set()
    for m, t in texts:
        for v, term in claimed.items():
            at, right = greedy(t, v), len(greedy(t, term))
            if at and not (right and len(at) > max(gl.REPEAT_THRESHOLD, right)):
                want |= {(m, term, v, s) for s in at}
    got = {(r.meeting_id, r.term, r.matched, r.start) for r in gl.scan_variants(df, table).collect()}
    assert got == want and len(want) > 300
    counts = {(m, i): n for m, t in texts for i, x in enumerate(terms) if (n := len(greedy(t, x.term)))}
    assert {(r.meeting_id, r.term_ord): r.occurrences for r in gl.term_frequency(df, table).collect()} == counts


SOUNDS = {c: s for s, g in {"li": "例力立", "dian": "电垫", "zi": "子字"}.items() for c in g}


def test_sounds_of_many_terms(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("例力立电垫子字百", k=n))
    texts = [(i, word(rnd.randrange(60)) + rnd.choice(["", "a", "，"]) + word(9)) for i in range(50)]
    terms = sorted({word(n) for n in (2, 3, 4, 5) for _ in range(40)})
    sound = lambda w: [SOUNDS.get(c, c) for c in w]
    want = set()
    for m, t in texts:
        for w in terms:
            for s in range(len(t) - len(w) + 1):
                x = t[s:s + len(w)]
                if (x != w and not re.search("[a，]", x) and any(a == b for a, b in zip(x, w))
                        and len(set(x) & set(w)) >= max(1, len(w) // 2)
                        and sum(a != b for a, b in zip(sound(x), sound(w))) <= (len(w) > 2)):
                    want.add((m, w, x, s))
    df = spark.createDataFrame(texts, TRANSCRIPTS)
    got = [(r.meeting_id, r.term, r.matched, r.start) for r in gl.scan_phonetic(df, gl.glossary_table(spark, [Term(w) for w in terms]), SOUNDS).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_a_frequent_form_is_spread(spark):
    """One key with nearly all rows goes to every partition, and no row is lost."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise("hot").alias("key"),
                                      F.col("id").cast("int").alias("start"))
    forms = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k100", 4), ("none", 5)], "key string, n int")
    out = d.spread_join(rows, forms, "key", "start")
    assert out.count() == 2 * 39_600 + 2
    parts = out.where("key = 'hot'").groupBy(F.pmod(F.xxhash64("start", "start"), F.lit(8))).count().count()
    assert parts == 8


def test_sounds_are_found_in_place(spark, monkeypatch):
    """Windows and hits went to disk before they were rows; a task that forgets, and terms beyond a task's memory, give the same."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choices("例力立电垫子字百\n", k=n))
    texts = [(i % 40, word(rnd.randrange(90))) for i in range(60)] + [(None, word(50)), (7, None), (8, "")]
    terms = sorted({word(n).strip() or "例" for n in (1, 2, 3, 4, 6) for _ in range(40)})
    df, table = spark.createDataFrame(texts, TRANSCRIPTS), gl.glossary_table(spark, [Term(w) for w in terms])
    scan = lambda: sorted(map(repr, gl.scan_phonetic(df, table, SOUNDS, min_term_len=1).collect()))
    joined = []
    settled = gl.settle
    monkeypatch.setattr(gl, "settle", lambda rows: joined.append(1) or settled(rows))
    got = scan()
    assert len(got) > 200 and not joined
    for name, value in (("SLICE", 2), ("HEARD", 20), ("HITS", 3)):
        monkeypatch.setattr(gl, name, value)
    assert scan() == got and not joined
    monkeypatch.setattr(d, "BROADCAST_CHARS", 0)
    assert scan() == got and joined


def test_variants_are_kept_and_terms_counted_in_place(spark, monkeypatch):
    """Hits went to disk before they were counted; forms beyond a task's memory give the same, as do texts that share an id."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choices("ab例\n", k=n))
    texts = [(i, word(rnd.randrange(120))) for i in range(30)] + [(40, "ab" * 90 + "aaaa" * 30), (41, None), (42, ""), (None, word(60))]
    words = [word(n) for n in (1, 2, 3, 4) for _ in range(12)]
    table = gl.glossary_table(spark, [Term(w, "", tuple(rnd.choices(words, k=3)), tuple(rnd.choices(words, k=3))) for w in words])
    settled, joined = gl.settle, []
    monkeypatch.setattr(gl, "settle", lambda rows: joined.append(1) or settled(rows))

    def both(rows):
        df = spark.createDataFrame(rows, TRANSCRIPTS)
        return [sorted(map(repr, f(df, table).collect())) for f in (gl.scan_variants, gl.term_frequency)]

    got = both(texts)
    assert min(map(len, got)) > 200 and not joined
    monkeypatch.setattr(gl, "HITS", 3)
    assert both(texts) == got and not joined
    monkeypatch.setattr(gl, "OWN_FORMS", 0)
    assert both(texts) == got
    shared = both([*texts, (3, "ab例ab"), (None, "aab")])
    monkeypatch.setattr(d, "BROADCAST_FORMS", 0)
    joined.clear()
    assert both(texts) == got and joined
    assert both([*texts, (3, "ab例ab"), (None, "aab")]) == shared


@pytest.mark.parametrize("piece", [16, 1 << 17])
def test_hits_of_an_index(monkeypatch, piece):
    """Short texts together, and a long one in pieces; occurrences of a form do not overlap, and many windows are no form."""
    rnd = random.Random(piece)
    monkeypatch.setattr(d, "PIECE", piece)
    monkeypatch.setattr(lookup, "PAIRS", 2)
    monkeypatch.setattr(d, "MOST_BITS", 7)
    word = lambda n: "".join(rnd.choices("ab例", k=n))
    texts = ["a" * 40 + word(200) + "ab" * 30, *([] if piece == 16 else [word(rnd.randrange(50)) for _ in range(20)])]
    forms = sorted({word(n) for n in (1, 2, 3, 5, 20) for _ in range(8)} | {"aaa", "ababa", "aaaaa"})
    index = lookup.Index(pa.array(forms))
    hits, keys, counts = index.counted(d.codes_of("".join(texts), None), np.cumsum([0, *map(len, texts)]))
    begin = np.cumsum([0, *map(len, texts)])
    want = {(i, f): greedy(t, f) for i, t in enumerate(texts) for f in forms if greedy(t, f)}
    assert {(int(k) // len(forms), forms[k % len(forms)]): n for k, n in zip(keys, counts)} == {k: len(v) for k, v in want.items()}
    got = sorted((int(r), forms[f], int(s - begin[r])) for rows, ids, starts in hits() for r, f, s in zip(rows, ids, starts))
    assert got == sorted((i, f, s) for (i, f), v in want.items() for s in v)


def test_windows_that_sound_like_no_term():
    letters = d.table_of({c: "例" for c in "例力立"})
    sounds = gl.Sounds(pa.table({"term": ["例力子", "电子"], "cjk": [True, True], "han": [True, True]}), letters)
    assert [[x.tolist() for x in found] for found in sounds.terms_of(["百百百", "力力子"])] == [[[], []], [[0], [2]]]
    assert [len(x) for found in sounds.terms_of(["百百百"]) for x in found] == [0, 0]


def test_a_glossary_of_one_split_is_spread(spark, tmp_path):
    """A million parts are one split of a file: one task made all their forms."""
    from colloquy.plans import terms

    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = terms._large_glossary(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and rows.count() == 100
