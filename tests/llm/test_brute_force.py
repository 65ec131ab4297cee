"""Operators that SQL cannot express, against brute force, a library or held-out labels."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import bpe, caps, jaccard, lines, pii, secrets, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoding():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(bpe.RANKS)) if t}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(bpe.RANKS)
    return bpe.Codec(ranks, bpe.serialise_model(ranks))


def random_texts(n, seed):
    rnd = random.Random(seed)
    signs = ["the ", "don't", "\n", "  ", "\t", "é", "ß", "€", "\U0001f600", "▁", "1234", "x", "!?", "<unk>", "\x00", "　", "ا", "²"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(n)]


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_codec_is_that_of_the_library(codec, encoding):
    for t in random_texts(3000, 1) + ["a" * 3000, "", "</s><|endoftext|>"]:
        assert ids_of(codec, t) == encoding.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_encoded_documents(spark, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bit_slices_against_products():
    rng = np.random.default_rng(3)
    for low, high, n, width in ((-30, 30, 300, 9), (5, 9, 70, 3), (-1000, 3, 129, 2), (0, 1, 64, 5)):
        rows, queries = rng.integers(low, high, (n, width)), rng.integers(low, high, (11, width))
        rows[n // 2:] = rows[:n - n // 2]  # ties
        ids = rng.permutation(n * 2)[:n]
        got = topk.Block(ids, rows).top(ids[:11], queries, 7)
        for q in range(11):
            score = sorted((-int(s), int(i)) for s, i in zip(rows @ queries[q], ids, strict=True) if i != ids[q])[:7]
            mine = got[got["query_id"] == ids[q]]
            assert sorted((-s, i) for s, i in zip(mine["score"], mine["vec_id"], strict=True)) == score


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def plain_identifiers(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_patterns_against_plain_ones():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aZ09..@@+-  ()_%:=5566AKIA\"'") for _ in range(rnd.randrange(60))) for _ in range(5000)]
    texts += ["".join(rnd.choice("0123456789. -+") for _ in range(rnd.randrange(60))) for _ in range(5000)]
    texts += ["".join(rnd.choice(["token", "API_KEY", " ", "=", ":", '"', "abc123", "paſſword", "deadbeef" * 3]) for _ in range(9)) for _ in range(2000)]
    for t in texts:
        assert sorted(secrets.base_spans(t)) == plain_secrets(t)
        assert pii.identifiers(t) == plain_identifiers(t)


@pytest.mark.parametrize(("op", "module", "plain"), [("op3_secrets", secrets, plain_secrets), ("op4_pii", pii, plain_identifiers)])
def test_scan_queries(spark, op, module, plain):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = module.QUERIES[op](spark, LARGER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r["doc_id"]])
        if op == "op3_secrets":
            said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        else:
            said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert not said or set(said.split(",")) <= set(r["spans"].split(","))


def test_random_tokens_are_found_and_words_are_not(spark):
    rnd = random.Random(5)
    secret = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    prose = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(100).collect()
    rows = [(i, f"{p['text'][:900]} key {secret(44)} and incomprehensibilities-notwithstanding then aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", secret(0))
            for i, p in enumerate(prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    found = [(r["doc_id"], a) for r in secrets.find_secrets(docs).collect() for a in r["added"]]
    texts = {r[0]: r[1] for r in rows}
    hits = [texts[d][a["start"]:a["end"]] for d, a in found]
    assert sum(len(h) == 44 for h in hits) >= 90
    assert not any("incompreh" in h or "aaaa" in h for h in hits)


@pytest.mark.parametrize(("text", "span"), [
    ("mail jane.roe [at] mail (dot) example (dot) org!", "jane.roe [at] mail (dot) example (dot) org"),
    ("write to jane at example dot org today", "jane at example dot org"),
    ("jаne@exаmple.org", "jаne@exаmple.org"),
    ("call plus one two one two five five five zero one nine nine now", "plus one two one two five five five zero one nine nine"),
    ("host 10 dot 20 dot 30 dot 40 is up", "10 dot 20 dot 30 dot 40"),
    ("j​ane@example​.org", "j​ane@example​.org"),
    ("４２４２ ４２４２ ４２４２ ４２４２", "４２４２ ４２４２ ４２４２ ４２４２"),
])
def test_disguises_map_back(text, span):
    base, added = pii.scan_text(text)
    assert [text[a:b] for _, a, b in added] == [span] and not base


@pytest.mark.parametrize("text", ["We met at the dot end.", "one two three", "At four, I saw seven.", "Das Haus hat zwei Türen"])
def test_prose_is_left_alone(text):
    assert pii.scan_text(text) == ([], [])


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((30, 48))
    x = np.concatenate([centre, *(centre[rng.integers(0, 30, 40)] + 0.15 * rng.standard_normal((40, 48)) for _ in range(5)),
                        np.repeat(centre[:1], 50, axis=0)])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in caps.near_vectors(docs).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)


@pytest.mark.parametrize(("width", "size"), [(48, 256), (64, 256), (128, 256), (64, 1500)])
def test_pairs_just_above_the_threshold_share_a_filter(width, size):
    rng = np.random.default_rng(width + size)
    n = 250
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((n, width)))
    side = rng.standard_normal((n, width))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.95, 0.96, (n, 1))
    b = cosine * a + np.sqrt(1 - cosine ** 2) * side
    least = caps.threshold(width, size)
    one, two = (caps.decode(x, width, size, least) for x in (a, b))
    shared = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(one, two, strict=True)])
    assert shared >= 0.97
    assert 8 < np.mean([len(p) for p in one]) < 80


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    test_links_against_all_pairs(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    test_similar_documents_against_all_pairs(spark)


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_similar_documents_against_all_pairs(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(12):
        base = [rnd.choice("abcdefghij") * rnd.randrange(1, 9) for _ in range(rnd.randrange(3, 120))]
        for _ in range(rnd.randrange(1, 14)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = "changed" + str(rnd.randrange(3))
            texts.append(" ".join(copy))
    texts += ["", " ", "one", "one"]
    sets = [shingle_set(t) for t in texts]
    near = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *(label[j] for j, n in enumerate(near[i]) if n)]) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in jaccard.similar(docs).collect()}
    assert got == {i: (label[i], sum(near[i]), label[i] == i) for i in range(len(texts))}


def runs_that_must_go(rows, least):
    """Lines inside any run of ``least`` words that an earlier place has."""
    seen, out = set(), {}
    for k, text in rows:
        own = [x.strip() for x in text.split("\n")]
        gone = set()
        for i in range(len(own)):
            words, j = 0, i
            while j < len(own) and words < least:
                words += len(own[j].split())
                j += 1
            if words >= least:
                run = tuple(own[i:j])
                gone |= set(range(i, j)) if run in seen else set()
                seen.add(run)
        out[k] = gone
    return out


def test_repeated_runs_against_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {r["doc_id"]: {i for x in r["runs"] for i in range(x["start"], x["end"])} for r in lines.repeated_runs(docs).collect()}
    must, earlier = runs_that_must_go(rows, lines.WINDOW), set()
    assert sum(map(len, must.values())) > 100
    for k, text in rows:
        own = [x.strip() for x in text.split("\n")]
        gone = runs.get(k, set())
        assert must[k] <= gone
        # what goes has been seen before, here or in an earlier document
        before = set(earlier)
        for i, line in enumerate(own):
            assert i not in gone or line in before
            before.add(line)
        earlier = before


def test_short_repeats_stay(spark):
    rows = [(i, f"Licensed under the same licence.\nText number {i} is its own\nAll rights reserved.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.dedup_lines(docs).where("n_removed > 0").count() == 0


def test_a_repeat_inside_a_document(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(3))
    docs = spark.createDataFrame([(1, f"{passage}\nbetween\n{passage}\nend")], "doc_id long, text string")
    assert lines.dedup_lines(docs).first()["text"] == f"{passage}\nbetween\nend"


def test_attribution_against_characters(spark, codec):
    rnd = random.Random(8)
    for t in random_texts(400, 9):
        ids = np.frombuffer(codec.encode(t), "<u4")
        sizes = np.array([len(codec.tokens[i]) for i in ids], np.int64)
        start, end = tokens.token_spans(tokens.characters(np.frombuffer(t.encode(), np.uint8)), sizes)
        cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t) + 1, 2 * rnd.randrange(0, 4))))
        left, right = np.array(cuts[0::2], np.int64)[:len(cuts) // 2], np.array(cuts[1::2], np.int64)
        owner = {c: k for k, (a, b) in enumerate(zip(left, right, strict=True)) for c in range(a, b)}
        raw = np.cumsum(sizes)
        for rule in tokens.RULES:
            want = {k: 0.0 for k in range(-1, len(left))}
            for n, size in zip(raw, sizes, strict=True):
                b = t.encode()
                first = len(b[:n - size].decode(errors="ignore"))
                first -= 0 if (b[n - size] & 0xC0) != 0x80 else 0
                of = [owner.get(c, -1) for c in range(first, len(b[:n].decode(errors="ignore")) + ((n < len(b)) and (b[n] & 0xC0) == 0x80))]
                if rule == "start":
                    want[of[0]] += 1
                elif rule == "split":
                    for k in of:
                        want[k] += 1 / len(of)
                else:
                    want[max(set(of), key=lambda k: (of.count(k), k >= 0, -k))] += 1
            counts, outside = tokens.allocate(start, end, left, right, rule)
            assert np.allclose([outside, *counts], [want[k] for k in range(-1, len(left))])
            assert np.isclose(outside + counts.sum(), len(ids))


def test_sections_of_a_table(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    parts = spark.createDataFrame([(1, 0, 5), (1, 11, 16)], "doc_id long, start int, end int")
    got = tokens.attribute(tokens.with_sections(docs, parts), "sections", "start").groupBy("doc_id", "section").agg(F.sum("n_tokens").alias("n"))
    total = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(docs).collect()}
    got = {(r["doc_id"], r["section"]): r["n"] for r in got.collect()}
    assert got[1, 0] >= 1 and sum(n for (d, _), n in got.items() if d == 1) == total[1] and got[2, -1] == total[2]


def test_majority_adds_up_what_lies_outside():
    spans = lambda *x: (np.array([a for a, _ in x]), np.array([b for _, b in x]))
    counts, outside = tokens.allocate(*spans((0, 5)), *spans((1, 3)), "majority")
    assert counts.tolist() == [0] and outside == 1
    counts, outside = tokens.allocate(*spans((0, 4), (4, 8)), *spans((1, 3), (4, 6), (6, 8)), "majority")
    assert counts.tolist() == [1, 1, 0] and outside == 0


def test_lines_with_null_repeated_and_clashing_rows(spark, encoding):
    rows = [(1, "a line\n\nand é €\n"), (1, "a line\n\nand é €\n"), (None, "no id\nhere"), (2, None), (3, "\n" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("s", "section", "start", "n_tokens")})
    got = {}
    for r in tokens.attribute(docs).collect():
        got.setdefault((r["doc_id"], r["section"]), []).append((r["start"], r["end"], r["n_tokens"]))
    assert all(len(v) == (2 if k[0] == 1 else 1) for k, v in got.items())
    for i, t in {(1, rows[0][1]), (None, rows[2][1]), (2, ""), (3, rows[4][1])}:
        ends = [m.end() for m in re.finditer("\n", t)] + [len(t)]
        assert [got[i, k][0][:2] for k in range(len(ends))] == list(zip([0, *ends], ends))
        assert sum(got[i, k][0][2] for k in range(len(ends))) == len(encoding.encode_ordinary(t))
    parts = spark.createDataFrame([(None, 0, 5), (1, 0, 6), (1, 20, 90)], "doc_id long, start int, end int")
    for rule in tokens.RULES:
        out = tokens.attribute(tokens.with_sections(docs, parts), "sections", rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
        total = {1: 2 * len(encoding.encode_ordinary(rows[0][1])), None: len(encoding.encode_ordinary(rows[2][1])), 3: len(encoding.encode_ordinary(rows[4][1]))}
        assert {r["doc_id"]: round(r["n"], 6) for r in out} == total


def test_held_out_toxicity(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)


def test_disguised_words_are_restored(spark):
    counts = toxicity.trigram_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    r = toxicity.Restorer(toxicity.log_model(counts))
    words = {"m0r0n": "moron", "l0ser": "loser", "idiooooot": "idiot", "p@thetic": "pathetic", "s.c.u.m": "scum", "cl0wn!!": "clown", "the": "the"}
    assert {w: r.restore(w) for w in words} == words
    assert toxicity.restore_text("you m o r o n", r).split()[-1] == "moron"


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    rows = sorted(clean.items())
    must = runs_that_must_go(rows, lines.WINDOW)
    table = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in rows], docs.schema)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, table, SF).collect()}
    for k, t in rows:
        assert (left.get(k, "") == t) if not must[k] and k in left and len(left[k]) == len(t) else len(left.get(k, "")) < len(t)
    table = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in left.items()], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, SF).collect()}
    sets = {k: shingle_set(t) for k, t in left.items()}
    for k in left:
        similar = [j for j in left if j < k and sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])]
        assert (k in kept) or similar
        assert not (k in kept and any(j in kept for j in similar))
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} <= kept | set(left)
