"""Fill-in-middle examples against slices of strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import infill

LETTERS = ["a", " ", "é", "ß", "€", "ا", "\U0001f600", "\n", "\x00", "中", "\U00010000", "<P", ">"]


def example(doc_id, text):
    """The contract, with Python's slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("portion", [1 << 22, 64, 1])
def test_cuts_of_random_texts(monkeypatch, portion):
    monkeypatch.setattr(infill, "PORTION", portion)
    rnd = random.Random(portion)
    for _ in range(30):
        texts = ["".join(rnd.choices(LETTERS, k=rnd.choice([0, 1, 2, 7, 8, 9, 40]))) for _ in range(rnd.randrange(20))]
        one, two = (np.array([rnd.randrange(1 << 32) for _ in texts], np.int64) for _ in range(2))
        array = pa.array(["skipped", *texts], pa.string())[1:]  # an array that starts within its buffers
        got = infill.cut_array(array, one, two).to_pylist()
        for t, a, b, r in zip(texts, one, two, got, strict=True):
            low, high = sorted((a % (len(t) + 1), b % (len(t) + 1)))
            assert r == {"n": len(t), "low": low, "high": high, "prefix": t[:low], "middle": t[low:high], "suffix": t[high:]}


def test_every_cut_of_a_text():
    text = "".join(LETTERS) * 3
    data = np.frombuffer(text.encode(), np.uint8)
    units = infill.Units(data)
    ends = np.cumsum([len(c.encode()) for c in text])
    assert units.end_of(np.arange(1, len(text) + 1)).tolist() == ends.tolist()
    assert units.before(np.arange(len(data) + 1)).tolist() == [int((ends <= i).sum()) for i in range(len(data) + 1)]


def test_examples_of_odd_documents(spark):
    rnd = random.Random(4)
    rows = [(None, "no id"), (1, None), (2, ""), (3, "has <M> inside"), (4, "é" * 300_000), (5, "same"), (5, "same"), (6, "<P"), (7, "S>")]
    rows += [(i, "".join(rnd.choices(LETTERS, k=rnd.randrange(60)))) for i in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("fim_n", "d", "t", "c", "n", "form", "prefix", "fim_output")})
    for d in (df, clash):
        out = infill.infilled(d)
        assert [c for c in out.columns if not c.startswith("fim_")] == [c for c in d.columns if not c.startswith("fim_")]
        got = out.select("doc_id", "text", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output",
                         infill.restored(F.col("fim_output"), F.col("fim_form")).alias("back")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[2:7] == example(r["doc_id"], r["text"])
            assert r["back"] == (r["text"] or "")
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.infilled(spark.createDataFrame([], "doc_id long, text string")).collect() == []
