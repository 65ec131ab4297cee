"""Conversation repair and chat formatting against plain programs."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from colloquy.llm import chat, repair

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
SIGN = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """The faults of the contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """Counts, cost, audit and lines of one conversation's damaged rows, by a plain recursion from the end."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        signs = SIGN.findall(text)
        faults.append("b" if not signs else "d" if (role, text) in seen else "t" if signs[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        """Cost, audit and lines from row i on, in a state, with so many inserts allowed before the next row."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        then = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}
        if inserts:
            ways.append((3, "I", (f"{name[then]}:",), best(i, then, inserts - 1)))
        if i < len(rows):
            _, _, role, text = rows[i]
            ways.append((4, "D", (), best(i + 1, state, 3)))
            if faults[i] not in ("b", "d"):
                extra = 3 * (faults[i] == "t")
                if role[:1] == then or (role[:1] == "s" and state == ""):
                    ways.append((extra, "K", (f"{role}:{text}",), best(i + 1, role[:1], 3)))
                ways.append((3 + extra, "R", (f"{name[then]}:{text}",), best(i + 1, then, 3)))
        done = [w if len(w) == 3 else (w[0] + w[3][0], w[1] + w[3][1], w[2] + w[3][2]) for w in ways if len(w) == 3 or w[3]]
        return min(done, default=None)

    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    for i in range(len(rows), -1, -20):  # from the end, so that the recursion stays short
        best(i, "u", 3)
    cost, audit, lines = best(0, "", 3)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))


def expected(rows):
    out = {}
    left = in_order(damage(rows))
    for conv in {r[0] for r in rows}:
        mine = [r for r in left if r[0] == conv]
        out[conv] = plain_repair(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in df.collect()}


def odd_conversations(seed, n):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "unknown", ""], ["Yes.", "no", " ", None, "Yes.", "Really?  ", "a\nb", "!", "x. y"]
    rows = []
    for conv in [None, *range(n)]:
        turns = rnd.sample(range(40), rnd.randrange(1, 13))
        rows += [(conv, t if rnd.random() < 0.95 or i else None, rnd.choices(roles, [6, 6, 3, 1, 1, 1, 1])[0], rnd.choice(texts) if rnd.random() < 0.6 else f"line {rnd.random()}.")
                 for i, t in enumerate(turns)]
    return rows


def test_lattice_search_is_the_least_of_all_paths():
    """Every string of edits of bounded length, tried."""
    def apply(codes, entry, edits):
        state, cost, i = entry, 0, 0
        for e in edits:
            then = 2 if state != 2 else 3
            if e == "I":
                state, cost = then, cost + 3
                continue
            if i == len(codes):
                return None
            c, i = codes[i], i + 1
            if e == "D":
                cost += 4
            elif c == "x":
                return None
            else:
                cost += 3 * c.isupper() + 3 * (e == "R")
                if e == "K" and c.lower() == "s" and state == 0:
                    state = 1
                elif e == "R" or c.lower() == "-sua"[then]:
                    state = then
                else:
                    return None
        return (cost, state) if i == len(codes) else None

    rnd = random.Random(3)
    for _ in range(40):
        codes = "".join(rnd.choice("suauaUASxo") for _ in range(rnd.randrange(1, 4)))
        tried = [(apply(codes, 0, e), "".join(e)) for n in range(7) for e in itertools.product("DIKR", repeat=n)]
        cost, audit = min((r[0], e) for r, e in tried if r and r[1] in (0, 3))
        found = repair.Lattice(codes, repair.ENDS, True).cheapest(0)
        assert (found[0], "".join(e[0] for e in found[2])) == (cost, audit), codes
        ends = tuple(float(rnd.randrange(9)) for _ in range(4))
        for entry in range(4):
            inner = repair.Lattice(codes, ends, False)
            # Inserts behind the last row belong to the next segment.
            ways = [(r[0] + ends[r[1]], e, r) for e_ in range(7) for t in itertools.product("DIKR", repeat=e_)
                    if t and t[-1] != "I" and (r := apply(codes, entry, t)) for e in ["".join(t)]]
            want = min(ways)
            found = inner.cheapest(entry)
            assert (found[0], found[1], "".join(e[0] for e in found[2])) == (want[2][0], want[2][1], want[1]), (codes, ends, entry)
            least = [min((r[0] for _, _, r in ways if r[1] == s), default=float("inf")) for s in range(4)]
            assert inner.reach(entry) == least


@pytest.mark.parametrize("shift", [10, 2, 0])
def test_repair_of_odd_conversations(spark, monkeypatch, shift):
    monkeypatch.setattr(repair, "SHIFT", shift)
    rows = odd_conversations(5, 150)
    # The order of equal turns is the operator's own: leave them out here.
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    df = spark.createDataFrame(rows, TURNS).withColumns({"g": F.lit("clash"), "sid": F.lit(1), "copy": F.lit(None).cast("int")}).repartition(5)
    monkeypatch.setattr(repair, "table", lambda *a: df)
    assert got(repair.op11_repair(spark, "")) == expected(rows)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op11_repair(spark, SF)) == expected(rows)


def test_repair_of_one_conversation_that_has_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHIFT", 4)
    rnd = random.Random(9)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["Yes.", f"{t}.", f"{t}!", f"{t}"])) for t in range(500)]
    rows += [(c, 0, "user", "Hi.") for c in range(20, 60)]
    df = spark.createDataFrame(rows, TURNS)
    monkeypatch.setattr(repair, "table", lambda *a: df)
    want = expected(rows)
    assert got(repair.op11_repair(spark, "")) == want and len(want[7][6]) > 400


def test_repair_of_ties_repeated_rows_and_nothing(spark, monkeypatch):
    rows = [(1, 3, "user", "b."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 3, "user", "a."), (2, None, "assistant", None), (2, None, None, "x")]
    frames = [spark.createDataFrame(x, TURNS) for x in (rows, rows[::-1], [])]
    results = []
    for df in frames:
        monkeypatch.setattr(repair, "table", lambda *a, df=df: df)
        results.append(got(repair.op11_repair(spark, "")))
    assert results[0] == results[1] and set(results[0]) == {1, 2} and results[2] == {}


def test_repaired_turns_alternate(spark):
    turns = repair.repair(repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet")))[1].collect()
    by = {}
    for r in sorted(turns, key=lambda r: (r["cid"], r["g"], r["i"])):
        by[r["cid"]] = by.get(r["cid"], "") + r["role"][0]
    assert by and all(re.fullmatch("s?(ua)+", x) for x in by.values())


TEXTS = ["", None, "\\", "\\\\", "</turn>", "<\\/turn>", "<turn>user<says>hi</turn>", "<also>", "\\<also>", "<", "</turn", "a\nb", "\\### Assistant: </turn> ok",
         "<<also>also>", "é€\U0001f600", "$1\\1", "<says>", "tail\\", "<turn", ">"]


@pytest.mark.parametrize("piece", [256, 2])
def test_formatted_conversations_read_back(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    rnd = random.Random(piece)
    roles = ["user", "assistant", "system", "assistant", "<says>", None, "", "a\\"]
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(TEXTS)) for c in [None, *range(60)] for t in range(rnd.randrange(1, 9))]
    rows += [(99, 0, "user", "same")] * 3 + [(98, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"parts": F.lit(1), "formatted": F.lit("clash"), "n_turns": F.lit(None).cast("int")}).repartition(4)
    out = chat.formatted(df)
    back = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", "formatted", "parts", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert set(back) == {r[0] for r in rows}
    plain = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        plain.setdefault(c, []).append((role or "", text or ""))
    digests = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for c, turns in plain.items():
        r = back[c]
        assert [tuple(t) for t in r["turns"]] == turns and r["n_turns"] == len(turns)
        assert "".join(p["text"] for p in r["parts"]) == r["formatted"]
        assert r["formatted"].count("<turn>") == 1 + sum(a[0] != b[0] for a, b in itertools.pairwise(turns))
        learnt = "".join(t for role, t in turns if role == "assistant")
        d = digests[c]
        assert d["loss_chars"] == len(learnt) and d["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d["formatted_chars"] == len(r["formatted"])


def test_formatting_of_nothing_and_without_python(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).collect() == []
    plan = chat.op12_chat(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
