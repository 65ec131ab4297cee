"""Secret scan: credential patterns and a battery of randomness tests.

A token is tested against two hypotheses. Under "random", its characters are
independent and uniform over its inferred encoding; a token that a test rejects
is none. Under "ordinary", it comes from the letters and letter pairs of the
corpus; its p-value says how likely ordinary text looks as random. Ordinary
tokens are the null of a false-discovery control by classes of length.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, table

KINDS = ("assign", "access", "hex", "random")
_either = "".join
ASSIGN = re.compile(
    "(" + "|".join(_either(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Only padding belongs to a token, so NAME=VALUE is two.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
# A value may stand behind a path or a prefix: parts of a token in each of the encodings that have such signs, and in those that don't.
PARTS = tuple(re.compile(p) for p in (r"[^/]{16,}", r"[^_-]{16,}", r"[^/_-]{16,}"))
LEAST_ASSIGNED = 6

# Encodings from the smallest alphabet on, each in its own order.
ENCODINGS = (
    string.digits, string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_lowercase, string.ascii_uppercase,
    string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
    string.ascii_letters, string.digits + string.ascii_letters, string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_")
LEAST_RANDOM_P = 1e-3
FALSE_DISCOVERIES = 0.01
# Lower ends of the classes of length, and steps of log10 p.
LENGTHS = (16, 20, 24, 32, 48, 64, 96, 128, 256)
STEPS, DEEPEST = 20, 40
CODES = 96


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the credential patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """``start, end`` of the tokens of a text and of their parts, a longer one before those in it."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        parts = {(a, b)}
        if any(c in "/_-" for c in m[0]):
            parts.update(x.span() for p in PARTS for x in p.finditer(text, a, b) if len(x[0].rstrip("=")) >= LENGTHS[0])
        out += sorted(parts, key=lambda s: (s[0], -s[1]))
    return out


def character_codes(text: str) -> np.ndarray:
    """Printable ASCII as 1 to 95, all else 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((c >= 32) & (c < 127), c - 31, 0).astype(np.int64)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each pair of neighbouring characters occurs in all texts; a table of fixed size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CODES * CODES, np.int64)
        for f in frames:
            part, size = [], 0
            for t in [*f["text"], None]:
                if isinstance(t, str):
                    part.append(t)
                    size += len(t)
                if part and (t is None or size > 1_000_000):
                    c = character_codes("\n".join(part))
                    total += np.bincount(c[:-1] * CODES + c[1:], minlength=CODES * CODES)
                    part, size = [], 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    rows = docs.where("text is not null").select("text").mapInPandas(count, "pair long, n long") \
        .groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CODES * CODES)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(CODES, CODES)


def upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


class Battery:
    """The tests, and what ordinary text of the corpus gives in them for each encoding."""

    def __init__(self, pairs: np.ndarray):
        self.index, self.ordinary = [], []
        for letters in ENCODINGS:
            k, code = len(letters), np.array([ord(c) - 31 for c in letters])
            self.index.append({c: i for i, c in enumerate(letters)})
            p = pairs[code].sum(axis=1) + 1.0
            p /= p.sum()
            m = pairs[np.ix_(code, code)] + 1.0
            m /= m.sum()
            half = np.arange(k) >= k / 2
            x, left, right = np.arange(k), m.sum(axis=1), m.sum(axis=0)
            mean1, mean2 = left @ x, right @ x
            sd = math.sqrt((left @ x ** 2 - mean1 ** 2) * (right @ x ** 2 - mean2 ** 2))
            self.ordinary.append({
                "k": k, "s2": float((p ** 2).sum()), "s3": float((p ** 3).sum()),
                "change": float(m[np.ix_(half, ~half)].sum() + m[np.ix_(~half, half)].sum()),
                "serial": float((x @ m @ x - mean1 * mean2) / sd) if sd else 0.0})

    def p_value(self, token: str) -> float | None:
        """How likely ordinary text is to look as random; None if the token doesn't look random."""
        letters = set(token.rstrip("="))
        which = next((i for i, a in enumerate(self.index) if letters <= a.keys()), None)
        token = token.rstrip("=")
        if which is None or len(token) < LENGTHS[0]:
            return None
        index, o = self.index[which], self.ordinary[which]
        x, n, k = np.array([index[c] for c in token], dtype=float), len(token), o["k"]
        chi = k * float((np.bincount(x.astype(int), minlength=k).astype(float) ** 2).sum()) / n - n
        high = x >= k / 2
        runs = int((high[1:] != high[:-1]).sum())
        d = x - x.mean()
        square = float((d * d).sum())
        serial = float((d[1:] * d[:-1]).sum()) / square if square else 1.0
        # Random: evenness by the cube-root normal form of chi-squared, and both others two-sided.
        f = k - 1
        z_chi = ((max(chi, 0.0) / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
        share = float(high.mean())
        change = 2 * share * (1 - share)
        z_runs = (runs - (n - 1) * change) / math.sqrt(max((n - 1) * change * (1 - change), 1e-9))
        z_serial = (serial + 1 / n) * math.sqrt(n)
        if min(upper(z_chi), 2 * upper(abs(z_runs)), 2 * upper(abs(z_serial))) < LEAST_RANDOM_P:
            return None
        # Ordinary: moments of the same statistics for n characters of the corpus, one-sided towards random.
        s2, s3 = o["s2"], o["s3"]
        mean = k * (1 - s2) + n * (k * s2 - 1)
        var = k * k * (4 * n * max(s3 - s2 * s2, 0.0) + 2 * (s2 + s2 * s2 - 2 * s3))
        ps = [upper((mean - chi) / math.sqrt(max(var, 1e-9)))]
        c = o["change"]
        z = (runs - (n - 1) * c) / math.sqrt(max((n - 1) * c * (1 - c), 1e-9))
        ps.append(upper(z if c < 0.5 else -z))
        z = (serial - o["serial"]) * math.sqrt(n)
        ps.append(upper(-z if o["serial"] > 0 else z))
        # Cauchy combination: right for tests that depend on each other
        t = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-9)) * math.pi) for p in ps) / len(ps)
        return 0.5 - math.atan(t) / math.pi if t < 1e6 else 1 / (math.pi * t)


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def step(p: float) -> int:
    """p rounded up to a step of its logarithm; higher is smaller."""
    return min(int(-math.log10(max(p, 10.0 ** -DEEPEST)) * STEPS), DEEPEST * STEPS)


def discoveries(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """For each class of length the lowest step that the step-up procedure accepts."""
    out = {}
    for c in {c for c, _ in counts}:
        of = {s: n for (x, s), n in counts.items() if x == c}
        tests, found = sum(of.values()), 0
        for s in sorted(of, reverse=True):
            found += of[s]
            if tests * 10.0 ** (-s / STEPS) <= rate * found:
                out[c] = s
    return out


SPAN = "array<struct<start:int,kind:int,end:int>>"


def outermost(found: pd.Series) -> pd.Series:
    """Spans that lie in no other one; a longer one comes before those in it."""
    out = []
    for spans in found:
        kept, last = [], -1
        for s in spans:
            if s["end"] > last:
                kept.append({"start": s["start"], "kind": 3, "end": s["end"]})
                last = s["end"]
        out.append(kept)
    return pd.Series(out)


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, the pattern spans ``base`` and the tested tokens ``tokens`` of each text."""
    shipped = docs.sparkSession.sparkContext.broadcast(Battery(pair_counts(docs)))

    @F.pandas_udf(f"base {SPAN}, tokens array<struct<start:int,end:int,length:int,step:int>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        battery = shipped.value
        for s in texts:
            base, tokens = [], []
            for t in s:
                t = t if isinstance(t, str) else ""
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in base_spans(t)])
                found = []
                for a, b in candidates(t):
                    p = battery.p_value(t[a:b])
                    # A token that looks unlike random is still one of the tests.
                    found.append({"start": a, "end": b, "length": length_class(b - a), "step": 0 if p is None else step(p)})
                tokens.append(found)
            yield pd.DataFrame({"base": base, "tokens": tokens})

    return docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.base", "s.tokens")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, base, added``: spans of the patterns and of tokens found random.

    Spans are in code points, the end exclusive. A null text is empty. All
    tokens of all texts and their parts are tests; within a class of length the
    expected share of ordinary tokens among those found is at most ``rate``. A
    part of a found token is not added again.
    """
    rows = settled(scanned(docs.select("doc_id", "text")))
    t = rows.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.step").agg(F.count("*").alias("n"))
    least = discoveries({(r["length"], r["step"]): r["n"] for r in t.collect()}, rate)
    limit = F.create_map(*[F.lit(x) for c in range(len(LENGTHS) + 1) for x in (c, max(least.get(c, 1 << 30), 1))])
    found = F.filter("tokens", lambda t: t["step"] >= F.element_at(limit, t["length"]))
    return rows.select("doc_id", "base", F.pandas_udf(outermost, SPAN)(found).alias("added"))


def listed(spans, kinds=KINDS):
    """Spans as ``kind:start:end`` by the order of their fields, joined by commas."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark, sf_dir) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


QUERIES = {"op3_secrets": op3_secrets}
