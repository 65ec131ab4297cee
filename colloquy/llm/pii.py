"""Personal data with offset-preserving deobfuscation.

Identifiers are found in the text as it is, and in the text rewritten by
transducers: look-alike letters and digits, invisible characters, spelled
digits, and words for the at sign, the dot and the plus. Each character of the
rewritten text knows the source characters it stands for, so that a span found
there becomes a span of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:int,start:int,end:int>>"

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No later start within a run of digits matches if its first does not.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip(
    "авеіјкмнорсѕтухԁԛԝһАВЕІЈКМНОРСЅТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abeijkmhopcstyxdqwhABEIJKMHOPCSTYXaeikvoptuxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# Spelled digits count in a row of four or more; single ones are prose.
SPELLED = re.compile(rf"(?i)\b(?:{_digit})(?:[\s.,-]{{1,3}}(?:{_digit})){{3,}}\b")
SPELLED_DIGIT = re.compile(rf"(?i)\b(?:{_digit})\b")
PLUS = re.compile(r"(?i)\bplus[\s]{1,3}(?=[0-9])")
AT_SIGN = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}at\s{0,3}[\])}>]\s{0,3}")
DOT_SIGN = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|punto|point)\s{0,3}[\])}>]\s{0,3}")
# An address in plain words ends in a known domain; what is in brackets needs none.
DOMAINS = ("com org net edu gov mil int info biz io co ai app dev me tv uk de fr es it nl eu ch at be ca us au jp cn in br ru pl se "
           "test example").split()
SPOKEN = re.compile(r"(?i)(?<=[A-Za-z0-9])(\s{1,3}at\s{1,3}|@)[A-Za-z0-9-]+(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]+)*"
                    rf"(?:\s{{1,3}}dot\s{{1,3}}|\.)(?:{'|'.join(DOMAINS)})\b")
SPOKEN_DOT = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
SPOKEN_POINT = re.compile(r"(?i)(?<=[0-9])\s{1,3}dot\s{1,3}(?=[0-9])")
SPOKEN_LOCAL = re.compile(r"(?i)(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9]+@)")
WORD_SIGNS = re.compile(r"(?i)[\[({<]\s{0,3}(?:at|dot|punkt|punto|point)\s{0,3}[\])}>]|\sdot\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """A match starts where the run of local characters before its at sign starts; domains have no at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of all identifiers, leftmost and not overlapping within a kind."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


class Tape:
    """A text that is rewritten step by step and keeps, for each character, its source span."""

    def __init__(self, text: str):
        self.text, self.spans = text, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``start, end`` by a string, for ascending edits that do not overlap."""
        if not edits:
            return
        old = self.spans if self.spans is not None else [(i, i + 1) for i in range(len(self.text))]
        text, spans, at = [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            spans += old[at:a]
            text.append(new)
            spans += [(old[a][0], old[b - 1][1])] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.spans = "".join(text), spans + old[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.spans is None else (self.spans[start][0], self.spans[end - 1][1])


def character_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in DISGUISED.finditer(text):
        c = m[0]
        out.append((m.start(), m.end(), LOOKALIKES.get(c, "" if c in INVISIBLE else unicodedata.normalize("NFKC", c))))
    return out


# Look-alikes, invisible characters and the wide or styled forms of letters and digits.
DISGUISED = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "！-～\U0001d400-\U0001d7ff①-⑳⁰-₉]")


def rewritten(text: str) -> Tape | None:
    """The text without its disguises; None if it has none."""
    edits = character_edits(text) if not text.isascii() else []
    low = text.lower()
    words = "dot" in low or ("at" in low or "pu" in low or "poi" in low) and bool(WORD_SIGNS.search(text))
    parts = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    spelled = sum(map(DIGIT_WORDS.__contains__, parts)) >= 4 and bool(SPELLED.search(text))
    if not (edits or words or spelled):
        return None
    tape = Tape(text)
    tape.rewrite(edits)
    tape.rewrite([(d.start(), d.end(), DIGIT_WORDS[d[0].lower()])
                  for m in SPELLED.finditer(tape.text) for d in SPELLED_DIGIT.finditer(tape.text, m.start(), m.end())])
    tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text)])
    for sign, new in ((AT_SIGN, "@"), (DOT_SIGN, ".")):
        tape.rewrite([(m.start(), m.end(), new) for m in sign.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in SPOKEN_POINT.finditer(tape.text)])
    edits = []
    for m in SPOKEN.finditer(tape.text):
        if m[1] != "@" and "dot" not in m[0].lower():
            continue
        edits += [(m.start(1), m.end(1), "@")] * (m[1] != "@")
        edits += [(d.start(), d.end(), ".") for d in SPOKEN_DOT.finditer(tape.text, m.end(1), m.end())]
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), ".") for m in SPOKEN_LOCAL.finditer(tape.text)])
    return tape


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text as it is, and those that only the rewritten text shows."""
    base = identifiers(text)
    tape = rewritten(text)
    if tape is None or tape.spans is None:
        return base, []
    found = {(k, *tape.source(a, b)) for k, a, b in identifiers(tape.text)}
    return base, sorted(found - set(base))


def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    for s in texts:
        both = [scan_text(t if isinstance(t, str) else "") for t in s]
        yield pd.DataFrame({"base": [rows(b) for b, _ in both], "added": [rows(a) for _, a in both]})


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: spans in the text as it is, and those found behind disguises.

    Spans are in code points, the end exclusive. A null text is empty. A text is
    read as a whole and no row moves to another machine.
    """
    spans = F.pandas_udf(scan, f"base {SPAN}, added {SPAN}")
    return docs.select("doc_id", spans("text").alias("s")).select("doc_id", "s.base", "s.added")


def listed(spans):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_pii(spark, sf_dir) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = [of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(listed("base"), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
