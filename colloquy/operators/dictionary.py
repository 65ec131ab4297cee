"""Occurrences of the forms of a table in texts.

The forms stay a table of any length. A text's windows of the forms' lengths are
hashed by differences of running sums, all starts at once, and looked up in a
Bloom filter of bounded size; a window that passes becomes a row and is joined to
the forms on its characters. The filter only saves rows: with a fuller one more
windows reach the join, none is lost.

A form may leave one place open. Texts and forms may be compared after a
character by character translation, such as to lower case or to sounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .ordered import settle

# What stands for an open place in a key; of the private use area.
WILD = "\uf8ff"
# Starts of a text that are hashed together.
PIECE = 1 << 17
# The first characters of a window that are looked up before all of it.
GATE = 3
# Bits of the filter for each form, and the least and greatest exponent of their number (8 MB).
BITS_PER_FORM, LEAST_BITS, MOST_BITS = 16, 16, 26
# Forms up to this number, and of so many characters in all, go to every task; more are shuffled.
BROADCAST_FORMS = 500_000
BROADCAST_CHARS = 10_000_000
# Rows of windows that leave a task together.
ROWS = 1 << 14
# Different windows that a task remembers to have passed on.
SEEN = 1 << 18
# A key that more than one in so many windows have is spread over tasks; there are at most so many such keys.
HOT_SHARE = 1_000
HOT_ROWS = 10_000

BASE = 0x9E3779B97F4A7C15
_A, _M, _S = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)


# -- translations --------------------------------------------------------------------------

@lru_cache(maxsize=1)
def case_table() -> np.ndarray:
    """Code points without their case, where that is one character."""
    table = np.arange(0x30000, dtype=np.uint32)
    for i in range(0x1F000):
        c = chr(i).upper()
        c = c.lower() if len(c) == 1 else ""
        if len(c) == 1:
            table[i] = ord(c)
    return table


def table_of(mapping: Mapping[str, str]) -> np.ndarray:
    table = np.arange(0x30000, dtype=np.uint32)
    for a, b in mapping.items():
        table[ord(a)] = ord(b)
    return table


def codes_of(text: str, table: np.ndarray | None) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes if table is None else np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def translated(c: Column, table: np.ndarray | None) -> Column:
    if table is None:
        return c

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out: list[str] = []
            for _, whole, bounds in _joined(b):
                said = text_of(codes_of(whole, table))
                out += [said[a:z] for a, z in pairwise(bounds.tolist())]
            yield pa.array(out, pa.string(), mask=b.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "string")(c)


# -- hashes --------------------------------------------------------------------------------

@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    def of(base):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


def marks(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _A
    return (x ^ (x >> _S)) * _M


def finished(h: np.ndarray, length: int, open_place: int) -> np.ndarray:
    """The hash of a window of this length with this place left open (0: none)."""
    h = (h ^ np.uint64(length * 4099 + open_place)) * _A
    return (h ^ (h >> _S)) * _M


class Filter:
    """A Bloom filter of two bits for each hash."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - bits)
        return (h >> shift).astype(np.int64), ((h * _A) >> shift).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = self.places(h, self.bits)
        bit = lambda at: (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        found = np.flatnonzero(bit(one))
        return found[bit(two[found]).astype(bool)]


def form_hashes(keys: Sequence[str], shapes: Sequence[tuple[int, int]], gate: int) -> np.ndarray:
    """Hashes of forms of the same translation, and of their first ``gate`` characters."""
    by_shape: dict[tuple[int, int], list[str]] = {}
    for k in keys:
        by_shape.setdefault((len(k), k.find(WILD) + 1), []).append(k)
    out = [np.zeros(0, np.uint64)]
    for (n, place), group in by_shape.items():
        # A shape that no text is looked up in, such as a form with the sign for an open place, is left out.
        if (n, place) in shapes:
            m = marks(codes_of("".join(group), None)).reshape(len(group), n) * powers(n + 1)[0][:n]
            if place:
                m[:, place - 1] = 0
            out.append(finished(m.sum(axis=1, dtype=np.uint64), n, place))
            if gate:
                out.append(finished(m[:, :gate].sum(axis=1, dtype=np.uint64), 0, 0))
    return np.concatenate(out)


def candidates_in(codes: np.ndarray, shapes: Sequence[tuple[int, int]], gate: int, known: Filter) -> Iterator[tuple[int, int, np.ndarray]]:
    """Starts of windows that pass the filter, by shape (length and open place)."""
    longest = max(n for n, _ in shapes)
    power, inverse = powers(PIECE + longest + 1)
    for base in range(0, len(codes), PIECE):
        m = marks(codes[base:base + PIECE + longest - 1])
        m *= power[:len(m)]
        sums = np.zeros(len(m) + 1, np.uint64)
        np.cumsum(m, out=sums[1:])
        every = np.arange(min(PIECE, len(m)))
        if gate:
            starts = every[:max(0, len(m) - gate + 1)]
            every = starts[known.has(finished((sums[starts + gate] - sums[starts]) * inverse[starts], 0, 0))]
        for n, place in shapes:
            starts = every[:np.searchsorted(every, len(m) - n, side="right")]
            h = sums[starts + n] - sums[starts]
            if place:
                h -= m[starts + place - 1]
            found = starts[known.has(finished(h * inverse[starts], n, place))]
            if len(found):
                yield n, place, found + base


# -- tables --------------------------------------------------------------------------------

def filter_of(forms: DataFrame, shapes: Sequence[tuple[int, int]], gate: int, count: int) -> Filter:
    """The filter of a table's keys; a bounded number of words comes to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_FORM * count).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(Filter.places(form_hashes(b.column(0).to_pylist(), shapes, gate), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))],
                                             ["word", "bit"])

    set_words = forms.select("key").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros((1 << bits) // 64, np.uint64)
    words[set_words["word"].to_numpy()] = set_words["bits"].to_numpy().view(np.uint64)
    return Filter(words, bits)


def _few(seen: Row) -> bool:
    return seen["n"] <= BROADCAST_FORMS and (seen["chars"] or 0) <= BROADCAST_CHARS


def few(forms: DataFrame) -> bool:
    """Whether forms go to every task."""
    return _few(forms.where("key <> ''").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("chars")).head())


def rows_stay(texts: DataFrame, forms: DataFrame, ident: str = "meeting_id") -> bool:
    """Whether ``matches`` leaves the hits of an ``ident`` in one partition: the forms go to every task, and no two texts share one."""
    return few(forms) and not texts.groupBy(ident).agg(F.count("*").alias("_n")).where("_n > 1").head(1)


def _joined(texts: pa.Array) -> Iterator[tuple[int, str, np.ndarray]]:
    """The first row, the text and the bounds of rows that are looked through together: short texts by the piece, a long one by itself."""
    first, parts, size = 0, [], 0
    for row, t in enumerate(texts):
        t = t.as_py() or ""
        if parts and size + len(t) > PIECE:
            yield first, "".join(parts), np.cumsum([0, *map(len, parts)])
            first, parts, size = row, [], 0
        parts.append(t)
        size += len(t)
    if parts:
        yield first, "".join(parts), np.cumsum([0, *map(len, parts)])


def _lookup(texts: DataFrame, forms: DataFrame, table: np.ndarray | None) -> tuple[Row, list[tuple[int, int]], int, Broadcast | None]:
    """Numbers of the forms, their shapes, the gate, and the filter with the table for every task."""
    seen = forms.agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("chars"),
                     F.collect_set(F.struct(F.length("key"), F.locate(WILD, F.col("key")))).alias("shapes")).head()
    shapes = sorted(tuple(s) for s in seen["shapes"])
    if not shapes:
        return seen, shapes, 0, None
    # A window with an open place is not looked up by its first characters.
    gate = 0 if any(place for _, place in shapes) else min(GATE, min(n for n, _ in shapes))
    return seen, shapes, gate, texts.sparkSession.sparkContext.broadcast((filter_of(forms, shapes, gate, seen["n"]), table))


def _inside(codes: np.ndarray, bounds: np.ndarray, shapes: Sequence[tuple[int, int]], gate: int,
            known: Filter) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Starts that pass the filter and their rows, by shape; windows that reach into the next text are left out."""
    for n, place, starts in candidates_in(codes, shapes, gate, known):
        rows = np.searchsorted(bounds, starts, side="right") - 1
        whole = starts + n <= bounds[rows + 1]
        if whole.any():
            yield n, place, starts[whole], rows[whole]


def windows(texts: DataFrame, forms: DataFrame, *, table: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """The distinct stretches of texts (``matched``) that may be forms; each that is one is among them."""
    forms = forms.where("key <> ''")
    _, shapes, gate, shipped = _lookup(texts, forms, table)
    if shipped is None:
        return texts.where("false").select(F.lit("").alias("matched"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = shipped.value
        seen: set[str] = set()
        for b in batches:
            for _, whole, bounds in _joined(b.column(0)):
                for n, _, starts, _ in _inside(codes_of(whole, letters), bounds, shapes, gate, known):
                    new = {whole[s:s + n] for s in starts.tolist()} - seen
                    if len(seen) > SEEN:
                        seen = set()
                    seen |= new
                    yield pa.RecordBatch.from_arrays([pa.array([*new], pa.string())], ["matched"])

    return texts.select(text).mapInArrow(scan, "matched string").distinct()


def places(texts: DataFrame, forms: DataFrame, *, table: np.ndarray | None = None, surround: int = 0, text: str = "text") -> tuple[DataFrame, bool]:
    """Windows that pass the filter, as ``matches`` returns them but with their ``key`` and not yet joined to the forms; whether these are few."""
    seen, shapes, gate, shipped = _lookup(texts, forms, table)
    kept = [c for c in texts.columns if c != text]
    schema = StructType([texts.schema[c] for c in kept]).add("start", IntegerType()).add("key", StringType())
    for c in ("matched", "said", "before", "after"):
        schema = schema.add(c, StringType())
    if shipped is None:
        return texts.where("false").select(*kept, *[F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names[len(kept):]]), True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = shipped.value
        for b in batches:
            rows, out = [], [[] for _ in range(6)]
            for first, t, bounds in _joined(b.column(len(kept))):
                codes = codes_of(t, letters)
                said = t if letters is None else None
                for n, place, starts, at in _inside(codes, bounds, shapes, gate, known):
                    said = text_of(codes) if said is None else said
                    rows += (at + first).tolist()
                    for s, begin, end in zip(starts.tolist(), bounds[at].tolist(), bounds[at + 1].tolist(), strict=True):
                        w = said[s:s + n]
                        key = w if not place else f"{w[:place - 1]}{WILD}{w[place:]}"
                        for column, v in zip(out, (s - begin, key, t[s:s + n], w, t[max(begin, s - surround):s], t[s + n:min(end, s + n + surround)]), strict=True):
                            column.append(v)
                    if len(rows) > ROWS:
                        yield batch(b, rows, out)
                        rows, out = [], [[] for _ in range(6)]
            yield batch(b, rows, out)

    def batch(b: pa.RecordBatch, rows: list, out: list) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        columns = [b.column(i).take(at) for i in range(len(kept))]
        columns += [pa.array(c, k) for c, k in zip(out, (pa.int32(), *[pa.string()] * 5), strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return texts.select(*kept, text).mapInArrow(scan, schema), _few(seen)


def matches(texts: DataFrame, forms: DataFrame, *, table: np.ndarray | None = None, surround: int = 0, text: str = "text") -> DataFrame:
    """Every occurrence of every form, overlapping ones too.

    ``forms`` has ``key``, a form translated by ``table``, perhaps with one place
    open, and other columns. Returns the columns of ``texts`` but the text, those of
    ``forms``, and ``start``, ``matched`` (as in the text), ``said`` (translated),
    ``before`` and ``after`` (up to ``surround`` characters). Null and empty keys
    match nothing.
    """
    forms = forms.where("key <> ''")
    placed, few = places(texts, forms, table=table, surround=surround, text=text)
    return met(placed, forms, few).select(*[c for c in texts.columns if c != text], *[c for c in forms.columns if c != "key"], "start", "matched",
                                          "said", "before", "after")


def met(placed: DataFrame, forms: DataFrame, few: bool) -> DataFrame:
    """Windows and the forms that they are, by ``key``: few forms go to every task, others are shuffled."""
    return placed.join(F.broadcast(forms), "key") if few else spread_join(settle(placed), forms, "key", "start")


def spread_join(rows: DataFrame, forms: DataFrame, key: str, by: str) -> DataFrame:
    """An equi-join; a key that many rows have is dealt over tasks by a hash of ``by``, its forms go to each of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    # Fewer than HOT_SHARE keys can have more than that share of all rows.
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, total / HOT_SHARE)).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(settle(hot))
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by, *[c for c in rows.columns if c != key]), F.lit(parts))).otherwise(0).cast("int"))
    last = F.when(F.col("_hot"), F.lit(parts - 1)).otherwise(0)
    right = forms.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return left.drop("_hot").join(right.drop("_hot").hint("merge"), [key, "_salt"]).drop("_salt")


def apart(hits: DataFrame, within: Sequence[str], *, longest_first: bool = False, stay: bool = False) -> DataFrame:
    """Of overlapping hits of a group (``within``) the leftmost, then the next that begins behind its end, and so on.

    Hits stream through their tasks in order; no group is held. Hits that are dealt by
    their group already (``rows_stay``) are not shuffled.
    """
    order = [*within, "start", *([F.desc(F.length("matched"))] if longest_first else [])]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, 0
        for b in batches:
            names = zip(*(b.column(c).to_pylist() for c in within), strict=True)
            take = []
            for i, (g, s, m) in enumerate(zip(names, b.column("start").to_pylist(), b.column("matched").to_pylist(), strict=True)):
                if g != group:
                    group, free = g, 0
                if s >= free:
                    free = s + len(m)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    dealt = hits if stay else hits.repartition(within[0])
    return dealt.sortWithinPartitions(*order).mapInArrow(choose, hits.schema)
