"""Repair of conversations whose turns are lost, emptied, cut, repeated or given a wrong role.

The rows of a conversation and what the roles so far amount to span a lattice; an
edit (Keep, Rerole, Delete, Insert) is an edge. Dijkstra searches from both ends
meet, all crossings of the same least cost are finished, and the path whose edits
read least is taken.

All conversations lie in one global order, cut into segments of ``2^SHIFT`` places,
so that a conversation of any length is searched by segments. A segment that others
follow is left at the costs with which the rest can end, and entered where the
segments before it left; both are carried along one small row per segment.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settled, table

SHIFT = 10
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

# What the roles written so far amount to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "-sua"
NAMES = {"s": "system", "u": "user", "a": "assistant"}
AFTER = (USER, USER, ASSISTANT, USER)
ENDS = (0, inf, inf, 0)  # a whole conversation may end empty or with an assistant


# -- the lattice ---------------------------------------------------------------------------

def steps(codes: str, place: int, state: int, open_end: bool) -> Iterator[tuple[int, int, int, str]]:
    """Edges from a node: next place and state, cost, and two letters for the edit and its role.

    A row's code is the initial of its role, a capital if the row is truncated, ``o``
    for another role and ``x`` for a row that must go. A role is never changed to
    what it is, which is never cheapest.
    """
    then = AFTER[state]
    if place < len(codes) or open_end:
        yield place, then, INSERT, "I" + INITIALS[then]
    if place < len(codes):
        code = codes[place]
        yield place + 1, state, DELETE, "D-"
        if code != "x":
            extra, initial = CUT * code.isupper(), code.lower()
            if initial == "s" and state == NOTHING:
                yield place + 1, SYSTEM, KEEP + extra, "Ks"
            if initial == INITIALS[then]:
                yield place + 1, then, KEEP + extra, "K" + initial
            else:
                yield place + 1, then, REROLE + extra, "R" + INITIALS[then]


@lru_cache(maxsize=1 << 16)
def _edges(code: str, open_end: bool) -> tuple:
    """Of a place: edges that stay there by state, and edges that lead on, each also by the state they lead to."""
    stay, on = ([[], [], [], []] for _ in range(2))
    stay_in, on_in = ([[], [], [], []] for _ in range(2))
    for s in range(4):
        for to, then, cost, edit in steps(code, 0, s, open_end):
            (on if to else stay)[s].append((then, cost, edit))
            (on_in if to else stay_in)[then].append((s, cost))
    return stay, on, stay_in, on_in


class Lattice:
    """The edit lattice of a segment; a node is ``4 * place + state``, the last node follows all ends."""

    def __init__(self, codes: str, ends: tuple, open_end: bool):
        self.ends, self.last = ends, 4 * len(codes) + 4
        self.at = [_edges(c, open_end) for c in codes] + [_edges("", open_end)]

    def out(self, node: int) -> Iterator[tuple[int, int, str]]:
        if node == self.last:
            return
        base, state = node & ~3, node & 3
        stay, on, _, _ = self.at[node >> 2]
        for then, cost, edit in stay[state]:
            yield base + then, cost, edit
        for then, cost, edit in on[state]:
            yield base + 4 + then, cost, edit
        if base + 4 == self.last and self.ends[state] < inf:
            yield self.last, self.ends[state], ""

    def into(self, node: int) -> Iterator[tuple[int, int]]:
        if node == self.last:
            for state in range(4):
                if self.ends[state] < inf:
                    yield self.last - 4 + state, self.ends[state]
            return
        base, state = node & ~3, node & 3
        for s, cost in self.at[node >> 2][2][state]:
            yield base + s, cost
        if base:
            for s, cost in self.at[(node >> 2) - 1][3][state]:
                yield base - 4 + s, cost

    def reach(self, entry: int) -> list[float]:
        """Least costs from an entry to the four states behind the last row."""
        done, heap = {}, [(0, entry)]
        while heap:
            cost, node = heapq.heappop(heap)
            if node not in done:
                done[node] = cost
                for to, more, _ in self.out(node):
                    if to not in done and to != self.last:
                        heapq.heappush(heap, (cost + more, to))
        return [done.get(self.last - 4 + s, inf) for s in range(4)]

    def cheapest(self, entry: int) -> tuple[int, int, list[str]]:
        """Cost without that of the end, state behind the last row, and the least edits of all cheapest ones."""
        start, last = entry, self.last
        done, heaps, best = ({}, {}), ([(0, start)], [(0, last)]), inf
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
            side = int(len(heaps[1]) < len(heaps[0]))
            mine, other, heap = done[side], done[1 - side], heaps[side]
            cost, node = heapq.heappop(heap)
            if node in mine:
                continue
            mine[node] = cost
            if node in other:
                best = min(best, cost + other[node])
            for edge in self.into(node) if side else self.out(node):
                to, more = edge[0], edge[1]
                if to in other:
                    best = min(best, cost + more + other[to])
                if to not in mine:
                    heapq.heappush(heap, (cost + more, to))
        ahead, behind = done
        # Nodes of the forward half that lie on a cheapest path: those of the crossings, and back from there.
        useful, todo = set(), [v for v, spent in ahead.items()
                               if spent + behind.get(v, inf) == best or any(spent + c + behind.get(w, inf) == best for w, c, _ in self.out(v))]
        while todo:
            v = todo.pop()
            if v not in useful:
                useful.add(v)
                todo += [w for w, c in self.into(v) if w in ahead and ahead[w] + c == ahead[v]]
        edits, node, spent = [], start, 0
        while node != last:
            ways = [(edit, to, spent + c) for to, c, edit in self.out(node)
                    if spent + c + behind.get(to, inf) == best or (to in useful and spent + c == ahead[to])]
            state = node & 3
            edit, node, spent = min(ways)
            edits.append(edit)
        return best - self.ends[state], state, edits[:-1]


def by_row(edits: list[str]) -> list[str]:
    """Edits as one string per row: inserts stand before the next row's edit, those at the end behind the last one's."""
    out, waiting = [], ""
    for e in edits:
        waiting += e
        if e[0] != "I":
            out.append(waiting)
            waiting = ""
    if waiting:
        out[-1] += waiting
    return out


@lru_cache(maxsize=1 << 14)
def _solved(codes: str, ends: tuple, open_end: bool, entries: tuple) -> list[tuple]:
    lattice = Lattice(codes, ends, open_end)
    return [(entry, *lattice.cheapest(entry)) for entry in entries]


def solved(codes: str, ends: tuple, open_end: bool, entries: tuple) -> list[tuple]:
    """``entry, cost, state, edits`` for each entry; short segments are remembered."""
    return (_solved if len(codes) <= 64 else _solved.__wrapped__)(codes, ends, open_end, entries)


# -- rows in order -------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy``: what is left of the rows after faults picked by a hash; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(0), (F.col("fault") == 3).cast("int"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, g``: all rows sorted by conversation and turn, ``g`` ascending in that order.

    Null turns come first; rows of equal turns are ordered by a hash of role and
    text. A range partitioning cuts a large conversation at any place.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie")]
    keyed = rows.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"))
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return settled(parts.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("g")))


def segments(rows: DataFrame) -> DataFrame:
    """Rows in order as segments: ``conv_id, sid, cid, before, follows, codes`` and the counts of faults.

    ``sid`` is the ``g`` of a segment's first row, its rows have the following
    numbers; ``cid`` is the first ``sid`` of the conversation, ``before`` the sid
    of the segment before, ``follows`` tells whether another comes.
    """
    sign = rf"[^{SPACE}]"
    identity = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    light = rows.select("g", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(sign)).alias("blank"),
                        F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z").alias("cut"), identity.alias("identity"))
    firsts = light.groupBy("conv_id", "identity").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("is_first"))
    # One row on each side, however often a text is repeated.
    light = light.join(firsts, "g", "left").withColumn("fault", F.when(F.col("blank"), "b").when(F.col("is_first").isNull(), "d")
                                                       .when(F.col("cut"), "t").otherwise("-"))
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(kind)).otherwise(kind)
    own = F.array_sort(F.collect_list(F.struct("g", "turn", "initial", code.alias("code"))))
    count = lambda f: F.count_if(F.col("fault") == f).alias({"b": "blank", "d": "duplicate", "t": "truncated"}[f])
    segs = light.groupBy("conv_id", F.shiftright("g", SHIFT).alias("block")).agg(own.alias("rows"), count("b"), count("d"), count("t"))
    row = lambda i: F.get("rows", i)
    others = F.slice(F.sequence(F.lit(0), F.size("rows") - 1), 2, F.size("rows"))
    many = lambda test: F.size(F.filter(others, test)).cast("long")
    last = F.element_at("rows", -1)
    segs = segs.select(
        "conv_id", F.col("rows")[0]["g"].alias("sid"), F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"),
        "blank", "duplicate", "truncated", F.col("rows")[0]["turn"].alias("first_turn"), last["turn"].alias("last_turn"),
        F.array_min(F.transform("rows", lambda r: r["turn"])).alias("least_turn"),
        F.col("rows")[0]["initial"].alias("first_initial"), last["initial"].alias("last_initial"),
        many(lambda i: illegal(row(i - 1)["initial"], row(i)["initial"])).alias("illegal"),
        many(lambda i: row(i)["turn"].isNotNull() & ~row(i)["turn"].eqNullSafe(row(i - 1)["turn"])).alias("turns"))
    w = Window.partitionBy("conv_id").orderBy("sid")
    above = lambda c: F.lag(c).over(w)
    new_turn = F.col("first_turn").isNotNull() & ~F.col("first_turn").eqNullSafe(above("last_turn"))
    return segs.select(
        "conv_id", "sid", F.first("sid").over(w).alias("cid"), above("sid").alias("before"), F.lead("sid").over(w).isNotNull().alias("follows"),
        "codes", "blank", "duplicate", "truncated", "least_turn", "last_turn", (F.col("turns") + new_turn.cast("long")).alias("turns"),
        (F.col("illegal") + F.coalesce(illegal(above("last_initial"), F.col("first_initial")), F.lit(False)).cast("long")).alias("illegal"))


def illegal(one: Column, two: Column) -> Column:
    return ~F.concat(one, two).isin("su", "ua", "au")


# -- the search over segments --------------------------------------------------------------

def end_costs(segs: DataFrame) -> DataFrame:
    """``sid, ends``: at which costs, by state, what follows a segment can end; for segments that are followed."""

    def matrix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ways = []
            for codes, follows in zip(f["codes"], f["follows"], strict=True):
                lattice = Lattice(codes, ENDS, not follows)
                ways.append([float(x) for entry in range(4) for x in lattice.reach(entry)])
            yield pd.DataFrame({"cid": f["cid"], "sid": f["sid"], "before": f["before"].astype("int64"), "follows": f["follows"], "ways": ways})

    def backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = ENDS
        for f in frames:
            sids, out = [], []
            for before, follows, ways in zip(f["before"], f["follows"], f["ways"], strict=True):
                ends = ends if follows else ENDS  # the last segment of a conversation comes first
                ends = tuple(min(ways[4 * s + t] + ends[t] for t in range(4)) for s in range(4))
                sids.append(before)
                out.append(list(ends))
            yield pd.DataFrame({"sid": sids, "ends": out})

    later = segs.where("before is not null").select("cid", "sid", "before", "follows", "codes") \
        .mapInPandas(matrix, "cid long, sid long, before long, follows boolean, ways array<double>")
    return later.repartition("cid").sortWithinPartitions("cid", F.desc("sid")).mapInPandas(backwards, "sid long, ends array<double>")


def entries(ways: DataFrame) -> DataFrame:
    """``sid, entry``: the state in which the segments before leave a conversation; for segments that follow others."""

    def forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = NOTHING
        for f in frames:
            sids, out = [], []
            for sid, first, leave in zip(f["sid"], f["first"], f["leave"], strict=True):
                if first:
                    state = NOTHING
                else:
                    sids.append(sid)
                    out.append(state)
                state = int(leave[0 if first else state])
            yield pd.DataFrame({"sid": sids, "entry": out}).astype({"sid": "int64", "entry": "int32"})

    several = ways.where("not first or follows").select("cid", "sid", "first", F.transform("ways", lambda w: w["leave"]).alias("leave"))
    return several.repartition("cid").sortWithinPartitions("cid", "sid").mapInPandas(forwards, "sid long, entry int")


def edited(segs: DataFrame) -> DataFrame:
    """``conv_id, cid, sid, cost, edits``: of each segment its part of the least of the cheapest repairs, edits by row."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for codes, first, ends in zip(f["codes"], f["first"], f["ends"], strict=True):
                found = solved(codes, ENDS if ends is None else tuple(ends), ends is None, (NOTHING,) if first else (0, 1, 2, 3))
                out.append([{"cost": int(cost), "leave": state, "edits": by_row(edits)} for _, cost, state, edits in found])
            yield pd.DataFrame({"cid": f["cid"], "sid": f["sid"], "first": f["first"], "follows": f["follows"], "ways": out})

    given = segs.join(end_costs(segs), "sid", "left").select("cid", "sid", F.col("before").isNull().alias("first"), "follows", "codes", "ends")
    ways = settled(given.mapInPandas(
        solve, "cid long, sid long, first boolean, follows boolean, ways array<struct<cost:long,leave:int,edits:array<string>>>"))
    way = F.get("ways", F.coalesce("entry", F.lit(0)))
    return ways.join(entries(ways), "sid", "left").select("cid", "sid", way["cost"].alias("cost"), way["edits"].alias("edits"))


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``cid, conv_id, g, i, edit, turn, role, text``: the repaired rows; ``g, i`` is their order.

    Deleted rows are missing. Inserted ones have no turn and an empty text.
    """
    each = edits.select("cid", "sid", F.posexplode("edits").alias("place", "own")) \
        .select("cid", (F.col("sid") + F.col("place")).alias("g"), "own")
    met = rows.join(each, "g").select("cid", "conv_id", "g", "turn", "role", "text",
                                      F.posexplode(F.regexp_extract_all("own", F.lit("[A-Z][a-z-]"), 0)).alias("i", "e"))
    edit, initial = F.substring("e", 1, 1), F.substring("e", 2, 1)
    name = F.when(initial == "u", NAMES["u"]).otherwise(NAMES["a"])
    return met.where(edit != "D").select(
        "cid", "conv_id", "g", "i", edit.alias("edit"), F.when(edit != "I", F.col("turn")).alias("turn"),
        F.when(edit == "K", F.col("role")).otherwise(name).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """``cid, sha256`` of a conversation's lines ``role:text``; its rows stream through a task and are not held."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for f in frames:
            ids, out = [], []
            for cid, line in zip(f["cid"], f["line"], strict=True):
                if cid != now:
                    if now is not None:
                        ids.append(now)
                        out.append(digest.hexdigest())
                    now, digest = cid, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"cid": ids, "repaired_sha256": out}).astype({"cid": "int64", "repaired_sha256": "str"})
        if now is not None:
            yield pd.DataFrame({"cid": [now], "repaired_sha256": [digest.hexdigest()]})

    lines = turns.select("cid", "g", "i", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("cid").sortWithinPartitions("cid", "g", "i").select("cid", "line") \
        .mapInPandas(stream, "cid long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, turn, role, text``) repaired: one row per conversation, and the repaired turns.

    The first has ``conv_id, cid, gaps, blank, duplicate, truncated, illegal, cost,
    audit``: a row's first fault counts, ``audit`` are the edits' initials, the
    ASCII-least of the cheapest. Rows without conv_id are one conversation; null
    roles and texts must be given a value before. A role without a letter is
    never kept.
    """
    rows = in_order(rows)
    segs = settled(segments(rows))
    edits = settled(edited(segs))
    said = F.regexp_replace(F.array_join("edits", ""), "[a-z-]", "")
    audits = edits.groupBy("cid").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("sid", said.alias("said")))), lambda x: x["said"]), "").alias("audit"))
    total = lambda c: F.sum(c).alias(c)
    gaps = F.coalesce(F.max("last_turn") - F.min("least_turn") + 1 - F.sum("turns"), F.lit(0))
    counts = segs.groupBy("conv_id", "cid").agg(gaps.alias("gaps"), total("blank"), total("duplicate"), total("truncated"), total("illegal"))
    return counts.join(audits, "cid"), repaired_turns(rows, edits)


def op11_repair(spark, sf_dir) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, turns = repair(damaged(given))
    found = found.join(digests(turns), "cid", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = found.select("conv_id", *numbers, "audit", "repaired_sha256")
    # Conversations that lost all rows, null ids too.
    none = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", *[F.lit(None).cast("long").alias(c) for c in numbers], *[F.lit(None).cast("string").alias(c) for c in ("audit", "repaired_sha256")])
    return rows.unionByName(none).groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op11_repair": op11_repair}
ORACLE: dict[str, str] = {}
