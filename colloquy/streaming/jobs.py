"""Stream jobs made of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import DEFAULT_FILLERS
from ..operators.cleaning import clean
from ..operators.glossary import Term, apply_exact

SESSION_LOG = ("recording_id bigint, speaker string, kind string, session_start timestamp, session_end timestamp, "
               "turns bigint, version bigint")

# Groups of speakers that a stream follows together, and turns that are merged into their sessions at a time, at least.
BUCKETS, MERGED_ROWS = 1024, 1 << 16

_WHO, _TIMES = ["recording", "who", "missing"], ["starts", "ends", "turns"]


def stream_clean(arriving: DataFrame, terms: Sequence[Term] = (), fillers: Sequence[str] = DEFAULT_FILLERS,
                 text: str = "text") -> DataFrame:
    """Clean and correct transcripts as they arrive; stateless, so restarts lose nothing."""
    return apply_exact(clean(arriving, text, fillers), terms, text)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, append it as parquet and stop."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_turns(arriving: DataFrame, time: str = "ts", gap: str = "30 seconds", lateness: str = "10 minutes",
                 idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Speaking sessions per recording and speaker from arriving turns, as a log of ``SESSION_LOG`` rows.

    A session ends after ``gap`` of silence of that speaker; interruptions by
    others do not end it. The state holds the sessions that a turn may
    still change. Whenever a speaker's turns arrive, those sessions are written as ``open``,
    with the time of the batch as their version; a session that ends more than
    ``lateness`` before the latest turn is written as ``closed`` once and leaves the
    state, when its speaker or another one of the bucket is heard again or the bucket
    has been silent for ``idle``. (Without ``idle`` a silent bucket's last sessions stay;
    with it a query that is to stop at the end of its input doesn't stop.) A turn later
    than that is written as ``late`` and changes no session. ``sessions_of`` and
    ``late_turns`` read the log.

    Speakers are dealt to ``buckets`` by their hash, and a bucket's speakers are followed
    together, since a call for every speaker takes far longer than its turns. The
    number must stay the same as long as a checkpoint is used.
    """
    silence = _micros(arriving, gap)
    wait = idle and max(1, _micros(arriving, idle) // 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.getCurrentWatermarkMs() * 1000
        held, arrived, late, n = _held(state.get if state.exists else ([],) * 7), [], [], 0
        for f in () if state.hasTimedOut else frames:
            turns = f[_WHO].assign(starts=f["at"], ends=f["at"] + silence, turns=1, heard=True)
            late.append(turns[turns["starts"] < known])
            arrived.append(turns[turns["starts"] >= known])
            n += len(f)
            if n > max(MERGED_ROWS, len(held)):
                held, arrived, n = _merged([held, *arrived]), [], 0
        held = _merged([held, *arrived])
        who, done = held.groupby(_WHO, sort=False).ngroup().to_numpy(), held["ends"].to_numpy() < known
        # Speakers with turns or closed sessions: those of others are as they were written.
        changed = np.bincount(who, held["heard"].to_numpy() | done)[who] > 0
        rows = [x.assign(kind="late", ends=x["starts"]) for x in late]
        rows += [held[done].assign(kind="closed"), held[changed & ~done].assign(kind="open")]
        if done.all():
            state.remove()
        else:
            state.update(_packed(held[~done]))
            if wait:
                state.setTimeoutDuration(wait)
        out = pd.concat(rows, ignore_index=True)
        if len(out):
            yield out[[*_WHO, "kind", "starts", "ends", "turns"]].assign(version=state.getCurrentProcessingTimeMs())

    # With a time-out by event time late rows would not come through.
    kind = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    # Pandas has no null among integers: ``missing`` tells which parts of a key are null, and a turn without a time is late.
    turns = arriving.withWatermark(time, lateness).select(
        F.pmod(F.xxhash64("recording_id", "speaker"), F.lit(buckets)).alias("bucket"), time,
        F.coalesce("recording_id", F.lit(0)).cast("long").alias("recording"), F.coalesce("speaker", F.lit("")).alias("who"),
        (F.col("recording_id").isNull().cast("long") * 2 + F.col("speaker").isNull().cast("long")).alias("missing"),
        F.coalesce(F.unix_micros(time), F.lit(np.iinfo(np.int64).min)).alias("at"))
    log = turns.groupBy("bucket").applyInPandasWithState(
        follow, "recording long, who string, missing long, kind string, starts long, ends long, turns long, version long",
        "recording array<long>, who array<string>, missing array<long>, sessions array<long>, starts array<long>, ends array<long>, turns array<long>",
        "append", kind)
    return log.select(
        F.when(F.col("missing") < 2, F.col("recording")).alias("recording_id"), F.when(F.col("missing") % 2 == 0, F.col("who")).alias("speaker"), "kind",
        F.timestamp_micros("starts").alias("session_start"), F.timestamp_micros("ends").alias("session_end"), "turns", "version")


def _micros(df: DataFrame, interval: str) -> int:
    """Microseconds of an interval such as ``30 seconds``."""
    return df.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {interval})").head()[0]


def _held(state: Sequence) -> pd.DataFrame:
    """The sessions of a bucket's state, speaker by speaker."""
    recording, who, missing, sessions, *times = state
    n = np.array(sessions, np.int64)
    ids = {c: np.repeat(np.array(x, t), n) for c, x, t in zip(_WHO, (recording, who, missing), (np.int64, object, np.int64), strict=True)}
    return pd.DataFrame(ids | {c: np.array(x, np.int64) for c, x in zip(_TIMES, times, strict=True)} | {"heard": np.zeros(n.sum(), bool)})


def _packed(held: pd.DataFrame) -> tuple:
    """The state that ``_held`` reads; a speaker's sessions follow each other."""
    speakers = held.groupby(_WHO, sort=False).size()
    return (*(speakers.index.get_level_values(c).tolist() for c in _WHO), speakers.tolist(), *(held[c].tolist() for c in _TIMES))


def _merged(parts: Sequence[pd.DataFrame]) -> pd.DataFrame:
    """Sessions of a speaker that touch are one."""
    s = pd.concat(parts, ignore_index=True)
    if not len(s):
        return s
    who = s.groupby(_WHO, sort=False).ngroup().to_numpy()
    order = np.lexsort((s["ends"], s["starts"], who))
    s, who = s.iloc[order], who[order]
    starts, ends = s["starts"].to_numpy(), s["ends"].groupby(who).cummax().to_numpy()
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (starts[1:] > ends[:-1])))
    last = np.append(first[1:], len(s)) - 1
    return s.iloc[first].assign(ends=ends[last], turns=np.add.reduceat(s["turns"].to_numpy(), first), heard=np.logical_or.reduceat(s["heard"].to_numpy(), first))


def sessions_of(log: DataFrame) -> DataFrame:
    """The sessions that a log of ``stream_turns`` knows: closed ones, and open ones as last written for their speaker."""
    key = ["recording_id", "speaker"]
    last = log.where("kind <> 'late'").groupBy(*key).agg(F.max("version").alias("_last")).withColumnsRenamed({k: f"_{k}" for k in key})
    same = F.col("recording_id").eqNullSafe(F.col("_recording_id")) & F.col("speaker").eqNullSafe(F.col("_speaker"))
    return log.where("kind <> 'late'").join(last, same).where("kind = 'closed' OR version = _last").select(
        *key, "session_start", "session_end", "turns", (F.col("kind") == "open").alias("open"))


def late_turns(log: DataFrame) -> DataFrame:
    """Turns that came too late to change a session."""
    return log.where("kind = 'late'").select("recording_id", "speaker", F.col("session_start").alias("ts"))
