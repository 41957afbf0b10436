"""The first event of each key, and again the first one later than so many hours after it: repeats that come within that
time of an accepted event are dropped, and don't prolong it.

In batch every event points to the first event of its key that is later than its time and the hours; the accepted ones are
those that the pointers lead to from each key's first. Pointers are found hour by hour and followed by doubling, so no key
is held in one task and the rounds grow with the logarithm of the longest chain. On a stream the state of a key is the time that was
accepted last, and a timer removes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.shared import written

HOUR = 3_600_000_000


def pointers(times: DataFrame, ttl: int) -> DataFrame:
    """k, t, next: for each k and t of times (distinct, t in microseconds) the least t of k beyond t + ttl; null if there is none."""
    hour = lambda c: F.floor(F.col(c) / HOUR)
    asked = times.select("k", F.col("t").alias("asker"), (F.col("t") + ttl).alias("at")).withColumn("hour", hour("at"))
    given = times.select("k", F.lit(None).cast("long").alias("asker"), F.col("t").alias("at"), F.col("t").alias("given")).withColumn("hour", hour("at"))
    both = asked.withColumn("given", F.lit(None).cast("long")).unionByName(given)
    later = Window.partitionBy("k", "hour").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    inside = both.withColumn("next", F.min("given").over(later)).where("asker is not null")
    # An hour that holds nothing later is followed by the first event of the next hour that has one.
    after = Window.partitionBy("k").orderBy("hour").rowsBetween(1, Window.unboundedFollowing)
    hours = both.groupBy("k", "hour").agg(F.min("given").alias("first")).select("k", "hour", F.min("first").over(after).alias("following"))
    return inside.join(hours, ["k", "hour"]).select("k", F.col("asker").alias("t"), F.coalesce("next", "following").alias("next"))


def accepted(times: DataFrame, ttl: int) -> DataFrame:
    """The k, t of times (distinct) that are accepted."""
    firsts = times.groupBy("k").agg(F.min("t").alias("t"))
    jumps = written(pointers(times, ttl).where("next is not null"), "jumps")
    # Only events that a pointer leads to, or a key's first, can be accepted.
    reached = firsts.unionByName(jumps.select("k", F.col("next").alias("t"))).distinct()
    jumps = written(jumps.join(reached, ["k", "t"], "left_semi"), "jumps")
    found = written(firsts, "accepted")
    while not jumps.isEmpty():
        led = found.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t"))
        found = written(found.unionByName(led).distinct(), "accepted")
        further = jumps.select("k", F.col("t").alias("next"), F.col("next").alias("last"))
        jumps = written(jumps.join(further, ["k", "next"]).select("k", "t", F.col("last").alias("next")), "jumps")
    return found


def _least(rows: pd.DataFrame, ts: str) -> pd.DataFrame:
    """A row per time, in order: of those at one time the least by the other columns, nulls first."""
    rows = rows.sort_values(ts, kind="stable")
    same = rows[ts].duplicated(keep=False).to_numpy()
    if not same.any():
        return rows
    ties = rows[same].sort_values([ts, *(c for c in rows.columns if c != ts)], kind="stable", na_position="first")
    return pd.concat([rows[~same], ties.drop_duplicates(ts)]).sort_values(ts, kind="stable")


def _kept(ttl: int, key: str, ts: str):
    def keep(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """The rows that are accepted, by time; all rows without a key or time. A key's rows of one micro-batch come in several
        batches, in any order, so a row per time is held until the last one."""
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        held, more = None, []
        for rows in batches:
            free = (rows[key].isna() | rows[ts].isna()).to_numpy()
            if free.any():
                yield rows[free]
                rows = rows[~free]
            if last is not None:
                rows = rows[rows[ts].to_numpy("datetime64[us]").astype(np.int64) > last + ttl]
            more += [rows] if len(rows) else []
            if held is not None and sum(map(len, more)) > len(held):
                held, more = _least(pd.concat([held, *more]), ts), []
            elif held is None and more:
                held, more = _least(more[0], ts), []
        if held is None:
            return
        held = _least(pd.concat([held, *more]), ts) if more else held
        times, taken, at = held[ts].to_numpy("datetime64[us]").astype(np.int64), [], 0
        while at < len(times):
            taken.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + ttl, side="right"))
        yield held.iloc[taken]
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return keep


def first_per_key(events: DataFrame, key: str, ts: str, hours: int = 24) -> DataFrame:
    """The events (a batch or a stream) without those that come at most so many hours after an accepted one of their key.

    Rows without a key or time are all kept, as nothing can repeat them. Of rows at one time the least by the other
    columns is accepted, in a stream of those of one micro-batch. An empty table gives an empty result. On a stream events
    count in the order in which they come, those of one micro-batch by time; one that comes in a later micro-batch than the accepted
    one but has an earlier time is its repeat, and the watermark is as many hours as the state is kept. A task holds a row
    per time of one key's rows of a micro-batch.
    """
    ttl = hours * HOUR
    if events.isStreaming:
        watched = events.withWatermark(ts, f"{hours} hours")
        return watched.groupBy(key).applyInPandasWithState(_kept(ttl, key, ts), events.schema, "accepted long", "append", "EventTimeTimeout")
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    rest = [c for c in events.columns if c not in (key, ts)]
    ones = events.where(known).groupBy(key, ts).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("v"))
    timed = ones.withColumns({"k": F.col(key), "t": F.unix_micros(F.col(ts).cast("timestamp"))})
    chosen = timed.join(accepted(written(timed.select("k", "t"), "times"), ttl), ["k", "t"], "left_semi")
    return chosen.select(key, ts, *(F.col("v")[c].alias(c) for c in rest)).select(*events.columns).unionByName(events.where(~known))
