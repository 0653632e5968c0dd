"""Streams of reading events: latest-wins positions, appends without repeats, session fencing, running loudness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Weight of the past in the average, wanted loudness, limits of the gain.
PAST, TARGET, LEAST_GAIN, MOST_GAIN = 0.8, 0.085, 0.5, 3.0


def latest_positions(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The newest values of each key; state is one row a key (update mode)."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return events.groupBy(key).agg(newest).select(key, "v.*")


def appended_once(chapters: DataFrame, keys: list[str], at: str | None = None, keep: str = "1 day") -> DataFrame:
    """Rows whose keys were not met before; with a time column the state is bounded by a watermark."""
    if at:
        return chapters.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)
    return chapters.dropDuplicates(keys)


def gains(levels: pd.Series, average: float | None) -> tuple[list[float], float]:
    """Gains of a voice's phrases in order, and its running average afterwards."""
    out = []
    for x in levels:
        average = x if average is None else PAST * average + (1 - PAST) * x
        out.append(min(MOST_GAIN, max(LEAST_GAIN, TARGET / average)) if average > 0 else MOST_GAIN)
    return out, average


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq")
    out, average = gains(rows["level"], state.get[0] if state.exists else None)
    state.update((average,))
    yield pd.DataFrame({"voice": key[0], "seq": rows["seq"], "gain": out})


def loudness(events: DataFrame) -> DataFrame:
    """T5: (voice, seq, gain) of a stream (voice, seq, level); state is one number a voice (append mode)."""
    return events.groupBy("voice").applyInPandasWithState(_step, "voice long, seq long, gain double", "average double", "append", GroupStateTimeout.NoTimeout)


def live_only(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of each player's current session; sessions is a table (player, session)."""
    return events.join(sessions, ["player", "session"], "left_semi")
