"""Books that grow while they are read, requests that go out once, and timers of a reading session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Minutes without a sign of life until engines are released, chapters ahead that are fetched early.
IDLE_MS, AHEAD = 10 * 60_000, 1


def wanted(positions: DataFrame, chapters: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """(book, chapter, url): the next chapter of each book that is read to within `ahead` chapters of its end.

    positions (book, chapter) are where readers are, chapters (book, chapter, next_url) what is there; a book whose last
    chapter has no next_url has ended.
    """
    last = chapters.groupBy("book").agg(F.max("chapter").alias("last"), F.max_by("next_url", "chapter").alias("url"))
    at = positions.groupBy("book").agg(F.max("chapter").alias("at"))
    return at.join(last, "book").where((F.col("at") + ahead >= F.col("last")) & F.col("url").isNotNull()).select("book", (F.col("last") + 1).alias("chapter"), "url")


def ask_once(ask: Callable[[DataFrame], DataFrame], read: Callable[[str], DataFrame | None], append: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over positions that lets each chapter be asked for once.

    What was asked for is a table, "asked" (book, chapter); it is written before the request, so one that was lost is not
    sent again by a batch that runs again: the chapter is then missing, and its book does not grow.
    ask(wanted) returns new chapters (book, chapter, next_url), which are appended to
    "chapters"; a book whose request brings none, or fails, grows no more. read(table) and append(rows, table) keep both.
    """

    def batch(positions: DataFrame, _: int) -> None:
        there, asked = read("chapters"), read("asked")
        new = wanted(positions.select("book", "chapter"), there)
        if asked is not None:
            new = new.join(asked.select("book", "chapter"), ["book", "chapter"], "left_anti")
        new = new.cache()
        try:
            if new.isEmpty():
                return
            append(new.select("book", "chapter"), "asked")
            append(ask(new).select("book", "chapter", "next_url"), "chapters")
        finally:
            new.unpersist()

    return batch


class _Session(StatefulProcessor):
    """When a session's engines are released and its sleep timer ends, in event time."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "seen long, sleep long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, sleep = self.now.get() if self.now.exists() else (-1, -1)
        events = pd.concat(list(rows)).sort_values(["ms", "kind"])
        out = []
        for r in events.itertuples(index=False):
            ms = int(r.ms)
            # what ended before this event, and had no watermark yet to say so
            due = [(sleep, "stop")] if 0 <= sleep < ms else []
            due += [(seen + self.idle, "release")] if 0 <= seen and seen + self.idle < ms else []
            out += [(key[0], at, action) for at, action in sorted(due)]
            sleep = -1 if 0 <= sleep < ms else sleep
            seen = max(seen, ms)
            if r.kind == "sleep":  # a new timer takes the place of the old one, one of no minutes ends it
                sleep = ms + int(r.minutes) * 60_000 if r.minutes > 0 else -1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in {seen + self.idle, *([sleep] if sleep >= 0 else [])}:
            self.handle.registerTimer(t)
        self.now.update((seen, sleep))
        yield pd.DataFrame(out, columns=["session", "ms", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        seen, sleep = self.now.get() if self.now.exists() else (-1, -1)
        out = []
        if at == sleep:
            out.append((key[0], at, "stop"))
            sleep = -1
            self.now.update((seen, sleep))
        if at == seen + self.idle:
            out.append((key[0], at, "release"))
            if sleep < 0:
                self.now.clear()
        yield pd.DataFrame(out, columns=["session", "ms", "action"])

    def close(self) -> None:
        pass


def session_ends(events: DataFrame, late: str = "1 minute", idle: int = IDLE_MS) -> DataFrame:
    """(session, ms, action) of a stream (session, at, kind, minutes): `release` after `idle` without an event, `stop`
    when a sleep timer ends. Times are the events' own; a timer fires once the watermark has passed it.
    """
    rows = events.withWatermark("at", late).select("session", "at", "kind", F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"), F.unix_millis("at").alias("ms"))
    return rows.groupBy("session").transformWithStateInPandas(_Session(idle), "session long, ms long, action string", "append", "EventTime")
