"""Q3, T4: who speaks, by what the author's words tell and how a conversation goes.

A scene is a sequence of lines, narration and breaks. What a row itself shows is given as small numbers (`CUES`); what one
row leaves for the next is its neighbour's, so what is left for a state machine is who spoke last, who else did, and
whom the narration brought in: 36 states. The rule of one step is stated once, as a table (`transitions`), which the
batch form scans (`scan.states`) and the stream looks up row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from leafmill.operators import scan

#: Genders in cues and states, and roles of lines by the number of their speaker; 3 is a speaker of unknown gender.
NONE, FEMALE, MALE, UNKNOWN = range(4)
ROLES = ["SPEECH", "FEMALE", "MALE", "SPEECH"]
#: What a row is; what a line is told to be (3: the last speaker goes on).
LINE, NARRATION, BREAK = range(3)
GOES_ON = 3
#: What a row shows. told, story: of the line itself; long, addressed, asked: of a line, for the next line too; beat,
#: silent, still: left for the next row, of the one who acts, keeps silent or does not react in the words between.
CUES = ["kind", "told", "story", "long", "addressed", "asked", "beat", "silent", "still"]
LEFT = ["addressed", "asked", "long", "beat", "silent", "still"]
# Characters of narration, and of a line, that count as long.
SCENE_CHARS, LONG_LINE = 200, 150
#: States: last (4) x other (3) x brought in (3). Events of a line: told (4) x beat (3) x silent (3) x story (2) x addressed (3).
STATES, LINE_EVENTS = 36, 216
NARRATED, BROKEN = LINE_EVENTS, LINE_EVENTS + 1
#: Rows before their turn that a stream holds for a scene; more are an error.
HELD = 1000
BLOCK = 4096


def line_event(told, story, long, before, addressed):
    """The number of a line's event, of columns as of numbers; before: what earlier rows left, by name.

    A line goes on with a story if nothing was asked before it, and it says so or both lines are long.
    """
    both = long * before["long"]
    goes_on = (story + both - story * both) * (1 - before["asked"])
    return (((told * 3 + before["beat"]) * 3 + before["silent"]) * 2 + goes_on) * 3 + addressed


def transitions(spark: SparkSession) -> DataFrame:
    """(event, map, spoken): for each event the next state and the speaker in each state; 218 rows.

    Who speaks a line, the first that holds: whom the author's words tell; the one who acts in the narration before; the
    last speaker, where the other one is said to keep silent or a story goes on; the one addressed; the one brought in;
    the other one. A told gender is the other speaker's if they have it, else the last one's if they have it.
    """
    n = F.col("id").cast("int")
    rows = spark.range((LINE_EVENTS + 2) * STATES, numPartitions=1).select(F.floor(n / STATES).cast("int").alias("event"), (n % STATES).alias("state"))
    part = lambda c, below, size: (F.floor(c / below) % size).cast("int")
    e, s = F.col("event"), F.col("state")
    rows = rows.select("event", "state", part(e, 54, 4).alias("told"), part(e, 18, 3).alias("beat"), part(e, 6, 3).alias("silent"), part(e, 3, 2).alias("story"), part(e, 1, 3).alias("addressed"), part(s, 9, 4).alias("last"), part(s, 3, 3).alias("other"), part(s, 1, 3).alias("brought"))
    col, known = F.col, F.col("last").isin(FEMALE, MALE)
    given = F.when(col("told").isin(FEMALE, MALE), col("told")).when((col("told") == GOES_ON) & (col("last") != NONE), col("last")).when(col("beat") != NONE, col("beat"))
    goes_on = (col("told") == GOES_ON) & (col("last") != NONE)
    quiet = known & (col("silent") != NONE) & (col("silent") != col("last"))
    story = (col("story") == 1) & (col("last") != NONE)
    guess = F.when(quiet | story, col("last")).when(col("addressed") != NONE, col("addressed")).when(col("brought") != NONE, col("brought")).when(col("other") != NONE, col("other")).otherwise(UNKNOWN)
    rows = rows.withColumn("speaker", F.coalesce(given, guess))
    # who it is: the last speaker again, or someone else, who leaves the last one as the other
    same = F.when(given.isNotNull(), goes_on | ((col("speaker") != col("other")) & (col("speaker") == col("last")))).otherwise(quiet | story)
    other = F.when(same | ~known, col("other")).otherwise(col("last"))
    brought = F.when((col("beat") != NONE) & col("speaker").isin(FEMALE, MALE) & (col("beat") != col("speaker")), col("beat")).otherwise(NONE)
    line = col("speaker") * 9 + other * 3 + brought
    next_state = F.when(e == BROKEN, 0).when(e == NARRATED, col("state") - col("brought")).otherwise(line).cast("int")
    found = rows.select("event", "state", next_state.alias("next"), F.when(e < LINE_EVENTS, col("speaker")).alias("speaker"))
    return found.groupBy("event").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("state", "next"))), lambda x: x["next"]).alias("map"),
        F.transform(F.array_sort(F.collect_list(F.struct("state", "speaker"))), lambda x: x["speaker"]).alias("spoken"))


def left_before(rows: DataFrame, keys: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """rows with what earlier rows left: _line (addressed, asked, long) of the last line, _row (beat, silent, still) of the last row.

    A break leaves nothing. Windows go over blocks of the order, and over one row a block.
    """
    of_line = ("addressed", "asked", "long")
    line = F.when(F.col("kind") == LINE, F.struct(*of_line)).when(F.col("kind") == BREAK, F.struct(*(F.lit(0).alias(c) for c in of_line)))
    keep = lambda c: F.when(F.col("kind") == BREAK, NONE).otherwise(F.col(c)).alias(c)
    rows = rows.withColumn("_l", line).withColumn("_r", F.struct(*map(keep, ("beat", "silent", "still")))).withColumn("_block", F.floor(F.col(order) / block))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_l", F.when(F.col("_l").isNotNull(), F.col(order))).alias("_l"), F.max_by("_r", order).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_block").alias("_b"), F.last("_l", True).over(w).alias("_lb"), F.last("_r", True).over(w).alias("_rb"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_li", F.last("_l", True).over(inside)).withColumn("_ri", F.last("_r", True).over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)] + [F.col("_block") == F.col("_b")]
    found = rows.join(ends, same)
    return found.withColumn("_line", F.coalesce("_li", "_lb")).withColumn("_row", F.coalesce("_ri", "_rb")).drop("_l", "_r", "_li", "_ri", "_lb", "_rb", "_block", "_b", *(f"_k{n}" for n in range(len(keys))))


def events(rows: DataFrame) -> DataFrame:
    """rows of left_before with the number of their event."""
    before = {f: F.coalesce(F.col(f"{c}.{f}"), F.lit(0)) for c, f in (("_line", "addressed"), ("_line", "asked"), ("_line", "long"), ("_row", "beat"), ("_row", "silent"), ("_row", "still"))}
    addressed = F.when(before["addressed"] != before["still"], before["addressed"]).otherwise(NONE)
    event = line_event(F.col("told"), F.col("story"), F.col("long"), before, addressed)
    return rows.withColumn("event", F.when(F.col("kind") == LINE, event).when(F.col("kind") == NARRATION, NARRATED).otherwise(BROKEN).cast("int"))


def role(kind: Column, speaker: Column) -> Column:
    return F.when(kind == LINE, F.element_at(F.array(*map(F.lit, ROLES)), speaker + 1)).otherwise("NARRATOR")


def roles(rows: DataFrame, keys: list[str], order: str, fan: int = scan.FAN, block: int = BLOCK) -> DataFrame:
    """Q3: (keys, order, role) of rows (keys, order, CUES): who speaks each line; NARRATOR for narration and breaks.

    `order` is a long from 0 on, distinct in a scene. A scene may be of any length. Null cues are 0.
    """
    clean = rows.select(*keys, F.col(order).cast("long").alias(order), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in CUES)).where(F.col(order).isNotNull())
    table = transitions(rows.sparkSession)
    coded = events(left_before(clean, keys, order, block)).select(*keys, order, "kind", "event")
    found = scan.states(coded, keys, order, table, "event", STATES, fan=fan)
    spoken = found.join(F.broadcast(table.select(F.col("event").alias("_e"), "spoken")), F.col("event") == F.col("_e"))
    return spoken.select(*keys, order, role(F.col("kind"), F.element_at("spoken", F.col("state") + 1)).alias("role"))


class _Scene(StatefulProcessor):
    """One scene of a stream: the state and what was left as a value, rows before their turn as a list."""

    def __init__(self, table: dict[int, tuple[list[int], list[int]]], key: str, order: str):
        self.table, self.key, self.order = table, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next long, state int, " + ", ".join(f"{c} int" for c in LEFT))
        self.early = handle.getListState("early", "n long, " + ", ".join(f"{c} int" for c in CUES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = {r[0]: tuple(map(int, r)) for r in (self.early.get() if self.early.exists() else ())}
        for part in rows:
            waiting |= {int(r[0]): tuple(map(int, r)) for r in part[[self.order, *CUES]].itertuples(index=False)}
        turn, state, *left = self.now.get() if self.now.exists() else (0, 0, *[0] * len(LEFT))
        before, out = dict(zip(LEFT, left, strict=True)), []
        waiting = {n: r for n, r in waiting.items() if n >= turn}  # a turn that has been is not read again
        while turn in waiting:
            row = dict(zip(CUES, waiting.pop(turn)[1:], strict=True))
            kind = row["kind"]
            call = before["addressed"] if before["addressed"] != before["still"] else NONE
            event = line_event(row["told"], row["story"], row["long"], before, call) if kind == LINE else NARRATED if kind == NARRATION else BROKEN
            following, spoken = self.table[event]
            out.append((key[0], turn, ROLES[spoken[state]] if kind == LINE else "NARRATOR"))
            state, turn = following[state], turn + 1
            for c in LEFT:
                if kind == BREAK:
                    before[c] = 0
                elif kind == LINE or c in ("beat", "silent", "still"):
                    before[c] = row[c]
        if len(waiting) > HELD:
            raise ValueError(f"scene {key[0]}: more than {HELD} rows before turn {turn}")
        self.now.update((turn, state, *(before[c] for c in LEFT)))
        self.early.clear()
        if waiting:
            self.early.put([waiting[n] for n in sorted(waiting)])
        yield pd.DataFrame(out, columns=[self.key, self.order, "role"])

    def close(self) -> None:
        pass


def roles_of_stream(rows: DataFrame, key: str, order: str) -> DataFrame:
    """T4: roles() of a stream of rows (key, order, CUES), append mode.

    Turns are numbered from 0 without gaps; one that comes early waits for those before it, and one that comes again is
    left out. The session needs the RocksDB state store.
    """
    table = {r["event"]: (r["map"], r["spoken"]) for r in transitions(rows.sparkSession).collect()}  # 218 rows
    clean = rows.select(key, F.col(order).cast("long").alias(order), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in CUES))
    kind = dict(rows.dtypes)[key]
    return clean.groupBy(key).transformWithStateInPandas(_Scene(table, key, order), f"{key} {kind}, {order} long, role string", "append", "None")


# How a line begins that goes on with a story.
STORY = [
    "во-вторых", "в-третьих", "в-четвертых", "в-пятых", "в-шестых", "в-седьмых", "в-восьмых", "кроме того", "более того", "к тому же", "а потом",
    "и потом", "после этого", "так вот", "итак", "а еще", "и еще", "а главное", "и главное", "а дальше", "и тогда", "и вот",
    "and then", "after that", "besides", "moreover", "secondly", "thirdly", "and so", "anyway", "what's more", "what’s more",
]


def continues_story(speech: Column, starts: list[str] = STORY) -> Column:
    """Whether a line begins as the next part of a story: its first words are one of `starts`."""
    joined = F.regexp_replace(F.translate(F.lower(speech), "ё", "е"), "(?<=\\p{L})[—–](?=\\p{L})", "-")
    words = F.array_join(F.slice(F.regexp_extract_all(joined, F.lit("(\\p{L}[\\p{L}'’-]*+)"), F.lit(1)), 1, 3), " ")
    found = F.lit(False)
    for s in starts:
        found = found | F.concat(words, F.lit(" ")).startswith(s + " ")
    return found
