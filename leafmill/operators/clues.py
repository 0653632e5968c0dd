"""Q4, Q8, Q9: what words tell of who speaks and whom a line is said to, from token rows and a table of marked words.

Marks are rows (key, mark, value): what a word is, and for some the gender it tells. Texts are told apart by keys; each
is read by windows and small groups over its tokens, so a corpus is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a word may be. actor: a pronoun or a word for a person; name: a name (its gender, or ? if that is unknown); verb: a
#: verb that agrees with its subject; the values of address are genders too, those of the others are not read.
MARKS = ["actor", "name", "verb", "says", "negates", "unnamed", "address", "own", "clause", "self"]
# Words in which a subject is looked for, those in which a negation counts, those of a form of address.
SUBJECT_WORDS, NEGATED_WORDS, ADDRESS_WORDS, AFTER_SELF = 16, 8, 4, 3


def marked(tokens: DataFrame, marks: DataFrame) -> DataFrame:
    """tokens with a column for each mark; null where a word isn't of that kind."""
    wide = marks.groupBy("key").agg(*(F.min(F.when(F.col("mark") == m, F.col("value"))).alias(m) for m in MARKS))
    return tokens.join(wide, "key", "left")


def _gender(value: str):
    return F.when(F.col(value) != "?", F.col(value))


def subjects(tokens: DataFrame, keys: list[str], marks: DataFrame, attribution: bool) -> DataFrame:
    """Q4: (keys, gender, name, weak, unnamed, silent, still): who acts in the first clause of each text that tells it.

    The first pronoun, person or name of the first SUBJECT_WORDS words; a name without a known gender has the verb's. With
    `attribution` (the words go on a line's sentence) the first verb alone may tell, weakly. A word for someone unnamed
    before any of these tells of a new person. A negation makes the one who acts still, and with a verb of speaking silent.
    The clause ends with a sentence, or at a word after a mark that opens another.
    """
    rows = marked(tokens, marks)
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = (F.col("i") > 0) & (F.col("after_end") | (F.col("after_mark") & F.col("clause").isNotNull()))
    rows = rows.withColumn("_past", F.max(ends.cast("int")).over(w)).where((F.col("_past") == 0) & (F.col("i") < SUBJECT_WORDS))
    named = F.col("capital") & F.col("name").isNotNull()
    acts = F.col("actor").isNotNull() | named
    who = F.struct("i", F.coalesce(_gender("actor"), F.when(named, _gender("name"))).alias("gender"), F.when(named, F.col("key")).alias("name"))
    early = F.col("i") < NEGATED_WORDS
    found = rows.groupBy(*keys).agg(
        F.min_by(who, F.when(acts, F.col("i"))).alias("who"), F.min_by("verb", F.when(F.col("verb").isNotNull(), F.col("i"))).alias("verb"), F.min(F.when(F.col("unnamed").isNotNull(), F.col("i"))).alias("stranger"),
        F.max(F.coalesce(early & F.col("negates").isNotNull(), F.lit(False))).alias("negated"), F.max(F.coalesce(early & F.col("says").isNotNull(), F.lit(False))).alias("speaks"))
    acted = F.when(F.col("stranger").isNull() | (F.col("who.i") < F.col("stranger")), F.col("who"))
    gender = F.when(acted.isNotNull(), F.coalesce(acted["gender"], F.col("verb")))
    weak = F.lit(attribution) & acted.isNull() & F.col("stranger").isNull() & F.col("verb").isNotNull()
    rows = found.select(*keys, F.when(weak, F.col("verb")).otherwise(gender).alias("gender"), acted["name"].alias("name"), F.coalesce(weak, F.lit(False)).alias("weak"), (acted.isNull() & F.col("stranger").isNotNull()).alias("unnamed"), (F.col("negated") & F.col("speaks")).alias("silent"), (F.col("negated") & ~F.col("speaks")).alias("still"))
    return rows.where("gender is not null or name is not null or unnamed")


def vocatives(tokens: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """Q9: (keys, phrase, gender, name, opening): the phrases of each text that only call someone.

    A phrase goes from one mark to the next. It calls someone if it has ADDRESS_WORDS words at most, all of them forms of
    address, persons, names or possessives, and tells a gender or a name. opening: it is the first of its text.
    """
    rows = marked(tokens, marks)
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("phrase", F.sum((F.col("after_mark") & (F.col("i") > 0)).cast("int")).over(w).cast("int"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "phrase").orderBy("i"))).where(F.col("_n") <= ADDRESS_WORDS + 1)
    named = F.col("capital") & F.col("name").isNotNull()
    calls = F.col("address").isNotNull() | F.col("actor").isNotNull() | F.col("own").isNotNull() | named
    first = lambda c, test: F.min_by(c, F.when(test, F.col("i")))
    found = rows.groupBy(*keys, "phrase").agg(
        F.max("_n").alias("_size"), F.min(F.coalesce(calls, F.lit(False))).alias("_only"), first("address", F.col("address").isNotNull()).alias("_address"), first("actor", F.col("actor").isNotNull()).alias("_actor"),
        first("name", named & (F.col("name") != "?")).alias("_told"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(named, F.struct("i", "key")))), lambda x: x["key"]), " ").alias("_name"))
    gender = F.coalesce(_gender("_address"), _gender("_actor"), F.col("_told"))
    rows = found.where(F.col("_only") & (F.col("_size") <= ADDRESS_WORDS)).select(*keys, "phrase", gender.alias("gender"), F.nullif("_name", F.lit("")).alias("name"), (F.col("phrase") == 0).alias("opening"))
    return rows.where("gender is not null or name is not null")


def addressees(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Q9: (keys, gender): whom a text speaks to, if all its vocatives with a gender agree."""
    found = calls.where("gender is not null").groupBy(*keys).agg(F.min("gender").alias("gender"), F.max("gender").alias("_other"))
    return found.where("gender = _other").select(*keys, "gender")


def self_genders(tokens: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """Q8: (keys, gender): what speakers say of themselves: verbs that agree, within AFTER_SELF words of a word for oneself, if all agree."""
    rows = marked(tokens, marks)
    w = Window.partitionBy(*keys).orderBy("i")
    told = F.lit(None).cast("string")
    open_ = F.lit(True)
    for k in range(1, AFTER_SELF + 1):
        open_ = open_ & ~F.coalesce(F.lead("after_mark", k).over(w), F.lit(True))
        told = F.coalesce(told, F.when(open_, F.lead("verb", k).over(w)))
    votes = rows.withColumn("_told", told).where("self is not null and _told is not null")
    found = votes.groupBy(*keys).agg(F.min("_told").alias("gender"), F.max("_told").alias("_other"))
    return found.where("gender = _other").select(*keys, "gender")


def beats(tokens: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """Q5: (keys, gender, name, unnamed, silent, still): who acts at the end of each stretch of narration.

    The last sentence tells, and gives no clue if the one before it shows someone of the other gender who acted too; a
    pronoun takes the name of the one before if their genders agree.
    """
    order = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("_sentence", F.sum((F.col("after_end") & (F.col("i") > 0)).cast("int")).over(order))
    last = rows.groupBy(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys))).agg(F.max("_sentence").alias("_last"))
    rows = rows.join(last, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]).withColumn("back", F.col("_last") - F.col("_sentence")).where("back <= 1")
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy(*keys, "back").orderBy("i")) - 1)).drop("_sentence", "_last", *(f"_k{n}" for n in range(len(keys))))
    who = F.struct("gender", "name", "unnamed", "silent", "still")
    found = subjects(rows, [*keys, "back"], marks, attribution=False).groupBy(*keys).agg(F.max(F.when(F.col("back") == 0, who)).alias("_now"), F.max(F.when(F.col("back") == 1, who)).alias("_before"))
    now, before = F.col("_now"), F.col("_before")
    both = before["gender"] != now["gender"]
    clear = ~F.coalesce(both & ~before["silent"] & ~before["still"], F.lit(False))
    name = F.coalesce(now["name"], F.when(before["gender"] == now["gender"], before["name"]))
    return found.where(now.isNotNull() & clear).select(*keys, now["gender"].alias("gender"), name.alias("name"), now["unnamed"].alias("unnamed"), now["silent"].alias("silent"), now["still"].alias("still"))
