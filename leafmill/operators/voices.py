"""Which voice reads a line: routing by language and role, order of voices, settings by engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Engines that know one language, the best voices and the men among those of one engine.
ENGLISH_ONLY, RUSSIAN_ONLY = "KOKORO", "KOKORO_RU"


def speaks(engine: Column, language: Column) -> Column:
    """whether an engine reads a language."""
    return F.when(engine == ENGLISH_ONLY, language == "en").when(engine == RUSSIAN_ONLY, language != "en").otherwise(F.lit(True))


def narrator_for(chosen: Column, narrator: Column, russian: Column, language: Column) -> Column:
    """the voice, a struct with engine, that reads a line: the chosen, the narrator, the Russian one, the narrator."""
    able = lambda v: F.when(speaks(v["engine"], language), v)
    return F.coalesce(able(chosen), able(narrator), able(russian), narrator)


def voice_for(mode: Column, role: Column, single: Column, male: Column, female: Column, narrator: Column) -> Column:
    """F16: a character's voice by the mode; an unknown speaker is the narrator."""
    by_gender = F.when(role == "MALE", male).when(role == "FEMALE", female)
    return F.coalesce(F.when((mode == "SINGLE") & (role != "NARRATOR"), single).when(mode == "BY_GENDER", by_gender), narrator)


def _kept(choice: Column, options: Column, *taken: Column) -> Column:
    free = reduce(lambda x, t: x & ~choice.eqNullSafe(t), taken, F.array_contains(F.transform(options, lambda o: o["choice"]), choice))
    return F.when(choice.isNotNull() & free, choice)


def _picked(options: Column, gender: str | None, *taken: Column) -> Column:
    fits = lambda o: reduce(lambda x, t: x & ~o["choice"].eqNullSafe(t), taken, F.lit(True) if gender is None else o["gender"].eqNullSafe(F.lit(gender)))
    return F.get(F.filter(options, fits), F.lit(0))["choice"]


def distinct_voices(mode: Column, single: Column, male: Column, female: Column, narrator: Column, options: Column) -> Column:
    """F16: (single, male, female): voices that sound apart; one taken or not on offer gives way to the first free one."""
    one = F.coalesce(_kept(single, options, narrator), _picked(options, None, narrator))
    man = F.coalesce(_kept(male, options, narrator), _picked(options, "MALE", narrator))
    woman = F.coalesce(_kept(female, options, narrator, man), _picked(options, "FEMALE", narrator, man))
    return F.struct(
        F.when(mode == "SINGLE", one).otherwise(single).alias("single"),
        F.when(mode == "BY_GENDER", man).otherwise(male).alias("male"),
        F.when(mode == "BY_GENDER", woman).otherwise(female).alias("female"),
    )


def voice_order(voices: DataFrame) -> DataFrame:
    """The recommended first, then men, then by number."""
    return voices.orderBy(*_voice_order())


def voice_places(voices: DataFrame) -> DataFrame:
    """Voices with place, from 1, in the order of their engine."""
    return voices.withColumn("place", F.row_number().over(Window.partitionBy("engine").orderBy(*_voice_order())))


def _voice_order() -> list[Column]:
    return [F.desc("recommended"), F.desc("male"), F.asc("speaker")]


def system_voices(voices: DataFrame) -> DataFrame:
    """Russian and English voices of a system: Russian, offline, installed and good ones first, then by name."""
    return voices.where("language in ('ru', 'en')").orderBy(*_system_order())


def system_places(voices: DataFrame) -> DataFrame:
    """The same voices with place, from 1, in the order of their engine."""
    return voices.where("language in ('ru', 'en')").withColumn("place", F.row_number().over(Window.partitionBy("engine").orderBy(*_system_order())))


def _system_order() -> list[Column]:
    return [F.col("language") != "ru", F.asc("needs_network"), F.asc("not_installed"), F.desc("quality"), F.asc("name")]


def install_kind(complete: Column, fast_bytes: Column) -> Column:
    """the state of an installed model."""
    return F.when(~complete, "ABSENT").when(fast_bytes > 0, "FAST").otherwise("LEGACY")


def speaker_in(checkpoint: Column, speaker: Column) -> Column:
    """a speaker's number in a checkpoint; null where the voice lives in the other one. The third speaker has his own."""
    return F.when(checkpoint == "DIMA", F.when(speaker == 2, 0)).when(speaker.isin(0, 1), speaker)


def missing_files(required: Column, found: Column) -> Column:
    """Required files that an archive did not have."""
    return F.array_except(required, found)


# What an engine's own pace is, how much a voice varies (level, lengths), tones that raise it.
OWN_PACE, CALM, RAISED = 1.05, (0.55, 0.65), (0.75, 0.85)
RAISED_TONES = ["EXCLAIM", "ANGRY", "JOY", "FEAR"]


def voice_params(engine: Column, speed: Column, rate: Column, pitch: Column, emotions: Column, role: Column, tone: Column) -> Column:
    """V8: what an engine is asked for a line: speed, noise (one engine alone) and pitch (system engines alone)."""
    raised = (emotions != "OFF") & (role != "NARRATOR") & tone.isin(RAISED_TONES)
    of = lambda k: F.when(engine == "VOSK", F.when(raised, RAISED[k]).otherwise(CALM[k]))
    pace = speed * rate
    return F.struct(
        F.when(engine == "SUPERTONIC", pace * OWN_PACE).otherwise(pace).alias("speed"),
        of(0).alias("noise"),
        of(1).alias("length_noise"),
        F.when(engine == "SYSTEM", pitch).otherwise(1.0).alias("pitch"),
    )


# The name of each engine in settings, and the last speaker it has.
CODES = {"supertonic": ("SUPERTONIC", 9), "kokoro": ("KOKORO", (1 << 31) - 1), "kokoroRu": ("KOKORO_RU", 2), "vosk": ("VOSK", 56)}


def decoded_choice(code: Column) -> Column:
    """V3: (engine, speaker, package, voice) of a stored choice, speakers clamped; null for what is none."""
    parts = F.split(code, ":", 3)
    number = F.get(parts, F.lit(1)).try_cast("int")
    struct = lambda engine, speaker, package, voice: F.struct(engine.alias("engine"), speaker.cast("int").alias("speaker"), package.alias("package"), voice.alias("voice"))
    none = F.lit("")
    found = F.when((parts[0] == "system") & (F.size(parts) == 3) & (F.trim(F.get(parts, F.lit(1))) != ""), struct(F.lit("SYSTEM"), F.lit(0), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
    for name, (engine, last) in CODES.items():
        found = found.when((parts[0] == name) & number.isNotNull(), struct(F.lit(engine), F.least(F.greatest(number, F.lit(0)), F.lit(last)), none, none))
    return F.when(F.trim(code) != "", found)


def encoded_choice(choice: Column) -> Column:
    """V3: a choice as it is stored."""
    names = F.create_map(*[F.lit(x) for name, (engine, _) in CODES.items() for x in (engine, name)])
    return F.when(choice["engine"] == "SYSTEM", F.concat(F.lit("system:"), choice["package"], F.lit(":"), choice["voice"])).otherwise(F.concat(names[choice["engine"]], F.lit(":"), choice["speaker"]))


# Voices of a list that are shown, speakers of one engine that are women.
OFFERED, WOMEN = 24, 5


def offered(narrators: DataFrame, catalog: DataFrame) -> DataFrame:
    """(narrator, voice, gender, place): the voices that characters may have beside each narrator, OFFERED at most.

    They are of the narrator's engine; of a system's voices those of its package that speak the language and are
    installed. narrators have narrator, engine, package and language; the catalog engine, voice, speaker, description,
    package, language, not_installed, male and ord. What a gender is told by depends on the engine: the number, the
    description, or the catalog.
    """
    of = lambda c: F.when(F.col("engine") == "SYSTEM", F.col(c)).otherwise("").alias(f"_{c}")
    group = ["engine", "_package", "_language"]
    said = F.when(F.contains("description", F.lit("female")), "FEMALE").when(F.contains("description", F.lit("male")), "MALE")
    by_flag = F.when(F.col("male"), "MALE").when(~F.col("male"), "FEMALE")
    gender = F.when(F.col("engine") == "SUPERTONIC", F.when(F.col("speaker") < WOMEN, "FEMALE").otherwise("MALE")).when(F.col("engine") == ENGLISH_ONLY, said).otherwise(by_flag)
    # a list is the same for all narrators of a group, so it is cut before it meets them
    lists = catalog.where((F.col("engine") != "SYSTEM") | ~F.col("not_installed")).select("engine", of("package"), of("language"), "voice", "ord", gender.alias("gender"))
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("ord", "voice"))).where(F.col("place") <= OFFERED)
    return narrators.select("narrator", "engine", of("package"), of("language")).join(lists, group).select("narrator", "voice", "gender", "place")


def engine_default(narrators: DataFrame, catalog: DataFrame) -> DataFrame:
    """(narrator, heard): the voice that a narrator really has: an engine's default of the language where none is named."""
    defaults = catalog.where("engine = 'SYSTEM' and is_default").groupBy("package", "language").agg(F.min_by("voice", "ord").alias("_default"))
    named = F.nullif("voice", F.lit(""))
    met = narrators.join(defaults, ["package", "language"], "left")
    return met.select("narrator", F.coalesce(named, F.when(F.col("engine") == "SYSTEM", F.col("_default")), F.col("voice")).alias("heard"))
