"""Column functions over words, sentences, labels and glyph texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures, bullets, endings of font names, openers of sentences, vowels, labels of book files.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BULLETS = "■●•▪◆◼►▸❑□○◦‣⁃∙·"
FONT_ENDS = "(?i)(?:regular|roman|bold|semibold|demibold|demi|medium|light|black|heavy|book|italic|oblique|condensed|narrow|mt|ps)+$"
LEADERS = "(?:\\s*\\.){4,}\\s*|\\s*…{2,}\\s*|(?:\\s*·){4,}\\s*"
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯaeiouyAEIOUY"
NOT_FB2 = ["epub", "rtf", "pdf", "txt", "doc"]
QUOTED = "«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\""


def clean_glyphs(text: Column) -> Column:
    """Ligatures as letters, odd spaces as spaces, private and control characters dropped."""
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(text, "[\\u00A0\\u2000-\\u200A\\u202F]", " "), "[\\uFFFD\\x00-\\x1F\\uE000-\\uF8FF]", "")


def tidy(text: Column) -> Column:
    """White space collapsed, a leading bullet as «• », dot leaders as « … »."""
    one = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    bullet = F.regexp_replace(one(text), f"^[{BULLETS}]\\s*", "• ")
    return one(F.regexp_replace(bullet, LEADERS, " … "))


def font_family(font: Column) -> Column:
    """A font's name without weight and style."""
    plain = F.regexp_replace(F.substring_index(F.substring_index(font, "-", 1), ",", 1), FONT_ENDS, "")
    return F.coalesce(F.nullif(plain, F.lit("")), font)


def is_odd_case(word: Column) -> Column:
    """Capitals where no spelling has them; camel case and plurals of capitals are spellings."""
    spelled = "^(?:\\p{Ll}*|\\p{Lu}*|\\p{Lu}\\p{Ll}*|\\p{Lu}?\\p{Ll}+(?:\\p{Lu}\\p{Ll}+)+|\\p{Lu}+s)$"
    return (F.length(word) >= 3) & ~word.rlike(spelled)


def plain_words(text: Column) -> Column:
    """C13, words alone: letters, with stress marks, hyphens and apostrophes inside.

    Marks before no letter are blanked out first; then a word is a letter and a run of one class, which takes no recursion.
    """
    marked = F.regexp_replace(text, "[-'’](?!\\p{L})", " ")
    return F.regexp_extract_all(marked, F.lit("(\\p{L}[\\p{L}\\u0301'’-]*+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """C14: sentences, cut after closing marks before white space; those without a letter are none."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?…])(?=\\s)"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s.rlike("\\p{L}"))


def without_quotes(text: Column) -> Column:
    """Quotations inside a line blanked out."""
    return F.regexp_replace(text, QUOTED, " ")


def styled(spoken: Column, style: str) -> Column:
    """A stress mark before a vowel as an accent after it (acute), left out (none), or as it is (plus)."""
    return F.regexp_replace(spoken, f"\\+([{VOWELS}])", {"acute": "$1́", "none": "$1", "plus": "+$1"}[style])


def stressed(word: Column, vowel: Column) -> Column:
    """The stress put before the character at a place."""
    low = F.lower(word)
    return F.concat(F.substr(low, F.lit(1), vowel), F.lit("+"), F.substr(low, vowel + 1))


def vowel_places(word: Column) -> Column:
    """Where the vowels of a word are."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.filter(F.transform(letters, lambda c, i: F.when(F.contains(F.lit(VOWELS), c), i)), lambda i: i.isNotNull())


def snippet(text: Column, start: Column, end: Column, before: int = 48, after: int = 64) -> Column:
    """C20: what stands around a hit, cut at spaces, dots where something is left out: (snippet, from, to)."""
    low = F.greatest(start - before, F.lit(0))
    first = F.instr(F.substr(text, low + 1, start - low), " ")  # the first space between
    a = F.when((low > 0) & (first > 0), low + first).otherwise(low)
    high = F.least(end + after, F.length(text))
    tail = F.substr(text, end + 1, high - end + F.when(high < F.length(text), 1).otherwise(0))
    last = F.length(tail) - F.length(F.substring_index(tail, " ", -1)) - 1  # where the last space is, -1 without
    b = F.when((high < F.length(text)) & (last > 0), end + last).otherwise(high)
    lead, trail = F.when(a > 0, "…").otherwise(""), F.when(b < F.length(text), "…").otherwise("")
    at = F.length(lead) + start - a
    return F.struct(F.concat(lead, F.substr(text, a + 1, b - a), trail).alias("snippet"), at.alias("from"), (at + end - start).alias("to"))


def says_fb2(label: Column) -> Column:
    """a label that names the format, and no other."""
    low = F.lower(label)
    other = F.lit(False)
    for name in NOT_FB2:
        other = other | F.contains(low, F.lit(name))
    return ~other & low.rlike("(?<![a-zа-яё0-9])fb2(?:\\.zip)?(?![a-zа-яё0-9])")


def book_language(text: Column) -> Column:
    """Ru with any Cyrillic letter."""
    return F.when(text.rlike("[\\u0400-\\u04FF]"), "ru").otherwise("en")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def remaining(minutes: Column, listening: Column) -> Column:
    """How long is left."""
    suffix = F.when(listening, "слушать").otherwise("читать")
    hours = F.floor(minutes / 60).cast("int")
    long = F.concat(F.lit("≈ "), hours, F.lit(" ч "), half_up(minutes - hours * 60), F.lit(" мин "), suffix)
    return F.when(minutes < 1, "меньше минуты").when(minutes < 60, F.concat(F.lit("≈ "), half_up(minutes), F.lit(" мин "), suffix)).otherwise(long)


def minutes_left(characters: Column, speed: Column, listening: Column) -> Column:
    """Minutes for so many characters, by ear or by eye."""
    return F.when(listening, characters / (speed * 850)).otherwise(characters / 1100.0)


def speed_label(speed: Column) -> Column:
    """A factor with up to two digits after the point."""
    return F.concat(F.rtrim(F.rtrim(F.format_string("%.2f", speed), F.lit("0")), F.lit(".")), F.lit("×"))


# How long a look at the releases stands, in milliseconds.
FRESH, RETRY = 6 * 3_600_000, 120_000


def check_due(age: Column, failed: Column, forced: Column) -> Column:
    """whether to look for an update of the app again."""
    return forced | age.isNull() | (age < 0) | (age >= F.when(failed, RETRY).otherwise(FRESH))


def voice_check_due(known: Column, installed: Column, age: Column, failed: Column, forced: Column) -> Column:
    """the same for the voices: not without any, and always after a change of version."""
    asks = forced | age.isNull() | ~known.eqNullSafe(installed) | (age >= F.when(failed, RETRY).otherwise(FRESH))
    return installed.isNotNull() & asks


def update_shown(stage: Column, asked: Column, latest: Column, dismissed: Column) -> Column:
    """whether the card of an update is shown."""
    return (
        F.when(stage.isin("AVAILABLE", "INSTALL_FAILED"), asked | (latest != dismissed))
        .when(stage.isin("DOWNLOADING", "PREPARING", "CONFIRMING"), F.lit(True))
        .when(stage.isin("CHECKING", "UP_TO_DATE", "CHECK_FAILED"), asked)
        .otherwise(F.lit(False))
    )


def update_headline(stage: Column, when: Column, size: Column, done: Column, total: Column) -> Column:
    """the card's headline; `when` is the date of the version it speaks of, null where none is known."""
    mb = lambda c: F.floor(c / (1 << 20)).cast("string")
    got = F.concat(mb(done), F.when(total > 0, F.concat(F.lit(" из "), mb(total))).otherwise(""), F.lit(" МБ"))
    fixed = F.create_map(*[F.lit(x) for pair in HEADLINES.items() for x in pair])
    return (
        F.when(stage == "UP_TO_DATE", F.concat(F.lit("У вас самая свежая версия"), F.coalesce(F.concat(F.lit(" — от "), when), F.lit(""))))
        .when(stage == "AVAILABLE", F.concat(F.lit("Вышла новая версия от "), when, F.when(size > 0, F.concat(F.lit(" (≈ "), mb(size), F.lit(" МБ)"))).otherwise("")))
        .when(stage == "DOWNLOADING", F.concat(F.lit("Скачиваем обновление"), F.when((done > 0) | (total > 0), F.concat(F.lit(": "), got)).otherwise("")))
        .otherwise(fixed[stage])
    )


# Headlines that say no more than the stage.
HEADLINES = {
    "CHECKING": "Проверяем, вышла ли новая версия…", "PREPARING": "Проверяем файл и готовим установку…", "CONFIRMING": "Устанавливаем обновление…",
    "CHECK_FAILED": "Не получилось проверить обновления", "INSTALL_FAILED": "Не получилось обновить приложение", "UNKNOWN": "Обновления приложения",
}


def site_label(host: Column) -> Column:
    """A host as it is shown; names in punycode are left as they are."""
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def percent_encoded(text: Column) -> Column:
    """Characters above ASCII as percent escapes of their UTF-8."""
    escape = lambda c: F.when(c.rlike("^[\\x00-\\x7F]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escape), "")


def letters(text: Column) -> Column:
    """C17: only the Russian letters of a text, in lower case with ё as е."""
    return F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^а-я]+", "")


def spoken_sentences(text: Column) -> Column:
    """C17: the sentences of a passage as they are sent to a voice: a leading dash dropped, one inside as a comma."""
    parts = F.split(text, "(?<=[.?!])[\\s\\p{Z}]+")
    trimmed = lambda s: F.regexp_replace(s, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    plain = lambda s: F.regexp_replace(F.regexp_replace(trimmed(s), "^—[\\s\\p{Z}]*", ""), "[\\s\\p{Z}]+—[\\s\\p{Z}]+", ", ")
    return F.filter(F.transform(parts, plain), lambda s: s != "")


def chapter_of(blocks: Column) -> Column:
    """K2: blocks (text, style) as a struct of paragraphs and of styles by their place; a block without a style has none."""
    styled = F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("key"), b["style"].alias("value"))), lambda e: e["value"].isNotNull())
    return F.struct(F.transform(blocks, lambda b: b["text"]).alias("paragraphs"), F.map_from_entries(styled).alias("styles"))
