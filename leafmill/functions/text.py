"""Column functions over text: normal forms, keys, scripts, headings and tone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is collapsed, chapter words, tone marks.
SPACES = "[\\t\\n\\r\\u00A0\\u2000-\\u200B ]+"
CHAPTER = "^(?i:(?:глава|chapter|часть|part)\\s+(?:\\d+|[ivxlcdm]+)(?:[. :—–-].*)?|пролог|эпилог|prologue|epilogue)(?:[. :—–-].*)?$"
SHOUT, CAPS, STARTLE = "!\\s*!", "(?<![\\p{L}-])\\p{Lu}{3,}(?![\\p{L}-])", "\\?\\s*!|!\\s*\\?"
HEADING_CHARS, SWITCH_LETTERS = 120, 4


def normalize(text: Column) -> Column:
    """Soft hyphens dropped, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), SPACES, " "))


def fold(text: Column) -> Column:
    """Lower case with ё as е; the length stays."""
    return F.translate(F.lower(text), "ё", "е")


def word_key(word: Column) -> Column:
    """The key of a pronunciation entry: stress marks dropped too."""
    return F.translate(F.lower(word), "ё+", "е")


def letters_key(text: Column) -> Column:
    """C11: what two texts must share to be the same when read aloud."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def name_key(name: Column) -> Column:
    """A name without case, stress and possessive endings."""
    plain = F.translate(F.lower(F.trim(name)), "ё́", "е")
    return F.regexp_replace(plain, "(?<=\\S)['’]s(?=\\s|$)", "")


def letter_counts(text: Column) -> tuple[Column, Column]:
    """Cyrillic and Latin letters."""
    return F.regexp_count(text, F.lit("[\\u0400-\\u04FF]")), F.regexp_count(text, F.lit("[A-Za-z]"))


def language(text: Column, fallback: str) -> Column:
    """The fallback unless the other script has at least four letters and more than twice as many."""
    cyrillic, latin = letter_counts(text)
    other, own, name = (latin, cyrillic, "en") if fallback == "ru" else (cyrillic, latin, "ru")
    return F.when((other >= SWITCH_LETTERS) & (other > 2 * own), name).otherwise(fallback)


def is_heading(line: Column) -> Column:
    """a whole line that names a chapter."""
    return (F.length(line) <= HEADING_CHARS) & F.trim(line).rlike(CHAPTER)


def sentence_tone(sentence: Column) -> Column:
    """Q13, exclaiming half: ANGRY before SURPRISE before EXCLAIM; null without an exclamation mark."""
    angry = sentence.rlike(SHOUT) | sentence.rlike(CAPS)
    return F.when(F.contains(sentence, F.lit("!")), F.when(angry, "ANGRY").when(sentence.rlike(STARTLE), "SURPRISE").otherwise("EXCLAIM"))


def character_error(got: Column, wanted: Column) -> Column:
    """Edit distance of the letters, in hundredths of the wanted ones."""
    a, b = (F.regexp_replace(F.translate(F.lower(x), "ё", "е"), "[^\\p{L}]", "") for x in (got, wanted))
    return F.levenshtein(a, b) * 100 / F.greatest(F.lit(1), F.length(b))


def safe_file_name(title: Column) -> Column:
    """A title as a file name of at most 60 characters."""
    name = F.substring(F.trim(F.regexp_replace(title, '[\\\\/:*?"<>|]', "_")), 1, 60)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Книга"))


def shared_url(text: Column) -> Column:
    """The first address in a shared text, closing punctuation dropped; null without one."""
    return F.nullif(F.rtrim(F.regexp_extract(text, "https?://\\S+", 0), F.lit(".,)]")), F.lit(""))


def xml_escape(text: Column) -> Column:
    """Text for XML, control characters dropped."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a Russian noun after a number."""
    tens, unit = F.abs(n) % 100, F.abs(n) % 10
    return F.when((tens >= 11) & (tens <= 14), many).when(unit == 1, one).when((unit >= 2) & (unit <= 4), few).otherwise(many)
