"""English text made ready for reading aloud: numbers, money, dates and times as words (G4, G5), and Roman numerals."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words, months, abbreviations.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
GROUPS = ["", "thousand", "million", "billion", "trillion"]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "January February March April May June July August September October November December".split()
CURRENCIES = {"$": ("dollar", "dollars"), "£": ("pound", "pounds"), "€": ("euro", "euro")}
SHORT = {
    r"\bMr\.": "Mister",
    r"\bMrs\.": "Missus",
    r"\bMs\.": "Miz",
    r"\bDr\.(?=\s+\p{Lu})": "Doctor",
    r"\bSt\.(?=\s+\p{Lu})": "Saint",
    r"\bProf\.": "Professor",
    r"\bvs\.": "versus",
    r"\betc\.": "et cetera",
    r"\be\.g\.": "for example",
    r"\bi\.e\.": "that is",
    r"\bNo\.(?=\s*\d)": "number",
}
ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]


def _below_thousand(n: int) -> list[str]:
    hundreds, rest = divmod(n, 100)
    words = [f"{ONES[hundreds]} hundred"] if hundreds else []
    if rest >= 20:
        ten, one = divmod(rest, 10)
        words.append(TENS[ten - 2] + (f"-{ONES[one]}" if one else ""))
    elif rest:
        words.append(ONES[rest])
    return words


def cardinal(n: int) -> str:
    if n < 0:
        return f"minus {cardinal(-n)}"
    if n >= 1000 ** len(GROUPS):  # the largest group word counts all above it
        top, n = divmod(n, 1000 ** (len(GROUPS) - 1))
        return f"{cardinal(top)} {GROUPS[-1]}" + (f" {cardinal(n)}" if n else "")
    words: list[str] = []
    digits = f"{n:,}".split(",")
    for group, name in zip(digits, reversed(GROUPS[: len(digits)]), strict=True):
        if int(group):
            words += [*_below_thousand(int(group)), *([name] if name else [])]
    return " ".join(words) or ONES[0]


def year(n: int) -> str:
    century, rest = divmod(n, 100)
    if 2000 <= n <= 2009:
        return cardinal(n)
    if rest == 0:
        return f"{cardinal(century)} hundred"
    return f"{cardinal(century)} {'oh ' if rest < 10 else ''}{cardinal(rest)}"


def ordinal(n: int) -> str:
    head, last = regex.fullmatch(r"(.*?)([a-z]+)", cardinal(n)).groups()
    return head + ORDINALS.get(last, last[:-1] + "ieth" if last.endswith("y") else last + "th")


def plural(words: str) -> str:
    if words.endswith("y"):
        return words[:-1] + "ies"
    return words + ("es" if words.endswith(("x", "s")) else "s")


def roman(text: str) -> int | None:
    """The value of a canonical Roman numeral up to 3999, else None."""
    left, total = text, 0
    for sign, value in ROMAN:
        while left.startswith(sign):
            left, total = left[len(sign) :], total + value
    spelled, rest = "", total
    for sign, value in ROMAN:
        spelled += sign * (rest // value)
        rest %= value
    return total if 0 < total <= 3999 and spelled == text else None


def _money(m) -> str:
    sign, whole, cents = m["sign"], int(m["whole"]), int((m["cents"] or "0").ljust(2, "0"))
    spoken = f"{cardinal(whole)} {CURRENCIES[sign][whole != 1]}"
    return spoken + (f" and {cardinal(cents)} cent{'s' * (cents != 1)}" if cents else "")


def _clock(m) -> str:
    hour, minute = cardinal(int(m[1])), int(m[2])
    return f"{hour} o'clock" if not minute else f"{hour} {'oh ' if minute < 10 else ''}{cardinal(minute)}"


def _whole(m) -> str:
    digits, n = m[1], int(m[1])
    as_year = 1100 <= n <= 1999 or (len(digits) == 4 and 1100 <= n <= 2099 and n % 1000 >= 10)
    words = year(n) if as_year else cardinal(n)
    return plural(words) if m[2] else words


def _day(form):
    return lambda m: form(m["month"], ordinal(int(m["day"]))) if 1 <= int(m["day"]) <= 31 else m[0]


_MONTH = f"(?P<month>{'|'.join(MONTHS)})"
_DAY = r"(?P<day>\d{1,2})(?:st|nd|rd|th)?"
#: In this order; a later rule sees what the earlier ones made.
RULES = [(regex.compile(p), r) for p, r in SHORT.items()] + [
    (regex.compile(p), r)
    for p, r in [
        (r"(?<=\d),(?=\d{3}(?!\d))", ""),
        (r"(?P<sign>[$£€])\s?(?P<whole>\d+)(?:\.(?P<cents>\d{1,2}))?", _money),
        (r"(\d+(?:\.\d+)?)\s?%", r"\1 percent"),
        (rf"\b{_MONTH}\s+{_DAY}\b", _day(lambda month, day: f"{month} {day}")),
        (rf"\b(?:the\s+)?{_DAY}\s+(?:of\s+)?{_MONTH}\b", _day(lambda month, day: f"the {day} of {month}")),
        (r"\b(\d{1,6})(?:st|nd|rd|th)\b", lambda m: ordinal(int(m[1]))),
        (r"(?<![\d:])([01]?\d|2[0-3]):([0-5]\d)(?![\d:])", _clock),
        (r"(?<![\d.])(\d+)\.(\d+)(?![\d.])", lambda m: f"{cardinal(int(m[1]))} point {' '.join(ONES[int(d)] for d in m[2])}"),
        (r"(?<![\d\p{L}])(\d{1,15})(?!\d)(s\b)?", _whole),
    ]
]


def spoken(text: str) -> str:
    for pattern, by in RULES:
        text = pattern.sub(by, text)
    return text


@F.pandas_udf(T.StringType())
def spoken_english(texts: pd.Series) -> pd.Series:
    return texts.map(spoken, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def roman_value(texts: pd.Series) -> pd.Series:
    return texts.map(roman, na_action="ignore").astype("Int32")
