"""Russian numbers, dates, units and abbreviations as words, in the case that their neighbours ask for.

Cases are letters: N G D A I P. Numerals are made from the nine units' forms and a few endings; which case and gender a
numeral takes is told by ordered tables of rules (preposition, ending of the noun, number) of which the first that fits
holds. `spoken_russian` runs the cascade over texts; every step is linear in a text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms of the units by case, words for the round numbers, and endings.
UNITS = {
    "N": ("один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"),
    "G": ("одного", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти"),
    "D": ("одному", "двум", "трём", "четырём", "пяти", "шести", "семи", "восьми", "девяти"),
    "I": ("одним", "двумя", "тремя", "четырьмя", "пятью", "шестью", "семью", "восемью", "девятью"),
    "P": ("одном", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти"),
}
TEENS = "десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
HUNDRED_ENDS = {"G": "сот", "D": "стам", "I": "стами", "P": "стах"}
#: Scale nouns: value, gender, stem, endings after (one, two to four, more), singular and plural endings by case.
SCALES = [
    (10**12, "m", "триллион", ("", "а", "ов"), dict(G="а", D="у", I="ом", P="е"), dict(G="ов", D="ам", I="ами", P="ах")),
    (10**9, "m", "миллиард", ("", "а", "ов"), dict(G="а", D="у", I="ом", P="е"), dict(G="ов", D="ам", I="ами", P="ах")),
    (10**6, "m", "миллион", ("", "а", "ов"), dict(G="а", D="у", I="ом", P="е"), dict(G="ов", D="ам", I="ами", P="ах")),
    (10**3, "f", "тысяч", ("а", "и", ""), dict(G="и", D="е", I="ей", P="е"), dict(G="", D="ам", I="ами", P="ах")),
]
ORDINAL_STEMS = dict(enumerate("перв втор трет четвёрт пят шест седьм восьм девят".split(), 1)) | {40: "сороков", 90: "девяност", 100: "сот"}
STRESSED = {"втор", "шест", "седьм", "восьм", "сороков"}
ENDINGS = {
    "m": dict(N="ый", G="ого", D="ому", A="ый", I="ым", P="ом"),
    "n": dict(N="ое", G="ого", D="ому", A="ое", I="ым", P="ом"),
    "f": dict(N="ая", G="ой", D="ой", A="ую", I="ой", P="ой"),
    "pl": dict(N="ые", G="ых", D="ым", A="ые", I="ыми", P="ых"),
}
THIRD = {
    "m": dict(N="ий", G="ьего", D="ьему", A="ий", I="ьим", P="ьем"),
    "n": dict(N="ье", G="ьего", D="ьему", A="ье", I="ьим", P="ьем"),
    "f": dict(N="ья", G="ьей", D="ьей", A="ью", I="ьей", P="ьей"),
    "pl": dict(N="ьи", G="ьих", D="ьим", A="ьи", I="ьими", P="ьих"),
}


def counted(n: int, forms: tuple[str, str, str]) -> str:
    """The form of a noun after a number: one, two to four, more."""
    n = abs(n)
    return forms[2] if 11 <= n % 100 <= 14 else forms[{1: 0, 2: 1, 3: 1, 4: 1}.get(n % 10, 2)]


def _oblique(word: str, case: str) -> str:
    """A numeral in a soft sign."""
    return word[:-1] + ("ью" if case == "I" else "и")


def _small(n: int, gender: str, case: str) -> list[str]:
    """The words of a number below a thousand; A is as N here."""
    case, out = "N" if case == "A" else case, []
    hundreds, rest = divmod(n, 100)
    if hundreds:
        out.append(HUNDREDS[hundreds - 1] if case == "N" else "ста" if hundreds == 1 else UNITS[case][hundreds - 1] + HUNDRED_ENDS[case])
    if 10 <= rest <= 19:
        out.append(TEENS[rest - 10] if case == "N" else _oblique(TEENS[rest - 10], case))
        return out
    tens, unit = divmod(rest, 10)
    if tens:
        plain = TENS[tens - 2]
        if case != "N":
            plain = {4: "сорока", 9: "девяноста"}.get(tens) or (_oblique(plain, case) if tens < 4 else UNITS["I" if case == "I" else "G"][tens - 1] + _oblique("десять", case))
        out.append(plain)
    if unit:
        own = {("f", 1): "одна" if case == "N" else "одной", ("f", 2): "две" if case == "N" else None, ("n", 1): "одно" if case == "N" else None}.get((gender, unit))
        out.append(own or UNITS[case][unit - 1])
    return out


def cardinal(value: int, gender: str = "m", case: str = "N") -> str:
    """A cardinal in a gender (m f n) and case; very large ones and those below one are not inflected."""
    if value < 0:
        return "минус " + cardinal(-value, gender)
    if value == 0:
        return "ноль"
    if case not in "NA" and value >= 10**12:
        case = "N"
    words, rest = [], value
    for size, kind, stem, plain, one, many in SCALES:
        count, rest = divmod(rest, size)
        if count:
            if count > 1:  # a thousand is not «one thousand»
                words += [cardinal(count, kind)] if case in "NA" else _small(count, kind, case)
            words.append(stem + (counted(count, plain) if case in "NA" else (one if count == 1 else many)[case]))
    text = " ".join(words + (_small(rest, gender, case) if rest else []))
    return text[:-1] + "у" if case == "A" and text.endswith("одна") else text


def ordinal(value: int, case: str = "N", kind: str = "m") -> str:
    """An ordinal, kind m f n or pl; only its last word is inflected."""
    last = next((p for p in (value % 100 if value % 100 < 20 else value % 10, value % 100, value % 1000) if p), 0)
    if value <= 0:
        return cardinal(value, "m" if kind == "pl" else kind)
    if not last:
        count, stem = next(((value // size, stem) for size, _, stem, *_ in SCALES if value % size == 0 and value // size < 10), (0, ""))
        if not count:
            return cardinal(value, "m" if kind == "pl" else kind)
        stem, before = ("" if count == 1 else UNITS["G"][count - 1]) + stem + "н", 0
    else:
        before = value - last
        if last in ORDINAL_STEMS:
            stem = ORDINAL_STEMS[last]
        elif last < 20:
            stem = TEENS[last - 10][:-1]
        elif last < 100:
            stem = TENS[last // 10 - 2][:-1] if last < 40 else UNITS["G"][last // 10 - 1] + "десят"
        else:
            stem = UNITS["G"][last // 100 - 1] + "сот"
    if stem == "трет":
        end = THIRD[kind][case]
    else:
        end = "ой" if kind == "m" and case in "NA" and stem in STRESSED else ENDINGS[kind][case]
    return (cardinal(before) + " " if before else "") + stem + end


# Prepositions by the case they take, nouns by what a number beside them means.
GENITIVE = set("до от из без для около после у против кроме вместо вокруг возле среди более менее свыше больше меньше ради мимо сверх".split())
DATIVE = set("к ко благодаря согласно вопреки навстречу".split())
PREPOSITIONAL = set("о об обо при".split())
INSTRUMENTAL = set("над под перед между меж".split())
ACCUSATIVE = set("в во на за через про сквозь спустя".split())
FUNCTION_WORDS = set("в во на с со к ко о об у и а но до от из за по под над при для без или же ли не ни то".split())
TIMES_OF_DAY = set("утра дня вечера ночи".split())
HOUR = dict(N="час", A="час", G="часа", D="часу", I="часом", P="часе")
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
MASCULINE_DATIVES = set("человеку другу брату отцу сыну мужу врачу учителю ребёнку ребенку мальчику гостю рублю доллару году дню месяцу часу".split())
MASCULINE_LOCATIVES = set("году часу ряду кругу шагу бою углу".split())
FEMININE_LOCATIVES = set(
    "странице главе строке строчке сцене минуте секунде неделе улице квартире комнате палате парте полке книге картине игре платформе дороге точке клетке камере школе "
    "группе команде роте бригаде колонне задаче статье поправке остановке передаче программе схеме попытке волне высоте отметке половине паре смене букве цифре лиге "
    "ступеньке полосе версте миле фазе зоне песне".split()
)
#: Nouns numbered in order: gender, whether always, and their forms N G D A I P (a dash: none).
NUMBERED = [
    ("m", True, "этаж этажа этажу этаж этажом этаже"), ("m", True, "класс класса классу класс классом классе"), ("m", True, "курс курса курсу курс курсом курсе"),
    ("m", True, "том тома тому том томом томе"), ("m", True, "век века веку век веком веке"), ("m", True, "раздел раздела разделу раздел разделом разделе"),
    ("m", True, "параграф параграфа параграфу параграф параграфом параграфе"), ("m", True, "пункт пункта пункту пункт пунктом пункте"),
    ("m", True, "абзац абзаца абзацу абзац абзацем абзаце"), ("m", True, "эпизод эпизода эпизоду эпизод эпизодом эпизоде"),
    ("m", True, "сезон сезона сезону сезон сезоном сезоне"), ("m", True, "раунд раунда раунду раунд раундом раунде"),
    ("m", True, "тур тура туру тур туром туре"), ("m", True, "акт акта акту акт актом акте"), ("m", True, "этап этапа этапу этап этапом этапе"),
    ("m", True, "уровень уровня уровню уровень уровнем уровне"), ("m", True, "вагон вагона вагону вагон вагоном вагоне"),
    ("m", True, "подъезд подъезда подъезду подъезд подъездом подъезде"), ("m", True, "корпус корпуса корпусу корпус корпусом корпусе"),
    ("m", True, "квартал квартала кварталу квартал кварталом квартале"), ("m", True, "канал канала каналу канал каналом канале"),
    ("m", True, "урок урока уроку урок уроком уроке"), ("m", True, "съезд съезда съезду съезд съездом съезде"), ("m", True, "ряд ряда ряду ряд рядом ряду"),
    ("m", True, "путь пути пути путь путём пути"), ("m", True, "номер номера номеру номер номером номере"),
    ("f", True, "страница страницы странице страницу страницей странице"), ("f", True, "глава главы главе главу главой главе"),
    ("f", True, "серия серии серии серию серией серии"), ("f", True, "строка строки строке строку строкой строке"), ("f", True, "линия линии линии линию линией линии"),
    ("f", True, "палата палаты палате палату палатой палате"), ("f", True, "школа школы школе школу школой школе"),
    ("f", True, "аудитория аудитории аудитории аудиторию аудиторией аудитории"), ("f", True, "часть части части часть частью части"),
    ("f", True, "группа группы группе группу группой группе"),
    ("m", False, "день - дню день днём дне"), ("m", False, "месяц месяца месяцу месяц месяцем месяце"),
    ("f", False, "неделя недели неделе неделю неделей неделе"), ("f", False, "минута минуты минуте минуту минутой минуте"),
    ("f", False, "квартира квартиры квартире квартиру квартирой квартире"), ("f", False, "комната комнаты комнате комнату комнатой комнате"),
    ("n", False, "место места месту место местом месте"),
]
LABELS: dict[str, tuple[str, bool, str]] = {}
for _kind, _always, _forms in NUMBERED:
    for _form in _forms.split():
        LABELS[_form] = (_kind, _always, "".join(c for c, f in zip("NGDAIP", _forms.split(), strict=True) if f == _form))
LABELS.pop("-", None)

#: Cases that a preposition allows, the likeliest first.
ALLOWED = (
    {w: "PA" for w in ("в", "во", "на")} | {"за": "AI"} | {w: "GI" for w in ("с", "со")} | {w: "A" for w in ("через", "про", "сквозь", "спустя")}
    | dict.fromkeys(GENITIVE, "G") | dict.fromkeys(DATIVE, "D") | dict.fromkeys(PREPOSITIONAL, "P") | dict.fromkeys(INSTRUMENTAL, "I")
)


def feminine_in_e(noun: str) -> bool:
    return noun in FEMININE_LOCATIVES or noun.endswith("ице")


def _in_e(noun: str) -> str:
    return "f" if feminine_in_e(noun) else "m"


def _in_i(noun: str) -> str:
    return "m" if noun == "пути" else "n" if noun.endswith(("ении", "ании", "етии", "ятии", "итии", "ытии")) else "f"


_INTO, _BESIDE, _TO, _SECOND = {"в", "во", "на"}, {"за", "под", "над", "перед", "между", "с", "со"}, {"к", "ко"}, {"во"}
#: Ordinals that only the noun's form tells: prepositions, the noun, numbers that do not fit (1: in one, 2: in two to four), case, gender.
ORDINAL_RULES: list[tuple[set[str], str, str, str, str | Callable[[str], str]]] = [
    (_INTO, "|".join(sorted(MASCULINE_LOCATIVES)), "", "P", "m"),
    (_INTO, r"(?!.*ие$).{2,}е", "1", "P", _in_e),
    (_INTO, r"(?!ночи$).{3,}и", "12", "P", _in_i),
    (_INTO, r".{2,}[ую]", "1", "A", "f"),
    (_BESIDE, r".{2,}(?:ом|ём|ем)", "1", "I", "m"),
    (_BESIDE, r".{2,}(?:ой|ью)", "1", "I", "f"),
    (_TO, r".{2,}[ую]", "1", "D", "m"),
    (_TO, r"(?!.*ие$).{2,}е", "1", "D", "f"),
]
#: «во 2 …», where the preposition tells that the author means the second.
SECOND_RULES = [(r".*и", "P", _in_i), (r".*е", "P", _in_e), (r".*[ую]", "A", "f"), (r".*", "A", "m")]


def _fits(n: int) -> str:
    """1 for numbers in one, 2 for those in two to four, else ''; teens are neither."""
    return "" if 11 <= n % 100 <= 19 else {1: "1", 2: "2", 3: "2", 4: "2"}.get(n % 10, "")


def ordinal_reading(n: int, before: str, noun: str) -> str | None:
    """The ordinal, where a cardinal can't agree with the noun."""
    if n <= 0 or not noun:
        return None
    fits, second = _fits(n), before in _SECOND and n == 2
    if noun in LABELS:
        kind, always, cases = LABELS[noun]
        allowed = ALLOWED.get(before, "")
        if fits == "1" and not always:
            return None
        if fits == "2" and "G" in cases and (not allowed or "A" in allowed) and not second:
            return None
        return ordinal(n, next((c for c in allowed if c in cases), cases[0]), kind)
    for words, shape, without, case, kind in ORDINAL_RULES:
        if before in words and not (fits and fits in without) and regex.fullmatch(shape, noun):
            return ordinal(n, case, kind if isinstance(kind, str) else kind(noun))
    if second:
        case, kind = next((c, k) for shape, c, k in SECOND_RULES if regex.fullmatch(shape, noun))
        return ordinal(n, case, kind if isinstance(kind, str) else kind(noun))
    return None


_ANY = None
#: The case of a cardinal: prepositions (None: any), the noun, whether the number has to end in one, case. The first that fits holds.
CASE_RULES: list[tuple[set[str] | None, str, bool, str]] = [
    (_ANY, r".*(?:ами|ями|ьми)", False, "I"),
    (_ANY, r".{2,}(?:ах|ях)", False, "P"),
    (_ANY, r".{2,}(?:ам|ям)", False, "D"),
    (INSTRUMENTAL | {"с", "со"}, r".*(?:ом|ем|ём|ой|ей|ью)", True, "I"),
    (GENITIVE | {"с", "со"}, r".*", False, "G"),
    (DATIVE, r".*", False, "D"),
    (PREPOSITIONAL, r".*", False, "P"),
    (INSTRUMENTAL, r".*", False, "I"),
    (_INTO, r"(?!.*ие$).{2,}е", False, "P"),
    (ACCUSATIVE, r".*[ую]", False, "A"),
    ({"по"}, r".*", True, "D"),
]
#: After no preposition that tells, for numbers in one.
ALONE_RULES = [("|".join(sorted(MASCULINE_DATIVES)), "D"), (r".*[ую]", "A"), ("|".join(sorted(FEMININE_LOCATIVES)) + "|.*ице", "P")]
#: By the noun alone: after one, and after two to four, what can't stand in the nominative is a genitive.
GENITIVE_AFTER = {1: r".*[ыи]", 2: r".*[^аяиыеь]", 3: r".*[^аяиыеь]", 4: r".*[^аяиыеь]"}


def case_of(n: int, before: str, noun: str) -> str:
    """The case that a cardinal takes."""
    in_one = n % 10 == 1 and n % 100 != 11
    for words, shape, one, case in CASE_RULES:
        if (words is None or before in words) and (in_one or not one) and regex.fullmatch(shape, noun):
            return case
    if in_one and before not in ALLOWED:
        for shape, case in ALONE_RULES:
            if regex.fullmatch(shape, noun):
                return case
    if not regex.match("[а-яё]", noun) or 11 <= n % 100 <= 14:
        return "N"
    return "G" if regex.fullmatch(GENITIVE_AFTER.get(n % 10, "(?!)"), noun) else "N"


#: Gender of a numeral by case: what the noun ends in; nominatives by the last digit too.
FEMININE_ENDS = {"G": ("ы", "и"), "D": ("е",), "I": ("ой", "ей", "ью")}


def gender_of(n: int, case: str, noun: str) -> str:
    """The gender of a numeral in one or two."""
    if not noun or 11 <= n % 100 <= 14:
        return "m"
    if case in "NA":
        if n % 10 == 1:
            return "f" if noun.endswith(("а", "я") + (("у", "ю") if case == "A" else ())) else "n" if noun.endswith(("о", "е")) else "m"
        return "f" if n % 10 == 2 and noun.endswith(("ы", "и")) else "m"
    if case == "P":
        return "f" if noun.endswith("и") or feminine_in_e(noun) else "m"
    return "f" if noun.endswith(FEMININE_ENDS[case]) else "m"


# Units with the three forms of their nouns, abbreviations, words after years, centuries and headings, suffixes.
MEASURES = {
    "км": ("m", "километр километра километров"), "м": ("m", "метр метра метров"), "см": ("m", "сантиметр сантиметра сантиметров"),
    "мм": ("m", "миллиметр миллиметра миллиметров"), "кг": ("m", "килограмм килограмма килограммов"), "гр": ("m", "грамм грамма граммов"),
    "л": ("m", "литр литра литров"), "мл": ("m", "миллилитр миллилитра миллилитров"), "ч": ("m", "час часа часов"), "мин": ("f", "минута минуты минут"),
    "сек": ("f", "секунда секунды секунд"), "руб": ("m", "рубль рубля рублей"), "р": ("m", "рубль рубля рублей"), "коп": ("f", "копейка копейки копеек"),
    "тыс": ("f", "тысяча тысячи тысяч"), "млн": ("m", "миллион миллиона миллионов"), "млрд": ("m", "миллиард миллиарда миллиардов"),
    "°": ("m", "градус градуса градусов"), "%": ("m", "процент процента процентов"), "$": ("m", "доллар доллара долларов"),
    "€": ("m", "евро евро евро"), "₽": ("m", "рубль рубля рублей"),
}
ABBREVIATIONS = [
    (r"т\.\s?е\.", "то есть"), (r"т\.\s?д\.", "так далее"), (r"т\.\s?п\.", "тому подобное"), (r"т\.\s?к\.", "так как"), (r"т\.\s?н\.", "так называемый"),
    (r"и\s+др\.", "и другие"), (r"и\s+пр\.", "и прочие"), (r"до\s+н\.\s?э\.", "до нашей эры"), (r"н\.\s?э\.", "нашей эры"), (r"см\.(?=\s)", "смотри"),
    (r"ср\.(?=\s)", "сравни"), (r"стр\.(?=\s)", "страница"), (r"рис\.(?=\s)", "рисунок"), (r"ул\.(?=\s)", "улица"), (r"им\.(?=\s)", "имени"),
    (r"проф\.(?=\s)", "профессор"), (r"акад\.(?=\s)", "академик"), (r"тов\.(?=\s)", "товарищ"), (r"г\.(?=\s+\p{Lu})", "город"),
]
YEAR_WORDS = {"году": "P m году", "года": "G m года", "годом": "I m годом", "годах": "P pl годах", "годов": "G pl годов", "годы": "N pl годы", "гг.": "N pl годы", "год": "N m год"}
SPAN_WORDS = {"годах": "P годах", "годов": "G годов"}
CENTURY_WORDS = {
    "века": "G m века", "веке": "P m веке", "веку": "D m веку", "веком": "I m веком", "веков": "G pl веков", "веками": "I pl веками", "вв.": "N pl века", "в.": "N m век", "век": "N m век",
}
HEADING_WORDS = {"глава": "N", "часть": "N", "книга": "N", "том": "N", "главу": "A", "книгу": "A", "главой": "I", "частью": "I", "томом": "I", "главе": "P", "книге": "P", "томе": "P"}
HEADING_GENITIVES = ["главы", "части", "книги", "тома"]
SUFFIXES = {
    "й": "N m", "ый": "N m", "ий": "N m", "ой": "G f", "я": "N f", "ая": "N f", "е": "N n", "ое": "N n", "ые": "N pl", "го": "G m", "ого": "G m", "его": "G m", "му": "D m",
    "ому": "D m", "ему": "D m", "м": "P m", "х": "G pl", "ых": "G pl", "их": "G pl", "ю": "A f", "ую": "A f", "ыми": "I pl", "ими": "I pl", "ми": "", "ти": "",
}
NAME_ENDS = [(("ом", "ем", "ём"), "I"), (("е",), "P"), (("у", "ю"), "D"), (("а", "я"), "G"), (("",), "N")]
FRACTIONS = {1: ("десятая", "десятых", "десятых"), 2: ("сотая", "сотых", "сотых"), 3: ("тысячная", "тысячных", "тысячных")}
ROMAN = regex.compile("M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")
ROMAN_VALUES = dict(I=1, V=5, X=10, L=50, C=100, D=500, M=1000)


def roman(numeral: str) -> int | None:
    """A canonical Roman numeral's value up to 3999."""
    if not numeral or not ROMAN.fullmatch(numeral):
        return None
    values = [ROMAN_VALUES[c] for c in numeral]
    return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True))


def decimal(number: str) -> str:
    whole, part = regex.split("[,.]", number)
    words = [cardinal(int(whole), "f"), counted(int(whole), ("целая", "целых", "целых")), cardinal(int(part), "f"), counted(int(part), FRACTIONS[min(3, len(part))])]
    return " ".join(words)


_WORD_BEFORE = regex.compile(r"(\p{L}+)[\s ]*$")


def word_before(m: regex.Match) -> str:
    """The word that ends in the 40 characters before a match."""
    found = _WORD_BEFORE.search(m.string[max(0, m.start() - 40) : m.start()])
    return found[1].lower() if found else ""


def _date(m):
    day, month, year = int(m[1]), int(m[2]), int(m[3])
    if not (1 <= day <= 31 and 1 <= month <= 12):
        return m[0]
    return f"{ordinal(day, 'G', 'n')} {MONTHS[month - 1]} {ordinal(year, 'G')} года"


def _day(m):
    first, last = int(m[1]), int(m[3] or 1)
    if not (1 <= first <= 31 and 1 <= last <= 31):
        return m[0]
    before = word_before(m)
    case = "D" if before in DATIVE else "A" if before in ("на", "по", "про", "за", "через") else "G"
    day = ordinal(first, case, "n")
    if not m[3]:
        return day
    return f"{day} по {ordinal(last, 'A', 'n')}" if m[2].strip() == "по" else f"{day} — {ordinal(last, case, 'n')}"


def _years(m):
    case, noun = SPAN_WORDS.get(m[5].lower(), "P годах" if m[1] else "N годы").split()
    return f"{m[1] or ''}{ordinal(int(m[2]), case)} — {ordinal(int(m[3]), case)} {noun}"


def _year(m):
    year, word = int(m[2]), m[4].lower()
    if word in ("год", "года", "годы", "годов") and year < 1000:
        return m[0]  # so many years
    case, kind, noun = (("P m году" if m[1] else "G m года") if word == "г." else YEAR_WORDS[word]).split()
    return f"{m[1] or ''}{ordinal(year, case, kind)} {noun}"


def _heading(m):
    number = int(m[2]) if m[2].isdigit() else roman(m[2])
    if number is None:
        return m[0]
    word = m[1].lower()
    return f"{m[1]} {ordinal(number, HEADING_WORDS.get(word, 'G'), 'm' if word.startswith('том') else 'f')}"


def _century(m):
    number = roman(m[1])
    if number is None:
        return m[0]
    case, kind, noun = CENTURY_WORDS[m[3]].split()
    return f"{ordinal(number, case, kind)} {noun}"


def _reign(m):
    number = roman(m[2])
    if number is None:
        return m[0]
    return f"{m[1]} {ordinal(number, next(case for ends, case in NAME_ENDS if m[1].endswith(ends)))}"


def _suffixed(m):
    number, suffix, after = int(m[1]), m[2].lower(), (m[3] or "").lower()
    neuter = len(after) > 3 and (after.endswith(("о", "е", "ё", "мя")) or after in MONTHS)
    if suffix == "е" and (after.startswith("год") or after == "гг" or (number >= 20 and number % 10 == 0 and not neuter)):
        return ordinal(number, "N", "pl")
    if suffix in ("ти", "ми") or (suffix == "х" and number < 100 and number % 10):
        return cardinal(number, "m", "G")
    return ordinal(number, *SUFFIXES[suffix].split())


def _time(m):
    before = word_before(m)
    case = "D" if before in DATIVE else "G" if before in GENITIVE | {"с", "со"} else "P" if before in PREPOSITIONAL else "N"
    minutes = "ноль ноль" if m[2] == "00" else ("ноль " if m[2][0] == "0" else "") + cardinal(int(m[2]), "m", case)
    return f"{cardinal(int(m[1]), 'm', case)} {minutes}"


def _measure(m):
    unit = m[3].lower()
    gender, forms = MEASURES["°" if unit == "°c" else unit]
    forms = [f + (" Цельсия" if unit == "°c" else "") for f in forms.split()]
    if not m[2].isdigit():
        said = f"{decimal(m[2])} {forms[1]}"
    elif word_before(m) in GENITIVE:
        said = f"{cardinal(int(m[2]), gender, 'G')} {counted(int(m[2]), (forms[1], forms[2], forms[2]))}"
    else:
        said = f"{cardinal(int(m[2]), gender)} {counted(int(m[2]), tuple(forms))}"
    return ("минус " if m[1] else "") + said + ("." if m[4] and m.end() == len(m.string) else "")


def _integer(m):
    n, before, noun = int(m[2]), word_before(m), (m[3] or "").lower()
    noun = "" if noun in FUNCTION_WORDS else noun
    if not m[1]:
        if said := ordinal_reading(n, before, noun):
            return said
        if noun in TIMES_OF_DAY:
            case = next((c for c in ALLOWED.get(before, "") if c != "P"), "N")
            return HOUR[case] if n == 1 else cardinal(n, "m", case)
    case = case_of(n, before, noun)
    return ("минус " if m[1] else "") + cardinal(n, gender_of(n, case, noun), case)


def _rule(pattern: str, say, flags: int = 0):
    return regex.compile(pattern, flags), say


_I = regex.IGNORECASE
#: The cascade; each rule sees what the ones before it left.
CASCADE = [
    _rule(r"№\s*(?=\d)", "номер "),
    _rule(r"(?<=\d) (?=\d{3}(?!\d))", ""),
    _rule(r"(?<![\d.])(\d{1,2})\.(\d{1,2})\.(\d{4})(?![\d.])(\s*г\.)?", _date),
    _rule(rf"(?<![\p{{L}}\d])(\d{{1,2}})(?:(\s*[—–-]\s*|\s+по\s+)(\d{{1,2}}))?(?=[\s ]+(?:{'|'.join(MONTHS)})(?!\p{{L}}))", _day, _I),
    _rule(r"(?<![\p{L}\d])(во?\s+)?(\d{3,4})\s*[—–-]\s*(\d{3,4})(\s*)(годах|годы|годов|гг\.)(?!\p{L})", _years, _I),
    _rule(r"(?<![\p{L}\d])(во?\s+)?(\d{1,4})(\s*)(году|года|годом|годах|годы|годов|год|гг\.|г\.)(?!\p{L})", _year, _I),
    _rule(rf"(?<!\p{{L}})({'|'.join([*HEADING_WORDS, *HEADING_GENITIVES])})\s+([IVXLCDM]+|\d{{1,4}})(?![\p{{L}}\d])", _heading, _I),
    _rule(r"(?<!\p{L})([IVXLC]{1,7})(\s*)(веков|веками|веком|веке|веку|века|век|вв\.|в\.)(?!\p{L})", _century),
    _rule(r"(?<!\p{L})([А-ЯЁ][а-яё]+)\s+([IVX]{1,5})(?![\p{L}\d])", _reign),
    _rule(rf"(?<![\d\p{{L}}])(\d{{1,6}})\s?-\s?({'|'.join(sorted(SUFFIXES, key=lambda s: -len(s)))})(?!\p{{L}})(?=(?:[\s ]+(\p{{L}}+))?)", _suffixed),
    _rule(r"(?<![\d:])([01]?\d|2[0-3]):([0-5]\d)(?![\d:])", _time),
    _rule(r"(?<![\d:])(\d{1,3}):(\d{1,3})(?![\d:])", r"\1 — \2"),
    _rule(r"([$€₽])\s?(\d+)", r"\2 \1"),
    _rule(r"(?<![\d\p{L}])(−?)(\d+(?:[.,]\d+)?)\s?(°c|°|%|\$|€|₽|км|мм|см|мл|кг|млрд|млн|тыс|руб|коп|мин|сек|гр|м|л|ч|р)(\.?)(?!\p{L})", _measure, _I),
    *[_rule(rf"(?<!\p{{L}}){pattern}", words, _I) for pattern, words in ABBREVIATIONS],
    _rule(r"(?<![\d.,])(\d+)[,.](\d{1,3})(?![\d.,]\d)", lambda m: decimal(m[0])),
    _rule(r"(?<![\d\p{L}])(−?)(\d{1,15})(?!\d)(?=(?:[\s ]+(\p{L}+))?)", _integer),
    _rule(r"(?<!\p{L})([вк]) (?=втор)", r"\1о ", _I),
    _rule(r"(?<!\p{L})([с]) (?=втор|ст[ао](?!\p{L}))", r"\1о ", _I),
    _rule(r"(?<!\p{L})([о]) (?=одн|одиннадцат)", r"\1б ", _I),
]
#: G1: what is no text to read: soft hyphens, marks, selectors, characters beyond the basic plane, notes, stars, thin spaces.
CLEANUP = [
    _rule(r"[­​﻿︀-️\U00010000-\U0010FFFF]", ""),
    _rule(r"\[(?:\d{1,3}|\*)\]", ""),
    _rule(r"(?<=[\p{L}.,!?»”])\*+", ""),
    _rule(r"[  ]", " "),
]
#: For an engine without a pause for dashes.
WITHOUT_DASHES = [
    _rule(r"^\s*[—–-]\s*", ""),
    _rule(r"(?<=[.!?…,;:])\s*[—–]\s+", " "),
    _rule(r"\s+[—–]\s+", ", "),
    _rule(r"[«»„“”]", ""),
    _rule(r",\s*,", ","),
]
COLLAPSE = _rule(r"[ \t ]{2,}", " ")


def rewritten(text: str, rules) -> str:
    for pattern, say in rules:
        text = pattern.sub(say, text)
    return text


def normalize(text: str, without_dashes: bool = False) -> str:
    """A Russian text as it is read aloud."""
    rules = [*CLEANUP, *CASCADE, *(WITHOUT_DASHES if without_dashes else []), COLLAPSE]
    return rewritten(text, rules).strip()


# Words with two readings, and beginnings of neighbours that name one.
CASTLE, LOCK = "средневеков старинн рыцарск королевск феодальн воздушн каменн древн", "двер ключ висяч кодов амбарн навесн врезн запереть отпереть открыть закрыть щелк"
COST = "сколько дорого дешево дёшево ничего этого того многого вполне"
WORTH = "отметить сказать попробовать посмотреть подумать помнить заметить упомянуть внимания признать ожидать"
STAND = "на у в во перед за под над между рядом около возле посреди среди молча неподвижно впереди позади прямо здесь там"
TORMENT, FLOUR = "страшн адск невыносим ужасн творческ любовн душевн бесконечн", "пшеничн ржан кукурузн овсян близн просеян мешок пачка килограмм мучн тесто пирог хлеб сорт"
#: Words, and in order: which neighbour (b before, a after), what it begins with, the stressed vowel. The first that fits holds.
HOMOGRAPHS = [
    ("замок замка замку замком замке", [("ba", CASTLE, 0), ("ba", LOCK, 1)]),
    ("стоит стоят", [("b", COST, 0), ("a", WORTH, 0), ("a", STAND, 1), ("b", "не$", 0)]),
    ("мука муки муке муку мукой", [("ba", TORMENT, 0), ("ba", FLOUR, 1)]),
]
READINGS = {word: [(where, regex.compile("|".join(marks.split())), vowel) for where, marks, vowel in rules] for words, rules in HOMOGRAPHS for word in words.split()}
_MARKED_WORD, _VOWEL = regex.compile(r"[\p{L}+]+"), regex.compile("[аяоёуюэеиы]")


def homographs(text: str) -> str:
    """A plus before the stressed vowel of words whose reading (N1) a neighbour names; marked words stay."""
    found = list(_MARKED_WORD.finditer(text))
    around = ["", *(m[0].lower() for m in found), ""]
    out, at = [], 0
    for k, m in enumerate(found):
        near = {"b": around[k], "a": around[k + 2]}
        vowel = next((v for where, marks, v in READINGS.get(around[k + 1], ()) if any(marks.match(near[w]) for w in where)), None)
        if vowel is not None:
            place = m.start() + [v.start() for v in _VOWEL.finditer(around[k + 1])][vowel]
            out += [text[at:place], "+"]
            at = place
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def spoken_russian(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalize(t))


@F.pandas_udf(T.StringType())
def cardinal_words(values: pd.Series, genders: pd.Series, cases: pd.Series) -> pd.Series:
    return pd.Series([cardinal(int(v), g, c) for v, g, c in zip(values, genders, cases, strict=True)])


@F.pandas_udf(T.StringType())
def ordinal_words(values: pd.Series, kinds: pd.Series, cases: pd.Series) -> pd.Series:
    return pd.Series([ordinal(int(v), c, k) for v, k, c in zip(values, kinds, cases, strict=True)])
