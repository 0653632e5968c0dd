"""Literal pairs for numbers and texts read aloud."""

import pytest

from leafmill.functions import russian as r

CARDINALS = [(1917, "m", "N", "тысяча девятьсот семнадцать"), (2024, "m", "N", "две тысячи двадцать четыре"), (21, "f", "N", "двадцать одна"), (1_200_000, "m", "N", "миллион двести тысяч"), (2, "m", "G", "двух"), (25, "m", "G", "двадцати пяти"), (300, "m", "I", "тремястами"), (0, "m", "G", "ноль"), (-3, "f", "D", "минус три"), (21, "f", "A", "двадцать одну"), (58_241, "f", "I", "пятьюдесятью восемью тысячами двумястами сорока одной"), (10**12 * 3 + 1, "n", "P", "три триллиона одно"), (16, "m", "P", "шестнадцати")]
ORDINALS = [(1917, "P", "m", "тысяча девятьсот семнадцатом"), (2000, "N", "m", "двухтысячный"), (3, "N", "f", "третья"), (40, "N", "m", "сороковой"), (90, "G", "pl", "девяностых"), (500, "D", "m", "пятисотому"), (1_000_000, "N", "n", "миллионное"), (12_000, "N", "m", "двенадцать тысяч"), (70, "A", "f", "семидесятую"), (113, "G", "m", "сто тринадцатого")]
TEXTS = [
    ("в 1917 году", "в тысяча девятьсот семнадцатом году"), ("в 1917 г. началась", "в тысяча девятьсот семнадцатом году началась"),
    ("05.12.2020", "пятого декабря две тысячи двадцатого года"), ("в 21:30", "в двадцать один тридцать"), ("к 21:30", "к двадцати одному тридцати"),
    ("до 7:05", "до семи ноль пяти"), ("прошло 3 года", "прошло три года"), ("в 90-х годах", "в девяностых годах"), ("для 2-х человек", "для двух человек"),
    ("Глава IV", "Глава четвёртая"), ("в XX веке", "в двадцатом веке"), ("Пётр I", "Пётр первый"), ("при Николае II", "при Николае втором"), ("Глава 1. Начало", "Глава первая. Начало"),
    ("1 книга и 2 минуты", "одна книга и две минуты"), ("2 часа", "два часа"), ("5 км", "пять километров"), ("21%", "двадцать один процент"), ("3,5", "три целых пять десятых"),
    ("т. е. т. д.", "то есть так далее"), ("№5", "номер пять"), ("г. Москва", "город Москва"),
    ("с 2 чашек кофе и 1 книги", "с двух чашек кофе и одной книги"), ("с 5 до 7 часов", "с пяти до семи часов"), ("между 3 домами", "между тремя домами"), ("в 5 домах", "в пяти домах"),
    ("к 25 годам", "к двадцати пяти годам"), ("с 21 другом", "с двадцатью одним другом"), ("около 3 км", "около трёх километров"), ("более 21%", "более двадцати одного процента"),
    ("около 1200 рублей", "около тысячи двухсот рублей"), ("в 5 часов", "в пять часов"), ("по 2 рубля", "по два рубля"),
    ("на 3 этаже", "на третьем этаже"), ("в 5 классе", "в пятом классе"), ("в 21 веке", "в двадцать первом веке"), ("с 5 страницы", "с пятой страницы"), ("ученик 5 класса", "ученик пятого класса"),
    ("в 10 часу", "в десятом часу"), ("на 3 минуту", "на третью минуту"), ("в 2 группу", "во вторую группу"), ("во 2 части", "во второй части"), ("к 2 числу", "ко второму числу"),
    ("на 7 ступени", "на седьмой ступени"), ("в 5 издании", "в пятом издании"), ("на 2 месте", "на втором месте"), ("в 57 школе", "в пятьдесят седьмой школе"),
    ("за 2 партой", "за второй партой"), ("под 3 номером", "под третьим номером"), ("на 2 путь", "на второй путь"), ("на 3 день", "на третий день"),
    ("она родилась 12 апреля", "она родилась двенадцатого апреля"), ("к 12 апреля", "к двенадцатому апреля"), ("с 1 по 5 мая", "с первого по пятое мая"), ("в 90-е годы", "в девяностые годы"),
    ("в 1990-е и 2000-е", "в тысяча девятьсот девяностые и двухтысячные"), ("20-е число", "двадцатое число"), ("в 1941—1945 гг.", "в тысяча девятьсот сорок первом — тысяча девятьсот сорок пятом годах"),
    ("счёт 3:2 в пользу хозяев", "счёт три — два в пользу хозяев"), ("он купил 21 книгу", "он купил двадцать одну книгу"), ("помогли 1 человеку", "помогли одному человеку"), ("в 2 ночи", "в два ночи"),
    ("в 1 ночи", "в час ночи"), ("в 2 домах и 1 квартире", "в двух домах и одной квартире"), ("по 1 рублю", "по одному рублю"), ("в 2 раза", "в два раза"), ("на 3 части", "на три части"),
    ("раз в 2 недели", "раз в две недели"), ("2 класса", "два класса"), ("в 1 доме", "в одном доме"), ("на 1 неделю", "на одну неделю"), ("через 21 минуту", "через двадцать одну минуту"),
    ("о 1 книге", "об одной книге"), ("с 100 рублей", "со ста рублей"), ("в 10 утра", "в десять утра"), ("−5 °C", "минус пять градусов Цельсия"), ("5 руб.", "пять рублей."),
    ("Он улыбнулся 😀[12] и ушёл*.", "Он улыбнулся и ушёл."),
]


@pytest.mark.parametrize(("value", "gender", "case", "words"), CARDINALS)
def test_cardinals(value, gender, case, words):
    assert r.cardinal(value, gender, case) == words


@pytest.mark.parametrize(("value", "case", "kind", "words"), ORDINALS)
def test_ordinals(value, case, kind, words):
    assert r.ordinal(value, case, kind) == words


@pytest.mark.parametrize(("text", "spoken"), TEXTS)
def test_texts(text, spoken):
    assert r.normalize(text) == spoken


def test_without_dashes():
    assert r.normalize("— Ты вернёшься? — спросила она почти шёпотом.", without_dashes=True) == "Ты вернёшься? спросила она почти шёпотом."
    assert r.normalize("— «Привет», — сказал он.", without_dashes=True) == "Привет, сказал он."


def test_roman():
    assert (r.roman("XIV"), r.roman("IIII"), r.roman(""), r.roman("MMMCMXCIX")) == (14, None, None, 3999)
