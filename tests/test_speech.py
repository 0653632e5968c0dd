"""Literal cases for dialogue, segments, respelled words and labels."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.functions import words as wd
from leafmill.operators import speech as s

PARTS = [
    ("— Ты вернёшься? — спросила она почти шёпотом.", "ru", [("Ты вернёшься?", True), ("спросила она почти шёпотом.", False)]),
    ("— Конечно, — ответил он, не оборачиваясь. — К утру всё закончится.", "ru", [("Конечно,", True), ("ответил он, не оборачиваясь.", False), ("К утру всё закончится.", True)]),
    ("— Москва — столица.", "ru", [("Москва — столица.", True)]),
    ("Он сказал: «Пойдём домой». Она кивнула.", "ru", [("Он сказал:", False), ("Пойдём домой", True), ("Она кивнула.", False)]),
    ("«Привет», — сказал он.", "ru", [("Привет", True), ("сказал он.", False)]),
    ("Он прочитал «Войну и мир» за неделю.", "ru", None),
    ("“Are you coming back?” she whispered.", "en", [("Are you coming back?", True), ("she whispered.", False)]),
    ("He read “The Hobbit” twice.", "en", None),
    ("Обычный абзац без реплик.", "ru", None),
    ("А-Цин фыркнула: — Оба хороши.", "ru", [("А-Цин фыркнула:", False), ("Оба хороши.", True)]),
    ("Кто виноват? — Никто.", "ru", None),
    ("«Если она здесь без мужа, — соображал Гуров, — то было бы не лишнее.»", "ru", [("Если она здесь без мужа,", True), ("соображал Гуров,", False), ("то было бы не лишнее.", True)]),
    ("«Было это давно, и никто не помнит", "ru", [("Было это давно, и никто не помнит", True)]),
    ('He said: "Stay!" and left.', "en", [("He said:", False), ("Stay!", True), ("and left.", False)]),
]


@pytest.mark.parametrize(("text", "language", "want"), PARTS)
def test_dialogue_parts(text, language, want):
    got = s.dialogue_parts(text, language)
    assert (got and [(text[a:b], said) for a, b, said in got]) == want


def test_quotes_left_open_and_attributed():
    assert s.leaves_quote_open("«Начало «внутри», и дальше «ещё") and not s.leaves_quote_open("«Всё». Он")
    assert s.leaves_quote_open('"One" two "three') and not s.leaves_quote_open("Нет «кавычки")
    text = "— Нет, — Лань Чжань отвернулся"
    line, author = s.dialogue_parts(text, "ru")
    assert s.attributes(text, line, author)
    text = "— Нет. — Повисла тишина"
    line, author = s.dialogue_parts(text, "ru")
    assert not s.attributes(text, line, author)


@pytest.mark.parametrize(("text", "goes_on", "tone"), [("НЕТ!", False, "ANGRY"), ("Стоять!!", False, "ANGRY"), ("Что?!", False, "SURPRISE"), ("Стой!", False, "EXCLAIM"), ("Я… я не знаю", False, "UNSURE"), ("П-простите", False, "UNSURE"), ("Э-э", False, "UNSURE"), ("Кто-то", False, None), ("Ну вот…", False, None), ("Ну вот…", True, "UNSURE")])
def test_sentence_tones(text, goes_on, tone):
    assert s.sentence_tone(text, goes_on) == tone


def test_chapter_segments():
    got = s.chapter_segments("Глава 1", ["Первый абзац. Второе предложение.", "", "— Ты куда? — спросил отец. — Домой!", "ячейка\tдругая"], dialogue=True)
    assert [(r["paragraph"], r["text"], r["pause"], r["role"], r["tone"]) for r in got] == [
        (-1, "Глава 1", "TITLE", "NARRATOR", "NEUTRAL"),
        (0, "Первый абзац.", "SENTENCE", "NARRATOR", "NEUTRAL"),
        (0, "Второе предложение.", "PARAGRAPH", "NARRATOR", "NEUTRAL"),
        (2, "Ты куда?", "TURN", "SPEECH", "NEUTRAL"),
        (2, "спросил отец.", "SENTENCE", "NARRATOR", "NEUTRAL"),
        (2, "Домой!", "PARAGRAPH", "SPEECH", "EXCLAIM"),
        (3, "ячейка", "TURN", "NARRATOR", "NEUTRAL"),
        (3, "другая", "CHAPTER_END", "NARRATOR", "NEUTRAL"),
    ]
    texts = ["Первый абзац. Второе предложение.", "", "— Ты куда? — спросил отец. — Домой!", "ячейка\tдругая"]
    assert all(texts[r["paragraph"]][r["start"] : r["end"]] == r["text"] for r in got if r["paragraph"] >= 0)
    assert s.chapter_segments("Первый абзац", ["Первый абзац!"])[0]["paragraph"] == 0
    assert s.chapter_segments(None, []) == [] and s.chapter_segments("x", [], {0})[0]["pause"] == "CHAPTER_END"
    assert s.chapter_segments(None, ["Заголовок", "Текст."], {0})[0]["pause"] == "TITLE"


def test_words():
    got = s.words("А-Цин сказала: «за́мок», don’t. Он — тут")
    assert [(w, opens) for w, _, _, opens in got] == [("А-Цин", True), ("сказала", False), ("замок", True), ("don’t", False), ("Он", True), ("тут", True)]
    assert got[2][1] == 16 and got[2][2] == ": «"


def test_respelled():
    text, index = s.respelled("Замок и ЗАМОК, ёлка.", {"замок": "з+амок", "елка": "+ёлка"}, "acute")
    assert text == "За́мок и ЗА́МОК, Ё́лка.".replace("Ё́", "ё́")
    assert len(index) == len(text) + 1 and s.original_range(index, text.index("и"), text.index("и") + 1) == (6, 6)
    assert s.respelled("нет слов", {"да": "д+а"}) == ("нет слов", list(range(9)))
    assert s.original_offset("a  b\n c", 0, 7, 2) == 3 and s.original_offset("a  b\n c", 0, 7, 4) == 6
    assert s.placed_words([(100, 0, 1), (50, 2, 3), (7, -1, 2), (9, 3, 9)], 40, (100, 200), 1000, "a  b c", 0, 6, "a b c") == [(20, 3, 4), (120, 0, 1)]


def test_word_target():
    text = "Кто-то пришёл. Мы don't знаем."
    assert s.word_target(text, 3) == ("Кто-то", 0, 6, "Кто-то пришёл.")
    assert s.word_target(text, 20)[:3] == ("don't", 18, 23)
    assert s.word_target(text, 6) == ("Кто-то", 0, 6, "Кто-то пришёл.") and s.word_target("", 0) is None


def test_labels(spark):
    row = spark.range(1).select(
        wd.remaining(F.lit(0.5), F.lit(True)).alias("a"), wd.remaining(F.lit(59.4), F.lit(False)).alias("b"), wd.remaining(F.lit(125.0), F.lit(True)).alias("c"), wd.speed_label(F.lit(1.5)).alias("d"), wd.speed_label(F.lit(2.0)).alias("e"),
        wd.tidy(F.lit("■ one  two")).alias("f"), wd.tidy(F.lit("Chapter ....... 5")).alias("g"), wd.font_family(F.lit("InfoDispBold-Roman")).alias("h"), wd.says_fb2(F.lit("Скачать fb2")).alias("i"), wd.percent_encoded(F.lit("a/ж b")).alias("j"),
    ).first()
    assert tuple(row) == ("меньше минуты", "≈ 59 мин читать", "≈ 2 ч 5 мин слушать", "1.5×", "2×", "• one two", "Chapter … 5", "InfoDisp", True, "a/%D0%B6 b")


def test_character_error_is_an_edit_distance(spark):
    """A19 against the plain recurrence, whole texts."""
    from leafmill.functions import text as tx

    def slow(a, b):
        a, b = ("".join(c for c in x.lower().replace("ё", "е") if c.isalpha()) for x in (a, b))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] * 100 / max(1, len(b))

    pairs = [("Ёлка стоит", "елки стоят"), ("", "abc"), ("abc", ""), ("kitten 12", "sitting"), ("é ü ж", "e u ж"), ("x" * 300, "y" * 200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.character_error(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(r.e == pytest.approx(slow(r.a, r.b)) for r in rows)


@pytest.mark.parametrize(("text", "marked"), [
    ("На холме стоял средневековый замок.", "На холме стоял средневековый з+амок."), ("Он повесил на дверь замок.", "Он повесил на дверь зам+ок."), ("Замок был большой.", "Замок был большой."),
    ("Сколько стоит эта книга?", "Сколько ст+оит эта книга?"), ("Ему не стоит соглашаться.", "Ему не ст+оит соглашаться."), ("Он стоит у окна.", "Он сто+ит у окна."),
    ("Он не стоит на месте.", "Он не сто+ит на месте."), ("Эту книгу стоит посмотреть.", "Эту книгу ст+оит посмотреть."), ("Пшеничная мука лежала в мешке.", "Пшеничная мук+а лежала в мешке."),
    ("Это была страшная мука.", "Это была страшная м+ука."), ("Мука лежала на полке.", "Мука лежала на полке."), ("Дверь замка.", "Дверь замк+а."), ("Стены старинного замка.", "Стены старинного з+амка."),
    ("К старинному зам+ку.", "К старинному зам+ку."),
])
def test_homographs(text, marked):
    from leafmill.functions import russian

    assert russian.homographs(text) == marked


def test_words_in_small_parts(spark, monkeypatch):
    """Many words are not held at once: the texts of a batch are read in parts, and long texts alone."""
    texts = ["one two—three", None, "", "it's " * 40, "a", "last"]
    monkeypatch.setattr(s, "WORDS_OF", 20)
    parts = [list(p) for p in s.tokens.func(iter([pd.Series(texts[:3]), pd.Series(texts[3:]), pd.Series([], dtype=object)]))]
    assert max(len(p) for p in parts) <= 3
    assert [p for part in parts for p in part] == [[dict(zip(("word", "start", "gap", "opens"), w, strict=True)) for w in s.words(t or "")] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r["id"]: r["w"] for r in rows.select("id", s.tokens("text").alias("w")).collect()}
    assert {k: [tuple(w) for w in ws] for k, ws in got.items()} == {k: s.words(t or "") for k, t in enumerate(texts)}


ODD_WORDS = ["it's -a- b--c 'tis rock’n’roll d'", "за́мок по-русски-", "a-́b x́-y ́z", "", None, "1 2", "x" * 20000, "a-" * 20000, "𝔘𝔫i-co𝔡e straße\nnew"]


def test_plain_words_as_in_sql(spark, tmp_path):
    import duckdb

    from leafmill.plans import registry

    rows = [(k, t) for k, t in enumerate(ODD_WORDS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["c13_words"](spark, str(tmp_path))
    assert "Python" not in got._jdf.queryExecution().toString()  # a word costs no Python object
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(registry.oracle_sql()["c13_words"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
