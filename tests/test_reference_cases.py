"""Literal cases of the folds that SQL cannot state."""

import numpy as np

from leafmill.functions import english
from leafmill.operators import html, reading, segment


def test_numbers():
    assert english.cardinal(0) == "zero" and english.cardinal(21) == "twenty-one"
    assert english.cardinal(1_002_300) == "one million two thousand three hundred"
    assert english.cardinal(-7) == "minus seven"
    assert english.cardinal(5_000 * 10**12) == "five thousand trillion"
    assert [english.year(n) for n in (1984, 1900, 2005, 1905, 2019)] == ["nineteen eighty-four", "nineteen hundred", "two thousand five", "nineteen oh five", "twenty nineteen"]
    assert [english.ordinal(n) for n in (1, 12, 20, 21, 104)] == ["first", "twelfth", "twentieth", "twenty-first", "one hundred fourth"]
    assert [english.roman(x) for x in ("IV", "MCMXCIV", "IIII", "VX", "", "ABC", "MMMCMXCIX")] == [4, 1994, None, None, None, None, 3999]


def test_spoken():
    for text, want in [
        ("Mr. Smith paid $5.50", "Mister Smith paid five dollars and fifty cents"),
        ("12,345 men", "twelve thousand three hundred forty-five men"),
        ("On April 12 at 10:05", "On April twelfth at ten oh five"),
        ("12 April", "the twelfth of April"),
        ("the 1990s", "the nineteen nineties"),
        ("3.14 and 50%", "three point one four and fifty percent"),
        ("at 7:00", "at seven o'clock"),
    ]:
        assert english.spoken(text) == want


def test_paragraphs_and_chapters():
    assert segment.paragraphs("Chapter 1\nOne line\nof text.\nNext one.\n\nhy-\nphen") == ["Chapter 1", "One line of text.", "Next one.", "hyphen"]
    assert segment.chapters("Book", ["intro", "Chapter 1", "a", "Глава 2. Б", "b"]) == [("Book", ["intro"]), ("Chapter 1", ["a"]), ("Глава 2. Б", ["b"])]
    assert segment.parts("Book", ["x" * 10] * 6, 30) == [("Book", ["x" * 10] * 3), ("Часть 2", ["x" * 10] * 3)]
    assert [t for t, _ in segment.chapters("Book", ["y" * 20_000] * 4)] == ["Book", "Часть 2"]


def test_chunks_keep_offsets():
    text = "А. С. Пушкин родился в 1799 г. Он писал. — Правда? • Да, и было это давно, очень давно; " + "слово за словом, " * 40 + "конец."
    found = segment.chunks(text, 80)
    assert all(text[a:b].split() == x.split() and len(x) <= 80 for a, b, x in found)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert found[0][2].startswith("А. С. Пушкин")
    rest = "".join(x for _, _, x in found).replace(" ", "")
    assert rest == "".join(c for c in text if not c.isspace() and c != "•")


def test_page():
    body = "".join(f"<p><b>Paragraph {k}, with some words, and more words to read here.<br>Second line {k}<p>" for k in range(6))
    page = f"<html><head><title>T</title></head><body><nav><a href='/toc'>contents</a></nav><div class=ad>Buy</div><article><h1>Name</h1>{body}<table><tr><th>a<th>b<tr><td>1<td>2</table></article><a class=next href='/c/2'>Next</a><footer>f</footer></body>"
    got = html.page(page, "https://site.example/c/1")
    assert got["status"] == "SUCCESS" and got["title"] == "Name" and got["next_url"] == "https://site.example/c/2"
    texts = [b["text"] for b in got["blocks"]]
    assert texts[0] == "Name" and "Second line 5" in texts and "Buy" not in texts
    assert [b["text"] for b in got["blocks"] if b["kind"] == "TABLE_HEADER"] == ["a\tb"]
    assert html.page("<body><a href=x>link</a> menu", "https://a.b")["status"] == "EMPTY_CONTENT"


def test_dialogue_and_quick_start():
    text = 'He stood. "Come here," she said. "Now!"'
    assert [(text[a:b], s) for a, b, s in reading.quoted_parts(text)] == [("He stood.", False), ("Come here,", True), ("she said.", False), ("Now!", True)]
    assert reading.quoted_parts('The book "War" is long.') is None
    assert [s for *_, s in reading.quoted_parts("Он сказал: «Привет» и ушёл.", "ru")] == [False, True, False]
    assert reading.quick_start("a" * 40 + ", " + "b" * 80) == ["a" * 40 + ",", "b" * 80]
    assert reading.quick_start("short, one") == ["short, one"]


def test_loudness():
    wave = np.sin(np.arange(24_000) * 2 * np.pi * 440 / 24_000) * 0.5
    assert abs(reading.loudness(np.concatenate([wave, np.zeros(24_000)]), 24_000) - 0.5 / 2**0.5) < 0.01
    assert reading.loudness(np.zeros(1000), 24_000) == 0


def test_page_titles_and_next_links():
    from leafmill.operators import html

    def link(body, url):
        return html.next_link(html.parse(body), url)

    here = "https://site.example/book/7/chapter-5"
    assert link("<p>no link</p>", here) == "https://site.example/book/7/chapter-6"
    assert link("<p>no link</p>", "https://site.example/read?page=3&x=1") == "https://site.example/read?page=4&x=1"
    assert link('<a class="next" href="/book/7/chapter-9">2</a>', here) == "https://site.example/book/7/chapter-6"
    assert link('<a rel="next" href="https://m.site.example/book/7/x">go</a>', here) == "https://m.site.example/book/7/x"
    assert link('<a rel="next" href="/book/7/page/2">go</a>', "https://site.example/book/7") == "https://site.example/book/8"
    assert link('<a rel="next" href="/br/?b=2&p=2">Next</a>', "https://site.example/br/?b=1&p=1") is None

    def title(page):
        root = html.parse(page)
        return html.title(root, root.find(lambda n: n.tag == "article")[0])

    text = "<article>text</article>"
    assert title(f"<h1>Site</h1><div class='story'><h1>Story</h1>{text}</div>") == "Story"
    assert title(f"<h1>Site</h1><h1 itemprop='name'>Named</h1>{text}") == "Named"
    assert title(f"<h1>One <span class='category'><a rel='up'>Book</a></span></h1>{text}") == "One | Book"
    crumbs = "".join(f"<span itemprop='name'>{x}</span>" for x in ("Lib", "Book", "Chapter 1"))
    meta = "<meta property='og:title' content='Long line'><meta property='og:site_name' content='lib'>"
    assert title(f"{meta}<div itemtype='https://schema.org/BreadcrumbList'>{crumbs}</div>{text}") == "Chapter 1 | Book"


def test_dialogue_of_whole_turns(spark, tmp_path):
    from leafmill.plans.reading import q1_dialogue_parts

    texts = ["short", "a long turn " * 30 + "ends here", None]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {r.turn: (r.start, r.end) for r in q1_dialogue_parts(spark, str(tmp_path)).where("speech").collect()}
    assert said == {k: (10, 10 + len(t) + 1) for k, t in enumerate(texts[:2])}
