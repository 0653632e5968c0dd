"""Speakers, casts, cues and endings: plain forms, literal cases, streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import cast, clues, cues, scan, speakers

ZERO = dict.fromkeys(speakers.CUES, 0)


def row(**cues_):
    return {**ZERO, **cues_}


def plain_roles(rows):
    """The rule as a loop over one scene."""
    last = other = brought = 0
    line = {"addressed": 0, "asked": 0, "long": 0}
    left = {"beat": 0, "silent": 0, "still": 0}
    out = []
    for r in rows:
        if r["kind"] == speakers.BREAK:
            last = other = brought = 0
            line, left = dict.fromkeys(line, 0), dict.fromkeys(left, 0)
            out.append("NARRATOR")
            continue
        if r["kind"] == speakers.NARRATION:
            brought = 0
            out.append("NARRATOR")
        else:
            addressed = line["addressed"] if line["addressed"] != left["still"] else 0
            story = not line["asked"] and (r["story"] or (r["long"] and line["long"]))
            again = None
            if r["told"] in (1, 2):
                who, again = r["told"], None
            elif r["told"] == 3 and last:
                who, again = last, True
            elif left["beat"]:
                who, again = left["beat"], None
            elif (last in (1, 2) and left["silent"] and left["silent"] != last) or (story and last):
                who, again = last, True
            else:
                who, again = addressed or brought or other or 3, False
            if again is None:  # a gender is told: the other one's if they have it, else the last one's
                again = who != other and who == last
            if not again and last in (1, 2):
                other = last
            last = who
            brought = left["beat"] if left["beat"] and who in (1, 2) and left["beat"] != who else 0
            out.append(speakers.ROLES[who])
            line = {c: r[c] for c in line}
        left = {c: r[c] for c in left}
    return out


def made(seed, n):
    rnd = random.Random(seed)
    return [row(kind=rnd.choice([0] * 8 + [1, 1, 2]), told=rnd.choice([0, 0, 0, 1, 2, 3]), story=rnd.choice([0, 0, 1]), long=rnd.randint(0, 1), addressed=rnd.choice([0, 0, 1, 2]), asked=rnd.randint(0, 1), beat=rnd.choice([0, 0, 1, 2]), silent=rnd.choice([0, 0, 1, 2]), still=rnd.choice([0, 0, 1, 2])) for _ in range(n)]


SCHEMA = "scene long, n long, " + ", ".join(f"{c} int" for c in speakers.CUES)


def frame(spark, scenes):
    return spark.createDataFrame([(s, n, *(r[c] for c in speakers.CUES)) for s, rows in scenes.items() for n, r in rows], SCHEMA)


@pytest.mark.parametrize("fan, block", [(3, 5), (scan.FAN, speakers.BLOCK)])
def test_roles_against_a_loop(spark, fan, block):
    scenes = {1: made(1, 200), 2: made(2, 7), 3: [], None: made(3, 40)}
    df = frame(spark, {s: [(2 * n if s == 2 else n, r) for n, r in enumerate(rows)] for s, rows in scenes.items()}).repartition(4)
    got = {(r["scene"], r["n"]): r["role"] for r in speakers.roles(df, ["scene"], "n", fan=fan, block=block).collect()}
    want = {(s, 2 * n if s == 2 else n): role for s, rows in scenes.items() for n, role in enumerate(plain_roles(rows))}
    assert got == want and set(got.values()) == {"FEMALE", "MALE", "SPEECH", "NARRATOR"}


def test_conversation(spark):
    """He asks her, she answers, they go on in turns; she is silent, so he speaks, even if he did before; a break ends it."""
    rows = [row(told=2, addressed=1), row(), row(), row(), row(kind=1, silent=1), row(), row(kind=2), row(), row(told=1), row(told=3)]
    got = speakers.roles(frame(spark, {1: list(enumerate(rows))}), ["scene"], "n").orderBy("n").collect()
    assert [r["role"] for r in got] == ["MALE", "FEMALE", "MALE", "FEMALE", "NARRATOR", "MALE", "NARRATOR", "SPEECH", "FEMALE", "FEMALE"]
    rows[3] = row(told=2)
    got = speakers.roles(frame(spark, {1: list(enumerate(rows))}), ["scene"], "n").orderBy("n").collect()
    assert got[5]["role"] == "MALE"


def test_null_cues_and_empty(spark):
    df = spark.createDataFrame([(1, 0, *[None] * len(speakers.CUES)), (1, None, *[0] * len(speakers.CUES))], SCHEMA)
    assert [tuple(r) for r in speakers.roles(df, ["scene"], "n").collect()] == [(1, 0, "SPEECH")]
    assert speakers.roles(df.limit(0), ["scene"], "n").count() == 0


def test_stream_is_batch(spark, tmp_path):
    """T4: the same roles, whatever batches rows come in; late and repeated turns too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    scenes = {s: list(enumerate(made(s, 30))) for s in (1, 2)}
    rows = [(s, n, *(r[c] for c in speakers.CUES)) for s, rows in scenes.items() for n, r in rows]
    random.Random(0).shuffle(rows)
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20] + rows[max(0, k - 3) : k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = speakers.roles_of_stream(source, "scene", "n").writeStream.outputMode("append").format("memory").queryName("roles").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert running.awaitTermination(90)
    finally:
        running.stop()
    got = sorted(map(tuple, spark.sql("select scene, n, role from roles").collect()))
    want = sorted(map(tuple, speakers.roles(frame(spark, scenes), ["scene"], "n").select("scene", "n", "role").collect()))
    assert got == want and len(got) == 60


def test_scan_is_a_fold(spark):
    """Maps that don't commute, sequences longer than three levels of blocks, gaps and ties."""
    maps = {0: [1, 2, 3, 4, 0], 1: [0, 0, 2, 4, 4], 2: [4, 3, 2, 1, 0], 3: [3, 3, 3, 3, 3]}
    table = spark.createDataFrame(list(maps.items()), "m int, map array<int>")
    rnd = random.Random(4)
    rows = [(k, n * (1 if k else 7), rnd.choice([0, 0, 1, 2, 2, 3][: 5 + (n % 9 == 0)]), n) for k in (0, 1) for n in range(150)]
    df = spark.createDataFrame([*rows, (0, None, 1, 0), (1, 5, 9, 0)], "k int, n long, m int, tag int")
    got = {(r["k"], r["tag"]): r["state"] for r in scan.states(df, ["k"], "n", table, "m", 5, start=2, fan=4).collect()}
    want = {}
    for k in (0, 1):
        s = 2
        for key, _, m, tag in rows:
            if key == k:
                want[k, tag] = s
                s = maps[m][s]
    assert got == want


def test_continues_story(spark):
    texts = ["А потом мы ушли", "И ещё вот что", "Итак!", "Потом", "And then? Well", "Andthen", None, "", "Во—вторых, нет"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(speakers.continues_story(F.col("t"))).collect()]
    assert got == [True, True, True, False, True, False, None, False, True]


TEXTS = [
    (1, "Вчера Маша улыбнулась. Потом Маша тихо сказала ему про Ивана. А Иван молчал."),
    (2, "— Нет, — кивнула Цзян Яньли и ушла. Госпожа Юй вышла. Лёва пришёл домой. Он устал."),
    (3, "Здесь Маше дали письмо, и маша его взяла. Там Маши не было; купец Лёва ждал."),
    (4, None),
]
VERBS = [("улыбнулась", "FEMALE"), ("сказала", "FEMALE"), ("молчал", "MALE"), ("кивнула", "FEMALE"), ("вышла", "FEMALE"), ("взяла", "FEMALE"), ("ушла", "FEMALE")]


def found_names(spark):
    tokens = cues.token_rows(spark.createDataFrame(TEXTS, "doc int, text string"), "doc")
    pairs = lambda rows: spark.createDataFrame(rows, "key string, gender string")
    never = spark.createDataFrame([(k,) for k in "он она вчера потом а вот здесь там нет".split()], "key string")
    words = cast.lexicon(cast.written(tokens, never), pairs(VERBS), pairs([("госпожа", "FEMALE"), ("купец", "MALE")]), pairs([("он", "MALE"), ("она", "FEMALE")]))
    return cast.names(tokens, ["doc"], words)


def test_names_and_votes(spark):
    rows = {(r["doc"], r["shown"], r["i"]): (r["gender"], r["weight"]) for r in found_names(spark).collect()}
    assert rows[1, "Маша", 1] == ("FEMALE", 2)  # a verb after it
    assert rows[2, "Цзян Яньли", 2] == ("FEMALE", 2)  # a verb before it
    assert rows[2, "Юй", 7] == ("FEMALE", 2)  # a word for a person before it
    assert rows[2, "Лёва", 9] == ("MALE", 1)  # a pronoun begins the next sentence
    assert rows[1, "Ивана", 9] == (None, None)
    told = {r["key"]: r["gender"] for r in cast.votes(found_names(spark)).collect()}
    assert told["маша"] == told["цзян яньли"] == told["яньли"] == "FEMALE" and told["лева"] == told["иван"] == "MALE"


def test_members_and_genders(spark):
    found = found_names(spark)
    counts, told = cast.mentions(found, ["doc"]), cast.votes(found)
    chosen = spark.createDataFrame([("юй", "MALE")], "key string, gender string")
    rows = {r["name"]: (r["gender"], r["n"], r["chosen"]) for r in cast.members(counts, told, chosen, 2).collect()}
    assert rows["Маша"] == ("FEMALE", 4, False)  # «Маше» and «Маши» are Маша
    assert rows["Юй"] == ("MALE", 1, True) and rows["Лёва"][0] == "MALE"
    forms = spark.createDataFrame([("галя", "FEMALE"), ("сергеевна", "FEMALE")], "key string, gender string")
    asked = spark.createDataFrame([("маше",), ("цзян",), ("галю",), ("марина сергеевна",), ("никто",)], "key string")
    got = {r["key"]: r["gender"] for r in cast.genders(asked, counts, told, forms).collect()}
    assert got == {"маше": "FEMALE", "цзян": "FEMALE", "галю": "FEMALE", "марина сергеевна": "FEMALE"}


def test_genders_look_a_form_up_once(spark):
    """Each rank of the order; the forms of names meet the told ones in one join, not one for each thing that they may tell."""
    pairs = lambda rows: spark.createDataFrame(rows, "key string, gender string")
    counts = spark.createDataFrame([("анна", 9), ("анне", 2), ("ивана", 1), ("иван", 1), ("пётр юрьев", 3), ("лев толстой", 1)], "key string, n long")
    told = pairs([("анна", "FEMALE"), ("анне", "MALE"), ("ивана", "FEMALE"), ("иван", "MALE"), ("юрьев", "MALE"), ("пётр", "FEMALE"), ("ольга", "FEMALE"), ("нина", None)])
    by_form = pairs([("галя", "FEMALE"), ("сергеевна", "FEMALE"), ("иван", "FEMALE"), ("нина", "FEMALE"), ("а баба", "MALE")])
    names = ["анне", "ивана", "пётр юрьев", "ольге", "вера сергеевна", "вера сергеевне", "галю", "нина", "никто", "он", "а б", "а бабе"]
    rows = cast.genders(spark.createDataFrame([(k,) for k in names], "key string"), counts, told, by_form)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    want = {"анне": "FEMALE", "ивана": "FEMALE", "пётр юрьев": "MALE", "ольге": "FEMALE", "вера сергеевна": "FEMALE", "вера сергеевне": "FEMALE", "галю": "FEMALE", "нина": "FEMALE"}
    assert {r["key"]: r["gender"] for r in rows.collect()} == want


def test_pieces_tell_what_token_rows_tell(spark, monkeypatch):
    """Random texts in many pieces: names, votes and tallies are those of the windows over all words; no word is a row of a window."""
    rnd = random.Random(8)
    words = "Маша маша Ивана Лёва лёва Он он Она она госпожа Купец пошла Пошёл сказала Нет нет Цзян Яньли d'Art О’Нил ǅин из-за Ёж x² Ⅷв 𝟘б 𐒰а 𐓘а Σας".split()
    gaps = [" ", " ", " ", " ", ", ", ". ", "! — ", " «", "-", "--", "’ ", "\n", "… ", " 7 ", "½", "(", ": "]
    texts = [(k % 90 if k else None, "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 5, 60])))) for k in range(120)] + [(500, None), (501, ""), (502, "… 12 "), (503, "— Маша")]
    docs = spark.createDataFrame([(k, f"{n}", t) for n, (k, t) in enumerate(texts)], "doc int, part string, text string").repartition(3)
    never, persons, pronouns, endings = {"нет", "он", "она"}, {"госпожа": "FEMALE", "купец": "MALE"}, {"он": "MALE", "она": "FEMALE"}, {"ла": (4, "FEMALE"), "зала": (9, "MALE"), "шел": (4, "MALE")}
    tokens = cues.token_rows(docs, "doc", "part")
    pairs = lambda d: spark.createDataFrame(list(d.items()), "key string, gender string")
    told = spark.createDataFrame([(e, n, g) for e, (n, g) in endings.items()], "ending string, least int, value string")
    verbs = cues.by_suffix(tokens.select("key"), told, [2, 3, 4]).withColumnRenamed("value", "gender")
    lexicon = cast.lexicon(cast.written(tokens, spark.createDataFrame([(k,) for k in never], "key string")), verbs, pairs(persons), pairs(pronouns))
    names = cast.names(tokens, ["doc", "part"], lexicon)
    monkeypatch.setattr(cast, "PIECE", 300)
    tells = cast.Tells(frozenset(never), persons, pronouns, endings)
    parts = cast.pieces(docs, ["doc", "part"], tells).localCheckpoint()
    assert parts.count() > 10
    got = cast.names_of(parts, ["doc", "part"], tells)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = rows(names)
    assert len(want) > 200 and {w for *_, w in want} == {None, 1, 2} and max(r[5] for r in want) == 4
    assert rows(got) == want
    assert rows(cast.tallies_of(parts, ["doc", "part"], tells).select("key", "size", "n", "shown", "voted", "female", "male")) == rows(cast.tallies(names, ["doc", "part"]))
    assert cast.names_of(cast.pieces(docs.where("doc > 499 and text is null"), ["doc", "part"], tells).localCheckpoint(), ["doc", "part"], tells).count() == 0


def test_longest_suffix_wins(spark):
    endings = spark.createDataFrame([("ла", 3, "F"), ("л", 3, "M"), ("лась", 6, "F"), ("лся", 5, "M"), ("а", 9, "never")], "ending string, least int, value string")
    words = spark.createDataFrame([(w,) for w in "сказала сказал улыбнулась улыбнулся стола лась ла дом сказала".split()], "key string")
    none = spark.createDataFrame([("стола",)], "key string")
    got = {r["key"]: r["value"] for r in cues.by_suffix(words, endings, [1, 2, 3, 4], none).collect()}
    assert got == {"сказала": "F", "сказал": "M", "улыбнулась": "F", "улыбнулся": "M"}


MANNER = ["крикн*", "крик", "тихо", "тих*", "прошепта*", "сквозь"]


def manner(spark, texts):
    patterns = spark.createDataFrame([(p, k) for k, p in enumerate(MANNER)], "pattern string, ord int")
    tokens = cues.token_rows(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "n")
    some = lambda words, pair: spark.createDataFrame([(w, pair) for w in words], "key string, pair int")
    own = cues.walk(tokens, cues.trie(patterns, 12), 12).withColumnRenamed("ord", "cue")
    words = cues.lexicon(own, some(["сквозь"], 100), some(["зубы", "зубов"], 100), some(["не", "без"], 0), some(["и", "а"], 0))
    return {r["n"]: (r["i"], r["cue"]) for r in cues.first_cues(tokens, ["n"], words).collect()}


def test_manner_cues(spark):
    texts = ["крикнула она", "тихо сказал он", "не очень тихо", "не сказал, тихо ушёл", "сказал, и крикнула", "сказал сквозь стиснутые зубы", "не сквозь зубы", "прошептав тише", "крик", "крикливо", "", None, "сквозь туман шёл он, зубы"]
    got = manner(spark, texts)
    assert got == {0: (0, 0), 1: (0, 2), 3: (2, 2), 5: (1, 100), 7: (0, 4), 8: (0, 1), 12: (0, 5)}


def test_trie_walk_is_plain_matching(spark):
    rnd = random.Random(3)
    word = lambda a, b: "".join(rnd.choice("ab") for _ in range(rnd.randint(a, b)))
    patterns = {word(1, 5) + rnd.choice(["", "*"]): k for k in range(25)}
    words = {word(1, 8) for _ in range(120)}
    df = spark.createDataFrame(list(patterns.items()), "pattern string, ord int")
    got = {r["key"]: r["ord"] for r in cues.walk(spark.createDataFrame([(w,) for w in words], "key string"), cues.trie(df, 5), 5).collect()}
    want = {}
    for w in words:
        stems = [k for p, k in patterns.items() if p.endswith("*") and w.startswith(p[:-1])]
        if w in patterns or stems:
            want[w] = patterns[w] if w in patterns else min(stems)
    assert got == want


MARKED = [
    *((k, "actor", "FEMALE") for k in ("она", "мама", "сестра")), *((k, "actor", "MALE") for k in ("он", "брат")), ("маша", "name", "FEMALE"), ("громов", "name", "?"),
    ("сказала", "verb", "FEMALE"), ("ответил", "verb", "MALE"), ("пришла", "verb", "FEMALE"), ("ответил", "says", "1"), ("ответила", "says", "1"), ("не", "negates", "1"), ("кто-то", "unnamed", "1"),
    ("милая", "address", "FEMALE"), ("моя", "own", "1"), ("и", "clause", "1"), ("который", "clause", "1"), ("я", "self", "1"),
]


def told(spark, texts, f, *more):
    tokens = cues.token_rows(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "n")
    return f(tokens, ["n"], spark.createDataFrame(MARKED, "key string, mark string, value string"), *more).collect()


def test_subjects(spark):
    texts = ["сказала она тихо", "ответил Громов", "крикнул кто-то, и она ушла", "Она не ответила", "Маша не встала", "ушёл, и она вздохнула", "сказала", "", None, "дом", "Громов молчал. Она ушла"]
    got = {r["n"]: tuple(r)[1:] for r in told(spark, texts, clues.subjects, True)}
    assert got == {
        0: ("FEMALE", None, False, False, False, False), 1: ("MALE", "громов", False, False, False, False), 2: (None, None, False, True, False, False),
        3: ("FEMALE", None, False, False, True, False), 4: ("FEMALE", "маша", False, False, False, True), 6: ("FEMALE", None, True, False, False, False), 10: (None, "громов", False, False, False, False)}
    assert 6 not in {r["n"] for r in told(spark, texts, clues.subjects, False)}


def test_vocatives(spark):
    texts = ["Мама, иди сюда", "Иди сюда, моя милая Маша!", "Маша ушла, брат", "Громов! Где сестра моя и брат мой", "нет", "Мама, брат, тише", None]
    rows = told(spark, texts, clues.vocatives)
    got = sorted((r["n"], r["gender"], r["name"], r["opening"]) for r in rows if r["name"] or r["gender"])
    assert got == [(0, "FEMALE", None, True), (1, "FEMALE", "маша", False), (2, "MALE", None, False), (3, None, "громов", True), (5, "FEMALE", None, True), (5, "MALE", None, False)]
    calls = spark.createDataFrame(rows)
    assert {tuple(r) for r in clues.addressees(calls, ["n"]).collect()} == {(0, "FEMALE"), (1, "FEMALE"), (2, "MALE")}


def test_self_genders(spark):
    texts = ["Я уже пришла домой", "я, пришла", "Он сказал, что я вчера не ответил и я пришла", "я и она тут пришла", "пришла я", ""]
    assert {tuple(r) for r in told(spark, texts, clues.self_genders)} == {(0, "FEMALE")}


def test_beats(spark):
    texts = ["Маша вошла. Она села", "Он встал. Она села", "Он не встал. Она села", "Она села", "Дождь. Громов молчал", "Она села. Дождь шёл", "", None]
    got = {r["n"]: (r["gender"], r["name"]) for r in told(spark, texts, clues.beats)}
    assert got == {0: ("FEMALE", "маша"), 2: ("FEMALE", None), 3: ("FEMALE", None), 4: (None, "громов")}
