"""Sounds, phonemes and word pieces against plain forms and literal cases."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import phonemes as ph
from leafmill.functions import sound as sd

RATE = 16_000


def tone(hz, seconds=0.5, rate=RATE, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def test_resampled_keeps_a_tone():
    for target in (8000, 22_050, 24_000):
        got = sd.resampled(tone(440), RATE, target)
        assert len(got) == int(8000 / (RATE / target))
        want = tone(440, 0.5, target)[: len(got)]
        assert np.abs(got[200:-200] - want[200:-200]).max() < 0.01
    assert sd.resampled(tone(5), RATE, RATE) is not None and len(sd.resampled(np.zeros(0, np.float32), 1, 2)) == 0
    assert np.abs(sd.resampled(tone(7000), RATE, 8000)[200:-200]).max() < 0.01  # above the new half rate


def test_bounds_and_levels():
    x = np.concatenate([np.zeros(1600, np.float32), tone(200, 0.1), np.zeros(3200, np.float32)])
    a, b = sd.speech_bounds(x, RATE)
    assert 1600 - 560 - 80 <= a <= 1600 - 560 + 80 and 3200 + 560 - 80 <= b <= 3200 + 560 + 80
    assert sd.speech_bounds(np.zeros(100, np.float32), RATE) == (0, 0) == sd.speech_bounds(np.zeros(0, np.float32), RATE)
    loud = sd.with_gain(np.array([0.1, 0.89, 2.0, -2.0], np.float32), 1.0)
    assert loud[:2] == pytest.approx([0.1, 0.89]) and 0.89 < loud[2] < 0.9901 and loud[3] == -loud[2]
    edge = sd.faded(np.ones(1000, np.float32), RATE)
    assert edge[0] == 0 == edge[-1] and edge[500] == 1 and len(sd.faded(np.ones(1, np.float32), RATE)) == 1


def test_filters():
    rumble, voice, hiss = (sd.equalised(tone(hz), RATE)[4000:] for hz in (20, 500, 7500))
    level = lambda x: float(np.sqrt((x.astype(float) ** 2).mean())) / (0.5 / np.sqrt(2))
    assert level(rumble) < 0.1 and level(voice) == pytest.approx(1, abs=0.02) and level(hiss) == pytest.approx(10 ** (1.5 / 20), abs=0.03)


def test_gains_follow_a_slow_average():
    assert sd.gains(np.array([0.085, 0.0, 0.17, 1e-6])).tolist() == pytest.approx([1, 1, 0.085 / 0.102, 0.085 / 0.0816002])
    assert sd.gains(np.array([9.0, 9.0])).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("hz", [90, 140, 220, 310])
def test_pitch(hz):
    x = tone(hz) + 0.3 * tone(2 * hz)
    assert sd.pitch(x, RATE) == pytest.approx(hz, rel=0.03)
    assert sd.pitch(np.zeros(9000, np.float32), RATE) == 0 == sd.pitch(np.zeros(10, np.float32), RATE)


def test_sounds_as_columns(spark):
    rows = spark.createDataFrame([(tone(150).tolist(), RATE)], "s array<float>, r int")
    out = rows.select(F.size(sd.prepared("s", "r", F.lit(8000))).alias("n"), sd.median_pitch("s", "r").alias("hz")).first()
    assert out.n == 4000 and out.hz == pytest.approx(150, rel=0.03)


@pytest.mark.parametrize(("word", "sounds"), [("зам+ок", "z a0 m o1 k"), ("з+амок", "z a1 m o0 k"), ("пь+ес", "pj j e1 s"), ("молч+ал", "m o0 l ch a1 l"), ("+яма", "j a1 m a0"), ("объ+ект", "o0 b j e1 k t"), ("кто-то", "k t o0 t o0")])
def test_phonemes(word, sounds):
    assert ph.phonemes(word) == sounds


def test_sanitized_and_looked_up(spark):
    cases = {"«Тише…» — сказал он": '"Тише..." - сказал он', "Д’Артаньян": "Д'Артаньян", "в 1987 году №": "в году"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ph.sanitize(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases
    assert ph.pieces_of("да, нет... ") == ["да", ",", "", " ", "нет", "...", "", " ", ""]
    known = {"молчал": "m o0 l ch a1 l"}
    assert ph.spoken_word("молчал", known.get, {}.get) == known["молчал"]
    assert ph.spoken_word("замок", known.get, {"замок": "з+амок"}.get) == "z a1 m o0 k" and ph.spoken_word("зам+ок", known.get, {}.get) == "z a0 m o1 k"


PLAIN_FORM = [("[«»„“”]", '"'), ("…", "..."), ("[–—‒]", "-"), ("[’`]", "'"), ("[^А-Яа-яЁёA-Za-zÄÖäö'+ ,.?!;:\"()\\-]", " "), (" +", " ")]


def in_plain_form(text):
    for pattern, by in PLAIN_FORM:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def test_every_character_sanitized_as_by_the_plain_form(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [t for i in range(0, len(points), 4096) for part in [points[i : i + 4096]] for t in ("".join(part), "ж".join(part), " ".join(part))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "", " ", "\n", "\n «\n» \n", "  я…  ё  "]], "t string")
    assert rows.where(~ph.sanitize(F.col("t")).eqNullSafe(in_plain_form(F.col("t")))).count() == 0


def test_sanitized_in_a_fraction_of_the_plain_form(spark):
    text = "Sie hörten «Tische» über die Straße, und es waren 1987 Gäste da. " * 1000
    rows = spark.range(0, 120, 1, 4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t"))
    took = {ph.sanitize: [], in_plain_form: []}
    for _ in range(3):
        for form, seconds in took.items():
            began = time.perf_counter()
            rows.select(form(F.col("t"))).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
    assert 2 * min(took[ph.sanitize]) < min(took[in_plain_form])


def test_word_pieces():
    w = ph.WordPieces.load(["[UNK]", "[CLS]", "[SEP]", "при", "##вет", ",", "мир", "-"])
    assert w.encode("привет, мир-привет") == [("[CLS]", 1), ("при", 3), ("##вет", 4), (",", 5), ("мир", 6), ("-", 7), ("при", 3), ("##вет", 4), ("[SEP]", 2)]
    assert [p for p, _ in w.encode("xyz \t\0мир" + "м" * 200)] == ["[CLS]", "[UNK]", "[UNK]", "[SEP]"]
