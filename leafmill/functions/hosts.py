"""R2: hosts as they go over the wire: percent escapes read, lower case, labels of other scripts in Punycode.

The code of a label is a fold over its characters beyond ASCII, in order of code point and place: how far each is from
the one before, in a number system whose digits' worth adapts. All of it is column functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the code: base, least and greatest threshold, skew, damping, first bias and first code point.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits that the number of one character may have: 36 * 35 ** 6 is over 2 ** 35.
LONGEST = 8
#: Full stops of other scripts.
DOTS = "。．｡"


def _digits(delta: Column, bias: Column) -> Column:
    """A number in digits of falling worth: after each, what is left is divided by how much the digit could hold."""
    step = lambda s, j: F.when(s["done"], s).otherwise(_digit(s, (j + 1) * BASE))

    def _digit(s, k):
        t = F.when(k <= bias + T_MIN, T_MIN).when(k >= bias + T_MAX, T_MAX).otherwise((k - bias).cast("int")).cast("long")
        last = s["q"] < t
        value = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, BASE - t))
        char = F.substring(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))
        left = F.when(last, s["q"]).otherwise(F.floor((s["q"] - t) / (BASE - t)))
        return F.struct(left.cast("long").alias("q"), F.concat(s["out"], char).alias("out"), last.alias("done"))

    start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LONGEST - 1)), start, step, lambda s: s["out"])


def _adapted(delta: Column, count: Column, first: Column) -> Column:
    """The bias after a number: halvings until the rest is small, then a fraction."""
    d = F.floor(delta / F.when(first, DAMP).otherwise(2))
    d = d + F.floor(d / count)
    high = ((BASE - T_MIN) * T_MAX) // 2
    start = F.struct(d.cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    shrink = lambda s, _: F.when(s["d"] > high, F.struct(F.floor(s["d"] / (BASE - T_MIN)).cast("long").alias("d"), (s["k"] + BASE).cast("long").alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(0), F.lit(LONGEST - 1)), start, shrink, lambda s: (s["k"] + F.floor((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW))).cast("long"))


def punycode(label: Column) -> Column:
    """A label with characters beyond ASCII as `xn--` and its code; another one as it is."""
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    # each character with its code point and place; those of ASCII come first and stand in order
    spots = F.transform(chars, lambda c, i: F.struct(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long").alias("m"), i.alias("p"), c.alias("c")))
    basic = F.filter(spots, lambda x: x["m"] < FIRST)
    other = F.array_sort(F.filter(spots, lambda x: x["m"] >= FIRST))
    plain = F.array_join(F.transform(basic, lambda x: x["c"]), "")
    start = F.struct(
        F.lit(FIRST).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), F.size(basic).cast("long").alias("len"), F.lit(BIAS).cast("long").alias("bias"),
        F.lit(True).alias("first"), F.when(F.size(basic) > 0, F.concat(plain, F.lit("-"))).otherwise("").alias("out"), F.transform(basic, lambda x: x["p"]).alias("there"))

    def step(s, x):
        place = F.size(F.filter(s["there"], lambda p: p < x["p"])).cast("long")
        delta = (x["m"] - s["n"]) * (s["len"] + 1) + place - s["i"]
        return F.struct(
            x["m"].alias("n"), (place + 1).alias("i"), (s["len"] + 1).alias("len"), _adapted(delta, s["len"] + 1, s["first"]).alias("bias"),
            F.lit(False).alias("first"), F.concat(s["out"], _digits(delta, s["bias"])).alias("out"), F.array_append(s["there"], x["p"]).alias("there"))

    return F.when(F.size(other) == 0, label).otherwise(F.concat(F.lit("xn--"), F.aggregate(other, start, step, lambda s: s["out"])))


def ascii_host(host: Column) -> Column:
    """R2: a host in lower case and ASCII; one whose percent escapes are broken keeps them.

    ß becomes ss and ς σ, as the older rule for names has it; other compatibility forms stay as they are. Null stays null.
    """
    read = F.when(F.contains(host, F.lit("%")), F.coalesce(F.try_url_decode(host), host)).otherwise(host)
    low = F.translate(F.lower(read), DOTS + "ς", "..." + "σ")
    labels = F.split(F.replace(low, F.lit("ß"), F.lit("ss")), "\\.")
    return F.when(low.rlike("^[\\x00-\\x7F]*$"), low).otherwise(F.array_join(F.transform(labels, punycode), "."))
