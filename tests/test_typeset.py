"""Literal cases and plain forms for pages of type."""

import random
import time

import numpy as np
import pytest

from leafmill.operators import typeset as ts


@pytest.mark.parametrize(("text", "want"), [
    ("however, we did. then i’m done", "However, we did. Then I’m done"), ("the simWar of dvd", "The SIMWAR of dvd"), ("FIGURE 5.4 inputs of it", "FIGURE 5.4 Inputs of it"),
    ("NOTE remember it", "NOTE Remember it"), ("see fig. two! yes", "See fig. two! Yes"), ("desiGn it", "DESIGN It"), ("mr. a. b said", "Mr. a. b said"),
])
def test_sentence_case(text, want):
    assert ts.sentence_case(text) == want


def test_known_spellings():
    assert ts.sentence_case("the simWar on dvd", {"simwar": "SimWar", "dvd": "DVD"}) == "The SimWar on DVD"
    assert ts.title_case("cOncePT sTaGe of iv and dvd", {"dvd": "DVD", "stage": "Stage"}) == "Concept Stage of IV and DVD"
    assert ts.title_case("Plain Title") == "Plain Title" and ts.title_case("plain title", broken=True) == "Plain Title"
    assert [ts.odd_case(w) for w in ("cOncePT", "JavaScript", "iPhone", "DVDs", "AB", "FIGURe")] == [True, False, False, False, False, True]


def test_reading_order():
    two_columns = np.array([[300, 0, 500, 400], [0, 0, 200, 190], [0, 200, 200, 400]], float)
    assert ts.in_order(two_columns, np.full(3, 10.0)) == [1, 2, 0]
    heading = np.vstack([two_columns + [0, 50, 0, 50], [0, 0, 500, 40]])
    assert ts.in_order(heading, np.full(4, 10.0)) == [3, 1, 2, 0]
    overlapping = np.array([[50, 0, 200, 30], [0, 3, 120, 33], [0, 20, 100, 60]], float)
    assert ts.in_order(overlapping, np.full(3, 10.0)) == [1, 0, 2]
    assert ts.in_order(np.zeros((0, 4)), np.zeros(0)) == []


def cut_one_by_one(boxes, sizes):
    """L7 in plain words: each cut gives the blocks on its sides one more number to be sorted by."""

    def stretches(at, low, high, apart):
        number, n, reach = {}, 0, None
        for i in sorted(at, key=lambda i: boxes[i][low]):
            n += reach is not None and apart(boxes[i][low], reach)
            number[i], reach = n, boxes[i][high] if reach is None else max(reach, boxes[i][high])
        return number

    numbers, uncut = [() for _ in boxes], [list(range(len(boxes)))]
    while uncut:
        at = uncut.pop()
        if len(at) < 2:
            continue
        column, band = stretches(at, 0, 2, lambda x, r: x > r + 0.5), stretches(at, 1, 3, lambda x, r: x >= r - 0.5)
        sides = [[i for i in at if column[i] == c] for c in range(max(column.values()) + 1)]
        high = lambda s: max(boxes[i][3] for i in s) - min(boxes[i][1] for i in s)
        gutters = len(sides) > 1 and (sum(high(s) >= 0.3 * high(at) for s in sides) >= 2 or len(sides) == len(at))
        if gutters or max(band.values()) > 0:
            side = column if gutters else {i: min(b, 1) for i, b in band.items()}
            uncut += [[i for i in at if side[i] == k] for k in range(max(side.values()) + 1)]
            more = {i: (side[i],) for i in at}
        elif len(sides) > 1:
            more = {i: (column[i], boxes[i][1]) for i in at}
        else:
            by, line, n = sorted(at, key=lambda i: boxes[i][1]), {}, 0
            for a, b in zip([None, *by], by, strict=False):
                n += a is not None and boxes[b][1] - boxes[a][1] >= 0.8 * max(sizes[a], sizes[b])
                line[b] = n
            more = {i: (line[i], boxes[i][0], boxes[i][1]) for i in at}
        for i in at:
            numbers[i] += more[i]
    return sorted(range(len(boxes)), key=lambda i: numbers[i])


def test_pages_are_cut_together():
    """Thousands of pages in one call, each as if by itself."""
    rnd = np.random.default_rng(8)
    group = np.sort(np.append(rnd.integers(0, 2000, 9000), np.repeat([7, 70], 60)))
    group = np.unique(group, return_inverse=True)[1]
    n = len(group)
    at = np.floor(rnd.uniform(0, 1, (n, 2)) * rnd.choice([60, 300], (n, 1)))
    boxes = np.hstack([at, at + np.floor(rnd.uniform(1, 90, (n, 2)) * rnd.choice([0.2, 1], (n, 1)))])
    sizes = rnd.choice([8.0, 10.0, 20.0], n)
    got = ts.in_orders(boxes, sizes, group)
    for g in range(group.max() + 1):
        mine = np.flatnonzero(group == g)
        assert (got[mine] - mine[0]).tolist() == cut_one_by_one(boxes[mine].tolist(), sizes[mine].tolist())


def test_clusters_are_connected_shapes(spark):
    rnd = random.Random(3)
    rows = [(p, rnd.choice(["PATH", "IMAGE"]), x := rnd.uniform(0, 400), y := rnd.uniform(0, 400), x + rnd.uniform(1, 60), y + rnd.uniform(1, 40)) for p in range(3) for _ in range(60)]
    got = ts.shape_clusters(spark.createDataFrame(rows, "page long, kind string, left double, top double, right double, bottom double")).collect()
    want = []
    for p in range(3):
        mine = [r[1:] for r in rows if r[0] == p]
        label = list(range(len(mine)))
        for i, (_, a, b, c, d) in enumerate(mine):
            for j, (_, e, f, g, h) in enumerate(mine):
                if a - 6 < g and e < c + 6 and b - 6 < h and f < d + 6 and label[i] != label[j]:
                    label = [label[i] if x == label[j] else x for x in label]
        for c in set(label):
            part = [m for m, x in zip(mine, label, strict=True) if x == c]
            want.append((p, len(part), any(m[0] == "IMAGE" for m in part), min(m[1] for m in part), max(m[4] for m in part)))
    assert sorted((r.page, r["count"], r.image, r.left, r.bottom) for r in got) == sorted(want)


def test_clusters_of_many_pages_take_few_calls():
    """Pages go together: the sweep of all pages and that of one page find the same pairs, in the time of few calls."""
    rnd = np.random.default_rng(5)
    n, pages = 40_000, 10_000
    page = np.sort(rnd.integers(0, pages, n))
    at = rnd.uniform(0, 300, (n, 2))
    box = np.hstack([at, at + rnd.uniform(0, 90, (n, 2))])
    box = box[np.lexsort((box[:, 1], page))]
    begin = np.searchsorted(page, page)
    began = time.process_time()
    a, b = ts._touching(box, page, begin)
    least = ts._joined(n, a, b)
    assert time.process_time() - began < 1
    want = set()
    for p in range(0, pages, 20):
        mine = np.flatnonzero(page == p)
        if len(mine):
            want |= {(mine[0] + x, mine[0] + y) for x, y in zip(*ts._swept(box[mine]), strict=True)}
    assert {(x, y) for x, y in zip(a, b, strict=True) if page[x] % 20 == 0} == want
    assert (least[a] == least[b]).all() and len(set(least)) > pages / 2 and (page[least] == page).all()


@pytest.mark.parametrize("many", [0, 7, 1000])
def test_clusters_do_not_depend_on_the_sweep(spark, many, monkeypatch):
    rnd = random.Random(4)
    rows = [(p, "IMAGE" if k == 3 else "PATH", x := rnd.uniform(0, 99), y := rnd.uniform(0, 99), x + 9, y + rnd.uniform(0, 9)) for p in range(40) for k in range(rnd.randrange(1, 14))]
    df = spark.createDataFrame([*rows, (50, "PATH", None, 1.0, 2.0, 3.0), (50, "PATH", 1.0, 1.0, 2.0, None)], "page long, kind string, left double, top double, right double, bottom double")
    want = sorted(map(str, ts.shape_clusters(df).collect()))
    monkeypatch.setattr(ts, "MANY", many)
    assert sorted(map(str, ts.shape_clusters(df.repartition(3)).collect())) == want and len(want) > 100


def test_captions_are_taken_once(spark):
    figures = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 0.0, 200.0, 100.0, 300.0), (2, 1, 0.0, 0.0, 10.0, 10.0)], "page long, figure long, left double, top double, right double, bottom double")
    captions = spark.createDataFrame([(1, 1, True, 0.0, 110.0, 100.0, 120.0), (1, 2, False, 0.0, 190.0, 100.0, 199.0), (2, 1, False, 0.0, 100.0, 10.0, 110.0)], "page long, caption long, labelled boolean, left double, top double, right double, bottom double")
    assert sorted(map(tuple, ts.paired_captions(figures, captions).collect())) == [(1, 1, 1), (1, 2, 2)]


def test_captions_of_figures_and_captions_in_more_boxes(spark):
    """Boxes of one name are one figure or one caption: the nearest box counts, and a figure takes one caption, which goes as a whole."""
    box = "left double, top double, right double, bottom double"
    figures = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 200.0, 10.0, 210.0), (1, 2, 0.0, 400.0, 10.0, 410.0)], f"page long, figure long, {box}")
    captions = spark.createDataFrame([(1, 7, True, 0.0, 15.0, 10.0, 20.0), (1, 8, True, 0.0, 212.0, 10.0, 220.0), (1, 8, True, 0.0, 412.0, 10.0, 420.0)], f"page long, caption long, labelled boolean, {box}")
    # figure 1 is nearer to caption 8 by its second box; then nothing of 8 is left for figure 2, and 7 is too far
    assert list(map(tuple, ts.paired_captions(figures, captions).collect())) == [(1, 1, 8)]


@pytest.fixture
def lines_of_one_name(spark, tmp_path):
    """Order lines, some of which share order, number and price: their block or index is one."""
    rng = random.Random(5)
    rows = [(k // 12, rng.randrange(200), rng.randrange(1, 3), float(rng.randrange(1, 50)), rng.randrange(3) * 250.0 + 100) for k in range(360)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["j14_captions", "t1_look_ahead"])
def test_lines_of_one_name_as_in_sql(spark, lines_of_one_name, name):
    import duckdb

    from leafmill.plans import registry

    got = registry.queries()[name](spark, lines_of_one_name)
    with duckdb.connect() as con:
        con.sql(f"create view lineitem as select * from '{lines_of_one_name}/lineitem.parquet/*.parquet'")
        want = con.sql(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        want = sorted(want.fetchall())
    assert len({r[:2] for r in want}) == len(want)
    assert sorted(map(tuple, got.select(*names).collect())) == want


def test_look_ahead_without_book_or_length(spark):
    from leafmill.operators import shelf

    rows = spark.createDataFrame([(1, 1, 14.0), (1, 2, None), (1, None, 14.0), (None, 1, 14.0), (1, 3, 14.0 * 80)], "book long, index long, length double")
    assert sorted(map(tuple, shelf.look_ahead(rows).collect()), key=str) == [(1, 1, 2), (1, 3, 1), (1, None, 1)]
