"""Graphs, splits, outlines, page lines, paragraphs, hosts, word lists and growing books."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import hosts
from leafmill.operators import flow, graph, lines, outline, shelf, splits
from leafmill.sources import lexicons
from leafmill.streaming import growing


def test_reachable_nodes(spark):
    """Cycles end, unknown inputs lead nowhere, each round joins only what is new."""
    nodes = [(1, k, [f"t{k + 1}"] if k < 8 else ["t3", "", "lost"], [f"t{k}"]) for k in range(9)] + [(2, 0, ["t1"], ["t0"]), (2, 5, [], ["t5"]), (1, 20, [], ["t20"])]
    df = spark.createDataFrame(nodes, "graph int, node int, inputs array<string>, outputs array<string>")
    edges, made = graph.producers(df)
    starts = spark.createDataFrame([(1, 2), (1, 2), (2, 0), (1, None)], "graph int, node int")
    rounds = []
    got = {tuple(r) for r in graph.reachable(edges, starts, rounds).collect()}
    assert got == {(1, k) for k in range(2, 9)} | {(2, 0)}
    assert rounds == [2, 1, 1, 1, 1, 1, 1]
    assert graph.reachable(edges.limit(0), starts.limit(0)).count() == 0


def fold_sizes(items, hard, soft):
    part, size, out = 0, 0, []
    for n, (length, heading) in enumerate(items):
        if n and (size >= hard or (heading and size >= soft)):
            part, size = part + 1, 0
        size += length or 0
        out.append(part)
    return out


def test_split_by_size_is_a_fold(spark):
    rnd = random.Random(1)
    books = {k: [(rnd.choice([None, 0, 1, 5, 20]), rnd.random() < 0.2) for _ in range(n)] for k, n in enumerate([0, 1, 2, 40, 300])}
    rows = [(k, 10 * n, *x) for k, items in books.items() for n, x in enumerate(items)] + [(None, n, 7, True) for n in range(30)]
    df = spark.createDataFrame(rows, "k int, n int, size int, heading boolean").repartition(3)
    for hard, soft in ((30, 10), (1, 1), (10_000, 10_000)):
        rounds = []
        got = {(r["k"], r["i"]): r["part"] for r in splits.by_size(df, "k", "n", "size", hard, "heading", soft, rounds).collect()}
        want = {(k, n): p for k, items in [*books.items(), (None, [(7, True)] * 30)] for n, p in enumerate(fold_sizes(items, hard, soft))}
        assert got == want
        assert len(rounds) <= 11  # twice as far each round
    plain = {(r["k"], r["i"]): r["part"] for r in splits.by_size(df, "k", "n", "size", 30).collect()}
    assert plain == {(k, n): p for k, items in [*books.items(), (None, [(7, False)] * 30)] for n, p in enumerate(fold_sizes([(x, False) for x, _ in items], 30, 1))}


def fold_pages(items, most):
    """Pages by trying each end, the furthest first."""
    starts, i = [], 0
    may = lambda k: k == len(items) or not (items[k - 1][1] or (items[k][2] is not None and items[k][2] == items[k - 1][2]))
    while i < len(items):
        starts.append(i)
        fits = [k for k in range(i + 1, len(items) + 1) if sum(x[0] for x in items[i:k]) <= most]
        i = max((k for k in fits if may(k)), default=max(fits, default=i + 1))
    return [sum(s <= n for s in starts) - 1 for n in range(len(items))]


def test_pages(spark):
    rnd = random.Random(2)
    chapters = {k: [(rnd.choice([0, 10, 20, 30, 120]), rnd.random() < 0.2, rnd.choice([None, None, n // 4])) for n in range(size)] for k, size in enumerate([1, 3, 60, 200])}
    chapters[9] = [(10, True, None)] * 30  # headings only: pages are cut anyway
    rows = [(k, n, *x) for k, items in chapters.items() for n, x in enumerate(items)]
    df = spark.createDataFrame(rows, "k int, n int, height int, keep boolean, block int").repartition(3)
    got = {(r["k"], r["i"]): r["part"] for r in splits.pages(df, "k", "n", "height", 100, "keep", "block").collect()}
    assert got == {(k, n): p for k, items in chapters.items() for n, p in enumerate(fold_pages(items, 100))}


def test_outline(spark):
    """Reading order, depth, entries without a page, a cycle, equal ords."""
    rows = [(1, 1, None, 2, "B", 10, 5.0), (1, 2, None, 1, "A", 0, None), (1, 3, 2, 1, "A1", -1, None), (1, 4, 3, 1, "A1a", 2, 0.0), (1, 5, 2, 1, "A2", 3, 0.0), (2, 1, 2, 1, "x", 0, 0.0), (2, 2, 1, 1, "y", 0, 0.0)]
    rows += [(3, k, k - 1 if k else None, 1, f"d{k}", k, 0.0) for k in range(9)]
    tree = spark.createDataFrame(rows, "doc int, node long, parent long, ord int, title string, page int, top double")
    got = [(r["doc"], r["level"], r["title"]) for r in outline.outline_rows(tree).orderBy("doc", "seq").collect()]
    assert got == [(1, 1, "A"), (1, 3, "A1a"), (1, 2, "A2"), (1, 1, "B")] + [(3, k + 1, f"d{k}") for k in range(6)]
    assert outline.outline_rows(tree, most=2).groupBy("doc").count().agg(F.max("count")).head()[0] == 2


def test_whole_outline_has_no_bounds(spark):
    """A chain of 70 levels, 6,000 entries of one book, a cycle, a missing parent, ords of several lengths and signs."""
    rows = [(1, k, k - 1 if k else None, 1, f"d{k}", k, None) for k in range(70)] + [(2, k, k // 3 or None, k * 7 % 23 - 11, f"t{k}", k % 5 - 1, 1.0) for k in range(1, 6001)]
    rows += [(3, 1, 2, 1, "x", 0, 0.0), (3, 2, 1, 1, "y", 0, 0.0), (3, 3, 1, 1, "under", 0, 0.0), (3, 4, 99, 1, "lost", 0, 0.0), (3, 5, None, 1, "root", 0, 0.0)]
    tree = spark.createDataFrame(rows, "doc int, node long, parent long, ord int, title string, page int, top double")
    under = {}
    for doc, node, parent, ord_, title, page, _ in rows:
        under.setdefault((doc, parent), []).append((ord_, node, title, page))
    want = []
    for doc in (1, 2, 3):
        todo, seq = [(1, e) for e in sorted(under[doc, None], reverse=True)], 0
        while todo:
            level, (_, node, title, page) = todo.pop()
            if page >= 0:
                want.append((doc, seq := seq + 1, level, title))
            todo += [(level + 1, e) for e in sorted(under.get((doc, node), ()), reverse=True)]
    assert [(r["doc"], r["seq"], r["level"], r["title"]) for r in outline.whole_outline(tree).orderBy("doc", "seq").collect()] == want


def _final_plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    return plan.toString()


def test_outline_goes_down_by_joins(spark):
    """No recursion that the driver holds: chapter_starts read an outline that is a table, and need no setting of the session."""
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
    tree = spark.createDataFrame([(1, k, k // 3 if k >= 3 else None, k, f"T{k}", k, 1.0) for k in range(1, 60)], "doc int, node int, parent int, ord int, title string, page int, top double")
    rows = outline.outline_rows(tree)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
    plan = _final_plan(rows)
    assert "UnionLoop" not in plan and "Join" not in plan
    assert [r["node"] for r in rows.where("level = 1").orderBy("seq").collect()] == [1, 2]


def test_needed_nodes_pass_by_the_driver(spark):
    nodes = spark.createDataFrame([(1, k, [f"t{k + 1}"], [f"t{k}"]) for k in range(20)], "graph int, node int, inputs array<string>, outputs array<string>")
    edges, _ = graph.producers(nodes)
    plan = _final_plan(edges)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_chapter_starts(spark):
    """A long part gives way to the chapters under it, a short one does not; the last one ends with the book."""
    rows = [(1, "Part", 0), (2, "One", 1), (3, "deep", 2), (2, "Two", 30), (1, "Short", 60), (2, "in short", 61), (1, "Last", 70), (2, "in last", 75)]
    df = spark.createDataFrame([(1, n, level, n, t, p, 0.0) for n, (level, t, p) in enumerate(rows)] + [(2, 0, 1, 0, "alone", 0, 0.0)], "doc int, seq int, level int, node int, title string, page int, top double")
    last = spark.createDataFrame([(1, 140), (2, 9)], "doc int, last_page int")
    starts = outline.chapter_starts(df, last)
    assert [r["title"] for r in starts.orderBy("seq").collect()] == ["Part", "One", "Two", "Short", "Last", "in last"]
    items = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 29, 9.0), (1, 2, 30, 0.0), (1, 3, 140, 1.0), (2, 0, 5, 0.0)], "doc int, n int, page int, top double")
    got = {(r["doc"], r["n"]): r["chapter"] for r in outline.chapters_of(items, starts).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 3, (1, 3): 7, (2, 0): None}


RUN = "doc int, page int, run int, text string, left double, right double, baseline double, size double"


def test_gutters_part_columns(spark):
    """Two columns with one gutter; a loose line over one column stays whole; a covering run hides no gap."""
    rows = []
    for b in range(10):
        y = 20.0 * b
        rows += [(1, 1, 10 * b, f"left{b}", 10.0, 90.0, y, 10.0), (1, 1, 10 * b + 1, "words", 93.0, 140.0, y + 1, 10.0), (1, 1, 10 * b + 2, f"right{b}", 160.0, 290.0, y, 10.0)]
    rows += [(1, 2, 0, "one", 10.0, 60.0, 0.0, 10.0), (1, 2, 1, "loose", 75.0, 120.0, 0.0, 10.0)] + [(1, 2, 2 + b, "full line", 10.0, 200.0, 20.0 + 20 * b, 10.0) for b in range(4)]
    rows += [(1, 3, 0, "over", 10.0, 200.0, 0.0, 10.0), (1, 3, 1, "under", 20.0, 30.0, 0.0, 10.0), (1, 3, 2, "next", 203.0, 250.0, 0.0, 10.0), (1, 3, 3, " ", 600.0, 610.0, 0.0, 10.0), (1, 3, 4, "dot", 600.0, 610.0, 0.0, 0.5)]
    got = [(r["page"], r["text"]) for r in lines.built(spark.createDataFrame(rows, RUN)).orderBy("page", "band", "part").collect()]
    assert got[:20] == [x for b in range(10) for x in ((1, f"left{b} words"), (1, f"right{b}"))]
    assert got[20] == (2, "one loose") and got[25:] == [(3, "overunder next")]


LINE = "doc int, page int, n int, text string, left double, right double, baseline double, size double, block int, block_left double, block_right double, column_right double, heading boolean"


def page_lines(texts, per_page=3):
    out = []
    for n, t in enumerate(texts):
        heading = t.startswith("#")
        out.append((1, n // per_page, n, t.lstrip("#"), 0.0, 50.0 if t.endswith("~") else 100.0, 12.0 * (n % per_page), 10.0, n // per_page, 0.0, 100.0, 100.0, heading))
    return [(*r[:3], r[3].rstrip("~"), *r[4:]) for r in out]


def test_tied_runs_keep_one_order(spark):
    """Runs of one place and number (two copies of a line) have one order in all steps, whatever order they come in."""
    rows = []
    for page in range(60):
        tied = [(1, page, 12, t, 289.0, 292.0, 49.0, 10.0) for t in ("R2", "A2")]
        rows += [(1, page, 11, "A7", 165.0, 168.0, 49.0, 10.0), *(tied if page % 2 else tied[::-1])]
    df = spark.createDataFrame(rows, RUN).repartition(7)
    got = lines.built(df).orderBy("page", "part").collect()
    assert [(r["page"], r["part"], r["text"]) for r in got] == [x for page in range(60) for x in ((page, 0, "A7"), (page, 1, "R2A2"))]


def test_paragraphs_cross_pages(spark):
    texts = ["#Title", "A paragraph that goes", "on to the next page with a chang-", "ing word and a one-", "third and a shop-", "keeper, at www.ex.org/", "path/a which goes on and on", "over a whole range of pages,", "never ending at all, until", "it does.~", "Then a new one"]
    words = spark.createDataFrame([(w,) for w in ("changing", "one", "third", "shopkeeper", "keeper", "shop")], "word string")
    df = spark.createDataFrame(page_lines(texts), LINE)
    want = ["Title", "A paragraph that goes on to the next page with a changing word and a one-third and a shopkeeper, at www.ex.org/path/a which goes on and on over a whole range of pages, never ending at all, until it does.", "Then a new one"]
    for pages in (1, 2, 50):
        assert [r["text"] for r in flow.paragraphs(df, words, pages).orderBy("n").collect()] == want


def test_ranges_do_not_matter(spark):
    """The same rows for one range and for fifty."""
    rnd = random.Random(6)
    texts = [rnd.choice(["Some words here", "lower start of a line", "a cut chang-", "ing of lines", "Ends here.", "Ends short.~", "#Head", "— speech", "soft hy­", "phen"]) for _ in range(150)]
    df = spark.createDataFrame(page_lines(texts), LINE).repartition(5)
    words = spark.createDataFrame([("changing",)], "word string")
    one, fifty = (sorted(map(tuple, flow.paragraphs(df, words, p).collect())) for p in (1000, 1))
    assert one == fifty and 20 < len(one) < 150


def test_paragraphs_shuffle_texts_twice(spark):
    """Texts are dealt by range and by paragraph; what else is dealt has one row a range. Lines of no book are a book."""
    rows = [(None if k % 2 else 1, *r[1:]) for k in (0, 1) for r in page_lines(["Some words", "go on", "and on a chang-", "ing page", "#Head", "New text", "that ends.~"])]
    words = spark.createDataFrame([("changing",)], "word string")
    found = flow.paragraphs(spark.createDataFrame(rows, LINE), words, 1)
    want = [(0, "Some words go on and on a changing page"), (4, "Head"), (5, "New text that ends.")]
    assert sorted((r["doc"] or 0, r["n"], r["text"]) for r in found.collect()) == [(d, *w) for d in (0, 1) for w in want]
    dealt = _final_plan(found).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
    assert dealt <= 7


def test_hosts(spark):
    names = ["Example.COM", "автор.today", "bücher.example", "例え.テスト", "a-ü-b.c", "xn--abc.de", "пример.рф", "😀.com", "ü" * 20 + ".com", "日本語日本語日本語abc.jp", "a%41.com", "b%zz.com", "", "ü", "ab..ü.c", "αβγδε.gr"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in [*names, None]], "h string").select(hosts.ascii_host(F.col("h"))).collect()]
    code = lambda label: label if label.isascii() else "xn--" + label.encode("punycode").decode()
    read = lambda n: {"a%41.com": "aa.com"}.get(n, n)
    assert got == [".".join(code(x) for x in read(n).lower().split(".")) for n in names] + [None]
    rnd = random.Random(7)
    labels = ["".join(rnd.choice("ab-é漢字яǘ😀") for _ in range(rnd.randint(1, 25))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "h string").select(hosts.punycode(F.col("h"))).collect()]
    assert got == [code(x) for x in labels]


@pytest.fixture
def word_list(spark, tmp_path):
    rows = [(f"w{k:05d}", k) for k in range(20_000)] + [("ё", -1), ("a", -2), (None, 0)]
    path = str(tmp_path / "list")
    lexicons.written(spark.createDataFrame(rows, "word string, value long").repartition(4), path, 4)
    return path


def opened(spark, path, condition):
    """How many blocks of how many files a filter reads."""
    reader = lexicons._Reader(path)
    list(reader.pushFilters(condition))
    parts = [p for p in reader.partitions() if p.file]
    return len({p.file for p in parts}), sum(p.past - p.first for p in parts)


def test_lookups_open_one_file(spark, word_list):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    df = lexicons.found(spark, word_list)
    assert df.count() == 20_002
    assert [r["value"] for r in df.where("word = 'w00777'").collect()] == [777]
    assert [r["value"] for r in df.where("word in ('w19999', 'ё', 'none')").orderBy("value").collect()] == [-1, 19_999]
    assert df.where("word >= 'w00100' and word < 'w00200'").count() == 100
    assert df.where("startswith(word, 'w0001')").count() == 10
    assert opened(spark, word_list, [EqualTo(("word",), "w00777")])[0] == 1
    assert opened(spark, word_list, [EqualTo(("word",), "none")])[1] <= 1
    assert opened(spark, word_list, [])[0] == 4
    assert opened(spark, word_list, [In(("word",), ("w00001", "w00002"))])[0] == 1
    assert opened(spark, word_list, [GreaterThanOrEqual(("word",), "w00100"), LessThan(("word",), "w00200")])[0] == 1
    assert "w00777" in df.where("word = 'w00777'")._jdf.queryExecution().executedPlan().toString()


def test_word_lists_are_sorted(spark, tmp_path):
    lexicons.registered(spark)
    unsorted = spark.createDataFrame([("b", 1), ("a", 2)], "word string, value int").coalesce(1)
    with pytest.raises(Exception, match="not sorted"):
        unsorted.write.format(lexicons.NAME).mode("append").save(str(tmp_path / "x"))
    crossed = spark.createDataFrame([("b", 1), ("d", 2), ("c", 3), ("e", 4)], "word string, value int").coalesce(1).rdd.toDF(["word", "value"])
    two = crossed.repartitionByRange(2, "value").sortWithinPartitions("word")
    with pytest.raises(Exception, match="overlap"):
        two.write.format(lexicons.NAME).mode("append").save(str(tmp_path / "y"))
    lexicons.written(unsorted.limit(0), str(tmp_path / "z"), 2)
    assert lexicons.found(spark, str(tmp_path / "z")).count() == 0


def test_one_variant_a_word(spark):
    df = spark.createDataFrame([("a", "x", 0.5, 2), ("a", "y", 0.5, 1), ("a", "z", 0.1, 0), ("b", "w", None, 3)], "word string, value string, prob double, line long")
    assert sorted(map(tuple, lexicons.chosen(df).collect())) == [("a", "y"), ("b", "w")]


def test_books_grow_by_one_request(spark, tmp_path):
    """Positions in many batches, one request a chapter; a failed request ends the growth of its book."""
    tables = {"chapters": spark.createDataFrame([(1, 0, "u1"), (2, 0, "v1"), (3, 0, None)], "book long, chapter int, next_url string"), "asked": None}
    asked = []

    def read(name):
        return tables[name]

    def append(rows, name):
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        tables[name] = rows if tables[name] is None else tables[name].unionByName(rows)

    def ask(wanted):
        rows = wanted.collect()
        asked.extend((r["book"], r["chapter"]) for r in rows)
        return spark.createDataFrame([(r["book"], r["chapter"], f"u{r['chapter'] + 1}" if r["chapter"] < 3 else None) for r in rows if r["book"] != 2], "book long, chapter int, next_url string")

    log = [(1, 0), (2, 0), (3, 0), (1, 0), (2, 0), (1, 1), (1, 1), (1, 2), (1, 3), (2, 0)]
    for k in range(0, len(log), 2):
        spark.createDataFrame(log[k : k + 2], "book long, chapter int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("book long, chapter int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = source.writeStream.foreachBatch(growing.ask_once(ask, read, append)).option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    assert len(asked) == len(set(asked)) and {x for x in asked if x[0] == 2} == {(2, 1)} and not any(b == 3 for b, _ in asked)
    assert sorted(c for b, c in asked if b == 1) == [1, 2, 3]


def test_sessions_end_by_timers(spark, tmp_path):
    """Release after the idle time, stop at the end of a sleep timer, in the events' own time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    minute = lambda m: f"2026-01-01 00:{m:02d}:00"
    batches = [[(1, 0, "play", None), (2, 0, "sleep", 5)], [(1, 5, "play", None), (2, 4, "play", None)], [(3, 30, "play", None)], [(3, 31, "play", None)], [(3, 59, "play", None)], [(3, 59, "play", None)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, minute(m), kind, n) for s, m, kind, n in rows], "session long, at string, kind string, minutes int").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session long, at timestamp, kind string, minutes int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = growing.session_ends(source).writeStream.outputMode("append").format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    try:
        assert running.awaitTermination(90)
    finally:
        running.stop()
    base = spark.sql("select unix_millis(timestamp '2026-01-01 00:00:00')").head()[0]
    got = {(r["session"], (r["ms"] - base) // 60_000, r["action"]) for r in spark.sql("select * from ends").collect()}
    assert got == {(1, 15, "release"), (2, 5, "stop"), (2, 14, "release"), (3, 41, "release")}


def test_look_ahead_counts_places(spark):
    """Five segments, two of one index: four places at most, and none twice."""
    df = spark.createDataFrame([(1, 1, 100), (1, 1, 100), (1, 2, 100), (1, 3, 0), (1, 4, 900), (2, 1, None), (None, 1, 5)], "book int, index int, length int")
    got = sorted(map(tuple, shelf.look_ahead(df).collect()))
    assert got == [(1, 1, 4), (1, 2, 3), (1, 3, 2), (1, 4, 1)]
    many = spark.range(100).selectExpr("1 as book", "id as index", "1 as length")
    assert {tuple(r)[1:] for r in shelf.look_ahead(many).where("index in (0, 80)").collect()} == {(0, 24), (80, 20)}
    slow = spark.range(9).selectExpr("1 as book", "id as index", "420 as length")
    assert {r["ahead"] for r in shelf.look_ahead(slow).where("index < 7").collect()} == {2}


def test_words_of_documents_are_not_dealt(spark):
    """A document's words are made single in its own row, so that only one row a word and task is dealt."""
    from leafmill.plans import growth

    variants = growth._variants(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in _final_plan(variants)
    assert variants.count() == variants.distinct().count()
