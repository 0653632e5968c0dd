import random
import re
from collections import Counter

import xxhash

from leafmill.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts(make_docs, sample):
    texts = sample + ["x y z x y z", "a b c\n\n \n a b c\na b c", "\r\n\x0b\x0c", "a b c d " * 40 + "#|<", "q q q q"]
    rows = {r.doc_id: r for r in rules.judge(make_docs(texts)).collect()}
    for k, t in enumerate(texts):
        r, want = rows[k], slow(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_common_lines(make_docs):
    def body(k, n=60):
        return "\n".join(" ".join(f"w{k}x{i}x{j}" for j in range(10)) for i in range(n // 10))

    footer = " ".join(f"Legal{i}" for i in range(30))
    rows = [(k, body(k) + "\n  " + footer.upper() + " ", "en", "a") for k in range(40)]
    rows += [(100 + k, "\n".join(f"{footer} " for _ in range(5)) + f"\nown {k}", "en", "a") for k in range(3)]
    rows += [(200 + k, body(999), "en", "b") for k in range(50)]  # copies of a clean document
    rows += [(300 + k, body(888).replace("w888x3x5", f"edit{k}"), "en", "b") for k in range(50)]  # near copies
    rows += [(400 + k, body(777 + k) + "\n" + footer, "en", None) for k in range(3)]
    out = {r.doc_id: r for r in rules.judge(make_docs(rows)).collect()}
    assert all(out[k].kept and out[k].removed_words == 30 for k in range(40))
    assert all(out[100 + k].removed_words == 150 and not out[100 + k].kept for k in range(3))
    assert all(out[k].kept and out[k].removed_words == 0 for k in [*range(200, 250), *range(300, 350), *range(400, 403)])


def test_blocks_of_common_lines(make_docs):
    """Documents that share several lines are as many as they are, whatever their own lines are."""
    shapes = [(5, 5), (5, 3), (10, 3), (2, 1)]
    rows, want = [], {}
    for host, (shared, own) in enumerate(shapes):
        menu = [" ".join(f"h{host}m{i}x{j}" for j in range(10)) for i in range(shared)]
        for k in range(200):
            lines = [" ".join(f"h{host}d{k}x{i}x{j}" for j in range(10)) for i in range(own)]
            rows.append((1000 * host + k, "\n".join(menu + lines), "en", f"host{host}"))
            want[1000 * host + k] = 10 * shared
    # many copies of one of them do not hide that the others are distinct
    rows += [(9000 + k, rows[0][1], "en", "host0") for k in range(500)]
    out = {r.doc_id: r.removed_words for r in rules.judge(make_docs(rows)).collect()}
    assert {k: out[k] for k in want} == want


def test_few_documents_with_a_block(make_docs):
    menu = "\n".join(" ".join(f"menu{i}x{j}" for j in range(10)) for i in range(4))
    rows = [(k, menu + "\n" + "\n".join(" ".join(f"d{k}x{i}x{j}" for j in range(10)) for i in range(4)), "en", "a") for k in range(12)]
    assert all(r.removed_words == 40 for r in rules.judge(make_docs(rows)).collect())
    assert all(r.removed_words == 0 for r in rules.judge(make_docs(rows[:10])).collect())


def test_empty_table(make_docs):
    assert rules.judge(make_docs([])).count() == 0


def test_twenty_shared_lines(make_docs):
    menu = [" ".join(f"menu{i}x{j}" for j in range(9)) for i in range(20)]
    rows = [(k, "\n".join(menu + [" ".join(f"d{k}x{i}x{j}" for j in range(9)) for i in range(6)]), "en", "one") for k in range(400)]
    out = rules.judge(make_docs(rows)).collect()
    assert len(out) == 400 and all(r.removed_words == 180 and not r.kept for r in out)


def sketch_bands(text):
    """The bands of a text: hashes of the parts of its sketch."""
    chain = lambda parts, h=42: chain(parts[1:], xxhash.xxh64_intdigest(parts[0], h)) if parts else h
    words, half, bits = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)], 1 << 33, (1 << 34) - 1
    hashes = sorted((((chain(list(x)) & bits) ^ half) - half for x in zip(words, words[1:], words[2:], strict=False)))
    sketch = list(dict.fromkeys(hashes[: 2 * rules.SKETCH]))[: rules.SKETCH]
    bands = [[v.to_bytes(8, "little", signed=True) for v in sketch if v % rules.BANDS == b] for b in range(rules.BANDS)]
    return [chain(b) - (chain(b) >> 63 << 64) for b in bands if b]


def slow_verdicts(rows, many=rules.MANY, share=rules.SHARE, depleted=rules.DEPLETED):
    """(removed words, kept) of each row, from the rule: rows are (text, host).

    A line goes if more than `many` documents of the host have it that are no copies or near copies of one another, and
    more than `share` of the host's documents, counted in the same way, and if these are more than a twenty-fifth of all
    different texts with the line.
    """
    hosts = {}
    for text, host in rows:
        hosts.setdefault(host, set()).add(text or "")
    gone_lines = {}
    for host, texts in hosts.items():
        bands = {t: sketch_bands(t) for t in texts}
        liked = Counter(b for some in bands.values() for b in some)
        kind = {t: max(((liked[b], b) for b in some if liked[b] > 1), default=t) for t, some in bands.items()}
        kinds_of, texts_of = {}, Counter()
        for t in texts:
            for line in {" ".join(WORD.findall(x.lower())) for x in t.split("\n")}:
                kinds_of.setdefault(line, set()).add(kind[t])
                texts_of[line] += 1
        gone_lines[host] = {line for line, kinds in kinds_of.items() if line and len(kinds) > max(many, share * len(set(kind.values())), texts_of[line] / 25)}
    out = []
    for text, host in rows:
        n, _, _, _, repeated = slow(text)
        gone = sum(len(WORD.findall(line)) for line in (text or "").split("\n") if " ".join(WORD.findall(line.lower())) in gone_lines[host])
        out.append((gone, n >= rules.MIN_WORDS and 100 * repeated <= rules.MAX_REPEAT * n and gone <= depleted * n))
    return out


def test_a_family_does_not_hide_others(make_docs):
    """100 different documents of a host share a footer; 1,000 near copies of one other have it too."""
    footer = " ".join(f"foot{i}" for i in range(12))
    body = lambda k, n=12: [" ".join(f"b{k}x{i}x{j}" for j in range(10)) for i in range(n)]
    rows = [(k, "\n".join([*body(k), footer]), "en", "a") for k in range(100)]
    family = body("f")
    rows += [(1000 + k, "\n".join([*family[: k % 12], f"{family[k % 12]} edit{k}", *family[k % 12 + 1 :], footer]), "en", "a") for k in range(1000)]
    out = {r.doc_id: r for r in rules.judge(make_docs(rows)).collect()}
    assert all(r.removed_words == 12 and r.kept for r in out.values())
    # near copies alone do not make their own lines common
    out = rules.judge(make_docs([r for r in rows if r[0] >= 1000])).collect()
    assert all(r.removed_words == 0 for r in out)


def test_copies_do_not_hide_others(make_docs, spark):
    """50 different documents share a line; 40,000 copies of another text do not have it."""
    rows = [(k, "\n".join([" ".join(f"d{k}x{i}x{j}" for j in range(10)) for i in range(8)] + ["the shared line of this host"]), "en", "a") for k in range(50)]
    other = " ".join(f"copy{i}" for i in range(60))
    copies = spark.range(1000, 41_000).selectExpr("id as doc_id", f"'{other}' as text", "'en' as lang", "'a' as source", "0L as n_chars")
    out = rules.judge(make_docs(rows).union(copies))
    assert out.where("doc_id < 50 and removed_words = 6").count() == 50
    assert out.where("doc_id >= 1000 and removed_words = 0 and kept").count() == 40_000


def test_large_families_with_heavier_edits(make_docs):
    """Of 3,000 near copies with a twentieth of the words changed, lines stay."""
    rnd = random.Random(5)
    base = [[f"w{i}x{j}" for j in range(10)] for i in range(40)]
    rows = []
    for k in range(3000):
        lines = [list(x) for x in base]
        for e in range(4):
            lines[rnd.randrange(40)][rnd.randrange(10)] = f"e{k}x{e}"
        rows.append((k, "\n".join(map(" ".join, lines)), "en", "a"))
    assert rules.judge(make_docs(rows)).where("removed_words > 0").count() == 0


def test_verdicts_against_loops(make_docs, sample):
    rnd = random.Random(2)
    blocks = [[" ".join(f"b{b}l{i}w{j}" for j in range(6)) for i in range(rnd.randint(1, 12))] for b in range(6)]
    rows = [(k, t, "en", f"host{k % 2}") for k, t in enumerate(sample)]
    for k in range(260):
        lines = [x.upper() if rnd.random() < 0.2 else f"  {x} " for b in rnd.sample(blocks, rnd.randint(0, 3)) for x in b]
        lines += [" ".join(f"own{rnd.randrange(9000)}" for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 8))]
        rnd.shuffle(lines)
        rows.append((1000 + k, "\n".join(lines), "en", rnd.choice(["host0", "host1", None])))
    rows += [rows[-1], rows[-2], (None, None, "en", None), (None, "", "en", "host0")]
    for k in range(40):  # near copies of one text
        rows.append((2000 + k, rows[30][1].replace("a", "a", 1) + f"\nend {k}", "en", "host0"))
    got = sorted((str(r.doc_id), r.n_words, r.removed_words, r.kept) for r in rules.judge(make_docs(rows)).collect())
    want = slow_verdicts([(t, host) for _, t, _, host in rows])
    assert got == sorted((str(r[0]), slow(r[1])[0], gone, kept) for r, (gone, kept) in zip(rows, want, strict=True))
    assert sum(gone > 0 for gone, _ in want) > 100 and 20 < sum(kept for _, kept in want) < len(rows) - 20
