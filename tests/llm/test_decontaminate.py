"""Operator 2 against a brute-force version."""

import hashlib
import re

import pytest

from cairn.llm import decontaminate


def toks(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, bench):
    wins = []
    for item, t in bench:
        w = toks(t)
        m = min(10, len(w))
        wins += [(str(item), tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m]
    out = {}
    for d, t in docs:
        w, hit, items = toks(t), set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    items.add(item)
        out.setdefault(d, []).append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return {d: sorted(v) for d, v in out.items()}


LONG = "the quick brown fox jumps over the lazy dog while nine wizards brew Élan and ten more words follow here"
BENCH = [(1, LONG), (12, LONG), (2, "short item"), (3, "Uniqueword"), (4, None), (5, " ,,, "), (6, "a a a a a a a a a a a a"), (7, "x y z x y z x y z x y z x y z"), (8, "q1 q2 q3 " + " ".join(LONG.split()[4:15]))]
DOCS = [
    (1, None), (2, ""), (3, "!!!"), (4, LONG), (5, LONG.upper().replace("É", "É")), (6, "before " + LONG[:60] + " after"), (7, "so a SHORT, item! and uniqueword"),
    (8, "a " * 30), (9, "x y z " * 9), (10, " ".join(LONG.split()[3:13])), (11, " ".join(LONG.split()[3:12])), (4, "uniqueword"), (13, "short" ), (14, ("filler text " * 3000) + LONG + " tail " * 500),
    (15, "short\x00item"), (16, "short\nitem short"), (17, "q1 q2 q3 " + LONG), (18, "item short"),
]


def check(spark, docs, bench, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {}
    for r in decontaminate.find(d, b, **options).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    assert {k: sorted(v) for k, v in got.items()} == brute(docs, bench)


def test_cases(spark):
    check(spark, DOCS, BENCH)


def test_benchmark_in_parts(spark):
    check(spark, DOCS, BENCH, part_bytes=40)


def test_empty_tables(spark):
    check(spark, DOCS[:3], [])
    check(spark, [], BENCH)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    check(spark, docs, bench)


def brute_matches(docs, bench):
    """Every maximal stretch of words that a document and an item share, of a window's length at least."""
    out = []
    for d, t in docs:
        w = toks(t)
        for item, x in bench:
            x = toks(x)
            m = min(10, len(x))
            for p in range(len(w)):
                for q in range(len(x)):
                    if w[p] == x[q] and not (p and q and w[p - 1] == x[q - 1]):
                        n = 0
                        while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                            n += 1
                        if n >= m:
                            out.append((d, p, str(item), n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pairs,part_bytes", [(1 << 20, 1 << 20), (3, 1 << 20), (50, 60)])
def test_every_item_has_its_longest_matches(pairs, part_bytes, spark):
    w = [f"w{i}" for i in range(40)]
    bench = [("A", " ".join(w[:15])), ("B", " ".join(w[4:30])), ("C", "a " * 14), ("D", "w7"), ("E", " ".join(w[:12] + ["x"] + w[:12])), ("B", " ".join(w[4:30]))]
    docs = [(1, " ".join(w[4:30])), (2, " ".join(w)), (3, "a " * 30), (4, "w7 w7"), (5, " ".join(w[:12] + w[:12])), (6, " ".join(w[:9])), (7, "a " * 11 + " ".join(w[2:14])), (8, " ".join(w[3:17])), (9, " ".join(w[16:29]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    decontaminate.PAIRS, before = pairs, decontaminate.PAIRS
    rows = decontaminate.find(d.coalesce(1), b, part_bytes=part_bytes).collect() if part_bytes < 100 else None
    got = rows and sorted(((r.doc_id, m["at"], m["item"], m["words"]) for r in rows for m in r.matches), key=repr)
    if rows is None:  # in this process, so that PAIRS holds
        import pyarrow as pa

        needles = decontaminate.Needles([i for i, _ in bench], [t for _, t in bench])
        data, offsets = decontaminate.column_bytes(pa.array([t for _, t in docs]))
        longest = decontaminate.shard(data, offsets, needles)[3]
        got = sorted(((docs[r][0], at, needles.ids[i], n) for r, at, n, i in longest.T.tolist()), key=repr)
    decontaminate.PAIRS = before
    assert got == brute_matches(docs, bench)


def test_words_that_polynomials_take_for_equal(spark):
    from tests.llm.test_common import thue_morse

    for n in (1024, 4096):
        a, b = thue_morse(n)
        check(spark, [(1, a), (2, b), (3, f"x {a} y {b}")], [(1, a), (2, f"{b} z")])


def test_one_word_items_in_very_long_texts(spark):
    import time

    began = time.time()
    check(spark, [(1, "the " * 1000 + "end"), (2, None)], [(i, "the") for i in range(40)] + [(99, "the the the")])
    d = spark.createDataFrame([(1, "the " * 1_000_000)], "doc_id long, text string")
    r = decontaminate.find(d, spark.createDataFrame([(1, "the")], "item_id long, text string")).select("n_words", "n_hit").first()
    assert tuple(r) == (1_000_000, 1_000_000) and time.time() - began < 90


def test_longest_matches_and_removal(spark):
    d = spark.createDataFrame([(4, "zero " + LONG + " end", "s", True), (5, "clean text", None, False)], "doc_id long, text string, items string, contaminated boolean")
    b = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    r = decontaminate.find(d, b).where("doc_id = 4").first()
    assert [(m["item"], m["at"], m["words"]) for m in r.matches] == [("1", 1, len(LONG.split()))]
    left = decontaminate.decontaminate(d, b)
    assert left.columns == d.columns and [tuple(x) for x in left.collect()] == [(5, "clean text", None, False)]
