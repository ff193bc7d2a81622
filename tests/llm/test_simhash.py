"""Operator 7 against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, radius):
    parent = {i: i for i in range(len(pairs))}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(pairs):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(pairs))]


TEXTS = [None, "", " \n\t", "One", "one", "ONE two", "a b c", "A  b\tc", "é b c d", "É b c d", "x " * 5000, "same line\n" * 4000, "ÀB\x1c\x85c d e", "w" * 70_000 + " end of it"]


def test_small_texts(spark):
    rows = [(10 + i, t, i) for i, t in enumerate(TEXTS)] + [(3, "a b c", 0), (10, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_dedup(df).collect())
    pairs = [(d, brute_fp(t)) for d, t, _ in rows]
    assert got == sorted((d, f, c) for (d, f), c in zip(pairs, brute_components(pairs, 2)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_dedup(docs).collect())
    assert got == sorted((d, f, c) for (d, f), c in zip(rows, brute_components(rows, 2)))


@pytest.mark.parametrize("parts,tile", [(2, 64), (3, 7), (4, 1000)])
def test_links_join_what_all_pairs_join(spark, parts, tile):
    rng = np.random.default_rng(parts)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {0, 2**64 - 1, 1, 3, 7, 15}
    for s in seeds:  # chains and clusters of one and two flipped bits
        for _ in range(30):
            fps.add(int(s))
            s ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            if rng.random() < 0.5:
                s ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    ids = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in ids], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, 2, tile, parts=parts).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in edges)
    want = brute_components([(i, x) for i, x in enumerate(ids)], 2)
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a & (2**64 - 1)), find(b & (2**64 - 1))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(x), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i, c in enumerate(want) if c == k) for k in set(want)}


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1005), (1005, 1002)]
    nodes = spark.createDataFrame([(i,) for i in [*range(301), 1000, 1002, 1005, 5000]], "node long")
    got = {r.node: r.root for r in simhash.components(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1002] == got[1005] == 1000 and got[5000] == 5000


def test_rows_that_repeat_an_id_leave_one_row_always_the_same(spark):
    a, b = "one two three four five six", "nothing like the other text at all"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (1, a, "x"), (1, a + " ", "z"), (2, a, "q"), (3, "another one of its own", "x")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        out = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()
        seen.add(tuple(sorted(map(tuple, out))))
        assert [r.doc_id for r in sorted(out)] == [1, 1, 3] and {r.text.strip() for r in out} == {a, b, rows[-1][1]}
    assert len(seen) == 1


def test_components_of_a_chain_that_takes_many_rounds(spark, monkeypatch):
    """No bound on rounds: a component is found however long its chain, in any order of its nodes."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(400).tolist()
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    assert {r.root for r in simhash.components(nodes, chain).collect()} == {0}


def test_a_hot_group_gives_a_forest_only():
    a = np.arange(4096, dtype=np.uint64) & np.uint64(3)
    x, y = simhash.forest(a, None, 2)
    assert len(x) == len(a) - 1


def test_empty(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
