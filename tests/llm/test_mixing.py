"""Operator 9: targets and ranks against plain loops, and the promises of the mix."""

import hashlib
import re

import pytest

from cairn.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    assert len(rows) == len(docs)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    # From the definition: what stays below the target is less than any document that could be taken once more.
    for s in sizes:
        certain = int(target[s] / sizes[s]) if sizes[s] else 0
        more = [x.size for x in rows if x.source == s and x.size and x.copies == certain]
        gap = target[s] - taken[s]
        assert -1e-6 * target[s] <= gap and (not more or gap < max(more) + 1)


def brute(docs, seed="mix-1:"):
    """Copies by a walk down the ranks, document by document."""
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    out = {}
    for s, target in brute_targets(sizes).items():
        mine = [(d, size(t)) for d, t, x in docs if x == s]
        certain = int(target / sizes[s]) if sizes[s] else 0
        left = target - certain * sizes[s]
        low, high = 0.0, 1.0
        while sum(min(1, high * z) * z for _, z in mine) < left and high < 1e9:
            high *= 2
        for _ in range(200):  # the factor by bisection of its definition
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(1, mid * z) * z for _, z in mine) < left else (low, mid)
        p = {d: min(1, high * z) for d, z in mine}
        copies = {d: certain for d, _ in mine}
        order = []
        for d, z in mine:
            if left > 1e-9 and p[d] >= 1 - 1e-9:
                copies[d] += 1
                left -= z
            elif left > 1e-9 and z:
                u = (int(hashlib.md5(f"{seed}{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append((u / (1 - u) / (p[d] / (1 - p[d])), d, z))
        for _, d, z in sorted(order):
            if z <= left:
                copies[d] += 1
                left -= z
        out |= copies
    return out


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    rows = mixing.mix(df).collect()
    check(rows, docs)
    assert {r.doc_id: r.copies for r in rows} == brute(docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    assert len({round(r.chance, 9) for r in rows if r.source == rows[0].source}) > 10


def test_inclusion_frequencies(spark):
    """Sources that are alike but for their random numbers: each size is taken as often as its chance says."""
    sizes = [1 + (i * i) % 97 for i in range(1200)] + [900]
    names = [f"s{k:03d}" for k in range(45)]
    docs = [(k * 10000 + i, "w " * z, s) for k, s in enumerate(names) for i, z in enumerate(sizes)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    groups = {}
    for r in rows:
        certain = int(r.target / r.source_size)
        groups.setdefault((round(r.target), r.size), []).append((r.copies - certain, r.chance))
    assert len({t for t, _ in groups}) >= 2
    for (_, z), x in groups.items():
        p, f = x[0][1], sum(c for c, _ in x) / len(x)
        assert all(q == pytest.approx(p) for _, q in x)
        if p in (0, 1):
            assert f == p
        else:  # a few small ones a source close the gaps, and are taken somewhat more often
            assert -4 * (p * (1 - p) / len(x)) ** 0.5 < f - p < 0.03 + 4 * (p * (1 - p) / len(x)) ** 0.5, (z, p, f)
    unequal = [sum(c for c, _ in x) / len(x) for (t, z), x in sorted(groups.items()) if 0 < x[0][1] < 1]
    assert max(unequal) > 3 * min(unequal)


def test_odd_sources(spark):
    docs = [(i, "w " * (i % 40), f"s{i % 4}") for i in range(400)] + [(1000, None, "s0"), (1001, "", "empty"), (1002, " \n", None), (1003, "a b c", None), (1004, "x " * 9000, "big"), (3, "w " * 3, "s3")]
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in docs], "doc_id long, text string, source string, size int")
    check(mixing.mix(df).collect(), docs)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    total = sum(size(t) for _, t, _ in docs)
    assert abs(sum(size(r.text) for r in out.collect()) - sum(r.taken for r in mixing.mix(df).collect())) <= 6 and total


def test_rows_that_repeat_are_taken_alike(spark):
    docs = [(1, "a b c", "s")] * 3 + [(2, "x " * 5, "s"), (2, "y " * 5, "s"), (None, "z z", None), (None, "z z", None)] + [(i, "w " * i, "t") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    check(rows, docs)
    assert all(len({r.copies for r in rows if (r.doc_id, r.size, r.source) == (a.doc_id, a.size, a.source)}) == 1 for a in rows)
    assert mixing.mixed_rows(df).count() == sum(r.copies for r in rows)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
