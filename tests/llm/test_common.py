"""Shared kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import common

TEXTS = ["", None, "a", " a  b\t", "é x\x85y z", "ABC-123 äö", "\n\n", "x" * 5000 + " y", "日本 語", "end"]


@pytest.mark.parametrize("keep,pattern", [(common.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (common.ALNUM, rb"[0-9a-z\x80-\xff]+")])
def test_words(keep, pattern):
    data, offsets = common.column_bytes(pa.array(TEXTS))
    for limit in (1, 7, 1 << 20):
        got = []
        for a, b in common.blocks(offsets, limit):
            body = data[offsets[a] : offsets[b]]
            starts, ends, first = common.words(data, offsets[a : b + 1], keep)
            for i in range(b - a):
                got.append([bytes(body[s:e]) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])])
        assert got == [re.findall(pattern, (t or "").encode()) for t in TEXTS]


def test_column_slices_and_kinds():
    for column in (pa.array(TEXTS), pa.array(TEXTS, pa.large_string()), pa.array(TEXTS).dictionary_encode(), pa.array(["skip", *TEXTS])[1:]):
        data, offsets = common.column_bytes(column)
        assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in TEXTS]
    data, offsets = common.column_bytes(pa.array([], pa.string()))
    assert len(offsets) == 1 and list(common.blocks(offsets)) == []


def test_hashes_depend_on_content_alone():
    body = np.frombuffer(b"abc x abc abcd abc", dtype=np.uint8)
    starts, ends, _ = common.words(body, np.array([0, len(body)]), common.NOT_SPACE)
    for second in (False, True):
        h = common.word_hashes(body, starts, ends, second)
        assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
        g = common.gram_hashes(np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], dtype=np.uint64), 3, second)
        assert g[0] == g[3] and len(set(g.tolist())) == 4
    assert len(common.gram_hashes(h, 9)) == 0


def thue_morse(n):
    """A word of n letters and its complement; polynomials modulo 2**64 take them for equal from 1024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 2048, 4096])
def test_hashes_share_no_algebra(n):
    a, b = thue_morse(n)
    body = np.frombuffer(f"{a} {b} {a}".encode(), dtype=np.uint8)
    starts, ends, _ = common.words(body, np.array([0, len(body)]), common.NOT_SPACE)
    for second in (False, True):
        h = common.word_hashes(body, starts, ends, second)
        assert h[0] == h[2] != h[1]
        x, y = h[0], h[1]
        one = np.where(np.array([c == "a" for c in a]), x, y)
        two = np.where(np.array([c == "a" for c in a]), y, x)
        assert common.gram_hashes(one, n, second)[0] != common.gram_hashes(two, n, second)[0]


@pytest.mark.parametrize("k", range(1, 34))
def test_grams_tell_every_word(k):
    rng = np.random.default_rng(k)
    h = rng.integers(0, 2**63, 100, dtype=np.uint64)
    for second in (False, True):
        g = common.gram_hashes(h, k, second)
        assert len(g) == 101 - k and len(set(g.tolist())) == len(g)
        for i in range(40, 40 + k):
            changed = h.copy()
            changed[i] += np.uint64(1)
            now = common.gram_hashes(changed, k, second)
            assert np.flatnonzero(now != g).tolist() == list(range(max(0, i - k + 1), min(len(g) - 1, i) + 1))


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    df = spark.createDataFrame([(i, "x" * (i % 7) * 100) for i in range(200)], "k long, t string").coalesce(1)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x) for x in b.column(1).to_pylist())])], names=["n", "bytes"])

    conf = spark.conf.getAll
    rows = common.bounded_batches(df, run, "n long, bytes long").collect()
    assert sum(r.n for r in rows) == 200 and len(rows) > 20 and spark.conf.getAll == conf


def test_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = [r.k for r in common.smallest_hashes(df, "k", 100).collect()]
    assert len(a) == len(set(a)) == 100 and a == [r.k for r in common.smallest_hashes(df.repartition(7), "k", 100).collect()]
    assert common.smallest_hashes(df, "k", 9000).count() == 5000 and common.smallest_hashes(df.limit(0), "k", 5).count() == 0
