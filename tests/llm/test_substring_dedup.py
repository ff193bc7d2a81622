"""Operator 10 against a brute-force version."""

import hashlib
import random
import re

import pytest

from cairn.llm import substring_dedup as sd


def brute(docs, window=20):
    toks = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in toks:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            p = (float("inf") if d is None else d, i)
            first[k] = min(first.get(k, p), p)
    out = []
    for d, w in toks:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "Straße", "x,"]
    passage = [r.choice(vocab) for _ in range(70)]
    docs = []
    for i in range(n):
        w = [r.choice(vocab) + str(r.randrange(50)) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            a = r.randrange(0, 50)
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[a : a + r.randrange(15, 60)]
        if docs and r.random() < 0.3:
            w = re.findall(r"\S+", r.choice(docs)[1])
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = "edited"
        docs.append((i * 3 + 5, r.choice([" ", "\n", "  \t"]).join(w)))
    r.shuffle(docs)
    return docs


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 19), (5, "word " * 20), (6, "word " * 21), (7, "word " * 400), (8, "a b c " * 60), (9, "b c a " * 60),
    (10, " ".join(f"t{i}" for i in range(4000))), (11, " ".join(f"t{i}" for i in range(3000, 5000))), (12, "x" * 90_000), (None, "word " * 30), (14, "\x1c ".join(f"t{i}" for i in range(100))),
]


@pytest.mark.parametrize("batches,seed", [(1, 1), (2, 2), (5, 3)])
def test_random_corpora(spark, batches, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, at int, key string")
    assert got(sd.substring_dedup(df, batches=batches)) == brute(docs)


def test_odd_texts_and_repeated_ids(spark):
    docs = ODD + [(10, ODD[9][1]), (6, "word " * 25), (6, "word " * 21)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(sd.substring_dedup(df)) == brute(docs)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(sd.substring_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == brute(docs)


def test_small_windows(spark):
    docs = corpus(9, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(sd.substring_dedup(df, window=8, gram=3)) == brute(docs, 8)


def test_compaction_keeps_results(spark):
    docs = corpus(4, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    d = sd._prepared(df, "doc_id", "text")
    index = sd.Index(spark, fanout=2, buckets=3)
    ids = sorted(i for i, _ in docs)
    gone = {}
    for k in range(0, 40, 10):
        for r in index.add(d.where((d.doc >= ids[k]) & (d.doc <= ids[k + 9])).select("doc", "tag", "text")).collect():
            a, n = r["at"] >> 6, (r["at"] >> 1) & 31
            gone.setdefault(r.doc, set()).update(range(a, a + n + 19))
        assert len(index.runs) <= 2
    assert {d: len(gone.get(d, ())) for d, _ in docs} == {d: n for d, _, n, _ in brute(docs)}


def test_windows_are_compared_once_and_no_run_is_merged_in_vain(spark, monkeypatch):
    docs, calls = corpus(6, 40), []
    hashes, compact = sd.window_hashes, sd.Index.compact
    monkeypatch.setattr(sd, "window_hashes", lambda *a: calls.append("windows") or hashes(*a))
    monkeypatch.setattr(sd.Index, "compact", lambda self: calls.append("compact") or compact(self))
    assert got(sd.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert calls == ["compact", "windows"]  # three batches: a merge before the third, none after it


@pytest.mark.parametrize("every", [1, 2, 3])
def test_batches_compared_late_or_at_once(spark, every):
    docs = corpus(8, 36) + [(5, "word " * 30), (5, "word " * 30)]
    d = sd._prepared(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    index, ids, gone = sd.Index(spark, buckets=3), sorted({i for i, _ in docs}), {}
    for k in range(0, 36, 6):
        found = index.insert(d.where((d.doc >= ids[k]) & (d.doc <= ids[k + 5])).select("doc", "tag", "text")).collect()
        if k // 6 % every == every - 1:
            found += index.windows().collect()
        for r in found:
            a, n = r["at"] >> 6, (r["at"] >> 1) & 31
            gone.setdefault((r.doc, r.tag), set()).update(range(a, a + n + 19))
    index.close()
    tags = [(r.doc, r.tag, r.text) for r in d.collect()]
    assert sorted((i, len(gone.get((i, t), ()))) for i, t, _ in tags) == sorted((i, n) for i, _, n, _ in brute([(i, x) for i, _, x in tags]))


@pytest.mark.parametrize("null", [2, 3, 1])
def test_many_null_ids(spark, null):
    docs = [(None if k % 3 < null else i, t) for k, (i, t) in enumerate(corpus(7, 45))]
    assert got(sd.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_rightmost_least():
    r = sd.np.random.default_rng(1)
    for n in (0, 1, 13, 14, 90):
        for k in (1, 2, 3, 6, 14):
            x = r.integers(0, 5, n).astype("uint64")
            want = [max(range(i, i + k), key=lambda j: (-int(x[j]), j)) for i in range(n - k + 1)]
            assert sd._rightmost_least(x, k).tolist()[: len(want)] == want


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_take_for_equal(spark, n):
    from tests.llm.test_common import thue_morse

    w = [f"t{i}" for i in range(26)]
    docs = [(i, " ".join([*w[:12], x, *w[13:]])) for i, x in enumerate(thue_morse(n))]
    assert got(sd.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_tasks_remember_the_smallest_place(monkeypatch):
    monkeypatch.setattr(sd, "REMEMBERED", 4)
    seen, r = sd._Seen(), random.Random(2)
    least = {}
    for _ in range(60):
        rows = sorted({(k, k * 2, k * 3): (r.randrange(50), r.randrange(9)) for k in r.choices(range(6), k=4)}.items())
        table = sd.np.array([[*a, *b] for a, b in rows], dtype=sd.np.int64).T
        for (k, place), settled in zip(rows, seen.earlier(table)):
            assert not settled or least[k] < place
            least[k] = min(least.get(k, place), place)


def test_texts(spark):
    t = " ".join(f"t{i}" for i in range(40))
    rows = sd.substring_dedup(spark.createDataFrame([(1, t), (2, "new " + t + " end")], "doc_id long, text string"), texts=True).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: None, 2: "new end"}


def test_empty(spark):
    assert sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
