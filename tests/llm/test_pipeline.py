"""The pipeline against brute-force versions of its stages, each on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_decontaminate import brute as brute_hits  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_fp  # noqa: E402
from tests.llm.test_token_files import whole  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Copies, so that the second stage has work, and rows that repeat an id.
    docs = docs.union(docs.where("doc_id < 10").selectExpr("doc_id + 1000", "upper(text)", "lang", "source", "n_chars")).union(docs.where("doc_id = 20"))
    want = None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        after = rows(out)
        if name != "token_files":
            assert out.columns == docs.columns
            assert not Counter(after).keys() - Counter(before).keys()
        if name == "toxicity":
            assert len(after) > 0.8 * len(before)
        elif name == "simhash_near_dedup":
            ids = [(r[0], brute_fp(r[1])) for r in before]
            comp = brute_components(ids, 2)
            want = {(r[0], f[1]) for r, f, c in zip(before, ids, comp) if r[0] == c}
            assert sorted((r[0], brute_fp(r[1])) for r in after) == sorted(want)
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hits = brute_hits([(r[0], r[1]) for r in before], bench)
            assert after == [r for r in before if not hits[r[0]][0][4]]
        elif name == "mixing":
            n = Counter(after)
            assert max(n.values()) <= 2
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
            total, taken = sum(map(size, before)), sum(map(size, after))
            assert abs(taken - 1.5 * total) < 0.05 * total
        else:
            order = sorted(before, key=lambda r: r[0])
            start = 0
            for r, ids, d in zip(sorted(after, key=lambda r: r[1]), whole([r[1] for r in order]), order):
                assert r == (d[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                start += len(ids)
            assert len(after) == len(before)
        docs = out


def test_run_agrees_with_itself(spark):
    a, b = rows(corpus_pipeline.run(spark, SF)), rows(corpus_pipeline.run(spark, SF))
    assert a == b and a


ODD = [
    (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "plain words in a row " * 20, "en", None, None), (4, "plain words in a row " * 20, "en", "t", 5), (None, "text without an id but with words", "en", "s", 1),
    (5, "long " * 20_000, "en", "t", 1), (6, "same id, first text of two", "en", "s", 1), (6, "same id, second text of them", "fr", "t", 1), (7, "twice the very same row", "en", "s", 1), (7, "twice the very same row", "en", "s", 1),
]


@pytest.mark.parametrize("rows_", [ODD, []])
def test_odd_documents(spark, tmp_path, rows_):
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "same id second text of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        left = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = rows(left)
    assert len(seen["toxicity"]) == len(rows_)
    if rows_:
        assert sorted(repr(r[0]) for r in seen["simhash_near_dedup"]) == sorted(map(repr, [1, 3, None, 5, 6, 6, 7]))
        assert [r[1] for r in seen["decontamination"] if r[0] == 6] == ["same id, first text of two"]
        assert [r[0] for r in sorted(seen["token_files"], key=lambda r: r[1])] == sorted((r[0] for r in seen["mixing"]), key=lambda d: (d is not None, d))
