"""Operator 6 against a brute-force version, with weak digests, and over several runs of the stream."""

import hashlib
import re

import pytest

from cairn.llm import exact_dedup as ed

TEXTS = [(5, "a b"), (3, "a  b"), (9, "ab\n"), (4, "ab"), (1, None), (2, ""), (8, " \t\n\x0b\x0c\r"), (7, "a b"), (6, "A b"), (10, "é" * 1000), (11, "é " * 1000), (12, "x\x00y"), (13, "xy"), (3, "a  b"), (None, "a  b"), (14, "w " * 50_000)]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, g in groups.items():
        g.sort()
        for i, x in enumerate(g):
            out.append((x[3], g[0][3], len(g), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [256, 4])
def test_rows(spark, tmp_path, bits):
    df = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(TEXTS)], "doc_id long, text string, digest string, rank int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(ed.exact_dedup(spark, f"{tmp_path}/documents.parquet", digest_bits=bits)) == brute(TEXTS)


def test_a_path_may_end_with_a_slash(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(ed.exact_dedup(spark, f"{tmp_path}/documents.parquet/")) == brute(TEXTS)


def test_stream_resumes(spark, tmp_path):
    path, state = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    for rows in (TEXTS[:6], TEXTS[6:]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        latest = ed.dedup_stream(spark, path, state)
    sizes = sorted(r.group_size for r in latest.collect())
    assert sum(sizes) == len(TEXTS) and sizes == sorted(r[2] for r in brute(TEXTS) if r[3])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ed.exact_dedup(spark, f"{tmp_path}/documents.parquet").collect() == []


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("bits", [256, 4])
def test_texts_of_single_rows_are_dropped_before_the_shuffle(spark, tmp_path, monkeypatch, shuffled, bits):
    keys = ["spark.sql.parquet.columnarReaderBatchSize", *(f"spark.sql.optimizer.runtime.bloomFilter.{k}" for k in ("enabled", "applicationSideScanSizeThreshold", "creationSideThreshold"))]
    before = [spark.conf.get(k, None) for k in keys]
    plans, batches, write = {}, [], ed.materialize

    def watched(df, name, root=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        batches.append(int(spark.conf.get(keys[0])))
        return write(df, name, root)

    monkeypatch.setattr(ed, "materialize", watched)
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(ed.exact_dedup(spark, f"{tmp_path}/documents.parquet", digest_bits=bits)) == brute(TEXTS)
    assert "might_contain" in plans["hits"].partition("Exchange")[2]
    assert min(batches) < 4096 and [spark.conf.get(k, None) for k in keys] == before


def loaded_stores(spark):
    """The state stores that this machine's process holds open."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    field = kind.getDeclaredField("loadedProviders")
    field.setAccessible(True)
    return field.get(kind.getField("MODULE$").get(None)).size()


def test_no_store_stays_open(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = loaded_stores(spark)
    ed.dedup_stream(spark, f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state").collect()
    assert loaded_stores(spark) <= before


def test_batches_and_a_state_of_earlier_settings(spark, tmp_path, monkeypatch):
    path, state = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    monkeypatch.setattr(ed, "FILES_PER_BATCH", 1)
    for i, t in enumerate(TEXTS):
        spark.createDataFrame([t], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        if i == 1:
            with monkeypatch.context() as m:
                m.setattr(ed, "STORE", {k: v for k, v in ed.STORE.items() if "changelog" not in k and "unload" not in k})
                ed.dedup_stream(spark, path, state)
    latest = ed.dedup_stream(spark, path, state)
    assert latest.agg({"group_size": "sum"}).first()[0] == len(TEXTS)
    assert sorted(r.group_size for r in latest.collect()) == sorted(r[2] for r in brute(TEXTS) if r[3])
