"""Operator 3: exact round trips, and the tokenizers library over whole texts."""

import zlib

import numpy as np
import pytest

from cairn.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    None, "", " \t\n", "Hello world, it's 2024! they'll've", "É è ç ñ ß Ø ÿ ÀB", "é å", "́x", "İstanbul ΣΑΣ ǅ", "日本語 テスト 😀😀", "a b c\u0085d",
    "x<|endoftext|>y <|startoftext|> <|end", "tab\x00nul\x1c\x1d\x7f soft­hyphen µ ª º ×÷", "'s't're 're'd 12345 3½ ²", "word " * 5000, "w" * 3000, "ﬁ ﬃ Ａ Ⅷ", "don't DON'T d'Or", "a\r\nb\x0bc\x0cd",
    "mixé3d_ca-se... ¿qué? «oui» “no”",
]


def test_words_give_the_library_s_ids():
    import pyarrow as pa

    from cairn.llm.common import column_bytes

    texts = ODD + ["".join(np.random.default_rng(i).choice(list("aéB ß'9.\t́st"), 60)) for i in range(200)]
    data, offsets = column_bytes(pa.array(texts))
    ids, lengths = token_files.encode_block(token_files.WordCoder(PATH), data, offsets)
    ends = np.cumsum(lengths)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
    for t, a, b in zip(texts, got, whole(texts)):
        assert a == b, repr(t)


def test_words_that_polynomials_take_for_equal_and_small_memories(monkeypatch):
    import pyarrow as pa

    from cairn.llm.common import column_bytes
    from tests.llm.test_common import thue_morse

    monkeypatch.setattr(token_files, "CACHE", 20)
    monkeypatch.setattr(token_files, "PIECE", 500)
    monkeypatch.setattr(token_files, "TOGETHER", 7)
    coder = token_files.WordCoder(PATH)
    texts = [" ".join(thue_morse(n)) for n in (1024, 2048, 4096)] + ODD * 2 + [" ".join(map(str, range(i, i + 40))) for i in range(0, 200, 9)]
    for t, want in zip(texts, whole(texts)):
        ids, lengths = token_files.encode_block(coder, *column_bytes(pa.array([t, t])))
        assert ids.tolist() == want * 2 and lengths.tolist() == [len(want)] * 2
        assert token_files.encode_block(coder, *column_bytes(pa.array([t])))[0].tolist() == want


def test_other_tokenizers_take_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from cairn.llm.common import column_bytes

    file = json.load(open(PATH))
    file["added_tokens"][0] |= {"content": "two words", "normalized": False}
    path = str(tmp_path / "other.json")
    json.dump(file, open(path, "w"))
    coder = token_files.WordCoder(path)
    assert not coder.by_word
    texts = ["it has two words in it", "", "two", "words two words"]
    ids, lengths = token_files.encode_block(coder, *column_bytes(pa.array(texts)))
    want = [e.ids + [2] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(100, 104, n), np.full(n, 7), np.where(rng.random(n) < 0.02, 2**32 - 1, 5), rng.integers(0, 2**32, n)):
        ids = ids.astype(np.uint32)
        image = token_files.write_image([5, None], np.array([1, n - 1]), ids)
        assert (token_files.read_ids(image) == ids).all()
        for a, b in ((0, 1), (n - 1, n), (n // 3, n // 2), (n // 2, n + 9), (n, n + 1)):
            assert (token_files.read_ids(image, a, b) == ids[a:b]).all()
        assert token_files.read_head(image)[0] == [5, None]


@pytest.mark.parametrize("shard_ids", [10, 1000, 1 << 20])
def test_documents_round_trip(spark, shard_ids, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][::-1]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(1003, ODD[3])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, ids string, part int")
    shards = token_files.write(df, PATH, shard_ids=shard_ids)
    rows = sorted(token_files.read(shards).collect(), key=lambda r: r.start)
    want = sorted(zip([d for d, _ in docs], whole([t for _, t in docs])))
    start = 0
    assert len(rows) == len(want)
    for r, (d, ids) in zip(rows, want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    if shard_ids > 10:
        files = token_files.export(shards, str(tmp_path))
        assert b"".join(token_files.read_ids(open(f, "rb").read()).tobytes() for f in files) == b"".join(np.array(i, dtype="<u4").tobytes() for _, i in want)


def test_empty(spark):
    assert token_files.read(token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []
