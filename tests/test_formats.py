"""Binary formats, envelopes, chunkers and shapes: round trips, goldens and broken inputs."""

import gzip
import hashlib
import hmac
import plistlib
import random
import shutil
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from cairn.functions import envelope as env
from cairn.functions import skeleton
from cairn.operators import ingest
from cairn.plans import validate
from cairn.sources import formats, legacy

MAGIC, KEY = b"OBJ1", bytes(range(32))


def seal(body=b"", size=32, key=KEY):
    rest = bytes(16) + bytes(64) + body.ljust(size, b"\7")
    return MAGIC + hmac.new(key, rest, hashlib.sha256).digest() + rest


def test_mac_as_column_and_as_arrow_function(spark):
    good = seal(b"hello")
    rows = [(0, good, True), (1, good[:-1] + b"x", False), (2, b"OBJ2" + good[4:], False), (3, good[:50], False), (4, None, False), (5, b"", False)]
    df = spark.createDataFrame(rows, "i int, e binary, want boolean")
    got = df.select("i", "want", env.envelope_ok(F.col("e"), MAGIC, KEY).alias("a"), env.verifier(spark, MAGIC, KEY)("e").alias("b"))
    assert all(r.a == r.b == r.want for r in got.collect())
    long_key = b"k" * 100
    assert spark.range(1).select(env.hmac_sha256(long_key, F.lit(b"abc")).alias("h")).first().h == hmac.new(long_key, b"abc", hashlib.sha256).hexdigest()


@pytest.mark.skipif(not shutil.which("openssl"), reason="needs openssl to build the envelope")
def test_two_layers_of_decryption(spark):
    def aes(data, key, iv):
        return subprocess.run(["openssl", "enc", "-aes-256-cbc", "-K", key.hex(), "-iv", iv.hex()], input=data, capture_output=True, check=True).stdout

    master, data_key, iv, data_iv = b"m" * 32, b"d" * 32, b"i" * 16, b"j" * 16
    plain = b"the plaintext" * 9
    sealed = MAGIC + bytes(32) + iv + aes(data_iv + data_key, master, iv) + aes(plain, data_key, data_iv)
    df = spark.createDataFrame([(sealed,), (sealed[:-16] + bytes(16),), (b"short",), (None,)], "e binary")
    assert [None if r.p is None else bytes(r.p) for r in df.select(env.decrypted(F.col("e"), master).alias("p")).collect()] == [plain, None, None, None]


def test_compression(spark):
    block = struct.pack(">I", 21) + bytes([0x54]) + b"hello" + struct.pack("<H", 5) + bytes([0x80]) + b"literals"
    assert env.lz4_decode(block) == b"hello" + b"hellohel" + b"literals"
    run = struct.pack(">I", 1 + 4 + 15 + 255 + 10) + bytes([0x1F]) + b"a" + struct.pack("<H", 1) + bytes([255, 10])
    assert env.lz4_decode(run) == b"a" * (1 + 4 + 15 + 255 + 10)
    for bad in (b"", block[:-1], block[:8], struct.pack(">I", 9) + bytes([0x10]) + b"a" + struct.pack("<H", 7)):
        with pytest.raises(ValueError):
            env.lz4_decode(bad)
    rows = [(b"x", 0), (gzip.compress(b"y"), 1), (run, 2), (run, None), (b"z", 9), (b"not gzip", 1), (None, 0)]
    got = spark.createDataFrame(rows, "d binary, c int").select(env.decompressed()("d", "c").alias("r")).select("r.*").collect()
    assert [None if r["data"] is None else bytes(r["data"])[:1] for r in got] == [b"x", b"y", b"a", b"a", None, None, None]
    assert "unknown" in got[4]["error"] and got[5]["error"]


def entry(name, version, tree=False, chunks=2):
    loc = {"blob_id": "ab" * 32, "is_packed": True, "is_large_pack": False, "rel_path": "p/é", "offset": 7, "length": 2**40, "stretch": True, "compression": 2}
    e = {n: (3 if k in "QqIi" else "u" if k == "s" else False) for n, k in formats._STAT}
    return e | {"name": name, "is_tree": tree, "tree": loc if tree else None, "os_type": 1, "data": [] if tree else [loc] * chunks, "acl": loc if chunks == 1 else None, "xattrs": [loc], "mtime_nsec": 999_999_999, "mtime_sec": -5, "username": None,
                "reparse_tag": 4 if version >= 2 else None, "reparse_is_dir": True if version >= 2 else None, "trailer": b"t" * 38 if version >= 4 else None}


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_trees_round_trip(spark, version):
    entries = [entry("a", version), entry("dir", version, tree=True), entry("日本", version, chunks=1), entry("", version, chunks=0)]
    raw = formats.write_tree(entries, version)
    assert formats.write_tree(list(formats.read_tree(raw)), version) == raw
    df = spark.createDataFrame([("t", raw), ("cut", raw[:-3]), ("none", b"")], "tree_id string, content binary")
    rows = formats.tree_entries(df, "tree_id", "content").collect()
    t = [r for r in rows if r.tree_id == "t"]
    assert [r.name for r in t] == ["a", "dir", "日本", ""] and all(r.error is None and r.version == version for r in t)
    assert t[0].mtime_nsec == 999_999_999 and t[0].mtime_sec == -5 and t[0].username is None and len(t[0].data) == 2 and t[1].tree.length == 2**40
    assert [r.name for r in rows if r.tree_id == "cut"] == ["a", "dir", "日本", None] and [r.error for r in rows if r.tree_id == "none"] == ["cut off"]
    back = validate.round_trips(df.where("tree_id <> 'none'"), "content", lambda x: formats.write_tree(x, version), lambda b: list(formats.read_tree(b))).collect()
    assert {r.tree_id: r.same for r in back} == {"t": True, "cut": False}


def test_packs(spark):
    a, b = seal(b"one", 32), seal(b"x" * 20 + MAGIC + b"y" * 40, 64)
    packs = [("ok", a + b + a), ("torn", a + b[:120]), ("head", a + a[:50]), ("bad", b"zz" + a), ("empty", b"")]
    df = spark.createDataFrame(packs, "path string, content binary")
    entries = formats.pack_entries(df, MAGIC)
    rows = entries.collect()
    of = lambda p: [(r.offset, r.length, r.truncated) for r in rows if r.path == p]
    assert of("ok") == [(0, len(a), False), (len(a), len(b), False), (len(a) + len(b), len(a), False)]
    assert of("torn") == [(0, len(a), False), (len(a), 120, True)] and of("head")[-1] == (len(a), 50, True) and of("empty") == []
    assert [r.error for r in rows if r.path == "bad"] == ["no magic at the start"]
    s = {r.path: r for r in formats.pack_summary(entries.where("error is null")).collect()}
    assert (s["ok"].entries, s["ok"].truncated, s["ok"].bytes, s["ok"].largest) == (3, 0, 2 * len(a) + len(b), len(b)) and s["torn"].truncated == 1
    refs = spark.createDataFrame([("ok", len(a), len(b)), ("gone", 0, 1)], "rel_path string, offset long, length long")
    got = {r.rel_path: r.bytes for r in formats.fetch(refs, df).collect()}
    assert bytes(got["ok"]) == b and got["gone"] is None


def test_legacy_index_and_pack(spark):
    rows = sorted((hashlib.sha1(bytes([i])).digest(), i * 10, i) for i in range(30))
    body = struct.pack(">II", 0xFF744F63, 2) + struct.pack(">256I", *[sum(r[0][0] <= b for r in rows) for b in range(256)]) + b"".join(struct.pack(">QQ", o, n) + d + bytes(4) for d, o, n in rows)
    assert legacy.read_index(body + hashlib.sha1(body).digest()) == [(d.hex(), o, n) for d, o, n in rows]
    table = spark.createDataFrame([(d.hex(),) for d, _, _ in rows], "sha1 string")
    assert [r.upto for r in legacy.fanout(table).orderBy("byte").collect()] == list(struct.unpack_from(">256I", body, 8))
    with pytest.raises(ValueError):
        legacy.read_index(body + bytes(20))
    pack = b"PACK" + struct.pack(">IQ", 2, 2) + b"\0" + b"\1" + struct.pack(">Q", 1) + b"n" + struct.pack(">Q", 3) + b"abc" + b"\0\0" + struct.pack(">Q", 0)
    assert legacy.read_pack(pack + hashlib.sha1(pack).digest()) == [(None, "n", b"abc"), (None, None, b"")]
    for bad in (pack + bytes(20), (pack + b"x") + hashlib.sha1(pack + b"x").digest()):
        with pytest.raises(ValueError):
            legacy.read_pack(bad)


@pytest.mark.parametrize("version", [10, 11, 12, 14, 15, 16, 17, 18, 19, 22])
def test_legacy_trees_round_trip(spark, version):
    key = {"sha1": "ab" * 20, "stretch": True, "storage": 2, "archive_id": None, "archive_size": 5, "archive_uploaded": 1234}
    node = {"is_tree": False, "data_keys": [key, key], "data_size": 9, "mtime_sec": -1, "mode": 0o644, "xattrs_key": key, "finder_type": "x", "data_compression": 1, "st_ino": 7}
    row = {"version": version, "uid": 5, "mtime_sec": 3, "nodes": [{"name": "é", "node": node}, {"name": "d", "node": {"is_tree": True}}], "missing": [{"name": "m", "node": node}], "aggregate_size": 8}
    raw = legacy.write_object(row, "tree")
    again = legacy.read_object(raw, "tree")
    assert legacy.write_object(again, "tree") == raw and again["nodes"][0]["node"]["data_size"] == 9
    rows = legacy.legacy_entries(spark.createDataFrame([("t", raw), ("cut", raw[:-2]), ("v", b"TreeV013")], "k string, c binary"), "k", "c").collect()
    t = [r for r in rows if r.k == "t"]
    assert [(r.name, r.is_tree, len(r.data)) for r in t] == [("é", False, 2), ("d", True, 0)] and t[0].compression == (1 if version >= 12 else 0)
    assert {r.k for r in rows if r.error} == {"cut", "v"}


@pytest.mark.parametrize("version", range(3, 12))
def test_legacy_commits_round_trip(version):
    row = {"version": version, "author": "a", "parents": [{"sha1": "p", "stretch": True}], "tree_sha1": "t", "tree_compression": 2, "created": 99, "failed": [{"path": "x", "error": None}], "is_complete": True, "bucket_xml": b"<x/>", "app_version": "5"}
    raw = legacy.write_object(row, "commit")
    again = legacy.read_object(raw, "commit")
    assert legacy.write_object(again, "commit") == raw and again["created"] == 99 and again["tree_sha1"] == "t" and again["bucket_xml"] == b"<x/>"


def test_attributes(spark):
    pairs = [("user.b", b"1"), ("user.a", b""), ("é", bytes(300))]
    raw = legacy.write_attributes(pairs)
    assert legacy.read_attributes(raw) == pairs and legacy.write_attributes([]) == b"" and legacy.read_attributes(b"") == []
    plist = plistlib.dumps({"a": b"x", "b": "y", "c": 3}, fmt=plistlib.FMT_BINARY)
    df = spark.createDataFrame([(1, raw), (2, plist), (3, raw[:-1]), (4, b"???"), (5, None)], "i int, c binary")
    got = legacy.attributes(df, "i", "c").collect()
    assert [r.name for r in got if r.i == 1] == ["user.b", "user.a", "é"] and [bytes(r.value) for r in got if r.i == 2] == [b"x", b"y"] and {r.i for r in got if r.error} == {3, 4}


def test_chunker_is_loss_free_and_rolls():
    r = random.Random(1)
    c = ingest.Buzhash(tuple(r.getrandbits(32) for _ in range(256)), window=16, bits=6, least=32, most=256)
    for data in (b"", b"x", bytes(31), bytes(32), bytes(33), bytes(5000), r.randbytes(20_000)):
        ends = list(c.cuts(data))
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(data) and all(32 <= s <= 256 for s in sizes[:-1]) and (not sizes or sizes[-1] <= 256)
        for a, b in zip([0, *ends], ends[:-1]):  # a cut is where the fresh hash of the window ends in zeros, or the limit
            assert b - a == 256 or c.hash(data[b - 16 : b]) & 63 == 0
            assert all(c.hash(data[e - 16 : e]) & 63 for e in range(a + 32, b))
    data = r.randbytes(20_000)
    edited = data[:9000] + b"!" + data[9000:]
    pieces = lambda d: {d[a:b] for a, b in zip([0, *c.cuts(d)], c.cuts(d))}
    assert len(pieces(data) & pieces(edited)) > 0.8 * len(pieces(data))
    table = tuple(range(256))
    assert ingest.variant(9, False, table) == ingest.Buzhash(table) and ingest.variant(3, True, table).window == 256
    ingest.register_variant(7, False, bits=9)
    assert ingest.variant(7, False, table).bits == 9


def test_first_difference(spark):
    df = spark.createDataFrame([(b"abc", b"abd"), (b"abc", b"abc"), (b"ab", b"abc"), (None, b"")], "a binary, b binary")
    assert [r.d for r in df.select(env.first_difference()("a", "b").alias("d")).collect()] == [2, None, 2, None]


def test_shapes(spark):
    u, v = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "0" * 12
    doc = {"a": 1, "b": {"c": [], "d": {"e": {"f": 1}}}, "l": [{"x": None}, 3], "m": {u: {"k": True}, v: {"k": False}}, "n": {u: {"k": 1}, v: {"z": 1}}}
    rows = dict(skeleton.shape(doc))
    assert rows["/a"] == "int" and rows["/b/c"] == "list" and rows["/b/d/e"] == "dict" and rows["/l[]/x"] == "null" and rows["/m/<uuid>/k"] == "bool" and f"/n/{u}/k" in rows and "/n/<uuid>/k" not in rows
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "[1]"), (3, "{"), (4, None)], "i long, t string")
    assert sorted((r.i, r.json_path, r.type) for r in skeleton.shapes(df, "i", "t").collect()) == [(1, "/a", "int"), (2, "", "invalid"), (3, "", "invalid"), (4, "", "invalid")]
