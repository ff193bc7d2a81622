"""Keysets, encrypted documents and packs, and the rule table, on a small synthetic store."""

import hashlib
import hmac
import json
import plistlib
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.plans import invariants
from cairn.sources import formats, keyset, store

CU, FOLDER = "AAAAAAAA-0000-0000-0000-000000000001", "BBBBBBBB-0000-0000-0000-000000000002"
KEYS = keyset.Keyset(bytes(range(32)), bytes(range(50, 82)), b"s" * 32)


def sealed(spark, plain: bytes, keys=KEYS) -> bytes:
    """An object: magic | mac | iv | sealed session | ciphertext."""
    iv, data_iv, session = b"i" * 16, b"d" * 16, b"k" * 32
    inner = keyset._cipher(spark, 1, keys.encryption_key, iv, data_iv + session)
    body = iv + inner + keyset._cipher(spark, 1, session, data_iv, plain)
    return keyset.OBJECT_MAGIC + hmac.new(keys.hmac_key, body, hashlib.sha256).digest() + body


def keyset_file(spark, password: str, keys=KEYS) -> bytes:
    salt, iv = b"saltsalt", b"v" * 16
    key, mac_key = keyset.derived(password, salt)
    plain = struct.pack(">I", 3) + b"".join(struct.pack(">Q32s", 32, f) for f in (keys.encryption_key, keys.hmac_key, keys.salt))
    body = keyset._cipher(spark, 1, key, iv, plain)
    return keyset.KEYSET_MAGIC + salt + hmac.new(mac_key, iv + body, hashlib.sha256).digest() + iv + body


def lz4(data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + pa.compress(data, codec="lz4_raw", asbytes=True)


VALUES = {"int": 2, "str": "x", "bool": True, "list": [], "dict": {}}


def documents():
    plan = {k: VALUES[t] for k, t in invariants.PLAN.items()}
    plan |= {"scheduleJSON": dict.fromkeys(invariants.SCHEDULES["Daily"], 1) | {"type": "Daily"}, "transferRateJSON": dict.fromkeys(invariants.TRANSFERS["Always"], 1) | {"scheduleType": "Always"},
             "emailReportJSON": dict.fromkeys(invariants.REPORTS["mail"], 1), "backupFolderPlansByUUID": {FOLDER: dict.fromkeys(invariants.FOLDER_PLAN, 1)}}
    record = dict.fromkeys(invariants.RECORD, "x") | {"version": 101, "isComplete": True, "node": {"isTree": True, "treeBlobLoc": {"blobIdentifier": "a"}}}
    return {"config": {k: VALUES[t] for k, t in invariants.CONFIG.items()}, "plan": plan, "index": dict.fromkeys(invariants.FOLDER_INDEX, []), "folder": dict.fromkeys(invariants.FOLDER, 1), "record": record}


def write(spark, root, docs, objects=(b"first", b"second" * 500), spoil=False):
    def put(path, data):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)

    put(f"{CU}/encryptedkeyset.dat", keyset_file(spark, "secret"))
    put(f"{CU}/backupconfig.json", json.dumps(docs["config"]).encode())
    put(f"{CU}/backupplan.json", sealed(spark, json.dumps(docs["plan"]).encode()))
    put(f"{CU}/backupfolders.json", json.dumps(docs["index"]).encode())
    put(f"{CU}/backupfolders/{FOLDER}/backupfolder.json", sealed(spark, json.dumps(docs["folder"]).encode()))
    put(f"{CU}/backupfolders/{FOLDER}/backuprecords/00017/0000010.backuprecord", sealed(spark, lz4(plistlib.dumps(docs["record"], fmt=plistlib.FMT_BINARY))))
    for i, data in enumerate(objects):
        name = hashlib.sha256(KEYS.salt + data).hexdigest()
        made = sealed(spark, lz4(data))
        put(f"{CU}/standardobjects/{name[:2]}/{name[2:]}", made[:-1] + bytes([made[-1] ^ 1]) if spoil and not i else made)
    put(f"{CU}/treepacks/1a/{FOLDER}.pack", sealed(spark, b"one") + sealed(spark, b"two" * 40))
    return store.files(spark, str(root))


def test_keyset_opens_or_says_which_rule_it_breaks(spark):
    blob = keyset_file(spark, "secret")
    assert keyset.open_keyset(spark, blob, "secret") == KEYS
    for data, password, rule in ((b"X" + blob, "secret", "C1"), (blob[:-1], "secret", "C2"), (blob[: keyset.KEYSET_HEADER], "secret", "C2"), (blob, "other", "C3"), (blob[:-1] + b"\0", "secret", "C3")):
        with pytest.raises(keyset.KeysetError) as e:
            keyset.open_keyset(spark, data, password)
        assert e.value.rule == rule


def test_sidecars_plain_or_sealed(spark):
    other = keyset.Keyset(b"o" * 32, b"h" * 32, b"s" * 32)
    rows = [("a", b'{"n": 1}'), ("b", sealed(spark, b'{"n": 2}')), ("c", sealed(spark, b'{"n": 3}', other)), ("d", b"{no json"), ("e", b"\xff\xfe"), ("f", None), ("g", b"[1]"), ("h", sealed(spark, b"x"))]
    df = spark.createDataFrame([(CU, k, bytearray(v) if v is not None else None) for k, v in rows] + [("no keys", "z", bytearray(sealed(spark, b"{}")))], "cu string, k string, content binary")
    got = {r.k: r.document for r in keyset.sidecars(df, keyset.keys(spark, {CU: KEYS})).collect()}
    assert got == {"a": '{"n": 1}', "b": '{"n": 2}'} | dict.fromkeys("cdefghz")
    plan = keyset.sidecars(df, keyset.keys(spark, {CU: KEYS}))._jdf.queryExecution().toString()
    assert KEYS.encryption_key.hex()[:16].upper() not in plan.upper()


def test_pack_objects(spark):
    good, bad = sealed(spark, b"good"), bytearray(sealed(spark, b"bad"))
    bad[-1] ^= 1
    packs = spark.createDataFrame([(CU, "p", good + bytes(bad) + good[:120]), ("other", "q", good)], "cu string, path string, content binary")
    entries = formats.pack_entries(packs, keyset.OBJECT_MAGIC)
    rings = keyset.keys(spark, {CU: KEYS})
    got = sorted((r.path, r.ordinal, r.plain and bytes(r.plain), r.problem) for r in keyset.pack_objects(entries, packs, rings).collect())
    assert got == [("p", 0, b"good", None), ("p", 1, None, "mac mismatch"), ("p", 2, None, "truncated"), ("q", 0, None, "mac mismatch")]
    assert keyset.pack_objects(entries, packs, rings, skip_truncated=True).where("problem = 'truncated'").isEmpty()


def test_a_whole_store_passes(spark, tmp_path):
    rows = invariants.check_store(spark, write(spark, tmp_path, documents()), "secret").collect()
    assert not [(r.id, r.name) for r in rows if not r.passed]
    assert {r.id for r in rows} == {"L1", "L2", "L3", "L4", "L5", "L6", "L7", "L8", "C1", "C2", "C3", "C4", "SV1", "SV2", "SV3", "B1", "B2", "B3", "S1", "ID1", "A1", "ID2", "P1", "P2"}


def test_what_is_broken_is_named(spark, tmp_path):
    docs = documents()
    docs["config"] |= {"chunkerVersion": 9, "isWORM": "no"}
    del docs["config"]["backupName"], docs["index"]["s3GlacierIRObjectDirs"], docs["folder"]["uuid"], docs["record"]["isComplete"], docs["plan"]["scheduleJSON"]["timeOfDay"]
    docs["plan"]["backupFolderPlansByUUID"]["second"] = {"name": 1}
    docs["record"] |= {"version": 7, "node": {"isTree": True}}
    write(spark, tmp_path, docs, spoil=True)
    wrong = f"{CU}/standardobjects/zz1"
    (tmp_path / wrong).mkdir()
    (tmp_path / wrong / "short").write_bytes(b"x")
    (tmp_path / CU / "treepacks" / "1a" / "notes.txt").write_bytes(b"ARQO")
    bad = {(r.id, r.name): r.violations for r in invariants.check_store(spark, store.files(spark, str(tmp_path)), "secret").collect() if not r.passed}
    assert bad == {
        ("SV1", "chunker version known"): 1, ("L3", "config isWORM is bool"): 1, ("L3", "config backupName is str"): 1, ("L5", "folder index s3GlacierIRObjectDirs is list"): 1, ("L7", "folder config uuid"): 1,
        ("B2", "record isComplete"): 1, ("L4", "form of scheduleJSON"): 1, **{("L4", f"folder plan {k}"): 1 for k in invariants.FOLDER_PLAN if k != "name"}, ("SV3", "record version known"): 1,
        ("B3", "tree node has a place"): 1, ("A1", "objects verify"): 1, ("S1", "shard names are two digits"): 1, ("ID1", "object names are 62 digits"): 1, ("P1", "pack names"): 1,
    }


def test_without_keys_what_is_sealed_fails(spark, tmp_path):
    files = write(spark, tmp_path, documents())
    (tmp_path / CU / "backupconfig.json").unlink()
    bad = {r.id for r in invariants.check_store(spark, files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)), "wrong").where(~F.col("passed")).collect()}
    assert bad == {"C3", "C4", "L3", "SV1", "SV2", "L4", "L7", "B2", "SV3", "B3", "A1"}
