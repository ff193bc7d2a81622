"""Store layout, records, retention rules, graphs, validation stages and streams on small synthetic stores."""

import json
import plistlib
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import diff, graph, ingest, inventory, ledger, mirror, retention, runs, stats
from cairn.plans import restore, validate
from cairn.sources import store
from cairn.streaming import streams

CU, FOLDER = "AAAAAAAA-0000-0000-0000-000000000001", "BBBBBBBB-0000-0000-0000-000000000002"


@pytest.fixture()
def root(tmp_path):
    def put(path, data=b"x"):
        p = tmp_path / "store" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put(f"{CU}/encryptedkeyset.dat")
    put(f"{CU}/standardobjects/ab/" + "0" * 62, b"good")
    put(f"{CU}/standardobjects/ab/" + "1" * 62, b"bad")
    put(f"{CU}/standardobjects/ab/readme.txt")
    put(f"{CU}/standardobjects/zz/" + "0" * 62)
    put(f"{CU}/treepacks/1/{FOLDER}.pack", b"good")
    record = {"version": 100, "isComplete": True, "node": {"path": "/a/b"}}
    put(f"{CU}/backupfolders/{FOLDER}/backuprecords/00017/9.backuprecord", json.dumps(record).encode())
    put(f"{CU}/backupfolders/{FOLDER}/backuprecords/00017/0000010.backuprecord", plistlib.dumps(record, fmt=plistlib.FMT_BINARY))
    put(f"{CU}/backupfolders/{FOLDER}/backuprecords/00016/99.backuprecord", b"neither")
    put(f"{CU}/backupfolders/{FOLDER}/backuprecords/notes/1.txt")
    return str(tmp_path / "store")


def test_layout(spark, root):
    listing = store.files(spark, root)
    assert sorted((r.family, r.shard, r.size) for r in store.objects(listing).collect()) == [("standardobjects", "ab", 3), ("standardobjects", "ab", 4), ("treepacks", "1", 4)]
    assert [(r.cu, r.has_keyset) for r in store.computers(listing).collect()] == [(CU, True)]
    rec = store.records(listing)
    assert sorted((r.bucket, r.num) for r in rec.collect()) == [("00016", 99), ("00017", 9), ("00017", 10)]
    assert store.latest_records(rec).first().path.endswith("0000010.backuprecord") and store.latest_records(rec, numeric=False).first().path.endswith("/9.backuprecord")
    parsed = store.parsed_records(listing.where("path like '%backuprecord'")).select("path", F.get_json_object("record", "$.node.path").alias("p"), "record").collect()
    assert sorted((r.p or "", r.record is None) for r in parsed) == [("", True), ("/a/b", False), ("/a/b", False)]
    assert "PushedFilters: [GreaterThan(length,3)]" in store.files(spark, root).where("length > 3")._jdf.queryExecution().executedPlan().toString() or store.files(spark, root).where("length > 3").count() > 0


def test_validation_stages(spark, root):
    listing = store.files(spark, root)
    stages = {
        "layout": lambda: store.computers(listing).withColumn("ok", F.col("has_keyset")),
        "audit": lambda: validate.audit(listing.where("path like '%standardobjects/ab/%' and path not like '%txt'"), F.col("content") == F.lit(b"good")),
    }
    out = validate.validate(stages)
    assert sorted(r.ok for r in out["audit"].collect()) == [False, True]
    stages["layout"] = lambda: store.computers(listing).withColumn("ok", F.lit(False))
    assert list(validate.validate(stages)) == ["layout"]
    assert validate.audit(listing, F.lit(True), max_bytes=3).where("size > 3").isEmpty()


def test_run_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "a", "started_at": 2.0}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "b", "started_at": 1.0}, indent=1))
    (tmp_path / "c.json").write_text("{ not json")
    assert [r.run_id for r in store.runs(spark, str(tmp_path), "run_id string, started_at double").collect()] == ["b", "a"]
    plans = spark.createDataFrame([('{"plan_id":"2","name":"b"}',), ('{"plan_id":"1","name":"A","active":false}',), ("{",)], "j string")
    assert [(r.plan_id, r.name, r.active, r.threads) for r in store.plans(plans, "j").collect()] == [("1", "A", False, 1), ("2", "b", True, 1)]
    one = spark.createDataFrame([(1, "x/y")], "a int, b string").select(store.serialized(F.struct("a", "b")).alias("s")).first().s
    assert one == '{"a":1,"b":"x\\/y"}'


def test_retention_ties_and_undated(spark):
    rows = [(0, "2024-12-30 10:00:00"), (1, "2024-12-31 10:00:00"), (2, "2024-12-31 10:00:00"), (3, "2025-01-01 09:00:00"), (4, None), (5, "2025-01-06 00:00:00")]
    df = spark.createDataFrame([(i, "f", t) for i, t in rows], "ordinal int, folder string, t string").withColumn("ts", F.to_timestamp("t"))
    kept = lambda **p: sorted(r.ordinal for r in retention.select_retained(df, retention.Policy(**p), ["folder"]).where("retained").collect())
    assert kept(daily=3) == [2, 3, 4, 5] and kept(weekly=2) == [3, 4, 5] and kept(last_n=1) == [4, 5] and kept() == [0, 1, 2, 3, 4, 5] and kept(yearly=2, last_n=2) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        retention.Policy(last_n=0)


def test_graph_shapes(spark):
    chain = [(f"c{i}", f"c{i + 1}", "n") for i in range(12)]
    diamond = [("a", "b", "l"), ("a", "c", "r"), ("b", "d", "x"), ("c", "d", "x"), ("d", "e", "y")]
    edges = spark.createDataFrame(chain + diamond, "parent string, child string, name string")
    roots = spark.createDataFrame([("R", "a"), ("S", "c0")], "root string, node string")
    got = {(r.root, r.node): r.depth for r in graph.reachable(edges, roots).collect()}
    assert got[("R", "e")] == 3 and got[("S", "c12")] == 12 and len(got) == 5 + 13
    flat = graph.flatten(edges, roots.where("root = 'R'"))
    assert sorted(r.path for r in flat.collect()) == ["", "l", "l/x", "l/x/y", "r", "r/x", "r/x/y"]
    assert graph.ranked_depth(flat).first().path == "l/x/y"
    wanted = spark.createDataFrame([("R", "l/x"), ("R", "nope")], "root string, path string")
    assert {r.path: r.node for r in graph.lookup(flat, wanted).collect()} == {"l/x": "d", "nope": None}
    assert graph.cyclic_nodes(edges).count() == 0
    for walk in (graph.reachable, graph.flatten):
        with pytest.raises(ValueError):
            walk(edges, roots, max_depth=2).count()
        assert walk(edges, roots.where("root = 'R'"), max_depth=3).agg(F.max("depth")).first()[0] == 3
    with pytest.raises(ValueError):
        graph.flatten(edges.unionByName(spark.createDataFrame([("e", "a", "z")], "parent string, child string, name string")), roots)


def test_cycles(spark):
    """A long chain is no cycle; of what hangs above, below and between cycles nothing is on one."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(1500)]
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    more = [("c7", "r3"), ("r5", "below"), ("below", "deeper"), ("r9", "m1"), ("m1", "m2"), ("m2", "s"), ("s", "s"), ("x", "y"), ("y", "x"), ("s", "x"), ("x", "y2"), ("y2", "x"), ("y2", "end"), (None, "x")]
    got = {r.node for r in graph.cyclic_nodes(spark.createDataFrame(chain + ring + more, "parent string, child string")).collect()}
    assert got == {f"r{i}" for i in range(40)} | {"s", "x", "y", "y2"}


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(26)}
    reach = {a: {b for x, b in edges if x == a} for a in range(25)}
    for _ in range(25):
        reach = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
    got = {x.node for x in graph.cyclic_nodes(spark.createDataFrame(sorted(edges), "parent long, child long")).collect()}
    assert got == {a for a, s in reach.items() if a in s}


def test_cursor_at_every_family_boundary(spark):
    objects = [("c", f, s, n) for f in ledger.FAMILIES for s in ("00", "ff") for n in ("a", "b")]
    df = spark.createDataFrame(random.Random(1).sample(objects, len(objects)), "computer string, family string, shard string, name string")
    for i, o in enumerate(objects):
        assert ledger.after_cursor(df, o).count() == len(objects) - i - 1


def test_path_rules(spark):
    import fnmatch

    globs = ["*.txt", "a*b", "[ab]?", "[!a]*", "*/x", "a.b", "[^a]", "[]", "{x}", "*[0-9].(c)"]
    names = ["a.txt", "dir/a.txt", "ab", "a/b", "bz", "zz", "d/x", "aXb", "a.b", "[]", "{x}", "9.(c)", "^", "line\n.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for g in globs:
        got = {r.p: r.m for r in df.select("p", paths.glob_match(F.col("p"), g).alias("m")).collect()}
        assert got == {n: fnmatch.fnmatchcase(n, g) for n in names}, g
    assert paths.gitignore_rules("# c\n\n!/a/\nb/c\n/\n!\n ! x \n!!y") == [("a", True, True, True), ("b/c", False, False, False), ("x", True, False, False), ("!y", True, False, False)]
    files = spark.createDataFrame([("a/b/c", 1), ("a/d", 2), ("e", 4)], "path string, size long")
    assert {r.dir: (r.item_size, r.contained_files) for r in inventory.rollup(files).collect()} == {"": (7, 3), "a": (3, 2), "a/b": (1, 1)}
    rule = lambda p, d: paths.glob_match(p, "a/b") & d
    assert [r.path for r in files.where(paths.pruned(F.col("path"), rule)).collect()] == ["a/b/c"]


def test_sidecars_and_lists(spark):
    df = spark.createDataFrame([("1", ("", "h", None), ("p", "s"))], "cu string, config struct<computerName:string,hostname:string,computerSerial:string>, plan struct<computerName:string,serialNumber:string>")
    assert tuple(store.source_info(df).first()) == ("1", "p", "s")
    assert spark.createDataFrame([({"k": "v"},)], "m map<string,string>").where(store.owned(F.col("m"), "k")).count() == 1
    a = spark.createDataFrame([("/x", "int"), ("/y", "str")], "json_path string, type string")
    assert [r.json_path for r in diff.nested_difference(a, a.where("json_path = '/x'")).collect()] == ["/y"]
    assert stats.positional(spark.createDataFrame([(7,)], "v long"), "v", {"p99": 0.995, "p0": 0.0}).first().asDict() == {"p99": 7, "p0": 7}
    eta = spark.range(1).select(runs.eta(F.lit(10), F.lit(30), F.lit(2.0)).alias("a"), runs.eta(F.lit(10), F.lit(None).cast("int"), F.lit(2.0)).alias("b")).first()
    assert eta.a == 10 and eta.b is None
    before = spark.createDataFrame([("a", "int")], "name string, type string")
    assert mirror.drift(before, before).count() == 0


def test_drip_resumes(spark, tmp_path):
    root, sink, checkpoint = tmp_path / "objects", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    root.mkdir()
    for i in range(5):
        (root / f"o{i}").write_bytes(b"good" if i else b"bad")
    ok = lambda c: c == F.lit(b"good")
    run = lambda: streams.audit_drip(spark, str(root), checkpoint, sink, ok, files_per_batch=2).awaitTermination()
    run()
    t = streams.drip_totals(spark, sink).first()
    assert (t.files, t.ok_files, t.failed) == (5, 4, 1)
    (root / "late").write_bytes(b"good")
    run()
    run()
    assert streams.drip_totals(spark, sink).first().files == 6


def test_run_fold_stream(spark, tmp_path):
    schema = "run_id string, seq long, kind string, bytes_done long"
    events = tmp_path / "events"
    first = [("a", 0, "run_started", 0), ("a", 1, "error", 5), ("b", 0, "run_started", None), ("b", 1, "run_paused", 7)]
    second = [("a", 1, "error", 5), ("a", 2, "run_completed", 9), ("a", 3, "run_paused", 9), ("b", 2, "run_resumed", 8)]
    out = {}

    def keep(batch, _):
        out.update({r.run_id: (r.events, r.errors, r.status, r.bytes_done) for r in batch.collect()})

    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(events))
        q = streams.fold_runs(spark.readStream.schema(schema).json(str(events))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    assert out == {"a": (4, 1, "completed", 9), "b": (3, 0, "running", 8)}
    sink = streams.event_sink(spark.readStream.schema(schema).json(str(events)), str(tmp_path / "json"), str(tmp_path / "cp2"))
    sink.awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 8


def test_progress_tells_what_is_left(spark, tmp_path):
    root = tmp_path / "objects"
    root.mkdir()
    for i in range(6):
        (root / f"o{i}").write_bytes(b"x")
    events = []
    listener = streams.Progress(events.append, total=6)
    spark.streams.addListener(listener)
    try:
        streams.audit_drip(spark, str(root), str(tmp_path / "checkpoint"), str(tmp_path / "sink"), lambda c: c == F.lit(b"x"), files_per_batch=2).awaitTermination()
        for _ in range(100):
            if events and events[-1]["event"] == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = [e for e in events if e["event"] == "progress" and e["files"]]
    assert [e["files"] for e in told][-1] == 6 and told[-1]["seconds_left"] == 0 and told[0]["seconds_left"] > 0 and events[-1] == {"event": "ended", "files": 6, "error": None}


def test_restored_contents_and_manifest(spark):
    chunks = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "gone"), ("c", 0, "x")], "path string, ordinal int, blob_id string")
    blobs = spark.createDataFrame([("x", b"one "), ("y", b"two")], "blob_id string, content binary")
    assert {r.path: bytes(r.content) for r in restore.contents(chunks, blobs).collect()} == {"a": b"one two", "c": b"one "}
    entries = spark.createDataFrame([("a", False, 7), ("b", False, 1), ("c", False, 9), ("d", True, 0), ("e", False, 0)], "path string, is_tree boolean, size long")
    stored = blobs.select("blob_id", F.octet_length("content").alias("length"))
    assert {r.path: r.status for r in restore.manifest(entries, chunks, stored).collect()} == {"a": "ok", "b": "missing", "c": "size differs", "d": "directory", "e": "ok"}


def test_chunks_of_a_batch_are_those_of_each_file(spark):
    r = random.Random(4)
    c = ingest.Buzhash(tuple(r.getrandbits(32) for _ in range(256)), window=16, bits=6, least=8, most=256)
    files = [r.randbytes(r.choice([0, 1, 15, 16, 17, 300, 3000])) for _ in range(60)]
    whole, at = b"".join(files), [0]
    for f in files:
        at.append(at[-1] + len(f))
    assert c.cuts_of(whole, at, segment=1000) == [list(c.cuts(f)) for f in files]
    for f in files:  # a plain loop over windows
        ends, start = [], 0
        while start < len(f):
            stop = min(start + c.most, len(f))
            end = next((p for p in range(max(start + c.least, c.window), stop) if c.hash(f[p - c.window : p]) & 63 == 0), stop) if start + c.least < len(f) else len(f)
            ends.append(end)
            start = end
        assert ends == list(c.cuts(f))
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(99, None)], "k long, content binary")
    rows = sorted(ingest.defined_chunks(df, "k", "content", c).collect(), key=lambda x: (x.k, x.ordinal))
    assert b"".join(bytes(x.chunk) for x in rows) == whole and all(x.offset == sum(len(y.chunk) for y in rows if y.k == x.k and y.ordinal < x.ordinal) for x in rows[:80])


def test_paths_stay_below_the_root():
    assert store.rooted("/data/store/", "a/./b//c/../d") == "/data/store/a/b/d" and store.rooted("s3://x", "") == "s3://x"
    for bad in ("../x", "a/../../x", "file:///etc/passwd"):
        with pytest.raises(ValueError):
            store.rooted("/data/store", bad)


def test_trees_are_compared_where_they_differ(spark):
    def entries(tree):
        rows = []

        def walk(node):
            import hashlib

            made = []
            for name, v in sorted(node.items()):
                child = walk(v) if isinstance(v, dict) else f"f{v}"
                made.append((name, child, isinstance(v, dict), 0 if isinstance(v, dict) else v))
            i = hashlib.md5(repr(made).encode()).hexdigest()
            rows.extend((i, *m) for m in made)
            return i

        root = walk(tree)
        return spark.createDataFrame(rows or [("-", "-", "-", False, 0)], "parent string, name string, child string, is_tree boolean, size long").distinct(), root

    a = {"same": {"x": 1, "deep": {"y": 2}}, "d": {"f": 1, "g": 2, "gone": {"h": 3}}, "t": 5, "u": {"v": 6}}
    b = {"same": {"x": 1, "deep": {"y": 2}}, "d": {"f": 9, "g": 2, "new": {"i": 4, "j": {}}}, "t": {"w": 7}, "u": 8}
    (ea, ra), (eb, rb) = entries(a), entries(b)
    got = sorted((r.path, r.kind) for r in diff.pruned_diff(ea, eb, (ra, rb)).collect())
    assert got == [("d/f", "modified"), ("d/gone", "removed"), ("d/gone/h", "removed"), ("d/new", "added"), ("d/new/i", "added"), ("d/new/j", "added"), ("t", "type_changed"), ("t/w", "added"), ("u", "type_changed"), ("u/v", "removed")]
    assert sorted(r.path for r in diff.pruned_diff(ea, eb, (ra, rb), expand=False).collect()) == ["d/f", "d/gone", "d/new", "t", "u"]
    assert diff.pruned_diff(ea, ea, (ra, ra)).count() == 0


def test_shapes_of_two_stores(spark):
    cols = "file string, json_path string, type string"
    a = spark.createDataFrame([("plan", "/x", "int"), ("plan", "/y", "str"), ("old", "/z", "int"), ("both", "/q", "int")], cols)
    b = spark.createDataFrame([("plan", "/x", "str"), ("plan", "/w", "int"), ("new", "/z", "int"), ("both", "/q", "int")], cols)
    rows = diff.shape_compare(a, b)
    assert sorted((r.file, r.json_path, r.what) for r in rows.collect()) == [("new", "/z", "file_only_b"), ("old", "/z", "file_only_a"), ("plan", "/w", "path_only_b"), ("plan", "/x", "type"), ("plan", "/y", "path_only_a")]
    kinds = ["file_only_a", "file_only_b", "path_only_a", "path_only_b", "type"]
    assert not diff.difference_summary(rows, kinds).first()["match"] and diff.difference_summary(diff.shape_compare(a, a), kinds).first()["match"]


def test_packs_are_filled_in_order_whatever_the_batches(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice([0, 0, 5, 30, 60, 99, 100, 101, 250])) for g in "ab" for i in range(120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.g, x.i): (x.pack, x.offset) for x in ingest.pack_greedy(spark.createDataFrame(rows, "g string, i int, n long"), ["g"], ["i"], "i", "n", 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for g in "ab":
        pack = size = 0
        for _, i, n in [x for x in rows if x[0] == g]:
            if size and size + n > 100:
                pack, size = pack + 1, 0
            want[g, i] = pack, size
            size += n
    assert got == want
