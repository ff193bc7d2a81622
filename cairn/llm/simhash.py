"""Operator 7, SimHash near-duplicates: tiled exact comparison with population-count skips.

Distinct fingerprints are dealt into tiles by population count: a tile's key is the vector of the population counts of
the fingerprint's 2, 3 or 4 parts (more parts, smaller tiles, for more fingerprints). Fingerprints within r bits have keys within r in the sum of absolute differences, so a tile is
compared only with itself and the tiles that near, and every other pair of tiles is skipped without loss. Each pair of
tiles is one comparison of numpy arrays: exclusive-or, bit counts, and a union of what links. A comparison gives back
the edges of a spanning forest, fewer than it has members, never all pairs; copies are one fingerprint before it. Tiles of
more than ``TILE`` members are cut into pieces that meet pairwise, so no task holds an unbounded group.

Components: hash-to-min over the spanning edges, each round written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Repeated rows stay repeated
rows. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, NOT_SPACE, blocks, bounded_batches, column_bytes, drop_scratch, materialize, scratch_dir, words

#: Shingle words, seed of XXH64, radius in bits.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Most fingerprints of a tile's piece.
TILE = 8192
#: Parts of a fingerprint by the number of distinct ones; any choice gives the same links.
PARTS = ((1 << 16, 2), (1 << 21, 3), (1 << 63, 4))


def fingerprint(data: bytes, starts: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> int:
    """The fingerprint of the words data[starts:ends], which single spaces join."""
    from xxhash import xxh64_intdigest

    n = len(starts)
    if not n:
        return 0
    m = max(1, n - k + 1)
    first, last = starts[:m], ends[n - m :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, m, 1 << 14):
        ab = zip(first[i : i + (1 << 14)].tolist(), last[i : i + (1 << 14)].tolist())
        h = np.array([xxh64_intdigest(data[a:b], SEED) for a, b in ab], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[int]:
    """Fingerprints of the texts of one block."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = LOWER[data[lo:hi]]
    starts, ends, first = words(body, offsets - lo, NOT_SPACE)
    # The words again, one space after each: shingles are then slices.
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    if len(starts):
        keep = NOT_SPACE[body]
        place = np.zeros(len(body), dtype=np.int64)
        place[starts] = 1
        order = np.cumsum(place) - 1
        flat = np.full(int(at[-1]), 32, dtype=np.uint8)
        inside = np.flatnonzero(keep)
        w = order[inside]
        flat[at[w] + inside - starts[w]] = body[inside]
    else:
        flat = np.zeros(0, dtype=np.uint8)
    joined = flat.tobytes()
    return [fingerprint(joined, at[a:b], at[a:b] + size[a:b], k) for a, b in zip(first[:-1], first[1:])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""
    import pyarrow as pa

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            fps: list[int] = []
            for a, b in blocks(offsets):
                fps += block_fingerprints(data, offsets[a : b + 1], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return bounded_batches(d, run, f"doc_id {kind}, fp long")


def bounds(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part."""
    cut = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def part_counts(fp: Column, parts: int) -> list[Column]:
    """Population counts of the fingerprint's parts."""
    return [F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))) for at, width in bounds(parts)]


def near_keys(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of keys within the radius; of each and its opposite one, as a pair meets once."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= tuple([0] * parts)]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within a, or between a and b: pairs of fingerprints.

    Links are found in strips, and each strip's links are united at once, so memory stays at a strip's.
    """
    nodes = a if b is None else np.concatenate([a, b])
    base = 0 if b is None else len(a)
    other = a if b is None else b
    label = np.arange(len(nodes))
    out_i, out_j = [], []
    for i in range(0, len(a), rows):
        cols = other[i:] if b is None else other
        close = np.bitwise_count(a[i : i + rows, None] ^ cols[None, :]) <= radius
        x, y = np.nonzero(close)
        x, y = x + i, y + base + (i if b is None else 0)
        # Minimum labels, by hooking and pointer jumping; an edge that joins two trees is kept.
        while len(x):
            lx, ly = label[x], label[y]
            open_ = lx != ly
            x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
            if not len(x):
                break
            high, low = np.maximum(lx, ly), np.minimum(lx, ly)
            order = np.lexsort((low, high))
            first = np.ones(len(order), dtype=bool)
            first[1:] = high[order][1:] != high[order][:-1]
            pick = order[first]  # one hook for each root, always to a smaller one: no cycle
            label[high[pick]] = low[pick]
            out_i.append(x[pick])
            out_j.append(y[pick])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    none = np.zeros(0, dtype=np.int64)
    i, j = (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)
    return nodes[i], nodes[j]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, root: str | None = None, parts: int | None = None) -> DataFrame:
    """(a, b): spanning edges between the distinct fingerprints ``fps`` (one column, fp) within ``radius`` bits."""
    import pyarrow as pa

    spark = fps.sparkSession
    root = root or scratch_dir(spark)
    if parts is None:
        number = fps.count()
        parts = next(p for most, p in PARTS if number < most)
    widths = [w for _, w in bounds(parts)]
    width = max(widths) + 1
    cols = part_counts(F.col("fp"), parts)

    def key(counts) -> Column:
        out = F.lit(0)
        for c in counts:
            out = out * width + c
        return out.cast("int")

    keyed = fps.select("fp", key(cols).alias("key"), *[c.cast("int").alias(f"c{i}") for i, c in enumerate(cols)])
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "tiles", root)
    # A tile's pieces: 4 parts make at most 17**4 keys, so this table has a proven bound (83,521 rows).
    many = F.ceil(F.col("members") / tile).cast("int")
    pieces = sizes.select(F.col("key").alias("k"), many.alias("pieces"))
    hash_of = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)).cast("int")
    keyed = keyed.join(F.broadcast(pieces), F.col("key") == F.col("k")).withColumn("piece", F.pmod(hash_of, F.col("pieces"))).drop("k")

    # To each pair of tiles: the tile at the lower key sends itself to the pair, and so does the other one.
    steps = near_keys(radius, parts)

    def ok(d, sign):
        out = F.lit(True)
        for i, x in enumerate(d):
            if x:
                out = out & (F.col(f"c{i}") + sign * x).between(0, widths[i])
        return out

    routes = []
    for d in steps:
        shifted = lambda sign: key([F.col(f"c{i}") + sign * x for i, x in enumerate(d)])
        if any(d):
            routes.append(F.when(ok(d, 1), F.struct(F.col("key").alias("lo"), shifted(1).alias("hi"), F.lit(0).alias("side"))))
            routes.append(F.when(ok(d, -1), F.struct(shifted(-1).alias("lo"), F.col("key").alias("hi"), F.lit(1).alias("side"))))
        else:
            routes.append(F.struct(F.col("key").alias("lo"), F.col("key").alias("hi"), F.lit(2).alias("side")))
    sent = keyed.select("fp", "piece", "pieces", F.explode(F.array_compact(F.array(*routes))).alias("r")).select("fp", "piece", "pieces", "r.*")
    other = pieces.select(F.col("k").alias("o"), F.col("pieces").alias("o_pieces"))
    partner = F.when(F.col("side") == 0, F.col("hi")).otherwise(F.col("lo"))
    sent = sent.join(F.broadcast(other), partner == F.col("o"))  # drops pairs whose other tile is empty
    # Pieces (x of the lower, y of the higher tile) meet in one group each; a tile with itself needs x <= y only.
    to = (
        F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("o_pieces") - 1), lambda y: F.struct(F.col("piece").alias("x"), y.alias("y"), F.lit(0).alias("s"))))
        .when(F.col("side") == 1, F.transform(F.sequence(F.lit(0), F.col("o_pieces") - 1), lambda x: F.struct(x.alias("x"), F.col("piece").alias("y"), F.lit(1).alias("s"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda z: F.struct(F.least(z, F.col("piece")).alias("x"), F.greatest(z, F.col("piece")).alias("y"), F.when(z == F.col("piece"), 2).when(F.col("piece") < z, 0).otherwise(1).alias("s"))))
    )
    sent = sent.select("fp", "lo", "hi", F.explode(to).alias("t")).select("fp", "lo", "hi", "t.*")

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("s").to_numpy()
        if (side == 2).any():
            a, b = forest(fp, None, radius)
        else:
            a, b = forest(fp[side == 0], fp[side == 1], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("lo", "hi", "x", "y").applyInArrow(meet, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches; nodes without an edge are their own root.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes, however many that takes; each round is
    a table in the shared folder, and the one before the last is deleted, so that a lost executor costs one round. Every
    round that changes something lowers the sum of the edges' ends, so the loop ends.
    """
    spark = edges.sparkSession
    root = root or scratch_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = materialize(e, "edges0", root)
    n = 0
    while True:
        n += 1
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mid = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mid, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(mid.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, f"edges{n}", root)
        stable = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        drop_scratch(spark, f"{root}/edges{n - 1}")
        e = new
        if stable:
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE, tile: int = TILE,
               root: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that its links reach), root (the smallest fingerprint)."""
    root = root or scratch_dir(docs.sparkSession)
    d = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints", root)
    # A node for each distinct fingerprint; copies collapse with partial minima before the shuffle.
    least = materialize(d.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "least", root)
    edges = materialize(links(least.select("fp"), radius, tile, root), "links", root)
    comp = components(least.select(F.col("fp").alias("node")), edges, root)
    comp = materialize(comp.join(least.withColumnRenamed("fp", "node"), "node"), "components", root)
    ids = comp.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(comp.join(ids, "root").select(F.col("node").alias("fp"), "component_id", "root"), "named", root)
    return d.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    Where several rows have that id, the one of the smallest fingerprint stays, and of those the one of the smallest hash
    of its columns, then of its columns' values; rows that agree in all of them are equal, and one of them stays.
    """
    import pyarrow as pa

    found = near_dedup(docs, id_col, text_col, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = materialize(found.groupBy(F.col("doc_id").alias("_keep_id"), "root").agg(F.min("fp").alias("_keep_fp")).drop("root"), "kept")
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return docs.join(one, docs[id_col].eqNullSafe(one._keep_id), "left_semi")
    # Rows that repeat an id: the fingerprint tells which of them was meant.
    kinds = dict(docs.dtypes)
    place, names, k = docs.columns.index(text_col), [*docs.columns, "_fp"], options.get("k", SHINGLE)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(place))
            fps = [f for a, b in blocks(offsets) for f in block_fingerprints(data, offsets[a : b + 1], k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=names)

    marked = bounded_batches(docs, run, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns) + ", _fp long")
    same = marked[id_col].eqNullSafe(one._keep_id) & (marked._fp == one._keep_fp)
    row = F.struct(F.xxhash64(*docs.columns).alias("_h"), *[F.col(c) for c in docs.columns])
    least = marked.join(one, same, "left_semi").groupBy(id_col, "_fp").agg(F.min(row).alias("_row"))
    return least.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
