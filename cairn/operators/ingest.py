"""From bytes to blobs to packs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Envelopes above this many bytes are stored as large blobs; a pack's target size; size of fixed chunks.
LARGE, PACK, FIXED = 256_000, 5 << 20, 40_000_000


def fixed_chunks(files: DataFrame, key: str, content: str, size: int = FIXED) -> DataFrame:
    """(key, ordinal, offset, chunk) of fixed-size pieces; an empty file has none. Strings go by characters."""
    n = F.length(content)
    cut = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = files.select(key, content, F.explode(cut).alias("ordinal"))
    return rows.select(key, "ordinal", (F.col("ordinal").cast("long") * size).alias("offset"), F.expr(f"substring({content}, ordinal * {size} + 1, {size})").alias("chunk"))


@dataclass(frozen=True)
class Buzhash:
    """Content-defined chunks by a cyclic polynomial over a sliding window; the table is a parameter."""

    table: tuple
    window: int = 48
    bits: int = 15
    least: int = 4 << 10
    most: int = 1 << 20

    def _rol(self, x: int, n: int) -> int:
        n %= 32
        return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF

    def hash(self, window: bytes) -> int:
        h = 0
        for b in window:
            h = self._rol(h, 1) ^ self.table[b]
        return h

    def window_hashes(self, data: bytes) -> "np.ndarray":
        """The hash of the window that ends before each place from ``window`` on, all at once.

        A window's hash is that of its halves, the first turned by the second's length, so log2(window) steps make it.
        """
        import numpy as np

        rol = lambda x, n: x if n % 32 == 0 else (x << np.uint32(n % 32)) | (x >> np.uint32(32 - n % 32))
        part = np.array(self.table, dtype=np.uint32)[np.frombuffer(data, dtype=np.uint8)]  # hashes of windows of 1, 2, 4 ...
        whole, have, size, left = None, 0, 1, self.window
        while True:
            if left & 1:  # the part goes before what is there already
                whole, have = (part, size) if whole is None else (rol(part[: len(part) - have], have) ^ whole[size:], have + size)
            left >>= 1
            if not left:
                return whole
            part = rol(part[:-size], size) ^ part[size:]
            size *= 2

    def cuts(self, data: bytes) -> Iterator[int]:
        """Ends of the chunks; their concatenation is the data."""
        yield from self.cuts_of(data, [0, len(data)])[0]

    def cuts_of(self, data: bytes, offsets: list[int], segment: int = 1 << 22) -> list[list[int]]:
        """For each of the documents that follow each other in ``data`` the ends of its chunks, from its own start."""
        from bisect import bisect_left

        import numpy as np

        mask, total, found = np.uint32((1 << self.bits) - 1), offsets[-1], []
        for at in range(offsets[0], total, segment):
            low = max(offsets[0], at - self.window + 1)
            piece = data[low : min(at + segment, total)]
            if len(piece) >= self.window:
                found.append(np.flatnonzero(self.window_hashes(piece) & mask == 0) + low + self.window)
        ends, out = (np.concatenate(found).tolist() if found else []), []
        for first, last in zip(offsets, offsets[1:]):
            start, cuts = first, []
            while start < last:
                stop = min(start + self.most, last)
                if start + self.least < last:
                    # A window that begins before the document is none of its own.
                    k = bisect_left(ends, max(start + self.least, first + self.window))
                    start = min(ends[k], stop) if k < len(ends) else stop
                else:
                    start = last
                cuts.append(start - first)
            out.append(cuts)
        return out


#: Chunkers by (version, flag); an unknown pair falls back to the default.
VARIANTS: dict[tuple, dict] = {(3, True): {"window": 256, "bits": 16, "least": 4096, "most": 131_072}}


def variant(version: int, flag: bool, table: tuple) -> Buzhash:
    return Buzhash(table, **VARIANTS.get((version, flag), {}))


def register_variant(version: int, flag: bool, **parameters) -> None:
    VARIANTS[(version, flag)] = parameters


def defined_chunks(files: DataFrame, key: str, content: str, chunker: Buzhash) -> DataFrame:
    """(key, ordinal, offset, chunk). Python only finds the cuts, of a batch of files at once; files are the unit of
    parallel work, as a file's cuts follow from each other, and the JVM takes the chunks out of the content."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = column.buffers()[1]
            at = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
            data = column.buffers()[2]
            cuts = chunker.cuts_of(data.to_pybytes() if data is not None else b"", at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.int64()))], names=["_key", "_content", "_ends"])

    f = files.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
    cut = f.mapInArrow(run, f"_key {dict(f.dtypes)['_key']}, _content {dict(f.dtypes)['_content']}, _ends array<long>")
    before = F.when(F.col("ordinal") > 0, F.try_element_at("_ends", F.col("ordinal"))).otherwise(F.lit(0).cast("long"))
    rows = cut.select("_key", "_content", "_ends", F.posexplode("_ends").alias("ordinal", "_end")).withColumn("offset", before)
    chunk = F.expr("substring(_content, cast(offset + 1 as int), cast(_end - offset as int))")
    return rows.select(F.col("_key").alias(key), "ordinal", "offset", chunk.alias("chunk"))


def route(length: Column, is_tree: Column, large: int = LARGE) -> Column:
    """The family that an envelope goes to."""
    return F.when(is_tree, "treepacks").when(length > large, "largeblobpacks").otherwise("blobpacks")


def new_blobs(chunks: DataFrame, known: DataFrame, blob: str = "blob_id") -> DataFrame:
    """Blobs that are not stored yet, once each, with their family."""
    fresh = chunks.join(known.select(blob).distinct(), blob, "left_anti")
    fresh = fresh.groupBy(blob).agg(F.min("length").alias("length"), F.bool_or("is_tree").alias("is_tree"))
    return fresh.withColumn("family", route(F.col("length"), F.col("is_tree")))


def ingest(chunks: DataFrame, known: DataFrame, key: list[str], large: int = LARGE) -> DataFrame:
    """What taking in files stores: (key, ordinal, blob_id, length, family, is_new, brings) of each chunk, in one pass.

    ``chunks`` has (key, ordinal, blob_id, length). A blob is new if no known one has its id; of new ones with one id the
    first chunk by (key, ordinal) brings it, the others refer to it. ``pack_greedy`` puts those that are brought into packs.
    """
    place = F.struct(*key, "ordinal")
    first = chunks.groupBy("blob_id").agg(F.min(place).alias("_first")).join(known.select("blob_id").distinct().withColumn("_known", F.lit(True)), "blob_id", "left")
    j = chunks.join(first, "blob_id")
    fresh = F.col("_known").isNull()
    return j.select(*key, "ordinal", "blob_id", "length", route(F.col("length"), F.lit(False), large).alias("family"), fresh.alias("is_new"), (fresh & (place == F.col("_first"))).alias("brings"))


def pack_greedy(blobs: DataFrame, group: list[str], order: list[str], blob: str, length: str, most: int = PACK) -> DataFrame:
    """In-order greedy packing: (group, blob, pack, offset, length). A repeated blob keeps its first place; one
    that is larger than a pack stands alone.

    The greedy cut depends on all that came before, so a group is one sequential job; its rows arrive in batches, and
    only the running size is kept. Groups are (computer, family) and so many run side by side.
    """
    import numpy as np

    more = [c for c in dict.fromkeys([*order, length]) if c not in (*group, blob)]
    first = blobs.groupBy(*group, blob).agg(F.min(F.struct(*order, length)).alias("_f")).select(*group, blob, *[F.col(f"_f.{c}").alias(c) for c in more])
    rows = first.repartition(*group).sortWithinPartitions(*group, *order)
    kinds = dict(rows.dtypes)

    def run(frames):
        now, pack, size = None, 0, 0
        for frame in frames:
            n = frame[length].to_numpy(dtype=np.int64)
            keys = list(zip(*[frame[g] for g in group]))
            heads = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            packs, offsets = np.zeros((2, len(n)), dtype=np.int64)
            for first, last in zip(heads, heads[1:]):
                if keys[first] != now:
                    now, pack, size = keys[first], 0, 0
                total = np.concatenate(([0], np.cumsum(n[first:last])))
                at = 0
                while at < last - first:  # one step a pack: all blobs that still fit
                    to = int(np.searchsorted(total, total[at] + most - size, side="right")) - 1
                    if to <= at:
                        if size:
                            pack, size = pack + 1, 0
                            continue
                        to = at + 1  # larger than a pack
                    packs[first + at : first + to] = pack
                    offsets[first + at : first + to] = size + total[at:to] - total[at]
                    size += int(total[to] - total[at])
                    at = to
            yield frame[[*group, blob]].assign(pack=packs.astype(np.int32), offset=offsets, length=n)

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in [*group, blob]], "pack int", "offset long", "length long"])
    return rows.mapInPandas(run, schema)


def pack_offsets(entries: DataFrame, pack: list[str], ordinal: str, length: str) -> DataFrame:
    """Each entry's offset in its pack."""
    w = Window.partitionBy(*pack).orderBy(ordinal)
    return entries.withColumn("offset", F.sum(length).over(w) - F.col(length))
