"""Shared pieces of the training-data operators: scratch tables and vectorised text kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.scratch import drop_scratch, materialize, scratch_dir  # noqa: F401

#: Kernels walk an Arrow batch in blocks of about so many text bytes; a longer document is one block.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def smallest_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of the smallest hash of ``key``, the same on every run.

    The number of rows gives the share of hashes that can be among them, with five deviations to spare; a task sends its
    part of that share to the sort, not ``most`` rows of its own.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, (most + 5 * most**0.5 + 25) / max(1, df.count()))
    out = df.withColumn("_h", h).where(F.col("_h") < int(share * (1 << 30)) + 1)
    return out.orderBy("_h", key).limit(most).drop("_h")


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside the next ones."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own ways
        pass


def bounded_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches of about ``BATCH_BYTES``; a worker gives its memory back when a task ends.

    Rows are texts of any length, so a bound on rows is none on memory: batches that come larger, as the session's own
    bound may be, are cut by the bytes of their widest column.
    """

    def cut(batches):
        for batch in batches:
            rows = batch.num_rows
            widest = max((c.nbytes for c in batch.columns), default=0)
            step = max(1, int(rows * BATCH_BYTES // max(widest, 1)))
            for i in range(0, rows, step):
                yield batch.slice(i, step)

    def released(batches):
        yield from run(cut(batches))
        release_memory()

    return df.mapInArrow(released, schema)


# --- vectorised words -------------------------------------------------------------------------------------------

_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_HEADS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Bytes that stay as they are, with A-Z made lower.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space [\x20\x09-\x0D] separates; every other byte is part of a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all of UTF-8's bytes beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))  # a new array; the rest is in place
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (first, last) of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each row the index of its first word (one more at the end).

    ``data`` holds the rows from ``offsets[0]``; starts and ends count from ``offsets[0]`` too. A word never crosses rows.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    n = hi - lo
    rows = offsets - lo
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = keep[data[lo:hi]]
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    np.logical_and(inside[:-1], ~first[1:n], out=before[1:])
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    np.logical_and(inside[1:], ~first[1:n], out=after[:-1])
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``second`` gives one of another family.

    Eight bytes at a time are chained through ``mix``, which is not linear, so that no algebra of the bytes (as with
    polynomials modulo 2**64) makes both families fail on the same pair. Long words take the halves of XXH3's 128 bits.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    a, b = map(np.uint64, _LANES[second])
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    at_byte = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64) * b + a)
    todo, far = None, np.flatnonzero(size > LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        todo = np.flatnonzero((size > k) & (size <= LONG_WORD)) if todo is None else todo[size[todo] > k]
        if not len(todo):
            break
        piece = at_byte[starts[todo] + k] & _HEADS[np.minimum(size[todo] - k, 8)]
        out[todo] = mix((out[todo] ^ piece) * a + b)
    if len(far):
        from xxhash import xxh3_128_intdigest

        half = 64 if second else 0
        out[far] = [xxh3_128_intdigest(data[i:j].tobytes(), seed=7) >> half & 0xFFFFFFFFFFFFFFFF for i, j in zip(starts[far].tolist(), ends[far].tolist())]
    return out


def _joined(x: np.ndarray, y: np.ndarray, second: bool) -> np.ndarray:
    a, b = map(np.uint64, _LANES[second])
    return mix(x * a + mix(y ^ b))


def gram_hashes(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of each k consecutive word hashes; len(h) - k + 1 values. Halves are joined, so log2(k) steps make them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, size, whole, have = h, 1, None, 0
    while True:
        if k & 1:
            whole, have = (part, size) if whole is None else (_joined(whole[: len(h) - have - size + 1], part[have : have + len(h) - have - size + 1], second), have + size)
        k >>= 1
        if not k:
            return whole
        part = _joined(part[:-size], part[size:], second)
        size *= 2
