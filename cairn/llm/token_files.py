"""Operator 3, token-ID files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted, so that each task writes a run of consecutive documents as shard
images of about ``SHARD_IDS`` ids. An image holds its documents' ids and lengths, an index of block starts, and blocks
of ``BLOCK`` ids: the block's minimum is subtracted, the rest is packed at the width that the ``KEEP`` share of the
values needs, and wider ones go to the block's exception list. Packing is done for all blocks of one width at once.

Images travel in a Parquet table, as executors can reach the shared store through Spark's writers only; ``export``
gives plain files. A document's place in the corpus is a sum over shards, kept in two levels: shards within a task's
run, and runs.

Format of an image, little-endian (fixed values): magic ``PFOR``, u32 documents, u64 ids, u32 blocks; doc_ids (i64,
with a byte each that is 1 for null), lengths (u32); block index (u64 byte offsets from the first block, one more at
the end); blocks: u32 minimum, u8 width, u16 exceptions, then width x 32 words of u32, then u16 places, u32 values. The
last block is filled with its last id.

Tokenising: where a tokenizer gives the same ids for words between ASCII white space as for the whole text, each distinct
word is encoded once by the library and remembered by its bytes; ids of a text are then a lookup for each word. Whether
that holds is read from the file's added tokens and tried on probes; any other tokenizer encodes whole texts. Where the
file's own normaliser makes each of A-Z lower, texts are made so first, and where its own splitter parts a stop from each
of a-z before it, so is that; both only make distinct words fewer. A worker process keeps one coder, and gives memory
back after each image.

Defined results: null and empty texts hold the end id alone. Rows that repeat a doc_id are written one after another in
the order of their texts' hashes, then texts, so ties are equal rows; null doc_ids come first. A very long text is one
document of one image, encoded in pieces of ``PIECE`` bytes cut at white space. An empty table gives an empty result.
Only the id and the text are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, NOT_SPACE, blocks, bounded_batches, column_bytes, materialize, release_memory, scratch_dir, words

END_ID = 2
BLOCK, KEEP = 1024, 0.95
SHARD_IDS = 1 << 20
#: Distinct words, and bytes of them, that a worker remembers; beyond, it starts anew.
CACHE, CACHE_BYTES = 800_000, 32 << 20
#: Words that the library gets at once.
TOGETHER = 500
#: Bytes of text encoded at once.
PIECE = 512 << 10
_LANES, _ROWS = 32, 32

_STOP, _LETTER = np.zeros((2, 256), dtype=bool)
_STOP[list(b".,;:!?")] = _LETTER[97:123] = True

#: Texts on which words by themselves must give the ids of the whole.
_PROBES = ("It's a test, isn't it? 42 words.", " two  spaces\tand\na line", "e \u0301a", "ÀÉ ß\u0085x 日本 語 😀", "a<b> (c) \"d\" -- e_f")


class _Numbers(dict):
    """Numbers words in order of first use; ``fresh`` are those numbered since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind the first ``used`` values, in room that doubles."""
    if used + len(more) > len(array):
        array = np.concatenate((array[:used], np.zeros(max(used, len(more), 1 << 12), dtype=array.dtype)))
    array[used : used + len(more)] = more
    return array


class WordCoder:
    """Ids of texts by their words, each distinct word encoded once by the library: those of word ``numbers[w]`` are ``size``
    ids of ``flat`` from ``begin``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        plain = not any(t.lstrip or t.rstrip or t.single_word or len(t.content.split()) != 1 for t in added.values())
        self.added = [t.content.lower().encode() for t in added.values()]
        self.between = next(((i, t.content) for i, t in added.items() if t.special and not t.normalized), None) if plain else None
        self.by_word = plain and all(self._each([t.encode()])[0] == [i for x in self._each(t.encode().split()) for i in x] for t in _PROBES)
        self.forget()
        # Fewer distinct words: letters made lower, and stops parted, where the file does so for each of them.
        norm, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.lower = self.by_word and norm is not None and all(norm.normalize_str(f"x{c.upper()}y") == f"x{c}y" for c in letters)
        pieces = lambda t: [x for x, _ in split.pre_tokenize_str(t)]
        parted = self.lower and split is not None and pieces(letters) == [letters] and all(pieces(f"x{a}{b}y") == [f"x{a}{b}y"] for a in letters for b in letters)
        self.stops = parted and all(pieces(f"x{c}{stop}{y}") == [f"x{c}", stop, *y.split()] for c in letters for stop in ".,;:!?" for y in (" y", ""))
        # A word of letters is one piece, whose last token alone has the model's suffix.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) if parted else None
        self.last = None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _each(self, raws: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in raws], add_special_tokens=False)]

    def _encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the number of each. Many go to the library as one text, with what tells them apart again: a
        space for words of letters, else a special token."""
        flat, sizes, order = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], []
        plain = [k for k, w in enumerate(raws) if w.isalpha()] if self.last is not None else []
        others = sorted(set(range(len(raws))).difference(plain)) if plain else range(len(raws))
        for group, between in ((plain, None), (others, self.between)):
            for i in range(0, len(group), TOGETHER):
                some, size = [raws[k] for k in group[i : i + TOGETHER]], None
                order += group[i : i + TOGETHER]
                if group is plain:
                    ids = np.array(self._each([b" ".join(some)])[0], dtype=np.uint32)
                    size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
                elif between is not None and not any(t in b" ".join(some).lower() for t in self.added):
                    ids = np.array(self._each([between[1].encode().join(some)])[0], dtype=np.uint32)
                    at = np.flatnonzero(ids == between[0])
                    size = np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
                    ids = np.delete(ids, at)
                if size is None or len(size) != len(some) or size.sum() != len(ids):  # not kept apart
                    parts = self._each(some)
                    ids = np.fromiter(chain.from_iterable(parts), dtype=np.uint32)
                    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
                flat.append(ids)
                sizes.append(size)
        ids, size, order = np.concatenate(flat), np.concatenate(sizes), np.array(order, dtype=np.int64)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        begin, size = (np.cumsum(size) - size)[back], size[back]
        ends = np.cumsum(size)
        return ids[np.repeat(begin - ends + size, size) + np.arange(len(ids))], size

    def forget(self) -> None:
        self.numbers, self.bytes, self.words, self.n_ids = _Numbers(), 0, 0, 0
        self.begin, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)

    def _learn(self) -> None:
        """Encode the words that have numbers only."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            self.bytes += sum(map(len, fresh))
            ids, size = self._encode(fresh)
            self.begin = _grown(self.begin, self.words, self.n_ids + np.cumsum(size) - size)
            self.size, self.flat = _grown(self.size, self.words, size.astype(np.int32)), _grown(self.flat, self.n_ids, ids)
            self.words, self.n_ids = self.words + len(fresh), self.n_ids + len(ids)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and the number of each."""
        import pyarrow as pa

        rows = offsets - offsets[0]
        body = data[int(offsets[0]) : int(offsets[-1])]
        if not self.by_word:
            raw, at = body.tobytes(), rows.tolist()
            found = self._each([raw[a:b] for a, b in zip(at, at[1:])])
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        if len(self.numbers) > CACHE or self.bytes > CACHE_BYTES:
            self.forget()
        body = LOWER[body] if self.lower else body
        starts, ends, first = words(body, rows, NOT_SPACE)
        if self.stops and len(starts):
            # A stop at the end of a word, behind one of a-z, is a word of its own.
            tail = np.flatnonzero((ends - starts > 1) & _STOP[body[ends - 1]])
            tail = ends[tail[_LETTER[body[ends[tail] - 2]]]] - 1
            starts, ends = np.sort(np.concatenate((starts, tail))), np.sort(np.concatenate((ends, tail)))
            first = np.searchsorted(starts, rows, side="left")
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(rows) - 1, dtype=np.int64)
        cut = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(body[NOT_SPACE[body]])]).dictionary_encode()
        distinct, at = column_bytes(packed.dictionary)
        raw, at = distinct.tobytes(), at.tolist()
        number = np.fromiter(map(self.numbers.__getitem__, [raw[a:b] for a, b in zip(at, at[1:])]), dtype=np.int64, count=len(at) - 1)
        self._learn()
        index = packed.indices.to_numpy()
        size = self.size[number][index]
        place = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        out = self.flat[np.repeat(self.begin[number][index] - place[:-1], size) + np.arange(place[-1])]
        return out, place[first[1:]] - place[first[:-1]]


_CODERS: dict[str, WordCoder] = {}


def coder_of(path: str) -> WordCoder:
    """The worker's coder of a file."""
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def encode_block(coder: WordCoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's rows, end ids included, and the number of ids of each row. A long text alone goes in pieces,
    cut before white space."""
    if len(offsets) == 2 and coder.by_word and offsets[1] - offsets[0] > PIECE:
        body = data[int(offsets[0]) : int(offsets[1])]
        spaces = np.append(np.flatnonzero(~NOT_SPACE[body]), len(body))
        cuts = np.unique(np.concatenate(([0], spaces[np.searchsorted(spaces, np.arange(PIECE, len(body), PIECE))], [len(body)])))
        parts = [coder.ids(body, cuts[i : i + 2])[0] for i in range(len(cuts) - 1)]
        ids = np.concatenate(parts)
        lengths = np.array([len(ids)])
    else:
        ids, lengths = coder.ids(data, offsets)
    return np.insert(ids, np.cumsum(lengths), END_ID).astype(np.uint32), lengths + 1


# --- patched frame of reference ------------------------------------------------------------------------------------


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 1024) values below 2**w to (blocks, w * 32) words: 32 lanes, 32 values one after another in each."""
    out = np.zeros((len(v), max(w, 1), _LANES), dtype=np.uint32)
    for r in range(_ROWS if w else 0):
        x = v[:, r * _LANES : (r + 1) * _LANES]
        word, shift = divmod(r * w, 32)
        out[:, word] |= x << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= x >> np.uint32(32 - shift)
    return out.reshape(len(v), -1)[:, : w * _LANES]


def _unpack(words_: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(words_), BLOCK), dtype=np.uint32)
    lanes = words_.reshape(len(words_), w, _LANES)
    mask = np.uint32((1 << w) - 1)
    for r in range(_ROWS if w else 0):
        word, shift = divmod(r * w, 32)
        x = lanes[:, word] >> np.uint32(shift)
        if shift + w > 32:
            x = x | (lanes[:, word + 1] << np.uint32(32 - shift))
        out[:, r * _LANES : (r + 1) * _LANES] = x & mask
    return out


def write_image(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard image of whole documents."""
    n_blocks = -(-len(ids) // BLOCK)
    full = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    full[: len(ids)] = ids
    v = full.reshape(n_blocks, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, dtype=np.uint32)
    v = v - low[:, None]
    kth = int(np.ceil(KEEP * BLOCK)) - 1
    most = np.partition(v, kth, axis=1)[:, kth] if n_blocks else low
    width = np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64)
    parts: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        x = v[rows]
        outlier = x >= np.uint64(1 << w)
        packed = _pack(x & np.uint32((1 << w) - 1), w).astype("<u4")
        count = outlier.sum(axis=1)
        _, place = np.nonzero(outlier)
        value = x[outlier].astype("<u4")
        place = place.astype("<u2")
        ends = np.cumsum(count)
        for k, r in enumerate(rows.tolist()):
            a, b = int(ends[k] - count[k]), int(ends[k])
            parts[r] = struct.pack("<IBH", int(low[r]), w, b - a) + packed[k].tobytes() + place[a:b].tobytes() + value[a:b].tobytes()
    index = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("<u8")
    nulls = bytes(d is None for d in doc_ids)
    head = b"PFOR" + struct.pack("<IQI", len(doc_ids), len(ids), n_blocks)
    return head + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + nulls + np.asarray(lengths, dtype="<u4").tobytes() + index.tobytes() + b"".join(parts)


def read_head(image: bytes) -> tuple[list, np.ndarray, np.ndarray, int, int]:
    """Document ids, lengths, block index, offset of the first block, and the number of ids."""
    if image[:4] != b"PFOR":
        raise ValueError("not a shard image")
    docs, n, n_blocks = struct.unpack_from("<IQI", image, 4)
    at = 20
    doc_ids = np.frombuffer(image, dtype="<i8", count=docs, offset=at).tolist()
    at += 8 * docs
    doc_ids = [None if z else d for d, z in zip(doc_ids, image[at : at + docs])]
    at += docs
    lengths = np.frombuffer(image, dtype="<u4", count=docs, offset=at).astype(np.int64)
    at += 4 * docs
    index = np.frombuffer(image, dtype="<u8", count=n_blocks + 1, offset=at).astype(np.int64)
    return doc_ids, lengths, index, at + 8 * (n_blocks + 1), n


def read_ids(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of an image; the index gives the blocks that hold them."""
    _, _, index, body, n = read_head(image)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    heads = [struct.unpack_from("<IBH", image, body + int(index[b])) for b in range(b0, b1)]
    width = np.array([h[1] for h in heads])
    out = np.zeros((b1 - b0, BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        raw = b"".join(image[body + int(index[b0 + r]) + 7 : body + int(index[b0 + r]) + 7 + 4 * _LANES * w] for r in rows.tolist())
        out[rows] = _unpack(np.frombuffer(raw, dtype="<u4").reshape(len(rows), w * _LANES), w)
    for r, (low, w, count) in enumerate(heads):
        if count:
            at = body + int(index[b0 + r]) + 7 + 4 * _LANES * w
            place = np.frombuffer(image, dtype="<u2", count=count, offset=at)
            out[r, place] = np.frombuffer(image, dtype="<u4", count=count, offset=at + 2 * count)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    return out.reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


# --- Spark ---------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents in ascending id order as shard images; the table (part, seq, documents, ids, image)."""
    import pyarrow as pa

    root = root or scratch_dir(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        coder = coder_of(tokenizer_path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def image():
            doc_ids = [i for h in held for i in h[0]]
            lengths, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            made = write_image(doc_ids, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([made], pa.binary())],
                                              names=["part", "seq", "documents", "ids", "image"])

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in blocks(offsets, PIECE):
                ids, lengths = encode_block(coder, data, offsets[a : b + 1])
                ends = np.cumsum(lengths)
                done = 0
                while done < b - a:  # whole documents, until a shard is full
                    base = int(ends[done - 1]) if done else 0
                    to = max(int(np.searchsorted(ends, base + shard_ids - size, side="right")), done + (not held))
                    if to > done:
                        held.append((names[a + done : a + to], lengths[done:to], ids[base : int(ends[to - 1])]))
                        size += int(ends[to - 1]) - base
                    if to < b - a or size >= shard_ids:
                        yield image()
                        release_memory()
                        size, seq = 0, seq + 1
                    done = to
        if held:
            yield image()

    return materialize(bounded_batches(d, run, "part int, seq int, documents long, ids long, image binary"), "tokens", root)


def read(shards: DataFrame) -> DataFrame:
    """One row per document, read back from the images: doc_id, start, n_tokens, ids_crc32."""
    import pyarrow as pa

    # Ids before each shard: within its run, and before its run (one row a task).
    runs = shards.groupBy("part").agg(F.sum("ids").alias("run_ids"))
    runs = runs.select("part", (F.sum("run_ids").over(Window.orderBy("part")) - F.col("run_ids")).alias("run_start"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("ids").over(within) - F.col("ids")).alias("before"))
    starts = starts.join(runs, "part").select("part", "seq", (F.col("before") + F.col("run_start")).alias("start"))
    # A table of known size: while it is small the planner broadcasts it, and the images are not shuffled.
    starts = materialize(starts, "starts")
    placed = shards.select("part", "seq", "image").join(starts, ["part", "seq"]).select("start", "image")

    def run(batches):
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = image.as_py()
                doc_ids, lengths, _, _, _ = read_head(image)
                raw = memoryview(read_ids(image).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return bounded_batches(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> list[str]:
    """The images as files in a folder of the driver, one at a time."""
    import os

    out = []
    for r in shards.orderBy("part", "seq").toLocalIterator():
        out.append(os.path.join(folder, f"tokens-{r.part:06d}-{r.seq:06d}.pfor"))
        with open(out[-1], "wb") as f:
            f.write(r.image)
    return out
