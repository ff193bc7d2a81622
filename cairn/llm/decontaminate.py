"""Operator 2, benchmark decontamination by suffix arrays of the training text.

Each shard (a block of documents in an Arrow batch) is turned into words and word hashes by numpy, and gets a suffix
array over its word suffixes. A suffix can only matter if its first three words (or fewer, for shorter items) begin
some benchmark suffix; a bit table drops the rest before they are sorted, without loss. Every benchmark suffix is then
binary-searched in the shard's array, all of them at once, which gives the range of its occurrences; each occurrence is
checked by a second hash of all its words. Occurrences of one item's suffixes that follow each other in both texts are
one longest verbatim match; so every item has its own matches, however many share a passage. Occurrences and matches
stay with their document, so nothing is shuffled and every shard works alone.

The benchmark is the one thing sent to all tasks, in parts of at most ``PART_BYTES`` of text, checked by size; the
driver holds one part at a time. A larger benchmark is searched in one pass over the documents for each part, in which
a worker builds the part's arrays once; a pass keeps a row for each document that it hits, and the passes are joined.

Defined results: words are lower-cased in A-Z. An item of fewer words than ``WINDOW`` is one window; an item without
words, or null, has none and is never found. Null documents have no words. A very long document is a shard of its own.
Rows that repeat a doc_id or an item_id stay separate rows; equal item_ids count as items apart in ``n_items`` once each
row. Empty tables give 0 hits or no rows. Columns of the documents that are named like results are kept apart.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ALNUM, LOWER, blocks, bounded_batches, column_bytes, gram_hashes, materialize, scratch_dir, word_hashes, words

WINDOW = 10
#: Most benchmark text that one broadcast holds.
PART_BYTES = 8 << 20
#: Pairs of places that are held at once while matches are made.
PAIRS = 1 << 20
#: Words that a suffix must share with a benchmark suffix to be sorted at all.
LEAD = 3
_TABLE_BITS = 20


def _lead(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    return out ^ (out >> np.uint64(29))


def _rows(data: np.ndarray, offsets: np.ndarray):
    """The words of a block (starts, ends, each row's first) in lower-cased bytes, and their hashes."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = LOWER[data[lo:hi]]
    starts, ends, first = words(body, offsets - lo, ALNUM)
    return body, starts, ends, first, word_hashes(body, starts, ends)


class Needles:
    """The windows of some benchmark items, for searching: for each length the distinct ones, with all their places."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        import pyarrow as pa

        self.ids, self.window = [str(i) for i in ids], window
        body, starts, ends, first, self.h = _rows(*column_bytes(pa.array(texts, pa.large_string())))
        self.second = word_hashes(body, starts, ends, second=True)
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)  # of each word
        m = np.minimum(window, n)
        at = np.flatnonzero(np.arange(len(self.h)) + m[self.item] <= first[1:][self.item])
        length = m[self.item[at]]
        self.by_length, self.tables, self.leads = {}, {}, {}
        for k in np.unique(length).tolist():
            w = at[length == k]
            one, two = gram_hashes(self.h, k)[w], gram_hashes(self.second, k, second=True)[w]
            order = np.lexsort((w, two, one))
            one, two, places = one[order], two[order], w[order]
            head = np.ones(len(order), dtype=bool)
            head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            cut = np.append(np.flatnonzero(head), len(order))
            place = places[cut[:-1]]
            # A place of each distinct window, its second hash, and where its places are in the list of all.
            self.by_length[k] = place, two[cut[:-1]], cut, places
            lead = min(LEAD, k)
            table = self.tables.setdefault(lead, np.zeros(1 << _TABLE_BITS, dtype=bool))
            self.leads[k] = _lead(self.h, lead)[place]
            table[(self.leads[k] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True


def suffix_array(h: np.ndarray, at: np.ndarray, depth: int, end: np.ndarray) -> np.ndarray:
    """The suffixes at ``at`` in the order of their first ``depth`` word hashes; a document's end sorts first."""
    keys = [_word(h, at, i, end) for i in range(depth - 1, -1, -1)]
    return at[np.lexsort(keys)] if len(at) else at


def _word(h: np.ndarray, at: np.ndarray, i: int, end: np.ndarray) -> np.ndarray:
    """The i-th word hash after each place, 0 beyond its document's end."""
    p = at + i
    inside = p < end[at]
    return np.where(inside, h[np.minimum(p, len(h) - 1)], np.uint64(0))


def search(h: np.ndarray, sa: np.ndarray, end: np.ndarray, needle: np.ndarray, place: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each needle (m word hashes of ``needle`` from a place) the range of the suffix array that begins with it, all
    by bisection."""
    found, n = [], len(place)
    for side in (0, 1):
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(sa), dtype=np.int64)
        while (active := low < high).any():
            mid = (low + high) >> 1
            at = sa[np.minimum(mid, len(sa) - 1)]
            less = np.zeros(n, dtype=bool)
            equal = np.ones(n, dtype=bool)
            for i in range(m):
                w = _word(h, at, i, end)
                less |= equal & (w < needle[place + i])
                equal &= w == needle[place + i]
            right = (less | equal) if side else less
            low = np.where(active & right, mid + 1, low)
            high = np.where(active & ~right, mid, high)
        found.append(low)
    return found[0], found[1]


def _expanded(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them, one list after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _matches(p: np.ndarray, q: np.ndarray, item: np.ndarray, m: int, held: list[np.ndarray]) -> None:
    """Runs of pairs (place in the shard, place in the benchmark) that go on in both, added to ``held`` as rows (p, q,
    words, item); runs that meet are joined by ``_longest``."""
    order = np.lexsort((p, q - p, item))
    p, q, item = p[order], q[order], item[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (q[1:] - p[1:] != q[:-1] - p[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    held.append(np.array([p[head], q[head], np.diff(np.append(head, len(p))) + m - 1, item[head]]))


def _longest(held: list[np.ndarray], m: int) -> np.ndarray:
    """The runs, those that were cut joined again, in the order of places."""
    if not held:
        return np.zeros((4, 0), dtype=np.int64)
    p, q, n, item = np.concatenate(held, axis=1)
    order = np.lexsort((p, q - p, item))
    p, q, n, item = p[order], q[order], n[order], item[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (q[1:] - p[1:] != q[:-1] - p[:-1]) | (p[1:] != p[:-1] + n[:-1] - m + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(p)) - 1 if len(head) else head
    out = np.array([p[head], q[head], p[last] + n[last] - p[head], item[head]])
    return out[:, np.lexsort((out[1], out[3], out[0]))]


def shard(data: np.ndarray, offsets: np.ndarray, needles: Needles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each row's first word; which words are hit; the pairs (row, item) found; and the longest matches, as rows
    (row, first word, words, item)."""
    body, starts, ends, first, h = _rows(data, offsets)
    n = len(offsets) - 1
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    pairs, matches = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((4, 0), dtype=np.int64)]
    if len(h) and needles.by_length:
        row_of = np.repeat(np.arange(n), np.diff(first))
        end = first[1:][row_of]
        second = None
        leads = {}
        for k, table in needles.tables.items():
            if len(h) >= k:
                lead = _lead(h, k)
                at = np.flatnonzero(table[(lead >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
                leads[k] = at, lead[at]
        for m, (place, two, cut, places) in needles.by_length.items():
            at, lead = leads.get(min(LEAD, m), (np.zeros(0, dtype=np.int64),) * 2)
            fits = at + m <= end[at]
            at, lead = at[fits], lead[fits]
            wanted = needles.leads[m]
            at = at[np.isin(lead, wanted)]
            tried = np.flatnonzero(np.isin(wanted, lead))
            if not len(at):
                continue
            sa = suffix_array(h, at, m, end)
            low, high = search(h, sa, end, needles.h, place[tried], m)
            p = sa[_expanded(low, high - low)]
            k = np.repeat(tried, high - low)
            if not len(p):
                continue
            second = word_hashes(body, starts, ends, second=True) if second is None else second
            same = gram_hashes(second, m, second=True)[p] == two[k]  # else equal hashes, other words
            order = np.argsort(p[same], kind="stable")
            p, k = p[same][order], k[same][order]
            np.add.at(cover, p, 1)
            np.add.at(cover, p + m, -1)
            # Each occurrence with each place of its window in the benchmark; few at a time, however often a word repeats.
            size = (cut[1:] - cut[:-1])[k]
            held: list[np.ndarray] = []
            upto = np.cumsum(size)
            a = 0
            while a < len(p):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
                q = places[_expanded(cut[k[a:b]], size[a:b])]
                _matches(np.repeat(p[a:b], size[a:b]), q, needles.item[q], m, held)
                a = b
            runs = _longest(held, m)
            row = row_of[runs[0]]
            pairs.append(np.array([row, runs[3]]))
            matches.append(np.array([row, runs[0] - first[row], runs[2], runs[3]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return first, np.cumsum(cover[:-1]) > 0, pairs, np.concatenate(matches, axis=1)


def _parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The benchmark in parts of at most ``limit`` bytes (an item that is longer is a part of its own)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        more = len((r.t or "").encode())
        if ids and size + more > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i), texts.append(r.t)
        size += more
    yield ids, texts


_BUILT: dict[str, Needles] = {}


def _needles(name: str, part: tuple, window: int) -> Needles:
    """The arrays of a part; a worker keeps the last one for its next task."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Needles(*part, window)
    return _BUILT[name]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         window: int = WINDOW, part_bytes: int = PART_BYTES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, matches.

    ``matches`` are the longest verbatim matches: item, first word in the document, number of words. ``keep`` names
    columns to carry along.
    """
    keep, spark = keep or [], docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.struct(docs[c].alias("v")).alias(f"_keep{i}") for i, c in enumerate(keep)])
    sent = [spark.sparkContext.broadcast(part) for part in _parts(benchmark, item_col, item_text_col, part_bytes)]
    if len(sent) == 1:
        out = _searched(base, sent[0], window)
    else:
        root = scratch_dir(spark)
        base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "documents", root)
        first = materialize(_searched(base, sent[0], window), "part0", root)
        hits = first
        cols = ["_row", "spans", "items", "matches"]
        hits = hits.select(cols)
        for k, part in enumerate(sent[1:], 1):
            hits = hits.unionByName(materialize(_searched(base.select("_row", "_text"), part, window).where(F.size("spans") > 0).select(cols), f"part{k}", root))
        both = hits.where(F.size("spans") > 0).groupBy("_row").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in cols[1:]])
        out = first.drop(*cols[1:]).join(both, "_row", "left").drop("_row")
        out = out.select("*", *[F.coalesce(c, F.array().cast(first.schema[c].dataType)).alias(f"_{c}") for c in cols[1:]]).drop(*cols[1:]).withColumnsRenamed({f"_{c}": c for c in cols[1:]})
    # Words under any span; spans of several parts may overlap.
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["at"] + s["words"]).alias("reach"), (acc["hit"] + F.greatest(F.lit(0), s["at"] + s["words"] - F.greatest(s["at"], acc["reach"]))).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("hit"))
    out = out.withColumn("n_hit", F.aggregate("spans", zero, step, lambda acc: acc["hit"]))
    out = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                     "items", "matches", *[f"_keep{i}" for i in range(len(keep))])
    return _named(out, keep)


def _searched(base: DataFrame, sent, window: int) -> DataFrame:
    """The rows of ``base`` without ``_text``, with n_words, spans (runs of words that are hit), items and matches of one
    part of the benchmark."""
    import pyarrow as pa

    others = [c for c in base.columns if c != "_text"]
    kinds, name = dict(base.dtypes), uuid.uuid4().hex
    run_type, match_type = pa.struct([("at", pa.int64()), ("words", pa.int64())]), pa.struct([("item", pa.string()), ("at", pa.int64()), ("words", pa.int64())])
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in others], "n_words long", "spans array<struct<at:long,words:long>>", "items array<string>", "matches array<struct<item:string,at:long,words:long>>"])

    def run(batches):
        needles = _needles(name, sent.value, window)
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index("_text")))
            n_words: list[int] = []
            spans, items, matches = ([[] for _ in range(batch.num_rows)] for _ in range(3))
            for a, b in blocks(offsets):
                first, hit, found, longest = shard(data, offsets[a : b + 1], needles)
                n_words += np.diff(first).tolist()
                if not found.shape[1]:
                    continue
                row_of = np.repeat(np.arange(b - a), np.diff(first))
                edge = np.flatnonzero(np.diff(hit, prepend=False, append=False) | np.append(np.append(False, (row_of[1:] != row_of[:-1]) & hit[1:] & hit[:-1]), False))
                # Each run of hit words begins at an edge; a run that meets the next row's is cut there.
                for x, y in zip(edge.tolist(), edge[1:].tolist()):
                    if hit[x]:
                        spans[a + int(row_of[x])].append({"at": x - int(first[row_of[x]]), "words": y - x})
                for r, i in found.T.tolist():
                    items[a + r].append(needles.ids[i])
                for r, at, length, i in longest.T.tolist():
                    matches[a + r].append({"item": needles.ids[i], "at": at, "words": length})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in others], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(run_type)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(matches, pa.list_(match_type))],
                names=[*others, "n_words", "spans", "items", "matches"])

    return bounded_batches(base, run, schema)


def _named(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_keep")], *[F.col(f"_keep{i}")["v"].alias(c) for i, c in enumerate(keep)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no benchmark window hits, with their own columns."""
    found = find(docs, benchmark, id_col, text_col, keep=docs.columns, **options)
    # By position, as the documents' own names may clash with those found.
    n, at = len(docs.columns), found.columns.index("contaminated")
    found = found.toDF(*[f"f{i}" for i in range(len(found.columns) - n)], *[f"c{i}" for i in range(n)])
    return found.where(~F.col(f"f{at}")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
