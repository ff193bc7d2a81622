"""Operator 5, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words (lower-cased in A-Z), the word pairs and the pairs with one word between, each hashed to
2**``BITS`` coordinates; a document has a feature or not. Training keeps per-coordinate learning rates, and the L1 term
leaves most weights at exactly zero, so the model that is sent to the tasks is an array of fixed size with few non-zero
weights. Scoring takes whole texts, in numpy, without a shuffle.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id (a documented bound: the
model is one broadcast, and its accuracy is held to held-out rows). Scores cover all rows.

Only texts make scores: labels, languages, sources and ids are never inputs. Defined results: null and empty texts have
no features and get the score of the bias. A very long text is scored whole, in a block of its own. A doc_id with
several labels takes the largest; repeated rows train once, by the smallest of their texts. Without any label outside
the fold nothing is learnt: every score is 0, nothing is predicted and no document goes. Empty tables give empty
results. Of the other columns only those that are carried along are read, by place, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ALNUM, LOWER, blocks, bounded_batches, column_bytes, release_memory, smallest_hashes, word_hashes, words

BITS = 18
#: Most labelled rows that the model is fitted on, and the passes over them.
SAMPLE, PASSES = 16_000, 4
#: Learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 8.0, 0.2
THRESHOLD = 0.3
#: Fewest rows that a coordinate must occur in to have a weight.
FEWEST = 3


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of the features of a block's rows, repeats included, by row."""
    body = LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    starts, ends, first = words(body, offsets - offsets[0], ALNUM)
    h = word_hashes(body, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = np.uint64(64 - bits)
    rows, at = [row], [h >> shift]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = (h[:-gap] * np.uint64(salt) + h[gap:] * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(row[:-gap][same])
            at.append(pair[same] >> shift)
    return np.concatenate(rows), np.concatenate(at).astype(np.int64)


class Ftrl:
    """Weights by coordinate; the last one is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p


def fit(texts, labels: list[int], passes: int = PASSES, **options) -> np.ndarray:
    """The weights after ``passes`` over the rows, in orders fixed by a seed."""
    import pyarrow as pa

    model = Ftrl(**options)
    bias = 1 << model.bits
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [pa.array(texts, pa.large_string())]

    def distinct():
        """(row, coordinate) pairs of each block, once each."""
        for chunk in chunks:
            data, offsets = column_bytes(chunk)
            for a, b in blocks(offsets):
                row, at = features(data, offsets[a : b + 1], model.bits)
                key = np.unique(row * (1 << model.bits) + at)
                yield key >> model.bits, key & (bias - 1), b - a

    # A coordinate of fewer than ``FEWEST`` rows can't be told from chance: it stays at weight zero. Counting first, and
    # making the features again, keeps only what is learnt from in memory.
    seen = np.zeros(bias, dtype=np.int64)
    for _, at, _ in distinct():
        seen += np.bincount(at, minlength=bias)
    rows: list[np.ndarray] = []
    for row, at, n in distinct():
        keep = seen[at] >= FEWEST
        row, at = row[keep], at[keep].astype(np.int32)
        cut = np.searchsorted(row, np.arange(n + 1))
        rows += [np.append(at[i:j], np.int32(bias)) for i, j in zip(cut[:-1], cut[1:])]
    rng = np.random.default_rng(11)
    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            model.learn(rows[i], labels[i])
    return model.weights()


def score_block(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of a block's rows. Only the few features of non-zero weight are told apart."""
    bits = (len(weights) - 1).bit_length() - 1
    row, at = features(data, offsets, bits)
    used = weights[at] != 0
    key = np.unique(row[used] * (1 << bits) + at[used])
    total = np.bincount(key >> bits, weights=weights[key & ((1 << bits) - 1)], minlength=len(offsets) - 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """True if crc32 of the id as text leaves the remainder ``fold``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled rows outside the held-out fold."""
    y = labels.select(F.col(id_col).alias("y_id"), F.col(label_col).alias("y")).where("y is not null and y_id is not null")
    y = y.where(~held_out(F.col("y_id"))).groupBy("y_id").agg(F.max("y").cast("int").alias("y"))
    y = smallest_hashes(y, "y_id", sample)
    d = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(y), d.d_id == y.y_id).groupBy("y_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y_id", "y", "text")
    # At most ``sample`` rows; one column batch at a time keeps the driver's peak near the texts' own size.
    table = rows.toArrow().sort_by("y_id")
    if not table.num_rows:
        return np.zeros((1 << BITS) + 1)
    weights = fit(table.column("text"), table.column("y").to_pylist())
    del table, rows
    release_memory()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, score. ``keep`` names columns to carry along."""
    import pyarrow as pa

    keep = keep or []
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    types = dict(d.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    names, learnt = ["doc_id", "score", *[f"_k{i}" for i in range(len(keep))]], bool(weights.any())

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            got = [score_block(data, offsets[a : b + 1], sent.value) for a, b in blocks(offsets)] if learnt else [np.zeros(batch.num_rows)]
            scores = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *[batch.column(2 + i) for i in range(len(keep))]], names=names)

    schema = ", ".join([f"doc_id {types['_id']}", "score double", *[f"_k{i} {types[f'_k{i}']}" for i in range(len(keep))]])
    return bounded_batches(d, run, schema)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their own columns. A model without weights rejects none."""
    scored = score(docs, weights, docs.columns[0], "text", keep=docs.columns)
    return scored.where(F.col("score") < threshold).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
