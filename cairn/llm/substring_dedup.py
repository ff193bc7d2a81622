"""Operator 10, substring deduplication: a log-structured index of window fingerprints.

Each window of ``WINDOW`` words holds ``WINDOW - GRAM + 1`` grams of ``GRAM`` words; the one of the smallest hash stands
for the window. Neighbouring windows share it, so a document is a list of *stretches*: the windows that one gram stands
for. Equal windows choose the same gram, so a window can only recur where its gram's hash does; nothing is missed, and
the index holds one entry for about seven words. An entry is (gram hash, hash of the whole stretch, document, place).

The index is a list of immutable runs, tables that are bucketed and sorted by gram hash. A new batch becomes a run of
its own; it is merge-joined with itself and with each older run on the gram hash, bucket by bucket, without another
shuffle. Stretches that are equal as a whole to an earlier one repeat in all their windows. Where only the gram recurs,
the windows themselves are hashed from the texts and compared one by one; batches that come together leave that to one
comparison of all of them. Both verify a match by 128 bits over all its words, from two families of hashes that share no
algebra. An index of ``FANOUT`` runs is compacted to one when another batch comes, and what it replaces is deleted; the
whole table is taken in more batches than that.

Copies within a task are settled before the shuffle (a task remembers ``REMEMBERED`` stretches; what it forgets is
settled later), so a passage in a third of all documents costs about one entry a task. Documents that need their text again are picked by a broadcast set of at most ``SLOTS`` hash values
(a proven bound; if it fills, every document is read again, and results are the same).

Defined results: null, empty and blank texts have no words, and the digest of the empty text. Rows that repeat a doc_id
are judged by (doc_id, start): at equal places neither starts earlier, so neither loses words to the other. Null doc_ids
come last. Empty tables give empty results. A very long text is cut nowhere: its stretches are rows like any other.
Only the id and the text are read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from functools import reduce
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import NOT_SPACE, blocks, bounded_batches, column_bytes, drop_scratch, gram_hashes, materialize, mix, scratch_dir, word_hashes, words

WINDOW, GRAM = 20, 7
#: Runs of the index that are merged into one.
FANOUT = 2
#: Batches that the whole table is taken in, by doc_id.
BATCHES = 3
#: Stretches that a task remembers to settle copies before the shuffle.
REMEMBERED = 1 << 17
SLOTS = 1 << 20
LAST = (1 << 63) - 1
#: Hashes have no dictionary that a writer of runs could find.
NO_DICTIONARY = {f"parquet.enable.dictionary#{c}": "false" for c in ("key", "block", "check")}


def _rightmost_least(x: np.ndarray, k: int) -> np.ndarray:
    """The place of the smallest of each k consecutive values, of equal ones the last. Halves are joined, so log2(k) steps make them."""
    best, at, size = x, np.arange(len(x)), 1
    while size < k:
        step = min(size, k - size)
        right = best[step:] <= best[:-step]
        best, at, size = np.minimum(best[:-step], best[step:]), np.where(right, at[step:], at[:-step]), size + step
    return at


def _stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(row, gram hash, two hashes of the whole stretch, first window, windows) of each stretch of a block's rows."""
    lo = int(offsets[0])
    body = data[lo : int(offsets[-1])]
    starts, ends, first = words(body, offsets - lo, NOT_SPACE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    s = np.flatnonzero(np.arange(len(starts)) + window <= first[1:][row]) if len(starts) else starts
    if not len(s):
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none
    g = gram_hashes(word_hashes(body, starts, ends), gram)
    at = _rightmost_least(g, window - gram + 1)[s]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    head = np.flatnonzero(new)
    a, n = s[head], np.diff(np.append(head, len(s)))
    # The whole stretch: its grams one after another, the last one at its end, chained with its form.
    size = n + window - 1
    place = (at[head] - a).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64)
    whole = []
    for grams in (g, gram_hashes(word_hashes(body, starts, ends, second=True), gram, second=True)):
        h = mix(grams[a] + mix(place))
        for off in range(gram, 2 * window - gram, gram):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[a + np.minimum(off, size - gram)])
        whole.append(h)
    return row[a], g[at[head]], whole[0], whole[1], a - first[row[a]], n


def _packed(a: np.ndarray, n: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """First window, number of windows (at most 31) and the settled bit in one number."""
    return (a << 6) | (n << 1) | settled


class _Seen:
    """The smallest places (document, first window) of the stretches that a task met, sorted by a number of their hashes."""

    def __init__(self):
        self.number, self.rows = np.zeros(0, dtype=np.uint64), np.zeros((5, 0), dtype=np.int64)  # key, block, check, document, first window

    def earlier(self, rows: np.ndarray) -> np.ndarray:
        """Which of ``rows``, no two of one stretch, repeat an earlier place; of the others the places are remembered."""
        if len(self.number) > REMEMBERED:
            self.__init__()
        number = mix(rows[0].view(np.uint64) + mix(rows[1].view(np.uint64)))
        at = np.searchsorted(self.number, number)
        near = np.minimum(at, max(len(self.number) - 1, 0))
        hit = self.number[near] == number if len(self.number) else np.zeros(len(number), dtype=bool)
        known = np.flatnonzero(hit)
        old, now = self.rows[:, near[known]], rows[:, known]
        same = (old[:3] == now[:3]).all(axis=0)
        after = (now[3] > old[3]) | ((now[3] == old[3]) & (now[4] > old[4]))
        before = same & ((now[3] < old[3]) | ((now[3] == old[3]) & (now[4] < old[4])))
        self.rows[3:, near[known[before]]] = now[3:, before]
        out = np.zeros(len(number), dtype=bool)
        out[known[same & after]] = True
        new = np.flatnonzero(~hit)
        new = new[np.argsort(number[new], kind="stable")]
        self.number, self.rows = np.insert(self.number, at[new], number[new]), np.insert(self.rows, at[new], rows[:, new], axis=1)
        return out


def entries(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The stretches of ``docs`` (doc, tag, text): key, block, check, doc, tag, at. Those that repeat an earlier one of
    their task are settled, and get a key that spreads them."""
    import pyarrow as pa

    def run(batches):
        seen = _Seen()
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = column_bytes(batch.column(2))
            for i, j in blocks(offsets):
                row, *hashes, a, n = _stretches(data, offsets[i : j + 1], window, gram)
                rows = np.array([*[h.view(np.int64) for h in hashes], ids[i:j][row], a], dtype=np.int64).reshape(5, -1)
                order = np.lexsort(rows[::-1])
                rows, n, row = rows[:, order], n[order], row[order]
                head = np.ones(len(order), dtype=bool)
                head[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
                lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
                settled = (rows[3:] != rows[3:, lead]).any(axis=0)
                settled |= seen.earlier(rows[:, head])[np.cumsum(head) - 1] if len(order) else settled
                key, block, check, doc, at = rows
                key = np.where(settled, mix(doc.view(np.uint64) * np.uint64(31) + at.view(np.uint64)).view(np.int64), key)
                block, check = np.where(settled, 0, block), np.where(settled, 0, check)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block), pa.array(check), pa.array(doc), pa.array(tags[i:j][row]), pa.array(_packed(at, n, settled.astype(np.int64)))],
                                                 names=["key", "block", "check", "doc", "tag", "at"])

    return bounded_batches(docs.select("doc", "tag", "text"), run, "key long, block long, check long, doc long, tag long, at long")


def window_hashes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, age, doc, tag, start) of the windows of the stretches ``spans`` of ``docs`` (age, doc, tag, text, spans)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            age, doc, tag = (batch.column(i).to_numpy() for i in range(3))
            data, offsets = column_bytes(batch.column(3))
            spans = batch.column(4)
            cut, at = spans.offsets.to_numpy(), spans.values.to_numpy()
            for i, j in blocks(offsets):
                lo = int(offsets[i])
                body = data[lo : int(offsets[j])]
                starts, ends, first = words(body, offsets[i : j + 1] - lo, NOT_SPACE)
                one = gram_hashes(word_hashes(body, starts, ends), window)
                two = gram_hashes(word_hashes(body, starts, ends, second=True), window, second=True)
                x = at[cut[i] : cut[j]]
                row = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
                a, n = x >> 6, (x >> 1) & 31
                start = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                p = first[row] + start
                yield pa.RecordBatch.from_arrays([pa.array(one[p].view(np.int64)), pa.array(two[p].view(np.int64)), pa.array(age[i:j][row]), pa.array(doc[i:j][row]), pa.array(tag[i:j][row]), pa.array(start)],
                                                 names=["w1", "w2", "age", "doc", "tag", "start"])

    return bounded_batches(docs.select("age", "doc", "tag", "text", "spans"), run, "w1 long, w2 long, age int, doc long, tag long, start long")


def _digests(docs: DataFrame, with_spans: bool, window: int) -> DataFrame:
    """(doc, tag, n_words, n_removed, kept_sha256 and, with spans, kept) of ``docs``; without spans all words are kept."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            n_words, n_removed, sha, kept_text = [], [], [], []
            for i, j in blocks(offsets):
                lo = int(offsets[i])
                raw, at = data[lo : int(offsets[j])].tobytes(), (offsets[i : j + 1] - lo).tolist()
                for r in range(j - i):
                    w = raw[at[r] : at[r + 1]].split()  # bytes split at [\x20\x09-\x0D]
                    n_words.append(len(w))
                    if with_spans:
                        spans = batch.column(3)
                        x = spans.values.to_numpy()[spans.offsets[i + r].as_py() : spans.offsets[i + r + 1].as_py()]
                        cover = np.zeros(len(w) + 1, dtype=np.int64)
                        np.add.at(cover, x >> 6, 1)
                        np.add.at(cover, (x >> 6) + ((x >> 1) & 31) + window - 1, -1)
                        w = list(compress(w, (np.cumsum(cover[:-1]) == 0).tolist()))
                    text = b" ".join(w)
                    n_removed.append(n_words[-1] - len(w))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if with_spans:
                        kept_text.append(text.decode())
            cols = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc", "tag", "n_words", "n_removed", "kept_sha256"]
            if with_spans:
                cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc long, tag long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_spans else "")
    return bounded_batches(docs.select("doc", "tag", "text", *(["spans"] if with_spans else [])), run, schema)


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` that may be among ``wanted`` (doc, tag): those whose hash falls into one of SLOTS taken slots."""
    slot = F.pmod(F.xxhash64("doc", "tag"), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot.alias("slot")).distinct()
    return docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")


#: Settings under which buckets of one file keep the order they were written in, and aggregations use it.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.execution.replaceHashWithSortAgg": "true"}


@contextmanager
def _ordered(spark: SparkSession):
    """While a plan runs, runs of the index are merged in their order: the joins by gram hash need no sorts."""
    before = {k: spark.conf.get(k) for k in ORDERED}
    for k, v in ORDERED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Index:
    """The runs of the index, and the batches' documents they point into."""

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, fanout: int = FANOUT,
                 repeated: bool = True):
        self.spark, self.root, self.window, self.gram, self.fanout = spark, root or scratch_dir(spark), window, gram, fanout
        #: Whether rows may repeat a (doc, tag).
        self.repeated = repeated
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: list[DataFrame] = []
        self.open: list[DataFrame] = []
        self.compared = 0

    def _save(self, df: DataFrame) -> str:
        """An immutable run: bucketed by key, sorted within each bucket, one file a bucket."""
        name = f"cairn_run_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, "key").sortWithinPartitions("key", "block")
        df.write.options(**NO_DICTIONARY).bucketBy(self.buckets, "key").sortBy("key", "block").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        drop_scratch(self.spark, f"{self.root}/{run}")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc, tag, text); give back those of its stretches that repeat an earlier one as a whole: doc, tag, at.

        Of grams that recur in several stretches, the first of each stretch waits for ``windows``.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        number = len(self.batches)
        self.batches.append(docs.withColumn("age", F.lit(number)))
        run = self._save(entries(docs, self.window, self.gram).withColumn("age", F.lit(number)))
        new = self.spark.table(run)
        open_ = new.where("at & 1 = 0")

        # Grams that recur, in the batch or in older runs: bucket by bucket.
        cols = ["key", "block", "check", "age", "doc", "tag", "at"]
        keys = open_.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        again, recurs = open_.join(keys.where("times > 1"), "key", "left"), F.col("times").isNotNull()
        parts = []
        for k, old in enumerate(self.runs):
            past = self.spark.table(old).where("at & 1 = 0")
            parts.append(past.join(keys.select("key"), "key", "left_semi").select(cols))
            again = again.join(past.groupBy("key").agg(F.lit(True).alias(f"in{k}")), "key", "left")
            recurs = recurs | F.col(f"in{k}").isNotNull()
        both = again.where(recurs).select(cols)
        for p in parts:
            both = both.unionByName(p)

        # Whole stretches: all but the first are repeats. Grams of several stretches: the first of each is noted.
        place = F.struct("age", "doc", F.expr("at >> 6").alias("start"))
        of_stretch = Window.partitionBy("key", "block", "check").orderBy("age", "doc", F.expr("at >> 6")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        of_gram = Window.partitionBy("key").orderBy("block", "check", "age", "doc", F.expr("at >> 6")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order: one sort
        both = both.withColumn("later", place > F.first(place).over(of_stretch))
        several = (F.min("block").over(of_gram) < F.max("block").over(of_gram)) | (F.min("check").over(of_gram) < F.max("check").over(of_gram))
        both = both.withColumn("several", several).where((F.col("later") & (F.col("age") == number)) | (~F.col("later") & F.col("several")))
        settled = new.where("at & 1 = 1").withColumn("later", F.lit(True))
        marked = [x.select("age", "doc", "tag", "at", "later") for x in (both, settled)]
        with _ordered(self.spark):
            shared = materialize(marked[0].unionByName(marked[1]), f"shared{number}", self.root)
        self.runs.append(run)
        self.open.append(shared.where("not later").drop("later"))
        return shared.where("later").select("doc", "tag", "at")

    def windows(self, docs: DataFrame | None = None) -> DataFrame:
        """Compare the windows that the batches since the last call left open; give back those that recur: doc, tag, at.

        ``docs`` (age, doc, tag, text) are all batches, if the caller has them in one.
        """
        low, high = self.compared, len(self.batches)
        self.compared = high
        spans = reduce(DataFrame.unionByName, self.open).groupBy("age", "doc", "tag").agg(F.collect_set("at").alias("spans"))
        spans = materialize(spans, f"spans{high}", self.root)
        self.open = []
        texts = _picked(docs if docs is not None else reduce(DataFrame.unionByName, self.batches), spans)
        if self.repeated:
            texts = texts.dropDuplicates(["age", "doc", "tag"])
        hashes = window_hashes(texts.join(spans, ["age", "doc", "tag"]), self.window)
        hashes = materialize(hashes, f"windows{high}", self.root)
        at = F.struct("age", "doc", "start")
        lead = hashes.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        single = hashes.where(F.col("age") >= low).join(lead, ["w1", "w2"]).where(at > F.col("first"))
        single = materialize(single.select("doc", "tag", F.expr("(start << 6) | 2").alias("at")), f"single{high}", self.root)
        for name in ("spans", "windows"):
            drop_scratch(self.spark, f"{self.root}/{name}{high}")
        return single

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc, tag, text); give back the stretches and windows of it that recur: doc, tag, at."""
        return self.insert(docs).unionByName(self.windows())

    def compact(self) -> None:
        """Merge all runs into one that holds the first entry of each stretch; the merged ones are deleted."""
        every = None
        for r in self.runs:
            t = self.spark.table(r).where("at & 1 = 0")
            every = t if every is None else every.unionByName(t)
        row = F.struct("age", "doc", F.expr("at >> 6").alias("start"), "at", "tag")
        kept = every.groupBy("key", "block", "check").agg(F.min(row).alias("r")).select("key", "block", "check", "r.doc", "r.tag", "r.at", "r.age")
        merged, self.runs = self.runs, [self._save(kept)]
        for r in merged:
            self._drop(r)

    def close(self) -> None:
        """Delete the runs."""
        for r in self.runs:
            self._drop(r)
        self.runs = []


def _repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether rows repeat a doc_id."""
    return not docs.groupBy(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _prepared(docs: DataFrame, id_col: str, text_col: str, repeated: bool = True) -> DataFrame:
    """(doc, tag, doc_id, text). The tag tells rows of one doc_id apart; it is 0 where no doc_id is repeated."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    return d.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES,
                    root: str | None = None, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (with ``texts`` also kept, null if nothing went).

    Batches are ranges of doc_id, so what the index holds is earlier than what comes.
    """
    spark = docs.sparkSession
    root = root or scratch_dir(spark)
    repeated = _repeated(docs, id_col)
    d = _prepared(docs, id_col, text_col, repeated)
    cuts = d.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []) - {LAST})  # null doc_ids are in the last batch
    index = Index(spark, root, window, gram, repeated=repeated)
    found = []
    own = F.col("doc_id").cast("long")  # not ``doc``: a reader can skip what is out of range
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = d
        part = part.where((own > low) | own.isNull() if high is None else own > low) if low is not None else part
        part = part.where(own <= high) if high is not None else part
        found.append(index.insert(part.select("doc", "tag", "text")))
    index.close()
    age = sum(((F.col("doc") > c).cast("int") for c in cuts), F.lit(0))
    found.append(index.windows(d.select(age.alias("age"), "doc", "tag", "text")))
    spans = materialize(reduce(DataFrame.unionByName, found).groupBy("doc", "tag").agg(F.collect_list("at").alias("spans")), "found", root)
    touched = _picked(d.select("doc", "tag", "text"), spans)
    if repeated:
        touched = touched.dropDuplicates(["doc", "tag"])
    touched = touched.join(spans, ["doc", "tag"])
    cleaned = _digests(touched, True, window).drop("n_words")
    if not texts:
        cleaned = cleaned.drop("kept")
    cleaned = materialize(cleaned.withColumnRenamed("kept_sha256", "new_sha256"), "cleaned", root)
    whole = _digests(d, False, window).drop("n_removed")
    out = whole.join(cleaned, ["doc", "tag"], "left")
    doc_id = F.when(F.col("doc") == LAST, None).otherwise(F.col("doc"))
    return out.select(doc_id.alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256"), *(["kept"] if texts else []))
