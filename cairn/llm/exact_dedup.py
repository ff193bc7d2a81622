"""Operator 6, exact deduplication: a stateful stream over disk-backed keyed state.

The stream's state is Spark's keyed aggregation state in the RocksDB store: no watermark, so nothing expires. For each
digest it keeps a stable identifier (the document that stays), a content locator (file and row that hold its bytes)
and the number of rows. Each micro-batch is aggregated per task before the shuffle, so that a digest with a third of
all rows costs one state row per task, not a hot task. Rows that hit a digest held by another row are then compared
with the full bytes found at the locator; only equal bytes share a group, and a digest that fails is regrouped by its
bytes. Texts are shuffled for that comparison only, and there those of shared digests (and the few a Bloom filter lets by).

Defined results: null text counts as empty; all texts that are empty or white space form one group. Rows that repeat
a doc_id are separate rows of one group; of rows equal in length and doc_id the one with the smallest locator stays.
Null doc_ids come last among equals. Bytes that are no UTF-8 stay as they are. An empty table gives an empty result.
Columns other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, scratch_dir

#: State on disk; without preallocated files, as there is a store for each shuffle partition. A store is closed when its
#: task commits, so that an executor holds those of its running tasks only; a batch is committed as one file of changes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: A Bloom filter (1 MB) of the shared digests drops the texts of other rows before they are shuffled, whatever the sizes; what it
#: lets through in error the join drops.
FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}
#: Rows that the reader decodes at once; with Spark's 4,096, the long texts here take large arrays in each task.
SCAN = {"spark.sql.parquet.columnarReaderBatchSize": "256"}
#: White space that doesn't count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Files taken by one micro-batch.
FILES_PER_BATCH = 10_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings are ``values`` meanwhile."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def normalised(text: Column) -> Column:
    """The text without ``BLANKS``. One byte each, so replaced in the bytes; ``translate`` makes an object of each character."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def located(df: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """Each row's digest, rank (smaller is better) and locator; the normalised text comes along until it is pruned."""
    text = F.col(text_col)
    norm = normalised(text)
    sha = F.coalesce(F.sha2(norm, 256), F.lit(""))  # never null; where the planner knows, a join needs no pass to see it
    return df.select(
        F.col(id_col).alias("doc_id"),
        sha.alias("text_sha256"),
        F.substring(sha, 1, digest_bits // 4).alias("digest"),
        norm.alias("norm"),
        F.struct(
            (-F.length(F.coalesce(text, F.lit("")))).cast("long").alias("neg_length"),
            F.col(id_col).isNull().alias("no_id"),
            F.col(id_col).alias("doc_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("rank"),
    )


def dedup_stream(spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text",
                 digest_bits: int = 256) -> DataFrame:
    """Run the stream over the files at ``path`` that it has not seen; return the latest state row of each digest.

    ``state_dir`` holds the state, the offsets and the changed rows. A rerun with the same folder resumes: new files
    are held against all history, and a micro-batch that is replayed after a failure overwrites its own output.
    """
    # A pattern may match a folder or a single file; a plain path must be a folder.
    plain = path.rstrip("/")
    pattern = re.sub(r"([*?\[\]{}\\])", r"\\\1", plain[:-1]) + f"[{plain[-1]}]"
    source = (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(pattern)
    )
    state = (
        located(source, id_col, text_col, digest_bits).groupBy("digest")
        .agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )

    def changed(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state_dir}/changed/{number}")

    with settings(spark, STORE | SCAN):
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True).foreachBatch(changed).start()
        )
        query.awaitTermination()
    schema = state.withColumn("batch", F.lit(0)).schema
    try:
        rows = spark.read.schema(schema).parquet(f"{state_dir}/changed/*")
    except Exception as e:  # no batch has run: the input holds no file or no row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.*")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest_bits: int = 256, state_dir: str | None = None) -> DataFrame:
    """One row per row at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bits`` shortens the digest that keys the state; results do not depend on it, as hits are checked by bytes.
    """
    state_dir = state_dir or scratch_dir(spark)
    state = materialize(dedup_stream(spark, path, state_dir, id_col, text_col, digest_bits), "state", state_dir)
    rows = located(spark.read.parquet(path), id_col, text_col, digest_bits)
    # Written, as the planner takes its true size; filtered again, as it makes filters of tables that are filtered only.
    shared = materialize(state.where("group_size > 1"), "shared", state_dir).where("group_size > 1").select("digest", "best")

    # Full bytes on hits: each row of a shared digest against the bytes at the state's locator.
    hits = rows.join(shared, "digest").select("digest", "norm", (F.col("rank") == F.col("best")).alias("held"))
    with settings(spark, FILTER | SCAN):
        hits = materialize(hits, "hits", state_dir)
    held = hits.where("held").select("digest", F.col("norm").alias("bytes"))
    # No aggregation above this join, so that AQE can split the rows of a digest with many.
    differ = hits.where("not held").join(held, "digest").where(F.col("norm") != F.col("bytes")).select("digest")
    differ = materialize(differ, "differ", state_dir)

    out = rows.select("doc_id", "text_sha256", "digest", "rank").join(state, "digest")
    if not differ.isEmpty():
        differ = differ.distinct()
        again = rows.join(differ, "digest").select("doc_id", "text_sha256", "digest", "rank", "norm")
        groups = again.groupBy("digest", "norm").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
        again = again.join(groups, ["digest", "norm"]).drop("norm")
        out = out.join(differ, "digest", "left_anti").unionByName(again.select(out.columns))
    out = out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        "text_sha256",
    )
    with settings(spark, SCAN):
        return materialize(out, "groups", state_dir)
