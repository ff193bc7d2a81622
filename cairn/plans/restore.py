"""Restoring (P10): what is to be written, from flattened paths and chunk references, and the bytes themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(entries: DataFrame, chunks: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """P10: (path, is_tree, size, chunks, bytes, missing, status) of each entry to restore.

    ``entries`` has (path, is_tree, size), ``chunks`` (path, ordinal, blob_id), ``stored`` (blob_id, length). A file is 'ok', 'missing' if a chunk is
    not stored, or 'size differs'; a directory is 'directory'. Chunks are counted where they are, never gathered.
    """
    s = stored.groupBy("blob_id").agg(F.max("length").alias("length"))
    per = chunks.join(s, "blob_id", "left").groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("length").isNull()).alias("missing"))
    j = entries.join(per, key, "left").fillna(0, ["chunks", "bytes", "missing"])
    status = F.when(F.col("is_tree"), "directory").when(F.col("missing") > 0, "missing").when(F.col("bytes") != F.col("size"), "size differs").otherwise("ok")
    return j.select(key, "is_tree", "size", "chunks", "bytes", "missing", status.alias("status"))


def contents(chunks: DataFrame, blobs: DataFrame, key: str = "path") -> DataFrame:
    """P10: (path, content) of files whose chunks are all there, in the order of their ordinals.

    A file's bytes meet in one row, so this is for files that fit a task; larger ones are written chunk by chunk from the join.
    """
    j = chunks.join(blobs.select("blob_id", "content"), "blob_id", "left")
    whole = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("c"), F.count_if(F.col("content").isNull()).alias("missing")).where("missing = 0")
    join = F.aggregate("c", F.lit(b""), lambda acc, x: F.concat(acc, x["content"].cast("binary")))
    return whole.select(key, join.alias("content"))
