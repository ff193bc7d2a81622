"""What a backup or restore would touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """Lower-case suffix after the last dot; names that only begin with a dot, or end in one, have none."""
    ext = F.regexp_extract(name, r"^.*[^/.][^/]*?(\.[^./]+)$", 1)
    return F.when(ext == "", F.lit("(no ext)")).otherwise(F.lower(ext))


def totals(files: DataFrame, size: str = "size", group: list[str] | None = None) -> DataFrame:
    """Number of files and bytes; null sizes count as 0."""
    aggs = [F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))), F.lit(0)).cast("long").alias("bytes")]
    return files.groupBy(*group).agg(*aggs) if group else files.agg(*aggs)


def largest(files: DataFrame, n: int = 20, size: str = "size", ordinal: str = "ordinal") -> DataFrame:
    """O1: the n largest; ties keep the one seen first. Spark keeps n rows a task and merges them."""
    return files.orderBy(F.col(size).desc(), F.col(ordinal)).limit(n)


def by_extension(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files and bytes by extension."""
    return totals(files.withColumn("ext", extension(F.col(path))), size, ["ext"])


def rollup(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Bytes and files below each directory, the root as ''. One row an ancestor, summed before the shuffle."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(above).alias("dir"), F.col(size).alias("_s")).groupBy("dir").agg(F.sum("_s").cast("long").alias("item_size"), F.count(F.lit(1)).alias("contained_files"))


def size_rule(size: Column, is_symlink: Column, cap: int) -> Column:
    """F8: kept if not above the cap; symbolic links are exempt."""
    return (size <= cap) | is_symlink


def special_kind(mode: Column) -> Column:
    """fifo, char, block or socket by the mode's type bits; null for others."""
    kind = mode.bitwiseAND(F.lit(0xF000))
    return F.when(kind == 0x1000, "fifo").when(kind == 0x2000, "char").when(kind == 0x6000, "block").when(kind == 0xC000, "socket")


def permissions(mode: Column) -> Column:
    """The permission bits."""
    return mode.bitwiseAND(F.lit(0o7777))


def is_symlink(mode: Column) -> Column:
    """Type bits of a symbolic link."""
    return mode.bitwiseAND(F.lit(0xF000)) == 0xA000


def hardlinks(entries: DataFrame, inode: str, links: str, path: str, order: list[str]) -> DataFrame:
    """For entries of one inode after the first, the path of the first, to which they are links."""
    shared = (F.col(links) > 1) & (F.col(inode) != 0)
    first = F.first(path).over(Window.partitionBy(inode).orderBy(*order))
    return entries.withColumn("link_to", F.when(shared & (first != F.col(path)), first))


def disk_fit(needed: Column, free: Column, overhead: float = 0.0) -> Column:
    """Estimate, whether it fits and what is missing. An unknown free space (0) counts as fit, with a note."""
    estimate = F.ceil(needed * (1 + overhead)).cast("long")
    known = free > 0
    return F.struct(
        estimate.alias("estimate"), (~known | (estimate <= free)).alias("fits"),
        F.when(known, F.greatest(estimate - free, F.lit(0))).otherwise(F.lit(0)).cast("long").alias("shortfall"),
        F.when(~known, F.lit("free space unknown")).otherwise(F.lit("")).alias("notes"),
    )
