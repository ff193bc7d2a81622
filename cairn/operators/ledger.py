"""Audit ledgers and incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order in which the object families are walked.
FAMILIES = ("blobpacks", "treepacks", "largeblobpacks", "standardobjects")


def skip_known(objects: DataFrame, ledger: DataFrame, key: str, since: Column | None = None) -> DataFrame:
    """Objects that the ledger does not hold as checked (after ``since``, if given)."""
    known = ledger if since is None else ledger.where(F.col("last_ok") >= since)
    return objects.join(known.select(key).distinct(), key, "left_anti")


def merge(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The union of two ledgers with the later check of each key. It is also the upsert."""
    return a.select(*key, "last_ok").unionByName(b.select(*key, "last_ok")).groupBy(*key).agg(F.max("last_ok").alias("last_ok"))


def prune(ledger: DataFrame, cutoff: Column) -> DataFrame:
    """Entries checked at or after the cutoff."""
    return ledger.where(F.col("last_ok") >= cutoff)


def forget(ledger: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The ledger without the keys of ``gone``."""
    return ledger.join(gone.select(*key).distinct(), key, "left_anti")


def unchanged(now: DataFrame, before: DataFrame, path: list[str], same: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``now`` whose path and stat columns equal those of an earlier walk; its ``keep`` columns are reused."""
    return now.join(before.select(*path, *same, *keep), [*path, *same])


def first_writer(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Of rows that share a key the one of the earliest source, then of the smallest order columns."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        every = s if every is None else every.unionByName(s)
    rest = [c for c in every.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct("priority", *order)).alias("_b")
    return every.groupBy(key).agg(best).select(key, "_b.*")


def family_rank(family: Column) -> Column:
    """The place of a family in the walk; a cursor must compare this, not the name."""
    return F.coalesce(F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), family), F.lit(0))


def after_cursor(objects: DataFrame, cursor: tuple) -> DataFrame:
    """Objects after a (computer, family, shard, name) cursor in walk order."""
    computer, family, shard, name = cursor
    place = F.struct("computer", family_rank(F.col("family")).alias("f"), "shard", "name")
    at = F.struct(F.lit(computer).alias("computer"), family_rank(F.lit(family)).alias("f"), F.lit(shard).alias("shard"), F.lit(name).alias("name"))
    return objects.where(place > at)


def within_budget(rows: DataFrame, size: str, order: list[str], most: int, group: list[str]) -> DataFrame:
    """Rows in order while the running sum before them is below the budget of their group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("spent_before") < most)


def spent(rows: DataFrame, order: list[str], group: list[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Per group what is done within its budgets and why it stopped: (rows, done, one sum a budget, reason).

    ``limits`` gives for each reason, as 'max_runtime' or 'max_bytes', a column and its bound. A row is begun while no
    running sum before it has reached its bound; the reason is the first of the reached ones in the order given, null if all rows are done.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {reason: F.coalesce(F.sum(col).over(w), F.lit(0)) >= most for reason, (col, most) in limits.items()}
    hit = F.coalesce(*[F.when(c, F.lit(r)) for r, c in before.items()])
    x = rows.withColumn("_hit", hit)
    sums = [F.sum(F.when(F.col("_hit").isNull(), F.col(col))).alias(col) for col, _ in limits.values()]
    return x.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_hit").isNull()).alias("done"), *sums, F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.struct(*order))).alias("reason"))


def sampled(rows: DataFrame, key: str, n: int, fraction: float, seed: str = "") -> DataFrame:
    """max(1, int(n * fraction)) rows without replacement, the same on every run: those of smallest hash."""
    most = max(1, int(n * fraction))
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("_h", key).limit(most).drop("_h")


def first_failures(failures: DataFrame, group: list[str], order: list[str], cap: int = 100) -> DataFrame:
    """The first ``cap`` failures of each group, as a report shows them."""
    w = Window.partitionBy(*group).orderBy(*order)
    return failures.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
