"""Which snapshots stay, and what their removal frees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("hourly", "daily", "weekly", "monthly", "yearly")


@dataclass(frozen=True)
class Policy:
    """Counts of records to keep: the last N, or the newest of each of the newest K buckets. All unset keeps all.

    0 as ``last_n`` is refused: it would select nothing, and so prune everything.
    """

    last_n: int | None = None
    hourly: int = 0
    daily: int = 0
    weekly: int = 0
    monthly: int = 0
    yearly: int = 0

    def __post_init__(self):
        if self.last_n is not None and self.last_n <= 0:
            raise ValueError("last_n must be positive")

    @property
    def keeps_all(self) -> bool:
        return self.last_n is None and not any(getattr(self, b) for b in BUCKETS)


def bucket(ts: Column, kind: str) -> Column:
    """A number that is equal within, and grows with, the time bucket (UTC; weeks are ISO weeks)."""
    if kind == "weekly":
        return F.extract(F.lit("yearofweek"), ts) * 100 + F.weekofyear(ts)
    unit = {"hourly": "hour", "daily": "day", "monthly": "month", "yearly": "year"}[kind]
    return F.date_trunc(unit, ts)


def select_retained(records: DataFrame, policy: Policy, group: list[str], ts: str = "ts", ordinal: str = "ordinal") -> DataFrame:
    """The records with a column ``retained``, and ``reasons`` that kept them.

    The newest of a bucket is the latest by time, then by ordinal (W2: the later input row). Records without a time
    are always kept. All rules share the grouping, so the rows are shuffled once.
    """
    if policy.keeps_all:
        return records.withColumn("retained", F.lit(True)).withColumn("reasons", F.array(F.lit("all")))
    dated = F.col(ts).isNotNull()
    newest = [F.col(ts).desc(), F.col(ordinal).desc()]
    rules = []
    if policy.last_n is not None:
        records = records.withColumn("_n", F.row_number().over(Window.partitionBy(*group, dated).orderBy(*newest)))
        rules.append(F.when(dated & (F.col("_n") <= policy.last_n), F.lit("last_n")))
    for kind in BUCKETS:
        k = getattr(policy, kind)
        if not k:
            continue
        records = records.withColumn("_b", bucket(F.col(ts), kind))
        records = records.withColumn(f"_r_{kind}", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*newest)))
        records = records.withColumn(f"_d_{kind}", F.dense_rank().over(Window.partitionBy(*group).orderBy(F.col("_b").desc())))
        rules.append(F.when(dated & (F.col(f"_r_{kind}") == 1) & (F.col(f"_d_{kind}") <= k), F.lit(kind)))
    rules.append(F.when(~dated, F.lit("undated")))
    out = records.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("retained", F.size("reasons") > 0)
    return out.drop("_n", "_b", *[f"_{x}_{k}" for x in "rd" for k in BUCKETS])


def prune_plan(records: DataFrame, policy: Policy, group: list[str], **names) -> DataFrame:
    """Per group how many records stay and go; nothing is deleted."""
    s = select_retained(records, policy, group, **names)
    return s.groupBy(*group).agg(F.count(F.lit(1)).alias("records"), F.count_if("retained").alias("kept"), F.count_if(~F.col("retained")).alias("pruned"))


def orphans(stored: DataFrame, references: DataFrame, key: str = "blob_id", unreadable: DataFrame | None = None) -> DataFrame:
    """Stored rows that nothing references. If any record or tree is ``unreadable`` there are none (fail closed)."""
    out = stored.join(references.select(key).distinct(), key, "left_anti")
    return out.where("false") if unreadable is not None and not unreadable.isEmpty() else out


def orphan_groups(members: DataFrame, references: DataFrame, group: str, key: str) -> DataFrame:
    """Per group (a pack) whether any member is referenced; a group with none may go, the others count as kept."""
    live = references.select(key).distinct().withColumn("_live", F.lit(True))
    j = members.join(live, key, "left")
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if("_live").alias("live")).withColumn("kept", F.col("live") > 0)


def latest_per_group(rows: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of the largest order columns in each group, by partial aggregation instead of a sort."""
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("_b")
    return rows.groupBy(*group).agg(best).select(*group, "_b.*")


def latest_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)
