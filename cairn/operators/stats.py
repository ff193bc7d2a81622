"""Statistics over records and constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def residuals(rows: DataFrame, value: Column, group: list[str], within: float = 3600.0) -> DataFrame:
    """Rows, share of zero residuals, mean, sample deviation, and how many lie within a distance of 0."""
    r = rows.withColumn("_v", value.cast("double"))
    return r.groupBy(*group).agg(
        F.count("_v").alias("n"), F.round(F.avg((F.col("_v") == 0).cast("double")) * 100, 4).alias("match_pct"), F.round(F.avg("_v"), 4).alias("mean"),
        F.round(F.stddev_samp("_v"), 4).alias("stdev"), F.count_if(F.abs("_v") <= within).alias("within"),
    )


def spread(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Smallest, largest, spread, mean and deviation."""
    v = F.col(value)
    return rows.groupBy(*group).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (F.max(v) - F.min(v)).alias("spread"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("stdev"))


def histogram(rows: DataFrame, value: Column, width: float, buckets: int = 10) -> DataFrame:
    """Rows by bucket; values beyond the last fall into it."""
    return rows.groupBy(F.least(F.lit(buckets - 1), F.floor(value / width)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gaps(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The distance to the next row of the group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("gap", F.lead(value).over(w) - F.col(value))


def monotone(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Whether values never fall in walk order."""
    g = gaps(rows, group, order, value)
    return g.groupBy(*group).agg(F.bool_and(F.coalesce(F.col("gap") >= 0, F.lit(True))).alias("monotone"))


def positional(rows: DataFrame, value: str, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Elements of the sorted values at position int(n * share), clamped to the last; not interpolated.

    Exact ranks by one range-partitioned sort: counts of the distinct values, their running sum in two levels. With a
    group the values of each are ordered within it.
    """
    group = group or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    coarse = F.floor(F.col(value) / 1024).alias("_b")
    counts = counts.withColumn("_b", coarse)
    bins = counts.groupBy(*group, "_b").agg(F.sum("_c").alias("_bc"))
    total = bins.groupBy(*group).agg(F.sum("_bc").alias("_n")) if group else None
    wb = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_bc").over(wb), F.lit(0))).drop("_bc")
    inner = Window.partitionBy(*group, "_b").orderBy(value)
    c = counts.join(bins, [*group, "_b"]).withColumn("_hi", F.col("_before") + F.sum("_c").over(inner))
    c = c.join(total, group) if group else c.withColumn("_n", F.lit(counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]))
    c = c.withColumn("_lo", F.col("_hi") - F.col("_c"))
    picks = []
    for name, share in shares.items():
        at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(share)))
        picks.append(F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col(value))).alias(name))
    return c.groupBy(*group).agg(*picks) if group else c.agg(*picks)


def power_of_two(value: Column) -> Column:
    """The largest power of two at or below a positive number."""
    return F.when(value >= 1, F.pow(F.lit(2), F.floor(F.log2(value))).cast("long"))


def distribution(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Rows by value, the most frequent first; ties by value."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by)
    return out.limit(top) if top else out


def identical(rows: DataFrame, block: str, represent: str, top: int = 10) -> DataFrame:
    """Groups of identical blocks with a representative, the largest first."""
    return rows.groupBy(block).agg(F.count(F.lit(1)).alias("occurrences"), F.min(represent).alias("example")).orderBy(F.col("occurrences").desc(), block).limit(top)


def bursts(rows: DataFrame, outcome: str, latency: str, group: list[str]) -> DataFrame:
    """Number and median latency by outcome."""
    return rows.groupBy(*group, outcome).agg(F.count(F.lit(1)).alias("n"), F.round(F.expr(f"percentile({latency}, 0.5)"), 4).alias("median"))


def entropy(symbols: DataFrame, key: str, symbol: str) -> DataFrame:
    """Distinct symbols and Shannon entropy (bits) of each key's symbols."""
    c = symbols.groupBy(key, symbol).agg(F.count(F.lit(1)).alias("_c"))
    n = c.groupBy(key).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    return n.select(key, "distinct", F.round(F.log2("_n") - F.col("_s") / F.col("_n"), 6).alias("entropy"))


def near_pairs(a: DataFrame, b: DataFrame, a_at: str, b_at: str, distance: int) -> DataFrame:
    """Pairs within a distance. Places are binned by the distance, so each row of b meets three bins of a."""
    left = a.withColumn("_bin", F.floor(F.col(a_at) / distance))
    bins = F.array(*[F.floor(F.col(b_at) / distance) + i for i in (-1, 0, 1)])
    right = b.withColumn("_bin", F.explode(bins))
    return left.join(right, "_bin").where(F.abs(F.col(a_at) - F.col(b_at)) <= distance).drop("_bin")


def near(value: Column, center: int, radius: int) -> Column:
    """within a radius of a number."""
    return F.abs(value - center) <= radius


def audit_totals(results: DataFrame, group: list[str]) -> DataFrame:
    """A4, A5: files, bytes, ok and failed, by partial sums in each task and one merge."""
    return results.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.count_if("ok").alias("ok_files"), F.count_if(~F.col("ok")).alias("failed"))


def failures_once(failures: DataFrame, blob: str, kind: str) -> DataFrame:
    """Failures counted once for each blob and kind, and the number of distinct blobs."""
    return failures.select(blob, kind).distinct().groupBy(kind).agg(F.count(F.lit(1)).alias("failures"), F.countDistinct(blob).alias("blobs"))


def layout_totals(objects: DataFrame, computers: DataFrame) -> DataFrame:
    """A3: per computer objects and bytes by family, and whether its keyset is there."""
    t = objects.groupBy("cu", "family").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").cast("long").alias("bytes"))
    return t.join(computers.select("cu", "has_keyset"), "cu", "left").withColumn("missing_keyset", ~F.coalesce("has_keyset", F.lit(False)))
