"""Operator 9, mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is e times its size gives each of its documents floor(e) certain whole copies. The words that are
left to the target are a sample of documents for one more copy, with unequal inclusion probabilities: p = min(1, l z)
in proportion to the document's size z, where l makes the expected words, the sum of p z, exactly those that are left.
Documents with p = 1 are certain too and split off. The others are ranked by the Pareto ranking variable, the odds of a
uniform random number divided by the odds of p (Rosen 1997), and the fixed size is filled in the order of the ranks: a
document that would pass the target is passed over, and the next ones that still fit are taken. So each source ends
below its target by less than the smallest document that was passed over last, or has no more to give.

Random numbers come from a hash of seed and doc_id, so reruns agree on any cluster.

Nothing is gathered by source. l follows from the number of documents of each size. For a walk down the ranks, words
are summed by (source, bin of ranks) with partial sums before the shuffle, and only the one bin of each source in which
the target is passed is ordered row by row; what comes out is the rank where the target is passed. The next walk starts
there with the documents that fit the smaller gap. Few walks are needed, as the gap shrinks like a random share each
time; they end when nothing fits.

Defined results: null, empty and blank texts have size 0 and take 0 words. A null source is a source of its own, the
last. Rows that repeat a doc_id share a random number; those that agree in size too are taken or left together. A very
long text is a document like any other: certain if l z passes 1, else passed over where it doesn't fit. An empty table
gives an empty result. Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, scratch_dir

#: Bins of the ranking variable to each doubling of it.
BINS = 1024
#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most copies of a source.
SHARE, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of seed and key; null keys share one."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of the per-source sizes: shares by weight, stopped at ``most`` times the size.

    A source is stopped if its stop, per weight, is below the common level; with sources in that order the level is a
    running sum, so no repeated resharing is needed. One row a source is all that this orders.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("stopped", F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.coalesce("stopped", F.lit(0.0))) / F.col("open_w"))
    s = s.withColumn("is_open", F.col("w") * F.col("level") < F.col("stop"))
    # The first open source fixes the level of all that follow.
    s = s.withColumn("fixed", F.min(F.when(F.col("is_open"), F.struct((F.col("stop") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("level")))).over(every)["level"])
    target = F.when(F.col("fixed").isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("w") * F.col("fixed")))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def size_factors(by_size: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, factor, most, need): p is ``factor`` x size for sizes up to ``most`` and 1 beyond; ``need`` are the words
    to sample after all certain copies.

    ``by_size`` has (source, size, n). If the sizes above z are certain, the factor is what they leave of the words,
    divided by the sum of squares of the others; z is the largest size for which that makes no probability pass 1.
    """
    s = sources.select(F.col("source").alias("s_source"), (F.col("target") - F.col("certain") * F.col("source_size")).alias("left"))
    x = by_size.join(s, _same(F.col("source"), F.col("s_source"))).drop("s_source").where("left > 0")
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    z, n = F.col("size").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    x = x.withColumn("words", z * n).withColumn("squares", z * z * n)
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    squares = F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    x = x.withColumn("above", above).withColumn("factor", (F.col("left") - above) / squares).where("factor * size < 1")
    best = F.max(F.struct("size", "factor", (F.col("left") - F.col("above")).alias("need"))).alias("b")
    return x.groupBy("source").agg(best).select("source", F.col("b.factor").alias("factor"), F.col("b.size").alias("most"), F.col("b.need").alias("need"))


def walk(x: DataFrame, start: DataFrame) -> DataFrame:
    """One walk down the ranks: (source, low, limit, high, room) for each source that has documents to take.

    ``x`` has (source, size, place, bin), ``start`` has (source, low, room). Documents after ``low`` of at most ``room``
    words are taken in the order of ``place`` up to before ``high``, the first that would pass the room (null: all are
    taken); ``limit`` is the room before and ``room`` what is left.
    """
    s = start.select(F.col("source").alias("s_source"), "low", F.col("room").alias("limit"))
    fits = _joined(x, s, "s_source").where((F.col("low").isNull() | (F.col("place") > F.col("low"))) & (F.col("size") <= F.col("limit")))
    sums = fits.groupBy("source", "low", "limit", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    passed = F.col("upto") > F.col("limit")
    cut = sums.groupBy("source", "low", "limit").agg(
        F.min(F.when(passed, F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("c"), F.max(F.when(~passed, F.col("upto"))).alias("got"))
    cut = materialize(cut.select("source", "low", "limit", "got", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("before")), "cut")
    e = cut.where("cut_bin is not null").select(F.col("source").alias("e_source"), F.col("low").alias("e_low"), F.col("limit").alias("e_limit"), "cut_bin", "before")
    edge = _joined(x, e, "e_source").where((F.col("bin") == F.col("cut_bin")) & (F.col("e_low").isNull() | (F.col("place") > F.col("e_low"))) & (F.col("size") <= F.col("e_limit")))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("place")) + F.col("before")  # equal places count as one
    edge = edge.select("source", "place", run.alias("run"), (run > F.col("e_limit")).alias("over"))
    edge = edge.groupBy(F.col("source").alias("e_source")).agg(F.min(F.when(F.col("over"), F.col("place"))).alias("high"), F.max(F.when(~F.col("over"), F.col("run"))).alias("reached"))
    out = cut.join(edge, _same(F.col("source"), F.col("e_source")), "left")
    got = F.coalesce("reached", "before", "got", F.lit(0))
    return out.select("source", "low", "limit", "high", (F.col("limit") - got).alias("room"))


def _joined(x: DataFrame, small: DataFrame, key: str) -> DataFrame:
    small = F.broadcast(small) if _small(small) else small
    return x.join(small, _same(F.col("source"), F.col(key))).drop(key)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix-1:", share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, root: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, chance (its p), copies, taken."""
    root = root or scratch_dir(docs.sparkSession)
    d = materialize(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sizes", root)
    by_size = materialize(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by_size", root)
    sources = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights)
    certain = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).cast("long")
    sources = materialize(sources.withColumn("certain", certain), "sources", root)
    factors = materialize(size_factors(by_size.where("size > 0"), sources), "factors", root)
    s = sources.join(factors.select(F.col("source").alias("f_source"), "factor", "most", "need"), _same(F.col("source"), F.col("f_source")), "left").drop("f_source")
    s = materialize(s.withColumnRenamed("source", "s_source"), "both", root)

    # The chance of one more copy, and the place in the order of the Pareto ranks.
    x = _joined(d, s, "s_source")
    p = F.when(F.col("factor").isNull() | (F.col("size") == 0), F.lit(0.0)).when(F.col("size") > F.col("most"), F.lit(1.0)).otherwise(F.col("factor") * F.col("size"))
    x = x.withColumn("chance", p)
    u = uniform(F.col("doc_id"), seed)
    odds = F.when((F.col("chance") > 0) & (F.col("chance") < 1), (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance"))))
    place = F.struct(odds.alias("odds"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))
    x = x.select("doc_id", "size", "source", "source_size", "target", "certain", "chance", F.when(odds.isNotNull(), place).alias("place"), F.floor(F.log2(odds) * BINS).cast("int").alias("bin"))
    x = materialize(x, "ranked", root)

    # Walks: the first from the top, each next one from where the last passed its room.
    ranked, none = x.where("place is not null").select("source", "size", "place", "bin"), F.lit(None).cast(x.schema["place"].dataType)
    start, walks = factors.select("source", none.alias("low"), F.col("need").alias("room")), []
    while True:
        walks.append(materialize(walk(ranked, start), f"walk{len(walks)}", root))
        start = walks[-1].where("high is not null and room >= 1").select("source", F.col("high").alias("low"), "room")
        if start.isEmpty():
            break
    every = walks[0]
    for w in walks[1:]:
        every = every.unionByName(w)
    taken = materialize(every.groupBy(F.col("source").alias("w_source")).agg(F.collect_list(F.struct("low", "high", "limit")).alias("walks")), "walks", root)
    x = x.join(F.broadcast(taken) if _small(taken) else taken, _same(F.col("source"), F.col("w_source")), "left")
    at = F.col("place")
    within = F.exists("walks", lambda w: (w["low"].isNull() | (at > w["low"])) & (w["high"].isNull() | (at < w["high"])) & (F.col("size") <= w["limit"]))
    copies = F.col("certain") + F.when((F.col("chance") == 1) | (at.isNotNull() & F.coalesce(within, F.lit(False))), 1).otherwise(0)
    return x.select("doc_id", "size", "source", "source_size", "target", "chance", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    Rows that agree in id, source and size are taken alike.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("copies").cast("int").alias("_copies"))
    same = docs[id_col].eqNullSafe(F.col("_id")) & docs[source_col].eqNullSafe(F.col("_source")) & (word_count(docs[text_col]) == F.col("_size"))
    out = docs.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[docs[c] for c in docs.columns])


def _small(table: DataFrame, limit: int = 8 << 20) -> bool:
    """True if a table that was written is below ``limit`` bytes; beyond, the join shuffles and AQE splits what is skewed."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < limit
