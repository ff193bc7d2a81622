"""Comparing snapshots, stores and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.scratch import materialize, scratch_dir


def snapshot_diff(a: DataFrame, b: DataFrame, key: str = "rel_path", expand: bool = True) -> DataFrame:
    """What changed from ``a`` to ``b``: rows of (key, is_tree, size, chunk_ids) to (key, kind, old_size, new_size).

    Chunk lists are compared in order; changes of metadata alone are no change. One full outer join on the key, and
    equal rows are dropped by the filter above it. With ``expand=False`` an added or removed directory is one row: its
    descendants are anti-joined away.
    """
    a = a.select(F.col(key), F.col("is_tree").alias("a_tree"), F.col("size").alias("old_size"), F.col("chunk_ids").alias("a_ids"), F.lit(True).alias("in_a"))
    b = b.select(F.col(key), F.col("is_tree").alias("b_tree"), F.col("size").alias("new_size"), F.col("chunk_ids").alias("b_ids"), F.lit(True).alias("in_b"))
    kind = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(F.col("a_tree") != F.col("b_tree"), "type_changed")
        .when(~F.col("a_tree") & ~F.col("a_ids").eqNullSafe(F.col("b_ids")), "modified")
    )
    out = a.join(b, key, "full_outer").withColumn("kind", kind).where("kind is not null")
    if not expand:
        dirs = out.where("kind in ('added', 'removed') and coalesce(a_tree, b_tree)").select(F.col(key).alias("_dir"), F.col("kind").alias("_kind"))
        parents = out.select(key, "kind", F.explode(ancestors(F.col(key))).alias("_dir"))
        below = parents.join(dirs, (parents._dir == dirs._dir) & (parents.kind == dirs._kind)).select(key).distinct()
        out = out.join(below, key, "left_anti")
    return out.select(key, "kind", "old_size", "new_size")


def pruned_diff(a: DataFrame, b: DataFrame, roots: tuple, expand: bool = True) -> DataFrame:
    """J1 over content-addressed trees: rows of (path, is_tree, kind, old_size, new_size), by going down where ids differ.

    ``a`` and ``b`` have (parent, name, child, is_tree, size); ``roots`` are the two root ids. Equal ids are equal subtrees, so
    only entries of trees that differ are joined: work follows the changes, not the store. With ``expand`` what is below
    an added or removed directory is listed too.
    """
    spark = a.sparkSession
    folder, depth, out = scratch_dir(spark), 0, []
    front = spark.createDataFrame([("", *roots)] if roots[0] != roots[1] else [], "path string, pa string, pb string")
    sides = [e.select(F.col("parent").alias(f"_{s}"), "name", F.col("child").alias(f"{s}_id"), F.col("is_tree").alias(f"{s}_tree"), F.col("size").alias(f"{s}_size"), F.lit(True).alias(f"in_{s}")) for e, s in ((a, "a"), (b, "b"))]
    while True:
        below = [front.where(F.col(f"p{s}").isNotNull()).join(e, F.col(f"p{s}") == F.col(f"_{s}")).drop("pa", "pb", f"_{s}") for e, s in zip(sides, "ab")]
        j = below[0].join(below[1], ["path", "name"], "full_outer").where("not (a_id <=> b_id and a_tree <=> b_tree)")
        full = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a_tree") != F.col("b_tree"), "type_changed").when(~F.col("a_tree"), "modified")
        rows = materialize(j.withColumn("full", full).withColumn("kind", kind).drop("path", "name"), f"depth{depth}", folder)
        out.append(rows.where("kind is not null").select(F.col("full").alias("path"), F.coalesce("b_tree", "a_tree").alias("is_tree"), "kind", F.col("a_size").alias("old_size"), F.col("b_size").alias("new_size")))
        deeper = rows if expand else rows.where("a_tree and b_tree")
        front = deeper.select(F.col("full").alias("path"), F.when(F.col("a_tree"), F.col("a_id")).alias("pa"), F.when(F.col("b_tree"), F.col("b_id")).alias("pb")).where("pa is not null or pb is not null")
        depth += 1
        if front.isEmpty():
            break
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def ancestors(path: Column) -> Column:
    """Proper ancestors of a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """A1: rows of a diff by kind."""
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dedup_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct blobs of two snapshots (blob_id, size): counts and bytes each, shared, unique to each, ratio.

    The ratio is the shared part of b's bytes, 0 if b is empty.
    """
    a = a.groupBy("blob_id").agg(F.max("size").alias("a_size"))
    b = b.groupBy("blob_id").agg(F.max("size").alias("b_size"))
    j = a.join(b, "blob_id", "full_outer")
    in_a, in_b = F.col("a_size").isNotNull(), F.col("b_size").isNotNull()
    size = F.coalesce("b_size", "a_size")
    total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("long")
    out = j.agg(
        F.count_if(in_a).alias("blobs_a"), F.count_if(in_b).alias("blobs_b"), F.count_if(in_a & in_b).alias("shared"),
        F.count_if(in_a & ~in_b).alias("unique_a"), F.count_if(~in_a & in_b).alias("unique_b"),
        total(in_a).alias("bytes_a"), total(in_b).alias("bytes_b"), total(in_a & in_b).alias("bytes_shared"),
    )
    ratio = F.coalesce(F.col("bytes_shared") / F.nullif(F.col("bytes_b"), F.lit(0)), F.lit(0.0))
    return out.withColumn("dedup_ratio", F.round(ratio, 6))


def record_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key 'missing_in_a', 'missing_in_b', or one row for each field that differs."""
    a = a.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("x"))
    b = b.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("y"))
    j = a.join(b, key, "full_outer").where("not (x <=> y)")
    each = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.struct(F.lit(f).alias("what"), F.col(f"x.{f}").alias("old"), F.col(f"y.{f}").alias("new"))) for f in fields]))
    whole = lambda what: F.array(F.struct(F.lit(what).alias("what"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    rows = F.when(F.col("x").isNull(), whole("missing_in_a")).when(F.col("y").isNull(), whole("missing_in_b")).otherwise(each)
    return j.select(key, F.explode(rows).alias("d")).select(key, "d.*")


def nested_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(json_path, type) of the left that the right lacks or has with another type."""
    right = b.select(F.col("json_path"), F.col("type").alias("right_type"))
    return a.join(right, "json_path", "left").where("not (type <=> right_type)").select("json_path", "type", "right_type")


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of intersection, differences and union of two id sets (one column, blob_id)."""
    a, b = a.select("blob_id").distinct().withColumn("a", F.lit(1)), b.select("blob_id").distinct().withColumn("b", F.lit(1))
    j = a.join(b, "blob_id", "full_outer")
    return j.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"), F.count(F.lit(1)).alias("either"))


def key_difference(wanted: Column, found: Column) -> Column:
    """U4: keys missing from and extra in a shape."""
    return F.struct(F.array_sort(F.array_except(wanted, found)).alias("missing"), F.array_sort(F.array_except(found, wanted)).alias("extra"))


def chunk_lockstep(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ordered chunk-length lists (key, ordinal, length) side by side: matching chunks, first divergence.

    The divergence offset is the sum of the lengths before it; null if the lists agree.
    """
    j = a.withColumnRenamed("length", "la").join(b.withColumnRenamed("length", "lb"), [key, "ordinal"], "full_outer")
    first = j.where("not (la <=> lb)").groupBy(key).agg(F.min("ordinal").alias("first_divergence"))
    j = j.join(first, key, "left")
    before = F.col("first_divergence").isNull() | (F.col("ordinal") < F.col("first_divergence"))
    return j.groupBy(key).agg(
        F.count(F.col("la")).alias("chunks_a"), F.count(F.col("lb")).alias("chunks_b"), F.count_if(before).alias("matching"),
        F.max("first_divergence").alias("first_divergence"),
        F.when(F.max("first_divergence").isNotNull(), F.coalesce(F.sum(F.when(before, F.col("la"))), F.lit(0))).cast("long").alias("divergence_offset"),
    )


def difference_summary(differences: DataFrame, kinds: list[str], kind: str = "what") -> DataFrame:
    """The number of differences of each kind, those without any too, and whether there is none at all."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    return differences.agg(*counts, F.count_if(~F.col(kind).isin(*kinds)).alias("other")).withColumn("match", F.greatest(*kinds, "other") == 0)


def shape_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """V4: two stores' shapes (file, json_path, type) side by side: (file, json_path, what, type_a, type_b) of what differs,
    'file_only_a', 'file_only_b', 'path_only_a', 'path_only_b' or 'type'. ``difference_summary`` counts it.
    """
    sets = [d.groupBy("file", "json_path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias(f"type_{s}")) for d, s in ((a, "a"), (b, "b"))]
    files = [d.select("file").distinct().withColumn(f"has_{s}", F.lit(True)) for d, s in ((a, "a"), (b, "b"))]
    j = sets[0].join(sets[1], ["file", "json_path"], "full_outer").join(files[0], "file", "left").join(files[1], "file", "left")
    what = F.when(F.col("has_b").isNull(), "file_only_a").when(F.col("has_a").isNull(), "file_only_b").when(F.col("type_b").isNull(), "path_only_a").when(F.col("type_a").isNull(), "path_only_b").when(F.col("type_a") != F.col("type_b"), "type")
    return j.select("file", "json_path", what.alias("what"), "type_a", "type_b").where("what is not null")
