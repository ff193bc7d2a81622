"""Walks over the tree graph (G1-G9). Loops run on the driver; each step is a distributed join.

A visited anti-join keeps every node once, however many paths lead to it. Edges and each round's frontier are written
once to the session's shared folder, so lineage stays short and a lost executor costs one round. Loops end when nothing
is left to do: a depth is a bound only where the caller names one, and passing it is an error, never a shorter result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.scratch import materialize, scratch_dir

#: Frontiers that a walk keeps apart before it writes them as one.
FRONTIERS = 8


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _beyond(depth: int, bound: int | None) -> None:
    if bound is not None and depth > bound:
        raise ValueError(f"the walk goes beyond depth {bound}")


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of the nodes that each root reaches, itself included, at their smallest depth.

    ``edges`` has (parent, child), ``roots`` has (root, node): with several nodes a root it is the multi-source walk.
    A graph that goes deeper than ``max_depth`` is refused.
    """
    folder, depth = scratch_dir(edges.sparkSession), 0
    edges = materialize(edges.select("parent", "child").distinct(), "edges", folder)
    seen = [materialize(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)), "depth0", folder)]
    frontier = seen[0]
    while True:
        depth += 1
        step = frontier.join(edges, frontier.node == edges.parent).select("root", F.col("child").alias("node")).distinct()
        fresh = step.join(_union(seen), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(fresh, f"depth{depth}", folder)
        if frontier.isEmpty():
            return _union(seen)
        _beyond(depth, max_depth)
        seen.append(frontier)
        if len(seen) > FRONTIERS:
            seen = [materialize(_union(seen), f"seen{depth}", folder)]


def flatten(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, descend=None) -> DataFrame:
    """(root, path, node, depth) of every path; a node is repeated for each path that leads to it.

    ``edges`` has (parent, child, name). ``descend(path)``, a column rule, prunes each frontier before it grows. A path of
    more steps than there are parents goes round a cycle, and is refused as one that passes ``max_depth`` is.
    """
    folder, depth, parents = scratch_dir(edges.sparkSession), 0, None
    edges = materialize(edges.select("parent", "child", "name"), "edges", folder)
    level = materialize(roots.select("root", F.lit("").alias("path"), "node").withColumn("depth", F.lit(0)), "depth0", folder)
    out = [level]
    while True:
        depth += 1
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        step = level.join(edges, level.node == edges.parent).select("root", path.alias("path"), F.col("child").alias("node")).withColumn("depth", F.lit(depth))
        level = materialize(step.where(descend(F.col("path"))) if descend else step, f"depth{depth}", folder)
        if level.isEmpty():
            return _union(out)
        _beyond(depth, max_depth)
        if depth % 32 == 0:
            parents = parents or edges.agg(F.count_distinct("parent")).first()[0]
            if depth > parents:
                raise ValueError("the graph has a cycle: its paths have no end")
        out.append(level)
        if len(out) > FRONTIERS:
            out = [materialize(_union(out), f"paths{depth}", folder)]


def depth_table(flat: DataFrame, zero, match) -> DataFrame:
    """Per depth the nodes and the shares of two conditions; the total row has depth -1."""
    aggs = [F.count(F.lit(1)).alias("nodes"), F.round(F.avg(zero.cast("double")) * 100, 4).alias("zero_pct"), F.round(F.avg(match.cast("double")) * 100, 4).alias("match_pct")]
    return flat.groupBy(F.col("depth").cast("int").alias("depth")).agg(*aggs).unionByName(flat.agg(*aggs).withColumn("depth", F.lit(-1)))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """The nodes that stand on a cycle; none if the graph has no cycle.

    Edges that lead from a source or into a sink are peeled off, and nodes with one way in and one way out are taken out
    of their chains, an independent set at a time, so that a long chain takes a logarithm of rounds. What remains is cut
    into strongly connected components by colours; chains then get those of their ends back.
    """
    folder, n, taken = scratch_dir(edges.sparkSession), 0, []
    left = materialize(edges.select("parent", "child").where("parent is not null and child is not null").distinct(), "edges0", folder)
    number = left.count()
    while True:  # peel and contract, until neither does anything
        n += 1
        ends = left.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("parent").alias("before"))
        ends = ends.join(left.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("child").alias("after")), "node")
        inner = materialize(ends, f"inner{n}", folder)
        kept = left.join(inner.select(F.col("node").alias("parent")), "parent", "left_semi").join(inner.select(F.col("node").alias("child")), "child", "left_semi")
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(2))
        single = inner.where("ins = 1 and outs = 1 and before <> node").select("node", "before", "after")
        others = single.select(F.col("node").alias("before"), F.lit(True).alias("chained"))
        chosen = single.where(coin("node") == 1).join(others, "before", "left").where(F.col("chained").isNull() | (coin("before") == 0)).drop("chained")
        # Both ends of its edges must have stayed.
        for end in ("before", "after"):
            chosen = chosen.join(inner.select(F.col("node").alias(end)), end, "left_semi")
        chosen = materialize(chosen.select("node", "before", "after"), f"chosen{n}", folder)
        # A chosen node's edges go; one from before it to after it, or to what comes after a chosen one after it, stands for them.
        rest = kept.join(chosen.select(F.col("node").alias("parent")), "parent", "left_anti").join(chosen.select(F.col("node").alias("child")), "child", "left_anti")
        new = chosen.select(F.col("before").alias("parent"), F.col("after").alias("child"))
        now = materialize(rest.select("parent", "child").unionByName(new).distinct(), f"edges{n}", folder)
        some, count = not chosen.isEmpty(), now.count()
        if some:
            taken.append(chosen)
        if not some and count == number and inner.where("ins = 1 and outs = 1 and before <> node").isEmpty():
            break
        left, number = now, count
        if not count:
            break
    none = left.select(F.col("parent").alias("node"), F.col("parent").alias("component")).where("1 = 0")
    parts, rounds = [], 0
    while not left.isEmpty():
        # The colour of a node is the largest one that reaches it; its component in that colour is what reaches back.
        nodes = left.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
        colour = materialize(nodes.select("node", F.col("node").alias("colour")), f"colour{n}-{rounds}", folder)
        while True:
            rounds += 1
            reached = left.join(colour.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "colour")
            more = materialize(colour.unionByName(reached).groupBy("node").agg(F.max("colour").alias("colour")), f"colour{n}-{rounds}", folder)
            changed = not more.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = more
            if not changed:
                break
        back = left.join(colour.select(F.col("node").alias("parent"), F.col("colour").alias("pc")), "parent").join(colour.select(F.col("node").alias("child"), F.col("colour").alias("cc")), "child").where("pc = cc")
        back = materialize(back.select(F.col("child").alias("parent"), F.col("parent").alias("child")), f"back{n}-{rounds}", folder)
        found = reachable(back, colour.where("node = colour").select(F.col("colour").alias("root"), "node"))
        found = materialize(found.select("node", F.col("root").alias("component")), f"found{n}-{rounds}", folder)
        inside = left.join(found.select(F.col("node").alias("parent"), F.col("component").alias("pc")), "parent").join(found.select(F.col("node").alias("child"), F.col("component").alias("cc")), "child").where("pc = cc")
        parts.append(materialize(found.join(inside.select(F.explode(F.array("parent", "child")).alias("node")).distinct(), "node", "left_semi"), f"part{n}-{rounds}", folder))
        left = left.join(found.select(F.col("node").alias("parent")), "parent", "left_anti").join(found.select(F.col("node").alias("child")), "child", "left_anti")
        left = materialize(left.select("parent", "child"), f"left{n}-{rounds}", folder)
    on = _union(parts) if parts else none
    for k, chosen in enumerate(reversed(taken)):
        a = chosen.join(on.select(F.col("node").alias("before"), F.col("component").alias("ca")), "before").join(on.select(F.col("node").alias("after"), F.col("component").alias("cb")), "after")
        on = materialize(on.unionByName(a.where("ca = cb").select("node", F.col("ca").alias("component"))), f"on{k}", folder)
    return on.select("node").distinct()


def live_paths(reached: DataFrame, blob_refs: DataFrame) -> DataFrame:
    """Packs that hold a referenced blob, by a projection of the one walk."""
    return blob_refs.join(reached.select(F.col("node").alias("owner")).distinct(), "owner", "left_semi").where("is_packed").select("rel_path").distinct()


def harvest(reached: DataFrame, blob_refs: DataFrame) -> DataFrame:
    """The locations of all reached blobs, one for each blob."""
    refs = blob_refs.join(reached.select(F.col("node").alias("owner")).distinct(), "owner", "left_semi")
    return refs.groupBy("blob_id").agg(F.min(F.struct("rel_path", "offset", "length")).alias("_l")).select("blob_id", "_l.*")


def validation_walk(reached: DataFrame, blob_refs: DataFrame, stored: DataFrame, max_blobs: int | None = None) -> DataFrame:
    """Each reached blob once with status 'ok', 'missing' or 'corrupt', in id order up to ``max_blobs``.

    ``stored`` has (blob_id, ok); a read that fails for any reason is a row without ok.
    """
    wanted = blob_refs.join(reached.select(F.col("node").alias("owner")).distinct(), "owner", "left_semi").select("blob_id").distinct()
    if max_blobs is not None:
        wanted = wanted.orderBy("blob_id").limit(max_blobs)
    s = stored.groupBy("blob_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return wanted.join(s, "blob_id", "left").select("blob_id", F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "ok").otherwise("corrupt").alias("status"))


def lookup(flat: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes at the wanted (root, path)."""
    return wanted.join(flat, ["root", "path"], "left").select("root", "path", "node")


def ranked_depth(flat: DataFrame) -> DataFrame:
    """The deepest path of each root."""
    w = Window.partitionBy("root").orderBy(F.col("depth").desc(), "path")
    return flat.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
