"""Registered tables and merged views."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decoded(rows: DataFrame, json_col: str, schema: str, need: str) -> DataFrame:
    """Rows whose document parses and has a field; bad documents are dropped, not errors."""
    return rows.withColumn("doc", F.from_json(json_col, schema)).where(F.col(f"doc.{need}").isNotNull())


def with_parent(rows: DataFrame, parents: DataFrame, on: Column) -> DataFrame:
    """Left lookup. The planner broadcasts the parents if their size is below its threshold."""
    return rows.join(parents, on, "left")


def own_wins(own: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """Own rows, and those of the mirror whose key is not among them."""
    return own.unionByName(mirror.join(own.select(key).distinct(), key, "left_anti").select(own.columns))


def resolve(wanted: DataFrame, plans: DataFrame, wanted_col: str = "wanted", id_col: str = "id", name_col: str = "name") -> DataFrame:
    """F16: the plan that a text names: exact id, else exact name, else a prefix of the id if only one plan has it.

    Prefixes are matched by an equi-join with all prefixes of the ids, of which an id has as many as characters.
    """
    w = wanted.select(wanted_col).distinct()
    p = plans.select(F.col(id_col).alias("plan_id"), F.col(name_col).alias("plan_name"))
    heads = p.where(F.length("plan_id") > 1).select("plan_id", F.explode(F.expr("transform(sequence(1, length(plan_id) - 1), n -> substring(plan_id, 1, n))")).alias("start"))
    hits = (
        w.join(p, w[wanted_col] == p.plan_id).select(wanted_col, "plan_id", F.lit(1).alias("rank"))
        .unionByName(w.join(p, w[wanted_col] == p.plan_name).select(wanted_col, "plan_id", F.lit(2).alias("rank")))
        .unionByName(w.join(heads, w[wanted_col] == heads.start).select(wanted_col, "plan_id", F.lit(3).alias("rank")))
    )
    best = hits.groupBy(wanted_col, "rank").agg(F.count(F.lit(1)).alias("n"), F.min("plan_id").alias("plan_id"))
    best = best.groupBy(wanted_col).agg(F.min_by(F.struct("plan_id", "n"), "rank").alias("b"))
    return w.join(best, wanted_col, "left").select(wanted_col, F.when(F.col("b.n") == 1, F.col("b.plan_id")).alias("plan_id"))


def compared(a: Column, b: Column) -> Column:
    """match, differ or unknown (either is null or empty)."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~known, "unknown").when(a == b, "match").otherwise("differ")


def recent_first(touches: DataFrame, key: str, at: str, cap: int = 32) -> DataFrame:
    """Each key once, the last touched first, at most ``cap``."""
    return touches.groupBy(key).agg(F.max(at).alias("last_touch")).orderBy(F.col("last_touch").desc(), key).limit(cap)


def columns_of(df: DataFrame) -> DataFrame:
    """Q5: (name, type) of a table's columns."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added or removed; a changed type is both."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))


def drift_by_version(shapes: DataFrame, version: str = "version") -> DataFrame:
    """(version, prior, name, type, change) of each version's (name, type) rows against the latest version before it.

    The first version has nothing to be compared with. Versions are few; their rows meet in one join on (prior, name, type).
    """
    order = Window.orderBy(version)
    steps = shapes.select(version).distinct().withColumn("prior", F.lag(version).over(order)).where("prior is not null")
    new = shapes.select(version, "name", "type").distinct().join(steps, version).withColumn("_new", F.lit(True))
    old = shapes.select(F.col(version).alias("prior"), "name", "type").distinct().join(steps, "prior").withColumn("_old", F.lit(True))
    both = new.join(old, [version, "prior", "name", "type"], "full_outer").where("_new is null or _old is null")
    return both.select(version, "prior", "name", "type", F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def dangling(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Q6: references without a referent."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(p, key, "left_anti")


def first_found(wanted: DataFrame, candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first of several sources that has the key."""
    out = wanted
    for i, c in enumerate(candidates):
        out = out.join(c.groupBy(key).agg(F.min(value).alias(f"_v{i}")), key, "left")
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(candidates))]).alias(value))


def verdict(scenarios: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """FAIL (n/m) if any failed, PASS* if some only passed after normalising, else PASS."""
    bad, soft, n = F.count_if(F.col(status) == "FAIL"), F.count_if(F.col(status) == "PASS_NORM"), F.count(F.lit(1))
    text = F.when(bad > 0, F.concat(F.lit("FAIL ("), bad.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).when(soft > 0, "PASS*").otherwise("PASS")
    return scenarios.groupBy(*group).agg(text.alias("verdict"))


def by_month(rows: DataFrame, date: Column, subject: Column, rules: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Rows by month and category; the first rule whose expression the subject matches decides, in fixed order."""
    category, rank = F.lit(other), F.lit(len(rules))
    for i, (name, pattern) in reversed(list(enumerate(rules))):
        category, rank = F.when(subject.rlike(pattern), name).otherwise(category), F.when(subject.rlike(pattern), i).otherwise(rank)
    return rows.groupBy(F.date_format(date, "yyyy-MM").alias("month"), category.alias("category"), rank.alias("category_rank")).agg(F.count(F.lit(1)).alias("n"))


def merged_lists(plans: DataFrame, map_col: str, field: str) -> DataFrame:
    """The distinct entries of a list field over all values of a map, sorted."""
    return plans.withColumn(field, F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values(map_col), lambda v: F.coalesce(v[field], F.array().cast("array<string>")))))))


def managed_entries(lines: DataFrame, marker: str, group: str = "file", number: str = "n", text: str = "line") -> DataFrame:
    """Each marker line with the line after it."""
    w = Window.partitionBy(group).orderBy(number)
    out = lines.withColumn("entry", F.lead(text).over(w)).where(F.startswith(text, F.lit(marker)))
    return out.select(group, F.trim(F.expr(f"substring({text}, {len(marker) + 1})")).alias("name"), "entry").where("entry is not null")


def directory_compare(want: DataFrame, got: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """PASS if a path has the same digest, PASS_NORM if only its NFC form has, else FAIL; EMPTY if nothing was got.

    Spark has no normalising function, so the key of the second join is an Arrow function.
    """
    import unicodedata

    import pandas as pd

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    exact = got.select(F.col(path).alias("_p"), F.col(digest).alias("_d"))
    soft = got.groupBy(nfc(F.col(path)).alias("_n")).agg(F.min(digest).alias("_nd"))
    j = want.join(exact, want[path] == F.col("_p"), "left").withColumn("_key", nfc(F.col(path))).join(soft, F.col("_key") == F.col("_n"), "left")
    if got.isEmpty():
        return want.select(path, F.lit("EMPTY").alias("status"))
    status = F.when(F.col("_d") == F.col(digest), "PASS").when(F.col("_p").isNull() & (F.col("_nd") == F.col(digest)), "PASS_NORM").otherwise("FAIL")
    return j.select(path, status.alias("status"))
