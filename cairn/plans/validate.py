"""Staged validation and rule tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("layout", "sample", "audit", "graph")


@dataclass(frozen=True)
class Rule:
    """V2: an invariant: a column that must be true of each row of a relation."""

    id: str
    name: str
    relation: str
    holds: Column
    message: Callable[[], Column] | None = None


def check_rules(relations: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(id, name, rows, violations, passed), all rules of a relation in one pass over it."""
    out = None
    for relation in dict.fromkeys(r.relation for r in rules):
        own = [r for r in rules if r.relation == relation]
        counts = relations[relation].agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"v{i}") for i, r in enumerate(own)])
        rows = counts.select("rows", F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(own)])).alias("r"))
        rows = rows.select("r.id", "r.name", "rows", "r.violations", (F.col("r.violations") == 0).alias("passed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(checked: DataFrame) -> DataFrame:
    """A13: 'n/m passed' and the ids that failed."""
    return checked.agg(
        F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"), F.lit(" passed")).alias("summary"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))).alias("failed"),
    )


def audit(contents: DataFrame, ok: Column, max_bytes: int | None = None) -> DataFrame:
    """V1 L1/L2: (path, size, ok, reason) of each file; larger files than ``max_bytes`` are not read."""
    c = contents if max_bytes is None else contents.where(F.col("length") <= max_bytes)
    return c.select("path", F.col("length").alias("size"), F.coalesce(ok, F.lit(False)).alias("ok")).withColumn("reason", F.when(~F.col("ok"), "mac mismatch"))


def latest_checked(rows: DataFrame, group: list[str], order: list[str], ok: Column, error: Column) -> DataFrame:
    """Per group (a folder) the count of its records, and of the latest one whether it is good and what is wrong.

    The check is an expression on the latest record alone: what it needs of it is kept by ``max_by``, no sort.
    """
    latest = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("records"), F.max_by(F.struct(*[c for c in rows.columns if c not in group]), F.struct(*order)).alias("_r"))
    flat = latest.select(*group, "records", "_r.*")
    good = F.coalesce(ok, F.lit(False))
    return flat.select(*group, "records", *order, good.alias("ok"), F.when(~good, error).alias("error"))


def validate(stages: dict[str, Callable[[], DataFrame]], tier: str = "audit") -> dict[str, DataFrame]:
    """V1: the tiers up to ``tier``, each a table with an ``ok`` column; stops after a layout that is not ok.

    Only the layout's verdict is brought to the driver. A stage that cannot run is reported as a row, not dropped.
    """
    out: dict[str, DataFrame] = {}
    for name in TIERS[: TIERS.index(tier) + 1]:
        if name not in stages:
            continue
        out[name] = stages[name]()
        if name == "layout" and not out[name].agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok")).first()["ok"]:
            break
    return out


def restored(expected: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """Expected against restored files: counts and bytes; a tree without any checked file is not ok."""
    j = expected.withColumnRenamed("size", "want").join(found.withColumnRenamed("size", "got"), path, "full_outer")
    same = F.col("want").eqNullSafe(F.col("got"))
    return j.agg(
        F.count("want").alias("expected"), F.count_if(same & F.col("want").isNotNull()).alias("matching"), F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("extra"), F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("bytes"),
    ).withColumn("ok", (F.col("expected") > 0) & (F.col("matching") == F.col("expected")))


def round_trips(rows: DataFrame, content: str, encode, decode) -> DataFrame:
    """Whether encode(decode(x)) gives x back, and the first byte that differs."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for data in frame[content]:
                raw = bytes(data)
                try:
                    again = encode(decode(raw))
                    at = next((i for i, (a, b) in enumerate(zip(raw, again)) if a != b), min(len(raw), len(again)))
                    out.append((again == raw, None if again == raw else at, None))
                except Exception as e:  # a failure is a result here: the report names it
                    out.append((False, None, f"{type(e).__name__}: {e}"))
            yield frame.drop(columns=[content]).assign(same=[o[0] for o in out], first_difference=pd.array([o[1] for o in out], dtype="Int64"), error=[o[2] for o in out])

    kept = [f"{c} {t}" for c, t in rows.dtypes if c != content]
    return rows.mapInPandas(run, ", ".join([*kept, "same boolean", "first_difference long", "error string"]))
