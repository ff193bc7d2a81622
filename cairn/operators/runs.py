"""Runs, events and activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def throughput(events: DataFrame, run: str, seconds: str, total: str, window: int = 30) -> DataFrame:
    """Bytes a second over the last ``window`` seconds of each run's running totals; null without two points."""
    w = Window.partitionBy(run).orderBy(seconds).rangeBetween(-window, 0)
    first_t, first_b = F.min(seconds).over(w), F.min(total).over(w)
    return events.withColumn("rate", F.round((F.col(total) - first_b) / F.nullif(F.col(seconds) - first_t, F.lit(0)), 6))


def eta(done: Column, total: Column, rate: Column) -> Column:
    """Seconds left at the rate; null if the total or the rate is unknown."""
    return F.when(total.isNotNull() & (rate > 0), F.greatest(total - done, F.lit(0)) / rate)


def tail(events: DataFrame, run: list[str], seq: list[Column], n: int = 50) -> DataFrame:
    """The last n events of each run."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(*run).orderBy(*seq))).where(F.col("rn") <= n)


def fold(events: DataFrame, run: str, kind: str, seq: list[str], finals: list[str]) -> DataFrame:
    """T3 in batch: per run the number of events by kind, errors, first and last event, and the status."""
    place = F.struct(*seq)
    last_kind = F.max_by(kind, place)
    status = F.when(last_kind.isin(finals), F.lit("completed")).when(F.count_if(F.col(kind) == "error") > 0, F.lit("degraded")).otherwise(F.lit("running"))
    return events.groupBy(run).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(kind) == "error").alias("errors"), F.countDistinct(kind).alias("kinds"), last_kind.alias("last_kind"), status.alias("status"))


def streaks(rows: DataFrame, group: str, order: list[str], hit: Column) -> DataFrame:
    """Runs of consecutive hits (gaps and islands): a hit's streak resets at any other row."""
    w = Window.partitionBy(group).orderBy(*order)
    r = rows.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("rn", F.row_number().over(w))
    r = r.withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy(group, "hit").orderBy(*order)))
    return r.where("hit").groupBy(group, "island").agg(F.count(F.lit(1)).alias("streak"), F.min("rn").cast("long").alias("first_row"))


def is_running(finished: Column, aborted: Column) -> Column:
    """neither finished nor aborted."""
    return finished.isNull() & ~F.coalesce(aborted, F.lit(False))


def progress(done: Column, total: Column) -> Column:
    """a fraction in 0 to 1; null if the total is unknown or 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / F.nullif(total, F.lit(0))))


def status(running: Column, aborted: Column, errors: Column) -> Column:
    """running before cancelled before failed before completed."""
    return F.when(running, "running").when(aborted, "cancelled").when(errors > 0, "failed").otherwise("completed")


def recent(finished: Column, created: Column, now: Column, hours: int = 24) -> Column:
    """finished, or else created, within the last hours."""
    return F.coalesce(finished, created) >= now - F.expr(f"INTERVAL {int(hours)} HOURS")


def categories(activities: DataFrame, status_col: str, group: list[str] | None = None) -> DataFrame:
    """Activities by category."""
    c = F.when(F.col(status_col) == "running", "in_progress").when(F.col(status_col) == "completed", "ok").otherwise("attention")
    return activities.groupBy(*(group or []), c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def span(rows: DataFrame, group: list[str], date: str) -> DataFrame:
    """Records, first and last date of each group; dates of 0 are unknown and don't count."""
    d = F.when(F.col(date) != 0, F.col(date))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("records"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def all_ok(rows: DataFrame, ok: Column, group: list[str]) -> DataFrame:
    """Whether all are ok (false for none), whether any failed, and a summary."""
    good = F.count_if(ok)
    n = F.count(F.lit(1))
    return rows.groupBy(*group).agg((good == n).alias("all_ok"), (good < n).alias("any_failed"), F.concat(good.cast("string"), F.lit("/"), n.cast("string"), F.lit(" passed")).alias("summary"))


def duration(seconds: Column) -> Column:
    """X11: H:MM:SS, rounded half to even, negative as 0."""
    s = F.greatest(F.bround(seconds.cast("double"), 0).cast("long"), F.lit(0))
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def iso(epoch: Column) -> Column:
    """UTC ISO text of an epoch, '' where it is null or 0."""
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss"))


def backoff(attempt: Column, base: float = 2.0, cap: float = 300.0) -> Column:
    """The deterministic part of the wait before a retry."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def exit_code(error: Column, ok: Column, partial: Column) -> Column:
    """0 ok, 2 not ok, 3 could not run, 4 stopped early."""
    return F.when(error.isNotNull(), 3).when(~ok, 2).when(partial, 4).otherwise(0)


def stale(runs_: DataFrame, alive: Column, now: Column, days: int = 30) -> DataFrame:
    """Running runs whose process is gone become stale; ended runs older than ``days`` are left out."""
    ended = F.col("status").isin("completed", "failed", "cancelled", "stale")
    r = runs_.withColumn("status", F.when((F.col("status") == "running") & ~alive, "stale").otherwise(F.col("status")))
    return r.where(~ended | (F.coalesce("finished_at", "started_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
