"""A store's files as relations.

Listing, retries, atomic writes and concurrent reads are Spark's file sources' and committers' work; the layout is
expressions over paths. Nothing here reads content unless a content column is selected.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directory names of the object families.
FAMILY_DIRS = ("blobpacks", "treepacks", "largeblobpacks", "standardobjects")
UUID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
OBJECT = "[0-9a-f]{62}"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content) of all files below ``root``. ``content`` is read only if it is
    selected, and a condition on ``length`` (F12) is applied before any read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def rooted(root: str, path: str) -> str:
    """A path below ``root``; one that leads out of it, by ``..`` or as a place of its own, is refused."""
    parts: list[str] = []
    for part in path.strip("/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"{path!r} leads out of the store")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if "://" in path:
        raise ValueError(f"{path!r} is a place of its own")
    return "/".join([root.rstrip("/"), *parts])


def objects(listing: DataFrame) -> DataFrame:
    """(cu, family, shard, name, path, size) of the files that lie where objects do; shards are 1 or 2 hex digits."""
    p = F.col("path")
    at = rf"/({UUID})/({'|'.join(FAMILY_DIRS)})/([0-9a-f]{{1,2}})/([^/]+)$"
    part = lambda i: F.regexp_extract(p, at, i)
    name_ok = F.when(part(2) == "standardobjects", part(4).rlike(f"^{OBJECT}$")).otherwise(part(4).rlike(rf"^(?:{UUID}|{OBJECT})(?:\.pack)?$"))
    return listing.where(p.rlike(at) & name_ok).select(part(1).alias("cu"), part(2).alias("family"), part(3).alias("shard"), part(4).alias("name"), "path", F.col("length").alias("size"))


def records(listing: DataFrame) -> DataFrame:
    """(cu, folder, path, bucket, num) of backup records: five-digit buckets, numeric names."""
    p = F.col("path")
    at = rf"/({UUID})/backupfolders/({UUID})/backuprecords/([0-9]{{5}})/([0-9]+)\.[^/.]+$"
    part = lambda i: F.regexp_extract(p, at, i)
    return listing.where(p.rlike(at)).select(part(1).alias("cu"), part(2).alias("folder"), "path", part(3).alias("bucket"), part(4).cast("long").alias("num"), part(4).alias("stem"))


def latest_records(rows: DataFrame, numeric: bool = True) -> DataFrame:
    """The latest record of each folder, by number or (as the writer does) by text."""
    order = F.struct("bucket", "num" if numeric else "stem")
    return rows.groupBy("cu", "folder").agg(F.max_by("path", order).alias("path"))


def computers(listing: DataFrame) -> DataFrame:
    """Each computer, and whether its keyset is there."""
    cu = F.regexp_extract("path", f"/({UUID})/", 1)
    return listing.withColumn("cu", cu).where("cu != ''").groupBy("cu").agg(F.bool_or(F.col("path").rlike(f"/{UUID}/encryptedkeyset[^/]*$")).alias("has_keyset"))


def parse_record(raw: bytes | None) -> str | None:
    """A record, binary property list first, then JSON, as JSON text; null if it is neither."""
    import base64
    import datetime
    import json
    import plistlib

    def plain(x):
        if isinstance(x, (bytes, bytearray)):
            return base64.b64encode(x).decode()
        if isinstance(x, (datetime.datetime, datetime.date)):
            return x.isoformat()
        raise TypeError(type(x).__name__)

    if not raw:
        return None
    try:
        return json.dumps(plistlib.loads(raw, fmt=plistlib.FMT_BINARY) if raw[:6] == b"bplist" else json.loads(raw.decode("utf-8")), default=plain)
    except (ValueError, TypeError, plistlib.InvalidFileException, UnicodeDecodeError, RecursionError):
        return None


def parsed_records(rows: DataFrame, content: str = "content") -> DataFrame:
    """The records with a column ``record`` (JSON text); property lists need Python, JSON is checked on the way."""
    import pandas as pd

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parse_record(None if x is None else bytes(x)))

    return rows.withColumn("record", parse(F.col(content)))


def serialized(record: Column) -> Column:
    """Compact JSON with slashes escaped."""
    return F.replace(F.to_json(record), F.lit("/"), F.lit("\\/"))


def sidecar(content: Column, schema: str) -> Column:
    """A plain sidecar's document; null on any failure."""
    return F.from_json(content.cast("string"), schema, {"mode": "PERMISSIVE"})


def source_info(docs: DataFrame) -> DataFrame:
    """One row per computer from two sidecars, the first non-empty key of each."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return docs.select("cu", first("config.computerName", "plan.computerName", "config.hostname").alias("computer_name"), first("config.computerSerial", "plan.serialNumber").alias("serial"))


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run files (indented JSON), malformed ones left out, the earliest first."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where("run_id is not null").orderBy("started_at", "run_id")


def plans(rows: DataFrame, json_col: str) -> DataFrame:
    """Plans with defaults for what is missing, by name."""
    d = F.from_json(json_col, "plan_id string, name string, active boolean, threads int")
    p = rows.select(d.alias("d")).where("d.plan_id is not null")
    return p.select("d.plan_id", F.coalesce("d.name", F.lit("(unnamed)")).alias("name"), F.coalesce("d.active", F.lit(True)).alias("active"), F.coalesce("d.threads", F.lit(1)).alias("threads")).orderBy(F.lower("name"), "plan_id")


def report(df: DataFrame, path: str) -> None:
    """A report or event sink: JSON lines, committed as a whole by Spark's committer."""
    df.write.mode("overwrite").json(path)


def owned(attributes: Column, marker: str) -> Column:
    """the marker attribute is there."""
    return F.map_contains_key(attributes, marker)
