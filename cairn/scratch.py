"""Written tables that cut lineage, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder the session names.

    ``spark.checkpoint.dir`` decides. Only where it is unset, and all runs on this machine (tests), does a temporary
    folder stand in; a cluster without the setting is refused. The folder goes when the driver ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files, it does not recompute), and gives the planner the table's true
    size, so that a later join broadcasts it only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{root or scratch_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
