"""Tables in and intermediate tables out, by paths that every node can see."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import share_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session that runs in one
    process; on a cluster no other node would see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.scratch", found)
    return found.rstrip("/")


def materialise(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here.

    The files outlive lost executors.  They stay until ``discard`` or until
    the cluster's owner clears the folder, as the returned frame is lazy.
    """
    spark = df.sparkSession
    share_code(spark)
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made and that nothing needs any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so once the driver's collector finds their plans unused, which a
    driver with little to do may not run for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it so that no given column clashes."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
