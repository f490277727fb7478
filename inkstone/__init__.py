"""Document-provenance analytics on Spark DataFrames."""

from __future__ import annotations

from pathlib import Path
from uuid import uuid4


def attach(spark):
    """Let Python workers that share the driver's file system import this package; returns the session.

    On a cluster without a shared installation ship the package with --py-files instead.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def read(spark, path):
    """A Parquet table; one of fewer files than cores, which few tasks would read, is spread evenly first. Large tables never are."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df):
    """Write a result to the folder that all executors share (spark.checkpoint.dir, else one under the warehouse) and read it again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{root.rstrip('/')}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
