"""Shared-storage cut points: tables written under ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode (tests) and an error on a cluster, whose executors would not share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on, how: str, max_rows: int = 200_000) -> DataFrame:
    """Broadcast ``right`` only if its counted rows are at most ``max_rows``; else a shuffle join, which AQE splits where skewed. ``right`` should be materialized."""
    from pyspark.sql import functions as F

    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def spare(taken: list[str], name: str) -> str:
    """``name``, with as many underscores in front as make it differ from the ``taken`` columns (in any case, as Spark compares)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def settled(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with the columns, worked out once: later expressions read them behind a generator, so the optimizer doesn't write a large expression anew into each of its uses."""
    from pyspark.sql import functions as F

    name = spare([*df.columns, *columns], "_settled")
    rest = [c for c in df.columns if c not in columns]
    return df.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))).select(*rest, f"{name}.*")
