"""Record ingest by Structured Streaming: micro-batches upsert by key, the greatest order wins.

The table lies in ``buckets`` by the hash of the key; a batch rewrites the buckets that it touches alone. A version is a small
pointer table (bucket, path), written after its data; the greatest complete version is the table, so a restarted stream goes on
from it, and a batch that is done again after a failure writes the same version anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


def latest(new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row of the greatest ``order``; of equal orders, the greatest rest."""
    rest = [c for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``new`` and ``old`` as one: of each key the greatest ``order``, so a late arrival of an older row changes nothing."""
    return latest(new if old is None else old.unionByName(new), keys, order)


def _pointers(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """The greatest complete version's number (-1: none) and its buckets' paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{target}/{VERSION}")
    fs = root.getFileSystem(conf)
    done = [int(s.getPath().getName()) for s in (fs.listStatus(root) if fs.exists(root) else []) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        return -1, {}
    return max(done), {r.bucket: r.path for r in spark.read.parquet(f"{target}/{VERSION}/{max(done)}").collect()}  # as many rows as buckets


def read(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as of its last version; None before the first."""
    _, paths = _pointers(spark, target)
    return spark.read.parquet(*[p for _, p in sorted(paths.items())]).drop("_bucket") if paths else None


def ingest(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = 16, fmt: str = "parquet") -> DataFrame | None:
    """Reads all new files of ``source`` as a stream into the table below ``target``; returns the table."""

    def write(batch: DataFrame, number: int) -> None:
        last, paths = _pointers(spark, target)
        if number <= last:  # done before a restart
            return
        new = latest(batch, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = new.persist()
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` rows
        if touched:
            old = [paths[b] for b in touched if b in paths]
            both = upsert(spark.read.parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) if old else None, new, [*keys, "_bucket"], order)
            both.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/{number}")
            paths |= {b: f"{target}/data/{number}/_bucket={b}" for b in touched}
        new.unpersist()
        spark.createDataFrame(sorted(paths.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{target}/{VERSION}/{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).format(fmt).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read(spark, target)


def stream_records(spark: SparkSession, source: str) -> DataFrame:
    """GEDCOM text as a stream: (file_id, text) of each level-0 record of new files."""
    raw = spark.readStream.format("text").option("lineSep", "\n0 ").load(source).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", "^(\ufeff)?0 ", "").alias("text"))
    return raw.filter(F.trim("text") != "")
