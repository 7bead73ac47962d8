"""Progressive results: caption updates as a stream, the latest one of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(updates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last update of each key: combined before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x")).select(*keys, "x.*")


def upsert_stream(updates: DataFrame, state_dir: str, checkpoint: str, keys: list[str], seq: str) -> StreamingQuery:
    """Keep the latest update of each key under ``state_dir``, one version for each batch.

    A batch reads the version before it and writes its own, so running a batch
    again gives the same result.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = current(spark, state_dir, epoch - 1)
        merged = batch if before is None else before.unionByName(batch)
        latest(merged, keys, seq).write.mode("overwrite").parquet(f"{state_dir}/version={epoch}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state_dir: str, epoch: int | None = None) -> DataFrame | None:
    """The newest version up to a batch, or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    path = spark._jvm.org.apache.hadoop.fs.Path
    whole = [int(n[8:]) for n in names if n.startswith("version=") and fs.exists(path(f"{state_dir}/{n}/_SUCCESS"))]
    found = [v for v in whole if epoch is None or v <= epoch]
    return spark.read.parquet(f"{state_dir}/version={max(found)}") if found else None
