"""Keeping an index up to date from a stream of record versions. An extension: the archive itself is processed in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.archive import upsert_latest


def new_versions(stream: DataFrame, key: str, event_time: str, delay: str = "7 days") -> DataFrame:
    """The stream without repeated deliveries of the same version within ``delay``; state older than the watermark is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key, event_time])


def counts_by_window(stream: DataFrame, event_time: str, by: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows of each tumbling window and group; late rows are taken up to ``delay``."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w"), by).agg(F.count("*").alias("n")) \
        .select(F.col("w.start").alias("start"), by, "n")


def keep_latest(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """An upsert of every micro-batch into a table of latest versions: a new generation is written beside the old one and
    becomes current by one small file, so readers never see a half and a batch that is run twice leaves the same."""
    spark: SparkSession = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        at = f"{path}/generation={n}"
        earlier = current(spark, path, below=n)
        both = batch if earlier is None else earlier.unionByName(batch, allowMissingColumns=True)
        upsert_latest(both, key, order).write.mode("overwrite").parquet(at)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest finished generation (before number ``below``), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("generation=")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{path}/generation={max(done)}") if done else None
