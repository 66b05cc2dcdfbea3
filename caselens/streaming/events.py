"""Streams over event folders: bucketed usage, sessions and running upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.session import Scratch


def read(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet table ``name`` of a folder, whether it is one file or a folder of files."""
    at = f"{folder}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = spark.read.parquet(at).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(at) if is_folder else stream.option("pathGlobFilter", name).parquet(folder)


def usage(events: DataFrame, ts: str, route: str, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts per window and route; rows later than ``late`` behind the newest are dropped, state is bounded by it."""
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), F.upper(F.coalesce(route, F.lit("UNKNOWN"))).alias("route")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "route", "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    s = e.groupBy(F.session_window("at", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All available input run through a stream; its result as a table in the shared folder.

    ``complete`` and ``update`` results are rewritten by each batch, ``append`` results are added up; a batch that is
    run again after a failure overwrites what it wrote, so every row counts once.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, f"stream-{name}")
    out, schema = f"{scratch.root}/out", stream.schema

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def upsert(stream: DataFrame, key: str, newest: str, name: str) -> DataFrame:
    """The newest row of each key over all batches of an incremental sync."""
    latest = stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.struct(newest)).alias("r")).select("r.*")
    return drain(latest, name)
