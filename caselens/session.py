"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "caselens") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CASELENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="caselens-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per Spark context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_caselens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/caselens/code-{uuid.uuid4().hex}/caselens.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(at.toString())
    sc._caselens_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores; for work that costs far more than moving its rows.

    Only small tables in few files are moved; ``scan`` must not shuffle, so that counting its partitions runs nothing.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def _forget(spark: SparkSession, root: str) -> None:
    """Remove a scratch folder when the driver's process ends, if the session still stands."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone, and the folder with it or not
        pass


class Scratch:
    """Tables written to the shared folder, so that later steps neither recompute them nor depend on one executor's disk.

    ``drop`` removes a table that nothing reads any more; what a returned frame still reads stays until the
    session ends, as with checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/caselens/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_forget, spark, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        """``df`` written once and read back; its plan ends at the files."""
        at = self.path(name)
        df.write.mode("overwrite").parquet(at, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._caselens_path = at
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables made by ``save``."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            at = getattr(df, "_caselens_path", None)
            if at:
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(conf).delete(p, True)
