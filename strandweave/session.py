"""Sessions for tests and benchmarks, and the package's path for Python workers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is installed or sent with the job."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))


#: Rows for each file of a settled table of known size.
FILE_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a temporary one on a single machine.

    On a cluster without that setting there is no such folder, and lost executors would take what they wrote with them.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="settle_")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at or sc._jsc.sc().getCheckpointDir().get()


def parts(rows: int, file_rows: int = FILE_ROWS) -> int:
    """Files for a table of so many rows. Each costs more than its rows: on a local file system Hadoop launches `chmod` for it, twice."""
    return max(6, -(-rows // file_rows))


def settle(df: DataFrame, most_rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    With a bound on its rows, or their order of magnitude, a small table is written to few files, of about ``file_rows``,
    rather than to one for each shuffle partition.
    Spark deletes checkpoints that nothing refers to any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    if most_rows is not None:
        df = df.coalesce(parts(most_rows, file_rows))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def local_session(name: str = "strandweave", cores: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine, with as many shuffle partitions as cores."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    return spark
