"""Tables in the folder of spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_run_dirs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only where none is set and all runs in one JVM."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")

        at = f"file://{tempfile.mkdtemp(prefix='ledgerlight')}"
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends, or by `clear`."""
    at = f"{shared_dir(spark)}/ledgerlight-{spark.sparkContext.applicationId}"
    if at not in _run_dirs:
        _run_dirs.add(at)
        atexit.register(clear, spark)
    return at


def clear(spark: SparkSession) -> None:
    """Deletes the tables that `saved` has written. Results that were not read yet cannot be after that."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    at = f"{shared_dir(spark)}/ledgerlight-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _run_dirs.discard(at)


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later steps do not depend on its lineage."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
