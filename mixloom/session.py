"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "mixloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; settings of a running one are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only in local mode (tests, one machine) a temporary folder is set where none is named; on a
    cluster that is an error, as parts would end on each executor's own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='mixloom-')}"
        _drop_at_exit(spark, folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and reads it back, so that later steps neither
    recompute it nor lose it with an executor. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/mixloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
