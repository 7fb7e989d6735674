"""Small helpers around the Spark session that several operators share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"arbora-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "lz4").parquet(path)
    written(spark).append(path)
    return spark.read.schema(schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    """The folders that persisted() has written in this application, in order."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of persisted(), once no DataFrame reads them any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Remove all that persisted() wrote in this application: once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_arbora_shipped", False) is not True:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="arbora-"), "arbora.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(top, "arbora")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, top))
        context.addPyFile(target)
        context._arbora_shipped = True
    return spark


def shipped(query):
    """The query, run after ship()."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        return query(ship(spark), *args, **kwargs)

    return run
