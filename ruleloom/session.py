"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _unset_folder() -> str:
    return tempfile.mkdtemp(prefix="ruleloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by spark.checkpoint.dir; a fresh one only if it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return (folder or _unset_folder()).rstrip("/")


@cache
def _scratch_folder(spark: SparkSession, folder: str, application: str) -> str:
    """The application's own folder; it is removed when the application ends."""
    path = f"{folder}/ruleloom/{application}"
    fs, hadoop_path = _file_system(spark, path)
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = _scratch_folder(spark, shared_folder(spark), spark.sparkContext.applicationId)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a result once and read it back: lineage ends, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def full_paths(spark: SparkSession, path: str) -> list[str]:
    """The complete paths that a path or pattern stands for; none if there is nothing."""
    fs, hadoop_path = _file_system(spark, path)
    return [s.getPath().toString() for s in fs.globStatus(hadoop_path) or []]


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The names of the data files in a folder, also one partitioned by columns."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path) or fs.getFileStatus(hadoop_path).isFile():
        return []
    names, files = [], fs.listFiles(hadoop_path, True)
    while files.hasNext():
        names.append(files.next().getPath().getName())
    return [n for n in names if not n.startswith(("_", "."))]


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(full_paths(spark, path))
