"""Cutting lineage through the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and all tasks run on this machine (tests, a laptop) a temporary folder
    of it is named instead, for the life of the session; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.conf.get("zoneforge.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-zf-")
        spark.conf.set("zoneforge.shared.dir", own)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/zf-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` this runs the plan a single time, keeps the columns
    compressed, and a lost executor costs nothing that is already written.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, whatever its scheme, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of that name: of several writers one does, and the others get False."""
    fs, at = _fs(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise e
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)
