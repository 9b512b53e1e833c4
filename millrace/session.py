"""What every operator needs of the session: table access and a shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a directory of tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session that names none, as in tests on one machine, gets a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = set_.get()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/millrace-{os.getuid()}"


_CLEARED: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, deleted when its driver ends."""
    folder = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        fs, where = file_system(spark, folder)
        atexit.register(_delete, fs, where)
    return folder


def _delete(fs, where) -> None:
    with suppress(Exception):  # the JVM may have ended first
        fs.delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; DataFrames that read it can't be used any more."""
    fs, where = file_system(spark, work_dir(spark))
    fs.delete(where, True)


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, and a lost executor costs no rework.

    Unlike a cached plan the files outlive executors; unlike a local checkpoint
    they have no single home.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path``; works for whatever store the cluster shares."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """Content of one small file, null if there is none."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of one small file, null if there is none."""
    held = read_bytes(spark, path)
    return None if held is None else held.decode()


def write_small(spark: SparkSession, path: str, content: str | bytes, overwrite: bool = False) -> None:
    fs, where = file_system(spark, path)
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def replace_small(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Writes one small file aside and moves it to its name, so that no reader sees a part of it."""
    part = f"{path}.{uuid.uuid4().hex}"
    write_small(spark, part, content)
    fs, source = file_system(spark, part)
    if not fs.rename(source, file_system(spark, path)[1]):
        fs.delete(source, False)  # another writer was first


class Conflict(RuntimeError):
    """Another run went ahead of the version this one read."""


def current(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The version in force in a folder of versions and its text, (0, null) where there is none yet."""
    fs, where = file_system(spark, f"{folder}/_VERSION-*")
    names = sorted(s.getPath().toString() for s in fs.globStatus(where) or ())
    return (int(names[-1].rsplit("-", 1)[1]), read_small(spark, names[-1])) if names else (0, None)


def advance(spark: SparkSession, folder: str, version: int, text: str) -> None:
    """Puts ``version`` in force, one above the version read: readers see all of ``text`` or nothing, and of several writers one succeeds.

    Its file is written aside and named by a link or rename that fails where
    the name is taken; HDFS and local file systems do so atomically. Object
    stores have no such rename: there the folder must lie on one of the others.
    Version files are small and stay.
    """
    jvm, target = spark._jvm, f"{folder}/_VERSION-{version:010d}"
    part = f"{folder}/_part-{uuid.uuid4().hex}"
    write_small(spark, part, text)
    fs, source = file_system(spark, part)
    _, named = file_system(spark, target)
    if fs.getUri().getScheme() == "file":
        try:
            os.link(source.toUri().getPath(), named.toUri().getPath())
        except FileExistsError as e:
            raise Conflict(f"{folder} is at version {version} already") from e
        finally:
            fs.delete(source, False)
        return
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(source), fs.makeQualified(named), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        )
    except Py4JJavaError as e:
        if fs.exists(named):
            raise Conflict(f"{folder} is at version {version} already") from e
        raise


def spread(df: DataFrame, key: str, tasks_per_core: int = 4) -> DataFrame:
    """``df`` in at least ``tasks_per_core`` tasks a core for work that is heavy per row, by hash of a unique ``key``.

    Only the optimizer's estimate of its size is asked for, and nothing is run:
    where that makes enough splits for all cores the rows stay where they are,
    so large inputs are never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    return df if size >= 2 * cores * split else df.repartition(tasks_per_core * cores, key)
