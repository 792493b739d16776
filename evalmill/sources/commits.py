"""Marker files that commit what tasks have written, in any file system Spark reaches.

A writer puts its rows into a folder of its own and then creates one small file.  Readers go by
those files, so rows without one do not exist, and of two writers of the same file the first wins.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str):
    """The path and its file system, as the JVM knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names right below a folder, sorted; none if it is not there."""
    where, system = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def commit(spark: SparkSession, path: str, content: Any = None) -> bool:
    """Create the file with that JSON content; False, and nothing done, if it is there already.

    The content is written aside and renamed, so a reader sees all of it or no file.
    """
    folder, name = path.rsplit("/", 1)
    aside, system = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(aside), system.makeQualified(_at(spark, path)[0]), options)
    except Py4JJavaError as error:
        system.delete(aside, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def content(spark: SparkSession, path: str) -> Any:
    """What :func:`commit` wrote."""
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that no reader can ask for any more."""
    where, system = _at(spark, path)
    system.delete(where, True)


def read_folders(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """The rows of these Parquet folders together; none of none."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers n of the markers ``kind-n`` in a folder, ascending."""
    return sorted(int(n.removeprefix(f"{kind}-")) for n in names(spark, folder) if n.startswith(f"{kind}-"))


def distinct_buckets(df: DataFrame, bucket: str) -> list[int]:
    """The values of a bucket column, whose number of buckets bounds them."""
    return sorted(r[0] for r in df.select(F.col(bucket)).distinct().collect())
