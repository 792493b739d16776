"""A version index kept on disk in buckets of its names.

An upsert reads and writes only the buckets its names fall into.  The new rows go to a folder of
their own; a small file that lists every bucket's present folder then commits the next state of the
index.  If another writer was first, the upsert starts again from that one's state, so no update is
lost, and readers see one state or the next, never half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.operators.state import index_upsert
from evalmill.sources.commits import commit, content, distinct_buckets, names, numbers, read_folders, remove

#: Buckets of a new index, and states that a reader may still be reading.
BUCKETS, KEPT_STATES = 64, 5
COLUMNS = ["name", "version", "path", "sha256", "seq"]


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, table: str) -> tuple[int, dict]:
    """Number and content of the newest state; -1 before there is any."""
    states = numbers(spark, f"{table}/commits", "state")
    return (states[-1], content(spark, f"{table}/commits/state-{states[-1]}")) if states else (-1, {})


def upsert_stored(
    updates: DataFrame, table: str, buckets: int = BUCKETS, schema: T.StructType | None = None
) -> list[int]:
    """Upsert ``updates`` (name, version, path, sha256, seq); the touched buckets.

    As :func:`index_upsert`: the last written row per name and version stays, whatever its order of
    arrival. ``buckets`` counts for a new index only.
    """
    spark = updates.sparkSession
    rows = updates.select(*COLUMNS)
    while True:
        number, state = _state(spark, table)
        buckets = state.get("buckets", buckets)
        keyed = rows.withColumn("bucket", bucket_of(F.col("name"), buckets))
        touched = distinct_buckets(keyed, "bucket")
        folders = state.get("folders", {})
        old = read_folders(spark, [f"{table}/{folders[str(b)]}" for b in touched if str(b) in folders], rows.schema)
        merged = index_upsert(old, rows).withColumn("bucket", bucket_of(F.col("name"), buckets))
        fresh = f"rows/{uuid.uuid4().hex}"
        # AQE splits a bucket that holds most rows and joins small ones.
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{table}/{fresh}")
        state = {"buckets": buckets, "folders": folders | {str(b): f"{fresh}/bucket={b}" for b in touched}}
        if commit(spark, f"{table}/commits/state-{number + 1}", state):
            _forget(spark, table, number + 1)
            return touched
        remove(spark, f"{table}/{fresh}")


def _forget(spark: SparkSession, table: str, number: int) -> None:
    """Drop states that no reader asks for any more, and the folders that only they name."""
    states = numbers(spark, f"{table}/commits", "state")
    kept = {
        f for n in states if n > number - KEPT_STATES
        for f in content(spark, f"{table}/commits/state-{n}")["folders"].values()
    }
    for n in states:
        if n <= number - KEPT_STATES:
            for folder in set(content(spark, f"{table}/commits/state-{n}")["folders"].values()) - kept:
                written = folder.rsplit("/", 1)[0]
                whole = all(f.rsplit("/", 1)[0] != written for f in kept)
                remove(spark, f"{table}/{written if whole else folder}")
            remove(spark, f"{table}/commits/state-{n}")


def read_stored(spark: SparkSession, table: str, schema: T.StructType, only: list[str] | None = None) -> DataFrame:
    """The index as it is, or the rows of some names, for which only their buckets are opened."""
    _, state = _state(spark, table)
    folders = state.get("folders", {})
    chosen = list(folders.values())
    if only is not None and folders:
        asked = spark.createDataFrame([(n,) for n in only], "name string")
        wanted = distinct_buckets(asked.select(bucket_of(F.col("name"), state["buckets"]).alias("bucket")), "bucket")
        chosen = [folders[str(b)] for b in wanted if str(b) in folders]
    rows = read_folders(spark, [f"{table}/{f}" for f in chosen], schema)
    return rows if only is None else rows.where(F.col("name").isin(only))


def stored_folders(spark: SparkSession, table: str) -> list[str]:
    """Names of the row folders on disk, committed or not."""
    return names(spark, f"{table}/rows")
