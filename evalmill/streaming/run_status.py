"""Run status kept up to date from a stream of partial updates.

The status table is a snapshot and a change log.  Every micro-batch writes the folded records of its
runs and, beside them, the malformed updates it met; one marker commits both.  After some batches
the newest snapshot and the changes since are folded into the next snapshot.  Readers take the
newest committed snapshot and the committed batches behind it, so they open few folders however
long the stream has run, and a folder without its marker is as if it were not there.

::

    table/commits/batch-7       changes/batch-7/    rejects/batch-7/
    table/commits/snapshot-9    snapshot/upto-9/    rejects/upto-9/
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evalmill.operators.state import merged_parts, split_updates, status_of, status_parts
from evalmill.sources.commits import commit, content, numbers, read_folders, remove

#: Batches between two snapshots.
SNAPSHOT_EVERY = 10


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet file stream over a folder of files or over one file."""
    # A file stream wants a folder or a pattern; this pattern matches just the given path.
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def run_status_stream(
    updates: DataFrame,
    fields: list[str],
    table: str,
    checkpoint: str,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> DataFrame:
    """Fold the updates that are there now into the status table, then return the table.

    A repeated batch overwrites what it left uncommitted and is skipped once its marker is there, so
    each counts once. Order comes from ``ts`` and ``seq``, not from arrival, so there is no
    watermark. Both folders must be shared by all executors and belong to each other.
    """
    spark = updates.sparkSession
    schema = updates.schema
    # The schemas of the table, also when no update ever comes.
    parts = _parts_schema(spark, schema, fields)

    def write_batch(batch: DataFrame, number: int) -> None:
        session, marker = batch.sparkSession, f"{table}/commits/batch-{number}"
        if number in numbers(session, f"{table}/commits", "batch"):
            if content(session, marker) != checkpoint:
                raise ValueError(f"{table} belongs to another checkpoint than {checkpoint}")
            return
        batch.persist()
        usable, malformed = split_updates(batch)
        folded = usable.groupBy("run_id").agg(*status_parts(fields))
        folded.write.mode("overwrite").parquet(f"{table}/changes/batch-{number}")
        malformed.write.mode("overwrite").parquet(f"{table}/rejects/batch-{number}")
        commit(session, marker, checkpoint)
        batch.unpersist()
        if (number + 1) % snapshot_every == 0:
            _compact(session, table, fields, number, parts, schema)

    query = (
        updates.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_status(spark, table, fields, parts)


def _parts_schema(spark: SparkSession, schema: T.StructType, fields: list[str]) -> T.StructType:
    return spark.createDataFrame([], schema).groupBy("run_id").agg(*status_parts(fields)).schema


def _folders(spark: SparkSession, table: str) -> tuple[list[int], list[int]]:
    """Committed snapshots, and committed batches behind the newest one."""
    snapshots = numbers(spark, f"{table}/commits", "snapshot")
    batches = numbers(spark, f"{table}/commits", "batch")
    return snapshots, [b for b in batches if b > max(snapshots, default=-1)]


def status_folders(spark: SparkSession, table: str) -> list[str]:
    """The folders that hold the present status: a snapshot at most, and the changes behind it."""
    snapshots, batches = _folders(spark, table)
    return [f"{table}/snapshot/upto-{s}" for s in snapshots[-1:]] + [f"{table}/changes/batch-{b}" for b in batches]


def _compact(
    spark: SparkSession, table: str, fields: list[str], upto: int, parts: T.StructType, schema: T.StructType
) -> None:
    """Fold what is committed into a snapshot; drop what the snapshot before it had replaced.

    The folders since that one stay, for readers that began before this one was there.
    """
    snapshots, batches = _folders(spark, table)
    if upto in snapshots:
        return
    rows = read_folders(spark, status_folders(spark, table), parts)
    rows.groupBy("run_id").agg(*merged_parts(fields)).write.mode("overwrite").parquet(f"{table}/snapshot/upto-{upto}")
    rejected = read_folders(spark, [f"{table}/rejects/batch-{b}" for b in batches], schema)
    rejected.write.mode("overwrite").parquet(f"{table}/rejects/upto-{upto}")
    commit(spark, f"{table}/commits/snapshot-{upto}")
    for old in snapshots[:-1]:
        remove(spark, f"{table}/snapshot/upto-{old}")
    for number in numbers(spark, f"{table}/commits", "batch"):
        if number <= max(snapshots, default=-1):
            remove(spark, f"{table}/changes/batch-{number}")
            remove(spark, f"{table}/rejects/batch-{number}")
            remove(spark, f"{table}/commits/batch-{number}")


def read_status(
    spark: SparkSession, table: str, fields: list[str], parts: T.StructType | None = None
) -> DataFrame:
    """The present record of each run."""
    folders = status_folders(spark, table)
    rows = read_folders(spark, folders, parts) if parts else spark.read.parquet(*folders)
    return status_of(rows.groupBy("run_id").agg(*merged_parts(fields)), fields)


def read_rejects(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All malformed updates that the stream met."""
    snapshots, batches = _folders(spark, table)
    folders = [f"{table}/rejects/upto-{s}" for s in snapshots] + [f"{table}/rejects/batch-{b}" for b in batches]
    return read_folders(spark, folders, schema)
