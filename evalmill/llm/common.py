"""Helpers shared by the training-data operators: tables in the shared folder and Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalmill.session import session_conf, shared_folder

#: Text rows in one Arrow batch. A batch is at least one whole text, however long.
BATCH_ROWS = 512
#: Bytes of a batch for work that takes many times its memory.
BATCH_BYTES = 2 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the stages above the written table, and
    what is read twice is computed once.  Shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def found_by_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    That is enough where they share its files; elsewhere the package is sent with ``--py-files``.
    """
    own = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if own not in known:
        environment["PYTHONPATH"] = os.pathsep.join([own, *filter(None, known)])


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's values; rows that are alike share them."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(*reversed(columns), F.lit(1)).alias("key_b")]


def _pieces(batch: pa.RecordBatch, most: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes, or of one longer row."""
    if most is None or batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half), most)
        yield from _pieces(batch.slice(half), most)


def over_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], dict],
    schema: StructType,
    rows: int = BATCH_ROWS,
    most: int | None = None,
) -> DataFrame:
    """Apply ``work`` to Arrow batches of at most ``rows`` rows and, if given, ``most`` bytes (or one
    longer row); it returns the result's columns."""
    fields = to_arrow_schema(schema)
    found_by_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for piece in _pieces(batch.slice(start, rows), most):
                    columns = work(piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) for f in fields], schema=fields
                    )

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
