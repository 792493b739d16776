"""Dataset references, scans and one-time materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.sources.commits import commit, content, names, remove

HUB_PREFIX = "hf:"


def dataset_name(uri: Column) -> Column:
    """Dataset URI without the hub prefix."""
    return F.when(
        F.startswith(uri, F.lit(HUB_PREFIX)), F.substr(uri, F.lit(len(HUB_PREFIX) + 1))
    ).otherwise(uri)


def dataset_dir(path: Column, root: str) -> Column:
    """Absolute paths as they are, others below ``root``."""
    joined = F.concat(F.lit(root.rstrip("/") + "/"), path)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(joined)


def is_hub_uri(uri: Column) -> Column:
    return F.startswith(uri, F.lit(HUB_PREFIX))


def dataset_scan(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    split_column: str = "split",
    columns: list[str] | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read one split of a dataset.

    The split is a filter on a column: a partition column prunes folders, any other column of a
    Parquet dataset is pushed to the scan. ``fmt`` may be parquet, json, csv or any other format
    the session can read; give ``schema`` as an option to spare the pass that infers it.
    """
    reader = spark.read.format(fmt)
    schema = options.pop("schema", None)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path)
    if split is not None:
        df = df.where(F.col(split_column) == split)
    return df.select(*columns) if columns else df


def cached_folder(spark: SparkSession, path: str) -> str | None:
    """Folder of the finished copy below ``path``, if there is one."""
    return content(spark, f"{path}/current") if "current" in names(spark, path) else None


def dataset_materialise(
    spark: SparkSession,
    name: str,
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Persist a dataset once and return ``(ok, dataset, num_examples, cache_dir)``.

    A copy is written into a folder of its own and then named in ``path``; the first writer to do so
    wins, others drop theirs and read that one, so nobody's copy changes under a reader. What an
    interrupted write left behind is named nowhere. The count comes from the copy's Parquet footers.
    """
    folder = cached_folder(spark, path)
    if folder is None:
        own = f"copy-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/{own}")
        if not commit(spark, f"{path}/current", own):
            remove(spark, f"{path}/{own}")
        folder = cached_folder(spark, path)
    cache = f"{path}/{folder}"
    return spark.read.parquet(cache).agg(F.count(F.lit(1)).alias("num_examples")).select(
        F.lit(True).alias("ok"),
        F.lit(name).alias("dataset"),
        "num_examples",
        F.lit(cache).alias("cache_dir"),
    )
