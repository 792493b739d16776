"""Index upsert and run status, folded from update rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.fixed_values import RUN_STATES
from evalmill.operators.lookups import lookup


def index_upsert(index: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Flat index ``(name, version, path, sha256, seq)``: the last written row per version."""
    columns = ["name", "version", "path", "sha256", "seq"]
    rows = updates.select(*columns)
    if index is not None:
        rows = index.select(*columns).unionByName(rows)
    entry = F.max_by(F.struct("path", "sha256", "seq"), F.struct("seq", "sha256", "path"))
    return rows.groupBy("name", "version").agg(entry.alias("_entry")).select(
        "name", "version", "_entry.*"
    )


def index_latest(index: DataFrame) -> DataFrame:
    """Per name the version written last, which need not be the highest."""
    return index.groupBy("name").agg(
        F.max_by("version", F.struct("seq", "version")).alias("latest"),
        F.count(F.lit(1)).alias("versions"),
    )


def index_with_latest(index: DataFrame) -> DataFrame:
    """The flat index with ``latest`` of its name in every row."""
    return lookup(index, index_latest(index).drop("versions"), ["name"])


def split_updates(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable and malformed update rows: a usable row has run, time, seq and a known status
    (or none)."""
    usable = (
        F.col("run_id").isNotNull()
        & F.col("ts").isNotNull()
        & F.col("seq").isNotNull()
        & F.coalesce(F.col("status").isin(RUN_STATES), F.lit(True))
    )
    return updates.where(usable), updates.where(~usable)


def last_known(field: str) -> Column:
    """Last non-missing value with its time and sequence number, or NULL; such can be merged."""
    known = F.struct("ts", "seq", F.col(field).alias("value"))
    return F.max(F.when(F.col(field).isNotNull(), known))


def last_value(field: str) -> Column:
    """Last non-missing value by time, then sequence number."""
    return last_known(field)["value"]


def status_columns(fields: list[str]) -> list[Column]:
    """Aggregates of one run's status record from its updates."""
    return [
        *[last_value(f).alias(f) for f in fields],
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("updates"),
    ]


def status_parts(fields: list[str]) -> list[Column]:
    """Aggregates of some of a run's updates that :func:`merged_parts` can join to others."""
    return [
        *[last_known(f).alias(f) for f in fields],
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("updates"),
    ]


def merged_parts(fields: list[str]) -> list[Column]:
    """Aggregates of parts that make one part of them."""
    return [
        *[F.max(f).alias(f) for f in fields],
        F.max("updated_at").alias("updated_at"),
        F.sum("updates").alias("updates"),
    ]


def status_of(parts: DataFrame, fields: list[str]) -> DataFrame:
    """The status records that parts stand for."""
    return parts.select("run_id", *[F.col(f)["value"].alias(f) for f in fields], "updated_at", "updates")


def run_status_fold(updates: DataFrame, fields: list[str]) -> DataFrame:
    """One status record per run from partial updates ``(run_id, ts, seq, fields...)``."""
    usable, _ = split_updates(updates)
    return usable.groupBy("run_id").agg(*status_columns(fields))
