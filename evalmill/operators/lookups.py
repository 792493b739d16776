"""Joins: aligned scores, lookups, coverage and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.fixed_values import BUILT, NOT_BUILT


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a lookup table that is unique on ``on``.

    Only the left side can be skewed, and of a left join AQE splits the skewed partitions of that
    side, whatever the number of hot keys; rows without a key are spread the same way. So each
    side is computed once, nothing is counted beforehand and no key is broadcast by hint. AQE does
    so where both sides are shuffled for the join: the hash of the key among the join's keys sees
    to it that a table which was just grouped by the same key is dealt anew, too.
    """
    mark = F.xxhash64(*on)
    joined = left.withColumn("_key_hash", mark).join(
        right.withColumn("_key_hash", mark), ["_key_hash", *on], "left"
    )
    return joined.select(*left.columns, *[c for c in right.columns if c not in on])


def aligned_score_join(
    predictions: DataFrame, golds: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Predictions with their gold letter and subject, matched by id instead of position.

    ``how="full"`` also keeps the rows without a partner and names them in ``alignment``.
    """
    if how not in ("inner", "full"):
        raise ValueError(f"how must be inner or full: {how}")
    if how == "inner":
        return predictions.join(golds, on)
    joined = predictions.withColumn("_p", F.lit(True)).join(
        golds.withColumn("_g", F.lit(True)), on, "full"
    )
    state = (
        F.when(F.col("_p").isNull(), "no prediction")
        .when(F.col("_g").isNull(), "no gold")
        .otherwise("matched")
    )
    return joined.withColumn("alignment", state).drop("_p", "_g")


def with_coverage(sources: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Every source row with ``built``: does the target hold its key?"""
    present = targets.select(*on).distinct().withColumn("_present", F.lit(True))
    return sources.join(present, on, "left").withColumn(
        "built", F.col("_present").isNotNull()
    ).drop("_present")


def coverage_listing(sources: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Coverage with a status text, sorted by key; a listing has one source row per key."""
    status = F.when(F.col("built"), BUILT).otherwise(NOT_BUILT)
    return with_coverage(sources, targets, on).withColumn("status", status).orderBy(*on)


def coverage_counts(sources: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Source rows with and without a target. Rows are counted per key before the join, so a key
    that many rows share costs one row per task."""
    sizes = sources.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_rows"))), F.lit(0))

    return with_coverage(sizes, targets, on).agg(
        rows_where(F.col("built")).alias("built"),
        rows_where(~F.col("built")).alias("not_built"),
        rows_where(F.lit(True)).alias("total"),
    )


def required_set_check(
    df: DataFrame, group: list[str], member: str, required: list[str]
) -> DataFrame:
    """Per group the required members it lacks, sorted, as array ``missing`` and flag ``ok``.

    One flag per required member is enough, so members are never collected.
    """
    needed = sorted(set(required))
    flags = df.groupBy(*group).agg(
        *[F.max(F.col(member) == name).alias(f"_has_{i}") for i, name in enumerate(needed)]
    )
    missing = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.col(f"_has_{i}"), F.lit(False)), F.lit(name))
                for i, name in enumerate(needed)
            ]
        )
    )
    return flags.select(*group, missing.alias("missing")).withColumn(
        "ok", F.size("missing") == 0
    )


def lookup_with_fallback(
    requests: DataFrame,
    primary: DataFrame,
    fallback: DataFrame | None,
    on: list[str],
    value: str,
    default: str | None = None,
) -> DataFrame:
    """``value`` from the primary table if it has one for the key, else from the fallback table,
    else ``default``; ``provenance`` names the table used. Rows whose value is NULL count as absent.

    Both tables are merged to one row per key first, so the requests are shuffled once.
    """
    tables = [("primary", primary), ("fallback", fallback)]
    merged = None
    for rank, (name, table) in enumerate(tables):
        if table is None:
            continue
        part = table.where(F.col(value).isNotNull()).select(
            *on, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"),
                          F.col(value).alias("value")).alias("_hit")
        )
        merged = part if merged is None else merged.unionByName(part)
    best = merged.groupBy(*on).agg(F.min("_hit").alias("_hit"))
    return lookup(requests, best, on).withColumns(
        {
            value: F.coalesce(F.col("_hit.value"), F.lit(default)),
            "provenance": F.coalesce(F.col("_hit.name"), F.lit("default")),
        }
    ).drop("_hit")


def split_reference(ref: Column) -> tuple[Column, Column]:
    """Name and version of ``name:version``, cut at the last colon; an empty version is NULL."""
    pattern = r"(?s)^(.*):([^:]*)$"
    has_version = F.contains(ref, F.lit(":"))
    name = F.when(has_version, F.regexp_extract(ref, pattern, 1)).otherwise(ref)
    version = F.when(has_version, F.nullif(F.regexp_extract(ref, pattern, 2), F.lit("")))
    return name, version


def version_resolve(
    refs: DataFrame,
    index: DataFrame,
    ref: str,
) -> DataFrame:
    """Resolve references against a flat index ``(name, version, path, sha256, seq)``.

    Adds ``name``, ``version`` (as asked, else the latest written), ``path``, ``sha256`` and
    ``status``: ``ok``, ``unknown name`` or ``unknown version``. Each distinct reference is
    resolved once; the requests themselves are shuffled once, by reference.
    """
    name, version = split_reference(F.col(ref))
    distinct = refs.select(ref).where(F.col(ref).isNotNull()).distinct()
    asked = distinct.select(ref, name.alias("name"), version.alias("_asked"))
    latest = index.groupBy("name").agg(
        F.max_by("version", F.struct("seq", "version")).alias("_latest")
    )
    entries = index.select("name", "version", "path", "sha256")
    status = (
        F.when(F.col("_latest").isNull(), "unknown name")
        .when(F.col("sha256").isNull(), "unknown version")
        .otherwise("ok")
    )
    resolved = (
        asked.join(latest, "name", "left")
        .withColumn("version", F.coalesce("_asked", "_latest"))
        .join(entries, ["name", "version"], "left")
        .select(ref, "name", "version", "path", "sha256", status.alias("status"))
    )
    found = lookup(refs, resolved, [ref])
    return found.withColumn("status", F.coalesce("status", F.lit("unknown name")))
