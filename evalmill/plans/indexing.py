"""Index of bundles: built from their files where complete, and listed with its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.fixed_values import BUILT, NOT_BUILT
from evalmill.operators.listing import listing_text
from evalmill.operators.lookups import lookup, with_coverage
from evalmill.operators.state import index_latest, index_upsert


def bundle_check(members: DataFrame, required: list[str], patterns: dict[str, str]) -> DataFrame:
    """Per bundle ``(name, version)`` its ``problems``, ``sha256``, ``path`` and ``seq``.

    ``members`` has a row per file: name, version, path, member, sha256, seq.  A bundle needs every
    ``required`` member and, per entry of ``patterns`` (what is missing -> regular expression), at
    least one member that fits.  Its digest is that of its required members' digests in their order.
    One aggregate per required member and pattern is enough, so members are never collected.
    """
    names, rules = sorted(set(required)), sorted(patterns.items())
    found = members.groupBy("name", "version").agg(
        *[F.max(F.when(F.col("member") == n, F.col("sha256"))).alias(f"_file{i}") for i, n in enumerate(names)],
        *[F.max(F.col("member").rlike(p)).alias(f"_fits{i}") for i, (_, p) in enumerate(rules)],
        F.max("path").alias("path"),
        F.max("seq").alias("seq"),
    )
    missing = [F.when(F.col(f"_file{i}").isNull(), F.lit(f"missing: {n}")) for i, n in enumerate(names)]
    missing += [
        F.when(~F.coalesce(F.col(f"_fits{i}"), F.lit(False)), F.lit(f"missing: {what} (at least one)"))
        for i, (what, _) in enumerate(rules)
    ]
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *[f"_file{i}" for i in range(len(names))]), 256))
    return found.select(
        "name", "version", "path", digest.alias("sha256"), "seq", F.concat_ws(", ", *missing).alias("problems")
    )


def index_build(
    index: DataFrame | None, members: DataFrame, required: list[str], patterns: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """The index with all complete bundles written to it, and the incomplete ones with ``problems``."""
    checked = bundle_check(members, required, patterns)
    complete = checked.where(F.col("problems") == "").drop("problems")
    rejected = checked.where(F.col("problems") != "").select("name", "version", "problems")
    return index_upsert(index, complete), rejected


def full_listing(sources: DataFrame, index: DataFrame, members: DataFrame) -> DataFrame:
    """Every source with version, status, bundle and the text of its members, sorted by name.

    ``sources`` has ``name`` and ``version``, ``members`` is a listing by ``name``.
    """
    latest = index_latest(index).select("name", F.col("latest").alias("version"))
    bundles = latest.join(index.select("name", "version", "path"), ["name", "version"]).select(
        "name", F.col("path").alias("bundle")
    )
    covered = with_coverage(sources, index, ["name"])
    listed = lookup(lookup(covered, bundles, ["name"]), listing_text(members, ["name"]), ["name"])
    status = F.when(F.col("built"), BUILT).otherwise(NOT_BUILT)
    return listed.select("name", "version", status.alias("status"), "bundle", "members", "listing").orderBy("name")
