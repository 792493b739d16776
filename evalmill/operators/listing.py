"""Batch plans and ordered member listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_steps(
    examples: Column, epochs: Column, steps: Column, batch_size: Column, accumulation: Column
) -> Column:
    """Optimizer steps: from epochs if known and positive, else the given number; NULL where
    the epochs are known but the examples are not."""
    effective = F.greatest(F.lit(1), batch_size * accumulation)
    needed = F.ceil(examples * epochs.cast("double") / effective).cast("bigint")
    by_epochs = F.when(needed.isNotNull(), F.greatest(F.lit(1), needed))
    return F.when(epochs > 0, by_epochs).otherwise(steps.cast("bigint"))


def fixed_steps(
    examples: Column, epochs: float | None, steps: int, batch_size: int, accumulation: int
) -> Column:
    """The same for settings that all datasets share."""
    return training_steps(
        examples, F.lit(epochs).cast("double"), F.lit(steps), F.lit(batch_size), F.lit(accumulation)
    )


def batch_plan(
    df: DataFrame,
    dataset: list[str],
    epochs: float | None = None,
    steps: int = 30,
    batch_size: int = 2,
    accumulation: int = 4,
) -> DataFrame:
    """Examples and optimizer steps per dataset; cap the datasets first."""
    counts = df.groupBy(*dataset).agg(F.count(F.lit(1)).alias("examples"))
    return counts.withColumn(
        "steps", fixed_steps(F.col("examples"), epochs, steps, batch_size, accumulation)
    )


def device_label(name: Column, device: Column) -> Column:
    """``name (device)``, where no device means CPU."""
    shown = F.coalesce(F.nullif(device, F.lit("")), F.lit("CPU"))
    return F.concat(name, F.lit(" ("), shown, F.lit(")"))


def member_listing(
    df: DataFrame, group: list[str], position: str | Column, label: Column
) -> DataFrame:
    """The members of each group in order, one row each: group, ``position`` and ``label``.

    A group of any size stays spread over tasks; :func:`listing_text` joins the texts of groups
    that fit a row.
    """
    at = F.col(position) if isinstance(position, str) else position
    return df.select(*group, at.cast("bigint").alias("position"), label.alias("label"))


def listing_text(members: DataFrame, group: list[str]) -> DataFrame:
    """One text per group of a :func:`member_listing`, all its members joined by a comma."""
    return members.groupBy(*group).agg(
        F.count("label").alias("members"),
        F.expr("listagg(label, ', ') WITHIN GROUP (ORDER BY position)").alias("listing"),
    )
