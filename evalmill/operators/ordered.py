"""Order-dependent operators that never put a whole group into one task.

Row order comes from a whole-number order column that is unique within its group. Ids are cut
into ranges of ``2**RANGE_BITS``; because they are unique, a range holds at most that many rows
whatever the skew of the group, so a window per range has a bounded size. Range totals are
summed the same way one level up, and their prefix is added back by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 21

NO_LIMIT = 2**63 - 1


def running_totals(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], bits: int = RANGE_BITS
) -> DataFrame:
    """Keys, order column, inclusive running sums per group in that order, and ``is_last``.

    The rows are shuffled once, by group and id range. The range totals and the totals above
    them read the same shuffle, which is why they all ask it for the same columns.
    """
    names = list(sums)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    # Never NULL, or else the joins below would filter their inputs, each in another way.
    range_of = F.coalesce(F.shiftright(F.col(order), bits), F.lit(0))
    rows = df.select(
        group.alias("_group"),
        range_of.alias("_range"),
        F.col(order),
        *[sums[n].cast("bigint").alias(f"_step_{n}") for n in names],
    ).repartition("_group", "_range")

    ranges = rows.groupBy("_group", "_range").agg(
        F.max(order).alias("_last"),
        *[F.sum(f"_step_{n}").alias(f"_step_{n}") for n in names],
    ).withColumn("_block", F.shiftright(F.col("_range"), bits))
    blocks = ranges.groupBy("_group", "_block").agg(
        F.max("_last").alias("_last"),
        *[F.sum(f"_step_{n}").alias(f"_step_{n}") for n in names],
    )

    def before(by: list[str], position: str, name: str) -> Column:
        earlier = Window.partitionBy(*by).orderBy(position).rowsBetween(
            Window.unboundedPreceding, -1
        )
        return F.coalesce(F.sum(f"_step_{name}").over(earlier), F.lit(0))

    blocks = blocks.select(
        "_group",
        "_block",
        F.max("_last").over(Window.partitionBy("_group")).alias("_group_last"),
        *[before(["_group"], "_block", n).alias(f"_block_{n}") for n in names],
    )
    ranges = ranges.join(blocks, ["_group", "_block"]).select(
        "_group",
        "_range",
        F.greatest("_last", "_group_last").alias("_group_last"),
        *[
            (F.col(f"_block_{n}") + before(["_group", "_block"], "_range", n)).alias(f"_range_{n}")
            for n in names
        ],
    )
    within = Window.partitionBy("_group", "_range").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.select(
        "_group",
        "_range",
        order,
        *[F.sum(f"_step_{n}").over(within).alias(f"_within_{n}") for n in names],
    )
    return rows.join(ranges, ["_group", "_range"]).select(
        *[F.col(f"_group.{k}").alias(k) for k in keys],
        order,
        *[(F.col(f"_range_{n}") + F.col(f"_within_{n}")).alias(n) for n in names],
        (F.col(order) == F.col("_group_last")).alias("is_last"),
    )


def numbered_rows(
    df: DataFrame, order: list[Column], name: str, store: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``df`` with ``name``, each row's number from 0 in that order over the whole table.

    The rows are sorted by ranges and written by ``store``, which returns what it wrote: a row's
    place in its task is then fixed, and adding up the rows of the tasks before gives its number. Only one
    count per task is gathered. Rows alike in ``order`` are numbered in any order.
    """
    spot = F.monotonically_increasing_id()  # the task in the upper bits, the row in the lower 33
    rows = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot))
    return _from_spots(rows, name)


def _from_spots(rows: DataFrame, name: str) -> DataFrame:
    task, within = F.shiftright("_spot", 33), F.col("_spot").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # One row per task that wrote: bounded by the number of partitions.
    numbered = rows.withColumn("_task", task).join(F.broadcast(before), "_task")
    return numbered.withColumn(name, F.col("_before") + within).drop("_task", "_before", "_spot")


def file_positions(df: DataFrame, name: str) -> DataFrame:
    """A Parquet table as read, with ``name``, each row's number from 0 in the order it was written:
    by file name, then by row of the file.

    Every file gives its number of rows, one row each to add up; rows are neither sorted nor shuffled.
    """
    marked = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # One row per file, less than what the driver holds of each to plan the scan.
    numbered = marked.join(F.broadcast(before), "_file")
    return numbered.withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def zip_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two Parquet tables side by side, by position; where one is longer, its rest stands
    alone and ``alignment`` says which side is missing. Their columns must differ in name."""
    first, second = file_positions(left, "position"), file_positions(right, "position")
    joined = first.withColumn("_l", F.lit(True)).join(second.withColumn("_r", F.lit(True)), "position", "full")
    missing = F.when(F.col("_l").isNull(), "no left").when(F.col("_r").isNull(), "no right").otherwise("matched")
    return joined.withColumn("alignment", missing).drop("_l", "_r")


def _nth_per_group(ids: DataFrame, keys: list[str], order: str, n: int, bits: int = RANGE_BITS) -> DataFrame:
    """Keys and ``_limit``, the ``n``-th smallest id, of every group that has as many.

    Ids are counted by range, before any shuffle; windows over the counts tell which range holds the
    ``n``-th, and only the ids of that range (``2**bits`` at most, as they are unique) are sorted.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    spread = ids.select(group.alias("_group"), F.col(order).alias("_id"), F.shiftright(F.col(order), bits).alias("_range"))
    counts = spread.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_block", F.shiftright("_range", bits))

    def before(by: list[str], position: str) -> Column:
        earlier = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(earlier), F.lit(0))

    blocks = counts.groupBy("_group", "_block").agg(F.sum("_rows").alias("_rows"))
    blocks = blocks.withColumn("_ahead", before(["_group"], "_block"))
    blocks = blocks.where((F.col("_ahead") < n) & (F.col("_ahead") + F.col("_rows") >= n)).drop("_rows")
    ranges = counts.join(blocks, ["_group", "_block"])
    ranges = ranges.withColumn("_ahead", F.col("_ahead") + before(["_group", "_block"], "_range"))
    ranges = ranges.where((F.col("_ahead") < n) & (F.col("_ahead") + F.col("_rows") >= n))
    inside = spread.join(ranges.select("_group", "_range", "_ahead"), ["_group", "_range"])
    place = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_id"))
    reached = inside.withColumn("_place", place + F.col("_ahead")).where(F.col("_place") == n)
    return reached.select(*[F.col(f"_group.{k}").alias(k) for k in keys], F.col("_id").alias("_limit"))


def nth_id(df: DataFrame, order: str, n: int) -> Column:
    """The ``n``-th smallest id, or no limit if there are fewer rows, as a scalar subquery that
    reads only the ids; NULL ids have no place."""
    ids = df.select(order).where(F.col(order).isNotNull())
    # A bare subquery, as only that is handed to the Parquet scan.
    return _nth_per_group(ids, [], order, n).agg(F.coalesce(F.max("_limit"), F.lit(NO_LIMIT))).scalar()


def _all_rows(n: int | None, lenient: bool) -> bool:
    if n is not None and n < 0 and not lenient:
        raise ValueError(f"cap must not be negative: {n}")
    return not n or n < 0


def head_n(df: DataFrame, order: str, n: int | None, lenient: bool = False) -> DataFrame:
    """The first ``n`` rows in the order of ``order``; ``None`` and 0 keep all rows.

    A negative ``n`` raises, or keeps all rows when ``lenient`` (the training cap). The cap is
    a filter on the order column, so wide rows are neither sorted nor gathered, and a Parquet
    scan skips the row groups beyond the n-th id. Rows without an id come last: they are left out
    by a cap.
    """
    return df if _all_rows(n, lenient) else df.where(F.col(order) <= nth_id(df, order, n))


def head_per_group(
    df: DataFrame, keys: list[str], order: str, n: int | None, lenient: bool = False
) -> DataFrame:
    """The first ``n`` rows of every group; otherwise as :func:`head_n`.

    The groups' limits are found on keys and ids alone, one row per group, and joined back; a
    group that holds most rows is split by AQE there. A NULL key is a group like any other.
    """
    if _all_rows(n, lenient):
        return df
    ids = df.select(*keys, order).where(F.col(order).isNotNull())
    limits = _nth_per_group(ids, keys, order, n).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    within = F.col(order) <= F.coalesce("_limit", F.lit(NO_LIMIT))
    return df.join(limits, same, "left").where(within).select(*df.columns)
