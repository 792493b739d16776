"""Scores: overall, per subject, running, samples and the nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions.numbers import round_exact, seconds_between
from evalmill.functions.text import blank_to_null, first_chars, last_chars
from evalmill.operators.ordered import head_n, running_totals

SAMPLE_ROWS = 10


def subject_or_unknown(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("unknown"))


def is_correct(pred: str = "pred", gold: str = "gold") -> Column:
    """True where both letters are known and equal."""
    return F.coalesce(F.col(pred) == F.col(gold), F.lit(False))


def _tallies(pred: str, gold: str) -> list[Column]:
    return [
        F.count_if(is_correct(pred, gold)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    ]


def _ratio() -> Column:
    return (F.col("correct") / F.greatest(F.lit(1), F.col("total"))).alias("accuracy")


def overall_accuracy(scored: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return scored.agg(*_tallies(pred, gold)).select("correct", "total", _ratio())


def accuracy_by_subject(
    scored: DataFrame, subject: str = "subject", pred: str = "pred", gold: str = "gold"
) -> DataFrame:
    return scored.groupBy(subject).agg(*_tallies(pred, gold)).select(
        subject, "correct", "total", _ratio()
    )


def accuracy_rollup(
    scored: DataFrame, subject: str = "subject", pred: str = "pred", gold: str = "gold"
) -> DataFrame:
    """Per-subject rows plus the overall row (``level`` 1, subject NULL).

    The rollup runs over the per-subject tallies, so the scored rows are not expanded.
    """
    tallies = scored.groupBy(subject).agg(*_tallies(pred, gold))
    return tallies.rollup(subject).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    ).select(subject, "level", "correct", "total", _ratio())


def running_accuracy(
    scored: DataFrame,
    run: list[str],
    order: str,
    pred: str = "pred",
    gold: str = "gold",
    every: int = 10,
) -> DataFrame:
    """Correct so far, items seen and percent after every ``every``-th item and the last one."""
    steps = scored.select(*run, order, is_correct(pred, gold).cast("bigint").alias("_ok"))
    totals = running_totals(steps, run, order, {"correct": F.col("_ok"), "seen": F.lit(1)})
    return totals.where((F.col("seen") % every == 0) | F.col("is_last")).select(
        *run, order, "correct", "seen", (100.0 * F.col("correct") / F.col("seen")).alias("percent")
    )


def sample_records(
    scored: DataFrame, order: str, n: int = SAMPLE_ROWS
) -> DataFrame:
    """The first ``n`` scored items with shortened texts.

    Needs ``prompt``, ``raw``, ``response``, ``analysis``, ``pred``, ``gold`` and ``subject``.
    """
    return head_n(scored, order, n).select(
        order,
        last_chars(F.col("prompt"), 200).alias("prompt_end"),
        first_chars(F.col("raw"), 200).alias("generated_raw"),
        first_chars(F.col("response"), 100).alias("response"),
        blank_to_null(first_chars(F.col("analysis"), 100)).alias("analysis"),
        "pred",
        F.col("gold").alias("gt"),
        "subject",
    )


def eval_report(
    scored: DataFrame,
    order: str,
    config: dict[str, str | int],
    elapsed: Column | float | None = None,
    ts: str | None = None,
) -> DataFrame:
    """The report in rows: one of ``section`` ``summary`` and one per subject.

    The summary holds counts, rounded accuracy, samples, elapsed time and settings; a subject's
    row its rounded accuracy and counts. Any number of subjects stays spread over tasks; only the
    samples and one row of totals meet in one. ``elapsed`` is a number measured by the caller;
    with ``ts`` it is taken from that column.
    """
    stamps = []
    if ts is not None:
        stamps = [F.min(ts).alias("_first"), F.max(ts).alias("_last")]
    subjects = scored.groupBy("subject").agg(*_tallies("pred", "gold"), *stamps)
    rounded = round_exact(F.col("correct") / F.greatest(F.lit(1), F.col("total")), 4)
    totals = subjects.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        *([F.min("_first").alias("_first"), F.max("_last").alias("_last")] if stamps else []),
    )
    samples = sample_records(scored, order).agg(
        F.sort_array(F.collect_list(F.struct("*"))).alias("samples")
    )
    if stamps:
        seconds = seconds_between(F.col("_first"), F.col("_last"))
    else:
        seconds = F.lit(elapsed).cast("double")
    summary = totals.select(
        F.lit("summary").alias("section"),
        F.lit(None).cast("string").alias("subject"),
        F.lit(True).alias("ok"),
        F.col("total").alias("items"),
        "correct",
        rounded.alias("accuracy"),
        samples.scalar().alias("samples"),
        round_exact(seconds, 1).alias("elapsed_seconds"),
        F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("config"),
    )
    per_subject = subjects.select(
        F.lit("subject").alias("section"),
        "subject",
        F.lit(True).alias("ok"),
        F.col("total").alias("items"),
        "correct",
        rounded.alias("accuracy"),
    )
    return summary.unionByName(per_subject, allowMissingColumns=True)
