"""Model evaluation: items, prompts, predictions, letters, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill import fixed_values as fixed
from evalmill.functions.answers import (
    choice_letter,
    gold_error,
    gold_letter,
)
from evalmill.operators.chat import eval_messages
from evalmill.operators.ordered import head_n
from evalmill.operators.predict import batch_predict
from evalmill.operators import scoring
from evalmill.operators.scoring import subject_or_unknown
from evalmill.plans.channels import tagged_channels
from evalmill.plans.serving import checked_requests
from evalmill.session import shared_folder


def letters(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Channels plus the chosen letter ``pred``."""
    return tagged_channels(outputs, raw).withColumn("pred", choice_letter(F.col("response")))


def golds(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(item_id, subject, gold, gold_error)`` from ``answer_idx`` and/or ``answer_str``, and
    the columns to ``keep``."""
    index = F.col("answer_idx") if "answer_idx" in items.columns else None
    text = F.col("answer_str") if "answer_str" in items.columns else None
    problem = gold_error(index) if index is not None else F.lit(None).cast("string")
    return items.select(
        "item_id",
        subject_or_unknown(F.col("subject")).alias("subject"),
        gold_letter(index, text).alias("gold"),
        problem.alias("gold_error"),
        *(keep or []),
    )


def evaluate(
    items: DataFrame,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Iterable[str | None]],
    level: str = "low",
    max_items: int | None = 100,
    tasks: int | None = None,
    keep_prompt: bool = False,
) -> DataFrame:
    """Run the predictor over the items and score each one.

    Gold letter and subject travel along with the item past the predictor, which sees only
    ``item_id`` and ``messages``; so predictions need no join to their golds. The cap is applied
    before the predictor.

    Reports read the result several times: write it to a table first, so that the model runs
    once.
    """
    capped = head_n(items, "item_id", max_items)
    index = F.col("answer_idx") if "answer_idx" in items.columns else None
    text = F.col("answer_str") if "answer_str" in items.columns else None
    prepared = capped.select(
        "item_id",
        subject_or_unknown(F.col("subject")).alias("subject"),
        gold_letter(index, text).alias("gold"),
        "prompt",
        eval_messages(F.col("prompt"), level).alias("messages"),
    )
    keep = ["item_id", "subject", "gold", *(["prompt"] if keep_prompt else [])]
    return letters(batch_predict(prepared, load, predict, ["item_id", "messages"], keep, tasks=tasks))


def run_settings(spark: SparkSession, params: str, model: str = "gpt-oss-20b") -> dict[str, object]:
    """Settings of one benchmark run from its JSON parameters, checked and completed.

    A run is one request, so its settings are one row; a rejected one raises with its error.
    """
    request = spark.createDataFrame([(0, model, params)], "req_id int, model string, params string")
    checked = checked_requests(
        request, None, {model: fixed.BENCHMARK_CONTRACT}, fixed.BENCHMARK_DEFAULTS, {}
    )
    row = checked.first()
    if row["error"]:
        raise ValueError(row["error"])
    return {name: row[name] for name in fixed.BENCHMARK_DEFAULTS[model]}


def benchmark_run(
    splits: DataFrame,
    params: str,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Iterable[str | None]],
    tasks: int | None = None,
) -> tuple[DataFrame, dict[str, object]]:
    """The whole run: settings, the split's items, cap, predictor, parser and scores.

    ``splits`` has the items with the ``split`` they belong to; only the wanted one is read. The
    scored rows are written once to the shared folder, so the predictor runs once however many
    reports read them. Returns that table and the settings.
    """
    spark = splits.sparkSession
    settings = run_settings(spark, params)
    items = splits.where(F.col("split") == settings["split"]).drop("split")
    scored = evaluate(
        items, load, predict, settings["reasoning_level"], settings["max_items"], tasks, keep_prompt=True
    )
    path = shared_folder(spark, "scored")
    scored.write.parquet(path)
    return spark.read.schema(scored.schema).parquet(path), settings


def run_reports(scored: DataFrame, settings: dict[str, object]) -> dict[str, DataFrame]:
    """What is reported of a run: by subject, running over the whole run, samples, the report."""
    return {
        "by_subject": scoring.accuracy_by_subject(scored),
        "running": scoring.running_accuracy(scored, [], "item_id"),
        "samples": scoring.sample_records(scored, "item_id"),
        "report": scoring.eval_report(scored, "item_id", settings),
    }
