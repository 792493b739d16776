"""Training-set preparation: cap, reshape, write, plan the steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.operators.chat import conversation_messages
from evalmill import fixed_values as fixed
from evalmill.operators.listing import fixed_steps, training_steps
from evalmill.operators.lookups import lookup
from evalmill.operators.ordered import head_per_group
from evalmill.operators.requests import layer_defaults, param_layering
from evalmill.plans.serving import checked_requests
from evalmill.sources.datasets import dataset_dir, dataset_name


def training_export(
    samples: DataFrame,
    dataset: str,
    order: str,
    image: str,
    text: str,
    path: str,
    max_train_samples: int | None = None,
    instruction: str = fixed.TRAIN_INSTRUCTION,
    epochs: float | None = None,
    steps: int = 30,
    batch_size: int = 2,
    accumulation: int = 4,
    compact: bool = True,
) -> DataFrame:
    """Write chat records as Parquet, one folder per dataset, and return the plan per dataset:
    ``(dataset, examples, steps)``.

    ``max_train_samples`` caps each dataset by itself. ``compact`` rebalances by dataset before
    the write, for few and large files; a dataset that holds most rows is split over tasks.
    Without it every task writes its own files and nothing is shuffled. The counts come from the
    footers of what was written.
    """
    capped = head_per_group(samples, [dataset], order, max_train_samples, lenient=True)
    records = capped.select(
        F.col(dataset),
        F.col(order),
        conversation_messages(F.col(image), F.col(text), instruction).alias("messages"),
    )
    if compact:
        records = records.hint("rebalance", dataset)
    records.write.mode("errorifexists").partitionBy(dataset).parquet(path)
    written = samples.sparkSession.read.schema(records.schema).parquet(path)
    counts = written.groupBy(dataset).agg(F.count(F.lit(1)).alias("examples"))
    return counts.withColumn(
        "steps", fixed_steps(F.col("examples"), epochs, steps, batch_size, accumulation)
    )


def training_requests(
    requests: DataFrame, overrides: DataFrame | None, examples: DataFrame
) -> DataFrame:
    """Training requests, checked and completed, with ``dataset`` and the ``steps`` to take.

    ``examples`` has ``dataset`` and its number of ``examples``; the number counts up to
    ``max_train_samples`` where that is positive. Steps are NULL for an unknown dataset that is
    trained by epochs.
    """
    checked = checked_requests(
        requests,
        overrides,
        {model: fixed.TRAIN_CONTRACT for model in fixed.TRAIN_DEFAULTS},
        fixed.TRAIN_DEFAULTS,
        {},
    ).withColumn("dataset", dataset_name(F.col("dataset_uri")))
    sized = lookup(checked, examples.select("dataset", "examples"), ["dataset"])
    cap = F.when(F.col("max_train_samples") > 0, F.col("max_train_samples"))
    used = F.when(F.col("examples").isNotNull(), F.least("examples", cap))
    steps = training_steps(
        F.col("examples"), F.col("epochs"), F.col("steps"),
        F.col("batch_size"), F.col("gradient_accumulation_steps"),
    )
    return sized.withColumn("examples", used).withColumn("steps", steps)


def recipe_arguments(
    runs: DataFrame, params: DataFrame, data_root: str, run_root: str
) -> DataFrame:
    """``key=value`` arguments of full training runs, one row each.

    ``runs`` has ``codename`` and ``dataset_dir``; ``params`` has ``codename``, ``key``, the
    value as text and ``pos``, and wins over the recipe. Parameters of unknown runs are left out.
    """
    folder = F.concat(F.lit(run_root.rstrip("/") + "/"), F.col("codename"))
    own = F.array(
        *[
            F.struct(F.lit(key).alias("key"), value.alias("value"))
            for key, value in {
                fixed.RECIPE_DATA: F.concat(
                    F.lit("["), dataset_dir(F.col("dataset_dir"), data_root), F.lit("]")
                ),
                fixed.RECIPE_NAME: F.col("codename"),
                fixed.RECIPE_OUTPUT: F.concat(folder, F.lit(fixed.RECIPE_OUTPUT_FOLDER)),
            }.items()
        ]
    )
    bottom = {"layer": F.lit(0), "pos": F.lit(0).cast("bigint")}
    shared = layer_defaults(runs.select("codename"), fixed.RECIPE_DEFAULTS).withColumns(bottom)
    single = runs.select("codename", F.inline(own)).withColumns(bottom)
    given = params.select("codename", "key", "value", F.lit(1).alias("layer"), "pos")
    # Joined after the layers are merged: then even a run with most parameters has few rows.
    layered = param_layering(
        shared.unionByName(single).unionByName(given), ["codename"], "key", ["value"], "layer", "pos"
    ).join(runs.select("codename").distinct(), "codename", "left_semi")
    return layered.select(
        "codename", F.concat("key", F.lit("="), F.coalesce("value", F.lit("None"))).alias("argument")
    )
