"""Raw model output cut into its channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.answers import channel_names, channel_spans, select_channels

CHANNELS = ("response", "analysis", "commentary")


def tagged_channels(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``response``, ``analysis`` and ``commentary`` to raw outputs."""
    text, spans, names = F.col(raw), F.col("_spans"), F.col("_names")
    # One step per projection, so that each text is cut once.
    return (
        outputs.withColumn("_spans", channel_spans(text))
        .withColumn("_names", channel_names(spans))
        .withColumn("_channels", select_channels(text, spans, names))
        .select(*outputs.columns, "_channels.*")
    )
