"""Chat messages, evaluation prompts and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.fixed_values import EVAL_INSTRUCTION, LEVEL_MESSAGE, LEVELS, TRAIN_INSTRUCTION
from evalmill.functions.text import is_level, normalise_level


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def level_text(level: Column) -> Column:
    return F.concat(F.lit(LEVEL_MESSAGE), normalise_level(level))


def inject_level(messages: Column, level: Column) -> Column:
    """Message array with the level as system message in front, unless there is one already or
    the level is not a known one."""
    wanted = is_level(level) & ~F.exists(messages, lambda m: F.coalesce(m.role == "system", F.lit(False)))
    return F.when(
        wanted, F.concat(F.array(message("system", level_text(level))), messages)
    ).otherwise(messages)


def system_message_inject(
    df: DataFrame, conversation: str, order: str, role: str, text: str, level: str
) -> DataFrame:
    """The same for conversations stored one turn per row, without collecting their turns.

    A conversation without a system turn gets one row more, placed one before its first turn.
    """
    if level.lower() not in LEVELS:
        return df
    heads = df.groupBy(conversation).agg(
        F.min(order).alias("_first"),
        F.max(F.coalesce(F.col(role) == "system", F.lit(False))).alias("_has_system"),
    )
    added = heads.where(~F.col("_has_system")).select(
        conversation,
        (F.col("_first") - 1).alias(order),
        F.lit("system").alias(role),
        F.lit(LEVEL_MESSAGE + level.lower()).alias(text),
    )
    return df.select(conversation, order, role, text).unionByName(added)


def eval_messages(prompt: Column, level: str) -> Column:
    """System instruction naming the level, then the item as user message."""
    return F.array(message("system", F.lit(EVAL_INSTRUCTION + level)), message("user", prompt))


def eval_prompt_build(df: DataFrame, prompt: str, level: str) -> DataFrame:
    return df.withColumn("messages", eval_messages(F.col(prompt), level))


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
        (F.lit(None) if image is None else image).cast("binary").alias("image"),
    )


def conversation_messages(
    image: Column, text: Column, instruction: str = TRAIN_INSTRUCTION
) -> Column:
    """A user message with instruction and image, and an assistant message with the text."""
    user = F.array(_part("text", F.lit(instruction)), _part("image", image=image))
    assistant = F.array(_part("text", text))
    return F.array(message("user", user), message("assistant", assistant))


def vision_messages(prompt: Column) -> Column:
    """A user message with an image slot followed by the prompt."""
    return F.array(message("user", F.array(_part("image"), _part("text", prompt))))


def conversation_record(
    df: DataFrame, image: str, text: str, instruction: str = TRAIN_INSTRUCTION
) -> DataFrame:
    return df.withColumn(
        "messages", conversation_messages(F.col(image), F.col(text), instruction)
    )
