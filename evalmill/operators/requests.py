"""Request parameters: typed parsing, layering, defaults, checks and prompt rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.fixed_values import (
    DOTTED_FLOAT_PATTERN,
    INTEGER_PATTERN,
    PIXEL_PREFIX,
    PIXEL_WORD,
)
from evalmill.functions.numbers import parse_float, parse_integer
from evalmill.functions.text import blank_to_null, strip_text


def typed_values(df: DataFrame, text: str) -> DataFrame:
    """Type the texts of a column: it is stripped, and ``kind``, ``bool_value``, ``int_value``
    and ``float_value`` are added.

    true/false in any case is a bool, text with a dot a float if it reads as one, other text an
    int if it reads as one, everything else a string. The text stays, so an integer too large
    for a long is not lost (kind ``int``, ``int_value`` NULL).
    """
    body, kind = F.col(text), F.col("kind")
    digits = F.translate(body, "_", "")
    # One step per projection, so that each text is stripped and matched once.
    return (
        df.withColumn(text, strip_text(body))
        .withColumn(
            "kind",
            F.when(F.lower(body).isin("true", "false"), "bool")
            .when(body.rlike(DOTTED_FLOAT_PATTERN), "float")
            .when(body.rlike(INTEGER_PATTERN), "int")
            .otherwise("string"),
        )
        .withColumns(
            {
                "bool_value": F.when(kind == "bool", F.lower(body) == "true"),
                "int_value": F.when(kind == "int", digits.try_cast("bigint")),
                "float_value": F.when(kind == "float", digits.try_cast("double")),
            }
        )
    )


def kv_typed_parse(df: DataFrame, kv: str) -> DataFrame:
    """Split ``key=value`` at the first ``=`` into ``key`` and ``text`` and type the value; texts
    without ``=`` are dropped (see :func:`kv_malformed`)."""
    at = F.locate("=", F.col(kv))
    parts = df.where(F.contains(F.col(kv), F.lit("="))).withColumns(
        {
            "key": strip_text(F.substring_index(F.col(kv), "=", 1)),
            "text": F.substr(F.col(kv), at + 1),
        }
    )
    return typed_values(parts, "text")


def kv_malformed(df: DataFrame, kv: str) -> DataFrame:
    """The rows that :func:`kv_typed_parse` ignores."""
    return df.where(~F.coalesce(F.contains(F.col(kv), F.lit("=")), F.lit(False)))


def param_layering(
    df: DataFrame, request: list[str], key: str, values: list[str], layer: str, position: str
) -> DataFrame:
    """One row per request and key: the value of the highest layer, then the last position.

    Input is the long form, one row per request, key, layer and position. Texts are combined by
    sorting, and a task that reads one file of requests may make most of the rows. So the rows are
    dealt out first, those of a hot request or key over all tasks, which then combine an even share
    each; after that such a key costs one row per task.
    """
    best = F.max_by(F.struct(*values, layer), F.struct(layer, position))
    dealt = df.select(*request, key, *values, layer, position, F.spark_partition_id().alias("_part"))
    dealt = dealt.repartition(*request, key, position, "_part")
    return dealt.groupBy(*request, key).agg(best.alias("_best")).select(*request, key, "_best.*")


def layer_defaults(requests: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Long-form default layer: every request with every default of a fixed list."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in defaults.items()]
    )
    return requests.select("*", F.inline(entries))


def request_defaults(
    df: DataFrame,
    model: str,
    defaults: dict[str, dict[str, object]],
    lenient: tuple[str, ...] = ("epochs", "max_train_samples"),
) -> DataFrame:
    """Fill and cast the parameters of each model; NULL and absent take the default.

    ``defaults`` maps model to parameter to default and becomes a literal in the plan, so there
    is no join. The default's type is the parameter's type (``epochs`` is a number with, and
    ``max_train_samples`` one without fraction). Text that cannot be read counts as absent and
    gives an entry in ``error``, except for ``lenient`` parameters. Columns of parameters that
    no input column supplies are added; a parameter that a model does not have is NULL.
    """
    names = list(dict.fromkeys(name for table in defaults.values() for name in table))
    types = dict(df.dtypes)
    columns, problems = {}, []
    for name in names:
        having = [m for m, table in defaults.items() if name in table]
        known = {m: defaults[m][name] for m in having if defaults[m][name] is not None}
        sample = next(iter(known.values()), 0.0 if name == "epochs" else 0)
        kind = {str: "string", float: "double"}.get(type(sample), "bigint")
        value = F.lit(None).cast(kind)
        if known:
            pairs = [F.lit(x) for pair in known.items() for x in pair]
            value = F.try_element_at(F.create_map(*pairs), F.col(model)).cast(kind)
        if name in types:
            given = F.col(name)
            if types[name] == "string" and kind != "string":
                read = parse_float(given) if kind == "double" else parse_integer(given)
                if name not in lenient:
                    bad = F.col(model).isin(having) & given.isNotNull() & read.isNull()
                    problems.append(F.when(bad, F.lit(f"{name}: cannot be read as {kind}")))
            else:
                read = given.cast(kind)
            value = F.coalesce(read, value)
            if len(having) < len(defaults):
                value = F.when(F.col(model).isin(having), value)
        columns[name] = value
    unknown = ~F.coalesce(F.col(model).isin(list(defaults)), F.lit(False))
    problems.append(F.when(unknown, F.lit("unknown model")))
    errors = blank_to_null(F.concat_ws("; ", *problems))
    return df.withColumns({**columns, "error": errors})


def required_filter(df: DataFrame, **required: str) -> DataFrame:
    """Add ``error`` where a required parameter is missing.

    Keywords map column to kind: ``text`` must not be blank, ``list`` must not be empty,
    ``value`` must not be NULL or empty text. The first missing one is named.
    """
    checks = {
        "text": lambda c: strip_text(c) == "",
        "list": lambda c: F.size(c) == 0,
        "value": lambda c: c == "",
    }
    error = F.lit(None).cast("string")
    for name, kind in reversed(required.items()):
        absent = F.col(name).isNull() | checks[kind](F.col(name))
        error = F.when(absent, F.lit(f"{name} required")).otherwise(error)
    return df.withColumn("error", error)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull())


def rewrite_prompt(prompt: Column, model: Column) -> Column:
    """Stripped prompt; the pixel-art model gets its prefix unless the prompt has the word."""
    body = strip_text(prompt)
    add = (model == "sdxl-pixel-art") & ~F.startswith(F.lower(body), F.lit(PIXEL_WORD))
    return F.when(add, F.concat(F.lit(PIXEL_PREFIX), body)).otherwise(body)


def rewrite_negative(negative: Column, model: Column) -> Column:
    """An empty negative prompt counts as none, except for the pixel-art model."""
    return F.when(model == "sdxl-pixel-art", negative).otherwise(blank_to_null(negative))


def prompt_rewrite(df: DataFrame, prompt: str, negative: str, model: str) -> DataFrame:
    return df.withColumns(
        {
            prompt: rewrite_prompt(F.col(prompt), F.col(model)),
            negative: rewrite_negative(F.col(negative), F.col(model)),
        }
    )
