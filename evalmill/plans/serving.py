"""A table of requests, from parameters to saved payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill import fixed_values as fixed
from evalmill.functions.text import blank_to_null, strip_text
from evalmill.operators.chat import inject_level, vision_messages
from evalmill.operators.contracts import TYPE_TESTS, Node, check_contract, kind_of, members_errors
from evalmill.operators.lookups import lookup, lookup_with_fallback, version_resolve
from evalmill.operators.once import computed_once
from evalmill.operators.predict import batch_predict
from evalmill.operators.requests import (
    accepted,
    kv_typed_parse,
    prompt_rewrite,
    request_defaults,
    required_filter,
)
from evalmill.plans.channels import CHANNELS, tagged_channels
from evalmill.session import session_conf, written
from evalmill.sources.files import file_payload_scan, local_path
from evalmill.sources.params import params_json
from evalmill.sources.payloads import image_payload_decode, payload_files, payload_route, payload_write


def json_literal(kind: Column, text: Column, integer: Column, number: Column) -> Column:
    """JSON text of a typed parameter value; a float beyond the finite numbers has none."""
    quoted = F.to_json(F.struct(text.alias("v")))
    digits = F.regexp_replace(F.translate(text, "_+", ""), "^(-?)0+(?=[0-9])", "$1")
    return (
        F.when(kind == "bool", F.lower(text))
        .when(kind == "int", F.coalesce(integer.cast("string"), digits))
        .when(kind == "float", F.when(F.abs(number) < float("inf"), number.cast("string")))
        .otherwise(F.substr(quoted, F.lit(6), F.length(quoted) - 6))
    )


def _base_params(requests: DataFrame, names: list[str], members: Column, known: Column, none: Column) -> DataFrame:
    """The parameters that the requests' own objects give."""
    return (
        requests.select(
            "req_id",
            "model",
            F.try_variant_get(
                F.try_parse_json(F.coalesce("params", F.lit("{}"))), "$", "map<string,variant>"
            ).alias("_members"),
        )
        .select(
            "req_id",
            "model",
            members.isNull().alias("bad_json"),
            F.coalesce(F.array_except(F.map_keys(members), known), none).alias("unknown"),
            F.lit(None).cast("string").alias("unread"),
            *[F.try_element_at(members, F.lit(n)).alias(f"_{n}") for n in names],
        )
    )


def request_params(
    requests: DataFrame, overrides: DataFrame | None, names: list[str]
) -> DataFrame:
    """``(req_id, model, bad_json, unknown, unread, _name...)``: merged parameters as VARIANT columns.

    ``requests`` has a unique ``req_id``, ``model`` and the JSON object ``params``;
    ``overrides`` has ``req_id``, ``pos`` and ``kv``, and wins over the object. The overrides of
    a request are folded to one column per given name before the join, so its keys are never
    collected; ``unknown`` is an array of all other keys. An override always hides the object's value: where
    it is no JSON value itself (an infinite number), the parameter is NULL and ``unread`` names it.
    """
    members, known = F.col("_members"), F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    # Of keys that stand twice in an object, the last one counts.
    with session_conf(requests.sparkSession, spark__sql__variant__allowDuplicateKeys="true"):
        base = _base_params(requests, names, members, known, none)
    if overrides is None:
        return base
    literal = json_literal(F.col("kind"), F.col("text"), F.col("int_value"), F.col("float_value"))
    given = kv_typed_parse(overrides, "kv").select("req_id", "key", "pos", literal.alias("json"))
    # The last one of each name: a struct, also where its value is no JSON.
    last = F.struct("pos", "json")
    folded = given.groupBy("req_id").agg(
        F.collect_set(F.when(~F.col("key").isin(names), F.col("key"))).alias("_given_unknown"),
        *[F.max(F.when(F.col("key") == n, last)).alias(f"_given_{n}") for n in names],
    )
    joined = base.drop("unread").join(folded, "req_id", "left")
    parsed = {f"_value_{n}": F.try_parse_json(F.col(f"_given_{n}.json")) for n in names}
    joined = computed_once(joined, parsed)
    values = {n: F.col(f"_value_{n}") for n in names}
    unread = F.concat_ws(
        "; ",
        *[
            F.when(F.col(f"_given_{n}").isNotNull() & values[n].isNull(), F.lit(f"{n}: not a JSON value"))
            for n in names
        ],
    )
    return joined.select(
        "req_id",
        "model",
        "bad_json",
        F.concat("unknown", F.coalesce("_given_unknown", none)).alias("unknown"),
        blank_to_null(unread).alias("unread"),
        *[
            F.when(F.col(f"_given_{n}").isNotNull(), values[n]).otherwise(F.col(f"_{n}")).alias(f"_{n}")
            for n in names
        ],
    )


# How a checked JSON value of each contract type becomes a column.
COLUMN_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def checked_requests(
    requests: DataFrame,
    overrides: DataFrame | None,
    contracts: dict[str, dict],
    defaults: dict[str, dict[str, object]],
    required: dict[str, str],
) -> DataFrame:
    """Merged, checked and completed parameters; ``error`` says why a request is rejected.

    ``contracts`` and ``defaults`` are given per model. As for a single request, the first of
    these counts: unknown model, unreadable parameters, broken contract, missing required
    parameter, value that cannot be cast. Parameters that are lists or objects stay VARIANT. A
    rejected request shows the default in place of a value of the wrong type.
    """
    properties: dict[str, dict] = {}
    for contract in contracts.values():
        check_contract(contract)
        properties |= contract.get("properties", {})
    merged = request_params(requests, overrides, list(properties))

    typed_names = {f"__{n}": kind_of(F.col(f"_{n}")) for n in properties}
    merged = merged.withColumns(typed_names)
    broken = members_errors("model", "unknown", contracts, lambda n: f"_{n}")

    known = F.coalesce(F.col("model").isin(list(contracts)), F.lit(False))
    problem = F.coalesce(
        F.when(~known, "unknown model"),
        F.when(F.col("bad_json"), "params must be a JSON object"),
        F.col("unread"),
        blank_to_null(F.array_join(broken, "; ")),
    )
    columns, unread = {}, []
    for name, rule in properties.items():
        kind = COLUMN_TYPES.get(rule.get("type", ""))
        columns[name] = F.col(f"_{name}")
        if kind:
            node = Node.of(F.col(f"_{name}"), F.col(f"__{name}"))
            fits = TYPE_TESTS[rule["type"]](node)
            columns[name] = F.when(fits, F.try_variant_get(node.value, "$", kind))
            lost = fits & F.col(name).isNull()
            unread.append(F.when(lost, F.lit(f"{name}: cannot be read as {kind}")))
    typed = (
        computed_once(merged, {**columns, "_contract": problem})
        .withColumn("_unread", F.coalesce(*unread, F.lit(None)))
        .select("req_id", "model", *columns, "_contract", "_unread")
    )
    completed = request_defaults(typed, "model", defaults).withColumnRenamed("error", "_cast")
    checked = required_filter(completed, **required)
    return checked.withColumn(
        "error", F.coalesce("_contract", "error", "_unread", "_cast")
    ).drop("_contract", "_unread", "_cast")


def image_requests(requests: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Image requests ready for their model, rejected ones with an ``error``."""
    models = list(fixed.IMAGE_DEFAULTS)
    contracts = {
        model: fixed.PIXEL_CONTRACT if model == "sdxl-pixel-art" else fixed.IMAGE_CONTRACT
        for model in models
    }
    checked = checked_requests(
        requests, overrides, contracts, fixed.IMAGE_DEFAULTS, {"prompt": "text"}
    )
    return prompt_rewrite(checked, "prompt", "negative_prompt", "model")


def chat_requests(requests: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Chat requests ready for their model; ``messages`` is an array of role and content, with
    the reasoning level as system message in front where there is none."""
    checked = checked_requests(
        requests,
        overrides,
        {model: fixed.CHAT_CONTRACT for model in fixed.CHAT_DEFAULTS},
        fixed.CHAT_DEFAULTS,
        {},
    )
    messages = F.try_variant_get(
        "messages", "$", "array<struct<role: string, content: string>>"
    )
    read = required_filter(
        checked.withColumnRenamed("error", "_error").withColumn("messages", messages),
        messages="list",
    )
    return read.withColumns(
        {
            "messages": inject_level(F.col("messages"), F.col("reasoning_level")),
            "error": F.coalesce("_error", "error"),
        }
    ).drop("_error")


def vision_requests(
    requests: DataFrame,
    overrides: DataFrame | None = None,
    files: DataFrame | None = None,
    adapters: DataFrame | None = None,
) -> DataFrame:
    """Image question requests: decoded image, ``messages`` with a slot for it, and the adapter.

    ``files`` (``path``, ``content``) are what an image may name instead of carrying base64;
    ``adapters`` (``lora_run``, ``adapter``) are the adapters that exist, others fall back to
    ``base``.
    """
    checked = checked_requests(
        requests,
        overrides,
        {model: fixed.VISION_CONTRACT for model in fixed.VISION_DEFAULTS},
        fixed.VISION_DEFAULTS,
        {"image": "value"},
    ).withColumnRenamed("error", "_error")
    decoded = image_payload_decode(checked, "image", files)
    ready = decoded.withColumn("error", F.coalesce("_error", "error")).drop("_error", "image")
    if adapters is None:
        ready = ready.withColumns({"adapter": F.lit("base"), "provenance": F.lit("default")})
    else:
        ready = lookup_with_fallback(
            ready, adapters, None, ["lora_run"], "adapter", "base"
        )
    return ready.withColumn("messages", vision_messages(F.col("prompt")))


def run_requests(
    checked: DataFrame,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Iterable[str | None]],
    inputs: list[str],
    content_type: str,
    tasks: int | None = None,
) -> DataFrame:
    """Run the accepted requests and route what they return, ready to be written."""
    results = batch_predict(
        accepted(checked), load, predict, inputs, ["req_id", "model"], "data", tasks
    )
    return payload_route(results.withColumn("content_type", F.lit(content_type)))


def chat_envelope(results: DataFrame, raw: str = "data", level: str = "reasoning_level") -> DataFrame:
    """Chat results as JSON: response, analysis, commentary and the level they were asked at."""
    parsed = tagged_channels(results, raw)
    envelope = F.to_json(
        F.struct(*CHANNELS, F.col(level).alias("reasoning_level")), {"ignoreNullFields": "false"}
    )
    return parsed.withColumn(raw, envelope).drop(*CHANNELS)


def run_chat(
    requests: DataFrame,
    overrides: DataFrame | None,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Iterable[str | None]],
    path: str,
    tasks: int | None = None,
) -> DataFrame:
    """Chat requests from their parameters to written payloads: checked, predicted, parsed to their
    envelope, routed as JSON and written. Rejected requests are left out (see :func:`chat_requests`).
    """
    ready = accepted(chat_requests(requests, overrides))
    results = batch_predict(
        ready, load, predict, ["req_id", "messages"], ["req_id", "model", "reasoning_level"], "data", tasks
    )
    shaped = chat_envelope(results).withColumn("content_type", F.lit("application/json"))
    return payload_write(payload_route(shaped.drop("reasoning_level")), path)


def override_files(overrides: DataFrame, files: DataFrame) -> DataFrame:
    """Overrides whose file parameters that name one of ``files`` hold its base64 instead."""
    at = F.locate("=", F.col("kv"))
    split = overrides.withColumns(
        {"_name": strip_text(F.substring_index("kv", "=", 1)), "_value": F.substr(F.col("kv"), at + 1)}
    )
    found = file_payload_scan(split.where(at > 0), files, "_name", "_value")
    return found.select("req_id", "pos", F.concat_ws("=", "_name", "_value").alias("kv"))


def referred_requests(requests: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """``(req_id, model, version, params, status)`` of requests ``(req_id, ref, params)``.

    ``ref`` names a model and maybe a version in the index. ``params`` is JSON or YAML, or the path of
    one of ``files`` (``path``, ``content``) that holds it.
    """
    resolved = version_resolve(requests, index, "ref").select(
        "req_id", F.col("name").alias("model"), "version", "params", "status"
    )
    asked = resolved.withColumn("_path", F.when(F.col("params").startswith("/") | F.col("params").startswith("file:"), local_path(strip_text("params"))))
    known = files.select(F.col("path").alias("_path"), F.decode("content", "UTF-8").alias("_file"))
    read = computed_once(lookup(asked, known, ["_path"]), {"_text": params_json(F.coalesce("_file", "params"))})
    return read.select("req_id", "model", "version", F.col("_text").alias("params"), "status")


def run_path(
    requests: DataFrame,
    index: DataFrame,
    files: DataFrame,
    overrides: DataFrame | None,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Iterable[str | None]],
    folder: str,
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole path of chat requests: references resolved, parameter files and YAML read, overrides
    layered, checked, predicted, parsed to their envelope and saved as files below ``folder``.

    Returns what was saved (with the files' names, lengths and digests) and the rejected requests with
    their ``error``. What was checked is written once, so neither the model nor the checks run twice.
    """
    referred = referred_requests(requests, index, files)
    given = None if overrides is None else override_files(overrides, files)
    checked = chat_requests(referred.select("req_id", "model", "params"), given)
    known = referred.select("req_id", "version", F.when(F.col("status") != "ok", F.col("status")).alias("_status"))
    checked = lookup(checked.drop("version"), known, ["req_id"])
    ready = written(checked.withColumn("error", F.coalesce("_status", "error")).drop("_status"), "checked-requests")
    results = batch_predict(
        accepted(ready), load, predict, ["req_id", "messages"], ["req_id", "model", "version", "reasoning_level"], "data", tasks
    )
    parts = chat_envelope(results).withColumns({"content_type": F.lit("application/json"), "part_no": F.lit(0)})
    routed = payload_route(parts.drop("reasoning_level"))
    saved = payload_files(routed, folder, ["model", "version", "req_id"])
    return saved, ready.where("error is not null").select("req_id", "model", "version", "error")
