"""Contracts as rows: a table of rules met by exploded parameters in a join.

Where contracts are data (many models, rules that change without a new plan), each rule is a row
``(model, path, keyword, operand)``. A request's parameters become one row per value in them, with
the path that rules name it by; both meet on model and path, and each meeting is judged by one
expression. The messages are those of :mod:`evalmill.operators.contracts`.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.operators.contracts import TYPE_TESTS, TYPES, Node, check_contract, kind_of, members_of
from evalmill.operators.once import computed_once
from evalmill.session import session_conf

RULES = "model string, path string, keyword string, operand string"


def rules_of(contract: dict, path: str = "$") -> list[tuple[str, str, str]]:
    """Rows (path, keyword, operand) of a contract; operands are texts, lists among them JSON."""
    rows = [(path, k, str(contract[k])) for k in ("type", "minimum", "maximum") if k in contract]
    if "enum" in contract:
        rows.append((path, "enum", json.dumps(contract["enum"])))
    rows += [(path, "required", name) for name in contract.get("required", [])]
    properties = contract.get("properties", {})
    if contract.get("additionalProperties", True) is False:
        rows.append((path, "additionalProperties", json.dumps(list(properties))))
    for name, inner in properties.items():
        rows += rules_of(inner, f"{path}.{name}")
    return rows + (rules_of(contract["items"], f"{path}[]") if "items" in contract else [])


def contract_rules(spark: SparkSession, contracts: dict[str, dict]) -> DataFrame:
    """The rule table of some contracts, one per model."""
    for contract in contracts.values():
        check_contract(contract)
    rows = [(model, *row) for model, contract in contracts.items() for row in rules_of(contract)]
    return spark.createDataFrame(rows, RULES)


def _children(node: Column) -> Column:
    """The values right inside one: members by name, elements of an array by their number."""
    members = F.transform(
        F.map_entries(members_of(node["value"])),
        lambda e: F.struct(
            F.concat(node["path"], F.lit("."), e["key"]).alias("path"),
            F.concat(node["shown"], F.lit("."), e["key"]).alias("shown"),
            e["value"].alias("value"),
        ),
    )
    elements = F.transform(
        F.try_variant_get(node["value"], "$", "array<variant>"),
        lambda v, i: F.struct(
            F.concat(node["path"], F.lit("[]")).alias("path"),
            F.concat(node["shown"], F.lit("["), i.cast("string"), F.lit("]")).alias("shown"),
            v.alias("value"),
        ),
    )
    return F.coalesce(members, elements)


def exploded_params(df: DataFrame, keys: list[str], params: str, depth: int) -> DataFrame:
    """``(keys, path, shown, value)``: a row per value of the JSON text, ``depth`` levels deep.

    ``path`` names elements of an array alike, ``shown`` by number; ``value`` is a VARIANT, NULL for
    text that is not JSON. The text is parsed and walked once.
    """
    # Of keys that stand twice in an object, the last one counts.
    with session_conf(df.sparkSession, spark__sql__variant__allowDuplicateKeys="true"):
        parsed = df.select(*keys, F.try_parse_json(F.coalesce(F.col(params), F.lit("{}"))).alias("_value"))
    root = F.array(F.struct(F.lit("$").alias("path"), F.lit("$").alias("shown"), F.col("_value").alias("value")))
    walked, levels = computed_once(parsed, {"_level0": root}), ["_level0"]
    for n in range(1, depth + 1):
        below = F.filter(F.transform(F.col(levels[-1]), _children), lambda found: found.isNotNull())
        walked = computed_once(walked, {f"_level{n}": F.flatten(below)})
        levels.append(f"_level{n}")
    rows = walked.select(*keys, F.explode(F.concat(*levels)).alias("_node"))
    return rows.select(*keys, "_node.path", "_node.shown", "_node.value")


def _problem(node: Node, keys: Column) -> Column:
    """What a value breaks of its rule, or NULL."""
    operand, keyword = F.col("operand"), F.col("keyword")
    number = F.try_variant_get(node.value, "$", "double")
    listed = F.from_json(operand, "array<string>")
    extra = F.array_sort(F.array_except(keys, listed))
    fits = reduce(
        lambda rest, kind: F.when(operand == kind, TYPE_TESTS[kind](node)).otherwise(rest), sorted(TYPES), F.lit(False)
    )
    text = F.try_variant_get(node.value, "$", "string")
    member = F.coalesce((node.kind == "STRING") & F.array_contains(listed, text), F.lit(False))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when((keyword == "type") & ~fits, say("not of type ", operand))
        .when((keyword == "enum") & ~member, say("not one of ", F.array_join(listed, ", ")))
        .when((keyword == "minimum") & node.is_number() & (number < operand.try_cast("double")), say("below minimum ", operand))
        .when((keyword == "maximum") & node.is_number() & (number > operand.try_cast("double")), say("above maximum ", operand))
        .when((keyword == "required") & ~F.array_contains(keys, operand), say(operand, " is required"))
        .when((keyword == "additionalProperties") & (F.size(extra) > 0), say("unknown keys ", F.array_join(extra, ", ")))
    )


def check_rules(df: DataFrame, key: str, model: str, params: str, rules: DataFrame, depth: int) -> DataFrame:
    """``(key, model, errors, ok)`` of requests whose contract is the rows of ``rules`` for their model.

    ``errors`` (sorted) are those of ``contract_check``; a model without rules has the one error
    ``$: no contract``, text that is not JSON ``$: not JSON``. ``depth`` is how deep rules reach (see
    :func:`rule_depth`); ``key`` is unique.
    """
    nodes = exploded_params(df, [key, model], params, depth)
    met = nodes.withColumnRenamed(model, "_model").join(
        rules.withColumnRenamed("model", "_rule_model").withColumnRenamed("path", "_rule_path"),
        (F.col("_model") == F.col("_rule_model")) & (F.col("path") == F.col("_rule_path")),
        "left",
    )
    typed = met.withColumns({"_kind": kind_of(F.col("value")), "_keys": F.map_keys(members_of(F.col("value")))})
    node = Node.of(F.col("value"), F.col("_kind"))
    is_root = F.col("shown") == "$"
    problem = (
        F.when(F.col("value").isNull() & is_root, "$: not JSON")
        .when(F.col("_rule_model").isNull() & is_root, "$: no contract")
        .when(F.col("_rule_model").isNotNull(), F.concat("shown", F.lit(": "), _problem(node, F.col("_keys"))))
    )
    judged = typed.select(key, F.col("_model").alias(model), problem.alias("_problem"))
    return judged.groupBy(key, model).agg(F.array_sort(F.collect_set("_problem")).alias("errors")).withColumn(
        "ok", F.size("errors") == 0
    )


def rule_depth(rules: DataFrame) -> int:
    """How many levels below the whole the deepest rule reaches."""
    steps = F.size(F.regexp_extract_all("path", F.lit(r"(\.|\[\])"), F.lit(1)))
    return rules.agg(F.max(steps)).first()[0] or 0
