"""Request parameters and contracts on literal edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from evalmill import fixed_values as fixed
from evalmill.operators import requests
from evalmill.operators.contract_rules import check_rules, contract_rules, rule_depth
from evalmill.operators.contracts import check_contract, contract_check


def test_kv_typed_parse_edges(spark):
    texts = ["a=TRUE", "a=.5", "a=1.", "a=1.2.3", "a=-3", "a=1_000", "a=1__0", "a=1e5", "a=nan",
             "a=", "=x", "abc", " k = v=w ", "a=" + "9" * 30, "a=1.e2", "a=fAlSe", "a=1_0.2_5", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, kv string")
    rows = {r.i: r for r in requests.kv_typed_parse(df, "kv").collect()}
    got = {
        i: (r.key, r.kind, r.bool_value, r.int_value, r.float_value, r.text)
        for i, r in rows.items()
    }
    assert got == {
        0: ("a", "bool", True, None, None, "TRUE"),
        1: ("a", "float", None, None, 0.5, ".5"),
        2: ("a", "float", None, None, 1.0, "1."),
        3: ("a", "string", None, None, None, "1.2.3"),
        4: ("a", "int", None, -3, None, "-3"),
        5: ("a", "int", None, 1000, None, "1_000"),
        6: ("a", "string", None, None, None, "1__0"),
        7: ("a", "string", None, None, None, "1e5"),
        8: ("a", "string", None, None, None, "nan"),
        9: ("a", "string", None, None, None, ""),
        10: ("", "string", None, None, None, "x"),
        12: ("k", "string", None, None, None, "v=w"),
        13: ("a", "int", None, None, None, "9" * 30),
        14: ("a", "float", None, None, 100.0, "1.e2"),
        15: ("a", "bool", False, None, None, "fAlSe"),
        16: ("a", "float", None, None, 10.25, "1_0.2_5"),
    }
    assert [r.i for r in requests.kv_malformed(df, "kv").orderBy("i").collect()] == [11, 17]


def test_typed_values_follow_python(spark):
    def python_kind(value):
        body = value.strip()
        if body.lower() in ("true", "false"):
            return "bool"
        try:
            return "float" if "." in body and float(body) is not None else type(int(body)).__name__
        except ValueError:
            return "string"

    pieces = ["1", "0", "_", ".", "e", "E", "+", "-", " ", "x", "23"]
    import random

    rng = random.Random(5)
    texts = sorted({"".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(4000)})
    df = spark.createDataFrame([(t, t) for t in texts], "given string, v string")
    for row in requests.typed_values(df, "v").collect():
        assert row.kind == python_kind(row.given), row
        if row.kind == "int":
            assert row.int_value == int(row.given)
        if row.kind == "float":
            assert row.float_value == float(row.given)


def test_layering_takes_the_last_layer_and_position_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, "a", "base", 0, 5), (1, "a", "over", 1, 0), (1, "a", "last", 1, 2), (1, "b", "x", 0, 0),
         (2, "a", None, 1, 1), (2, "a", "y", 0, 9)],
        "req int, key string, value string, layer int, pos int",
    )
    once = requests.param_layering(df, ["req"], "key", ["value"], "layer", "pos")
    rows = {(r.req, r.key): (r.value, r.layer) for r in once.collect()}
    assert rows == {(1, "a"): ("last", 1), (1, "b"): ("x", 0), (2, "a"): (None, 1)}
    again = requests.param_layering(
        once.withColumn("pos", F.lit(0)), ["req"], "key", ["value"], "layer", "pos"
    )
    assert {(r.req, r.key): (r.value, r.layer) for r in again.collect()} == rows


def test_defaults_cast_fill_and_report(spark):
    df = spark.createDataFrame(
        [("sdxl", None, "30", None), ("sdxl-pixel-art", "", "x", "2"),
         ("sdxl-spo", "n", " 1_0 ", "nope"), ("other", None, None, None)],
        "model string, negative_prompt string, steps string, guidance_scale string",
    )
    rows = requests.request_defaults(df, "model", fixed.IMAGE_DEFAULTS).collect()
    got = [(r.negative_prompt, r.steps, r.guidance_scale, r.width, r.lora_strength, r.error) for r in rows]
    assert got == [
        ("", 30, 7.5, 1024, None, None),
        ("", 25, 2.0, 1024, 1.2, "steps: cannot be read as bigint"),
        ("n", 10, 5.0, 1024, None, "guidance_scale: cannot be read as double"),
        (None, None, None, None, None, "unknown model"),
    ]


def test_training_parameters_that_swallow_bad_values(spark):
    df = spark.createDataFrame(
        [("qwen3-vl", "bad", "bad", "8"), ("qwen3-vl", "0.5", "200", None)],
        "model string, epochs string, max_train_samples string, batch_size string",
    )
    rows = requests.request_defaults(df, "model", fixed.TRAIN_DEFAULTS).collect()
    assert [(r.epochs, r.max_train_samples, r.batch_size, r.learning_rate, r.error) for r in rows] == [
        (None, None, 8, 2e-4, None), (0.5, 200, 2, 2e-4, None)
    ]


def test_required_parameters(spark):
    df = spark.createDataFrame(
        [(" \t", [], None), ("x", ["m"], "img"), (None, None, ""), ("x", ["m"], "")],
        "prompt string, messages array<string>, image string",
    )
    checked = requests.required_filter(df, prompt="text", messages="list", image="value")
    assert [r.error for r in checked.collect()] == [
        "prompt required", None, "prompt required", "image required"
    ]
    assert requests.accepted(checked).count() == 1
    assert requests.rejected(checked).count() == 3


def test_prompt_rewrite(spark):
    df = spark.createDataFrame(
        [(" cat ", "", "sdxl"), ("PIXELated cat", "", "sdxl-pixel-art"), ("cat", "", "sdxl-pixel-art")],
        "p string, n string, model string",
    )
    rows = requests.prompt_rewrite(df, "p", "n", "model").collect()
    assert [(r.p, r.n) for r in rows] == [
        ("cat", None), ("PIXELated cat", ""), ("pixel, cat", "")
    ]


CASES = [
    (fixed.CHAT_CONTRACT, {}, ["$: messages is required"]),
    (fixed.CHAT_CONTRACT, {"messages": []}, []),
    (fixed.CHAT_CONTRACT, {"messages": [{"role": "user", "content": "x"}]}, []),
    (fixed.CHAT_CONTRACT, {"messages": [{"role": "user", "content": "x"}, {"role": "bot"}]},
     ["$.messages[1]: content is required",
      "$.messages[1].role: not one of system, user, assistant"]),
    (fixed.CHAT_CONTRACT, {"messages": ["text"]}, ["$.messages[0]: not of type object"]),
    (fixed.CHAT_CONTRACT, {"messages": "text"}, ["$.messages: not of type array"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "extra": 1, "b": 2}, ["$: unknown keys b, extra"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "max_tokens": 1.0}, []),
    (fixed.CHAT_CONTRACT, {"messages": [], "max_tokens": 1.5}, ["$.max_tokens: not of type integer"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "max_tokens": 0}, ["$.max_tokens: below minimum 1"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "max_tokens": True}, ["$.max_tokens: not of type integer"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "max_tokens": "5"}, ["$.max_tokens: not of type integer"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "temperature": 2}, []),
    (fixed.CHAT_CONTRACT, {"messages": [], "temperature": 2.01}, ["$.temperature: above maximum 2"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "temperature": True}, ["$.temperature: not of type number"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "reasoning_level": "max"},
     ["$.reasoning_level: not one of low, medium, high"]),
    (fixed.CHAT_CONTRACT, {"messages": [], "reasoning_level": None},
     ["$.reasoning_level: not of type string", "$.reasoning_level: not one of low, medium, high"]),
    (fixed.IMAGE_CONTRACT, {"prompt": "x", "width": 64, "seed": 12345678901234567890}, []),
    (fixed.IMAGE_CONTRACT, {"prompt": None, "width": 63}, ["$.prompt: not of type string",
                                                          "$.width: below minimum 64"]),
    (fixed.PIXEL_CONTRACT, {"prompt": "x", "lora_strength": 2.5},
     ["$.lora_strength: above maximum 2"]),
    (fixed.VISION_CONTRACT, {"image": "x", "prompt": "y", "anything": [1]}, []),
    (fixed.BENCHMARK_CONTRACT, {"split": "train", "max_items": 1e2}, ["$.split: not one of test, dev"]),
    (fixed.TRAIN_CONTRACT, {"dataset_uri": "hf:a/b", "epochs": 1}, []),
    (fixed.CACHE_CONTRACT, [1], ["$: not of type object"]),
]


def test_contracts(spark):
    for contract in {id(c): c for c, _, _ in CASES}.values():
        mine = [(json.dumps(v), e) for c, v, e in CASES if c is contract]
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(mine)], "i int, params string")
        rows = contract_check(df, "params", contract).orderBy("i").collect()
        assert [sorted(r.errors) for r in rows] == [sorted(e) for _, e in mine]
        assert [r.ok for r in rows] == [not e for _, e in mine]


def test_rule_rows_find_the_same_errors(spark):
    """All contracts at once, from a table, in one join."""
    contracts = {str(id(c)): c for c, _, _ in CASES}
    rules = contract_rules(spark, contracts)
    rows = [(i, str(id(c)), json.dumps(v)) for i, (c, v, _) in enumerate(CASES)]
    rows += [(100, rows[0][1], "{broken"), (101, "none", "{}"), (102, rows[-1][1], None), (103, None, "{}"), (104, rows[-1][1], "null")]
    df = spark.createDataFrame(rows, "i int, m string, params string")
    assert rule_depth(rules) == 3
    found = {r.i: r for r in check_rules(df, "i", "m", "params", rules, rule_depth(rules)).collect()}
    assert len(found) == len(rows)
    for i, (_, _, errors) in enumerate(CASES):
        assert found[i].errors == sorted(errors) and found[i].ok == (not errors)
    assert [found[i].errors for i in range(100, 105)] == [
        ["$: not JSON"], ["$: no contract"], [], ["$: no contract"], ["$: not of type object"]
    ]


def test_contract_on_text_that_is_not_json(spark):
    df = spark.createDataFrame([("{broken",), (None,), ("null",)], "params string")
    rows = contract_check(df, "params", fixed.CACHE_CONTRACT).collect()
    assert [r.errors for r in rows] == [["$: not JSON"], [], ["$: not of type object"]]


def test_contracts_with_unknown_keywords_are_refused():
    for bad in ({"pattern": "x"}, {"type": "date"}, {"properties": {"a": {"oneOf": []}}},
                {"items": {"format": "x"}}, {"additionalProperties": {"type": "string"}},
                {"enum": [1]}, {"type": ["string", "null"]}):
        with pytest.raises(ValueError):
            check_contract(bad)
    for contract in (fixed.IMAGE_CONTRACT, fixed.PIXEL_CONTRACT, fixed.CHAT_CONTRACT,
                     fixed.VISION_CONTRACT, fixed.TRAIN_CONTRACT, fixed.BENCHMARK_CONTRACT):
        check_contract(contract)
