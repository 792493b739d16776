"""Requests from parameters to routed payloads, and recipe arguments."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from evalmill import fixed_values as fixed
from evalmill.operators import chat
from evalmill.plans import serving, training
from evalmill.sources.files import read_files
from evalmill.sources.payloads import payload_write


def requests_of(spark, rows):
    data = [
        (i, model, json.dumps(p) if isinstance(p, (dict, list)) else p)
        for i, (model, p) in enumerate(rows)
    ]
    return spark.createDataFrame(data, "req_id int, model string, params string")


def test_no_override_is_lost(spark):
    base = {"prompt": "x", "guidance_scale": 3.0, "seed": 5}
    requests = requests_of(spark, [("sdxl", base)] * 5 + [("sdxl", base | {"zz": 1, "yy": 2})])
    overrides = spark.createDataFrame(
        [(0, 0, "guidance_scale=1.0e999"), (1, 0, "seed=0123456789012345678901234567890"), (2, 0, "seed=007"),
         (3, 0, 'prompt=say "hi" \\ {x}'), (4, 0, "aa=1"), (4, 1, "bb=2"), (5, 0, "aa=3")],
        "req_id int, pos int, kv string",
    )
    rows = {r.req_id: r for r in serving.image_requests(requests, overrides).collect()}
    assert rows[0].error == "guidance_scale: not a JSON value" and rows[0].guidance_scale != 3.0
    assert rows[1].error is not None and rows[1].seed != 5
    assert (rows[2].seed, rows[2].error) == (7, None)
    assert (rows[3].prompt, rows[3].error) == ('say "hi" \\ {x}', None)
    assert rows[4].error == "$: unknown keys aa, bb"
    assert rows[5].error == "$: unknown keys aa, yy, zz"


def test_of_double_keys_the_last_one_counts(spark):
    requests = requests_of(spark, [("sdxl", '{"prompt": "a", "steps": 3, "prompt": "b"}')])
    row = serving.image_requests(requests).first()
    assert (row.prompt, row.steps, row.error) == ("b", 3, None)


def test_image_requests(spark):
    requests = requests_of(spark, [
        ("sdxl", {"prompt": " cat ", "steps": 30}),
        ("sdxl-pixel-art", {"prompt": "cat", "negative_prompt": "", "seed": 2**62}),
        ("sdxl", {"prompt": "  "}),
        ("sdxl", {"steps": 3}),
        ("sdxl", {"prompt": "x", "lora_strength": 1}),
        ("sdxl-pixel-art", {"prompt": "x", "lora_strength": 3, "width": 10}),
        ("sdxl", "{broken"),
        ("sdxl", "[1]"),
        ("sdxl", None),
        ("other", {"prompt": "x"}),
        ("sdxl-spo", {"prompt": "x", "steps": 2.0, "width": None}),
        (None, {"prompt": "x"}),
    ])
    overrides = spark.createDataFrame(
        [(0, 1, "steps=7"), (0, 0, "steps=5"), (0, 2, "malformed"), (8, 0, "prompt= dog "),
         (1, 0, "guidance_scale=2.5"), (4, 0, "extra=1"), (99, 0, "prompt=nobody")],
        "req_id int, pos int, kv string",
    )
    rows = {r.req_id: r for r in serving.image_requests(requests, overrides).collect()}
    assert len(rows) == 12
    assert (rows[0].prompt, rows[0].steps, rows[0].guidance_scale, rows[0].error) == ("cat", 7, 7.5, None)
    assert (rows[1].prompt, rows[1].negative_prompt, rows[1].seed, rows[1].guidance_scale,
            rows[1].lora_strength, rows[1].error) == ("pixel, cat", "", 2**62, 2.5, 1.2, None)
    assert (rows[8].prompt, rows[8].width, rows[8].error) == ("dog", 1024, None)
    assert {i: rows[i].error for i in (2, 3, 4, 5, 6, 7, 9, 10, 11)} == {
        2: "prompt required",
        3: "$: prompt is required",
        4: "$: unknown keys extra, lora_strength",
        5: "$.width: below minimum 64; $.lora_strength: above maximum 2",
        6: "params must be a JSON object",
        7: "params must be a JSON object",
        9: "unknown model",
        10: "$.width: not of type integer",
        11: "unknown model",
    }
    plain = {r.req_id: r for r in serving.image_requests(requests).collect()}
    assert plain[0].steps == 30 and plain[4].error == "$: unknown keys lora_strength"
    assert plain[8].error == "$: prompt is required"


def test_chat_requests(spark):
    user, system = {"role": "user", "content": "hi"}, {"role": "system", "content": "s"}
    requests = requests_of(spark, [
        ("gpt-oss-20b", {"messages": [user]}),
        ("gpt-oss-120b", {"messages": [system, user], "reasoning_level": "high"}),
        ("gpt-oss-20b", {"messages": []}),
        ("gpt-oss-20b", {"messages": [{"role": "user"}], "temperature": 3}),
        ("gpt-oss-20b", {"messages": "hi"}),
    ])
    rows = {r.req_id: r for r in serving.chat_requests(requests).collect()}
    assert [tuple(m) for m in rows[0].messages] == [("system", "Reasoning: medium"), ("user", "hi")]
    assert (rows[0].max_tokens, rows[0].temperature, rows[0].error) == (2048, 0.7, None)
    assert [tuple(m) for m in rows[1].messages] == [("system", "s"), ("user", "hi")]
    assert (rows[1].max_tokens, rows[1].error) == (256, None)
    assert rows[2].error == "messages required"
    assert rows[3].error == "$.messages[0]: content is required; $.temperature: above maximum 2"
    assert rows[4].error == "$.messages: not of type array"


def test_accepted_requests_run_and_their_payloads_are_written(spark, tmp_path):
    requests = requests_of(spark, [("sdxl", {"prompt": f"p{i}"} if i % 4 else {}) for i in range(12)])

    def predict(model, batch):
        return [base64.b64encode(f"{model}:{p}".encode()).decode() for p in batch["prompt"]]

    routed = serving.run_requests(
        serving.image_requests(requests), lambda: "m", predict, ["prompt", "seed"], "image/png", tasks=2
    )
    written = payload_write(routed, str(tmp_path / "out"))
    assert {r.req_id: (r.kind, bytes(r.body)) for r in written.collect()} == {
        i: ("binary", f"m:p{i}".encode()) for i in range(12) if i % 4
    }


def test_vision_messages(spark):
    message = spark.range(1).select(chat.vision_messages(F.lit("what?")).alias("m")).first().m[0]
    assert message.role == "user"
    assert [(p.type, p.text) for p in message.content] == [("image", None), ("text", "what?")]


def test_recipe_arguments(spark):
    runs = spark.createDataFrame([("a", "sudoku"), ("b", "/abs")], "codename string, dataset_dir string")
    params = spark.createDataFrame(
        [("a", "lr", "1", 0), ("a", "lr", "2", 1), ("a", "new.key", "True", 2), ("zzz", "lr", "9", 0)],
        "codename string, key string, value string, pos long",
    )
    rows = training.recipe_arguments(runs, params, "/data/", "/runs").collect()
    a = {r.argument for r in rows if r.codename == "a"}
    b = {r.argument for r in rows if r.codename == "b"}
    assert {"lr=2", "new.key=True", "data_paths=[/data/sudoku]", "+run_name=a", "ema=True",
            "hydra.run.dir=/runs/a/hydra-out"} <= a
    assert {"lr=1e-4", "data_paths=[/abs]", "arch.H_cycles=3"} <= b
    assert (len(a), len(b), len(rows)) == (16, 15, 31)


def test_vision_requests(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"rest"
    (tmp_path / "i.png").write_bytes(png)
    path = str(tmp_path / "i.png")
    requests = requests_of(spark, [
        ("qwen3-vl", {"image": base64.b64encode(png).decode(), "prompt": "what?", "lora_run": "mine"}),
        ("qwen3-vl", {"image": path, "prompt": "", "lora_run": "gone", "other": 1}),
        ("qwen3-vl", {"image": "", "prompt": "x"}),
        ("qwen3-vl", {"prompt": "x"}),
        ("qwen3-vl", {"image": "/none", "prompt": "x", "max_tokens": 5}),
    ])
    adapters = spark.createDataFrame([("mine", "/runs/mine")], "lora_run string, adapter string")
    out = serving.vision_requests(requests, None, read_files(spark, str(tmp_path)), adapters)
    rows = {r.req_id: r for r in out.collect()}
    assert [bytes(rows[i].image_bytes) for i in (0, 1)] == [png, png]
    assert [(rows[i].adapter, rows[i].provenance) for i in (0, 1)] == [
        ("/runs/mine", "primary"), ("base", "default")
    ]
    assert (rows[4].max_tokens, rows[0].max_tokens, rows[0].temperature, rows[0].min_p) == (5, 128, 1.5, 0.1)
    assert [rows[i].error for i in range(5)] == [
        None, None, "image required", "$: image is required", "could not decode image"
    ]
    assert rows[0].messages[0].content[1].text == "what?"
    assert {r.adapter for r in serving.vision_requests(requests).collect()} == {"base"}


def test_training_requests(spark):
    requests = requests_of(spark, [
        ("qwen3-vl", {"dataset_uri": "hf:org/set", "epochs": 1}),
        ("qwen3-vl", {"dataset_uri": "org/set", "epochs": 2, "max_train_samples": 10, "batch_size": 0}),
        ("qwen3-vl", {"dataset_uri": "none", "epochs": 1}),
        ("qwen3-vl", {"dataset_uri": "none", "epochs": 0}),
        ("qwen3-vl", {"epochs": 1}),
        ("qwen3-vl", {"dataset_uri": "org/set", "epochs": "one"}),
        ("qwen3-vl", {"dataset_uri": "org/set", "max_train_samples": -1}),
    ])
    examples = spark.createDataFrame([("org/set", 1000)], "dataset string, examples long")
    rows = {r.req_id: r for r in training.training_requests(requests, None, examples).collect()}
    assert [(rows[i].examples, rows[i].steps) for i in (0, 1, 2, 3, 6)] == [
        (1000, 125), (10, 20), (None, None), (None, 30), (1000, 30)
    ]
    assert rows[4].error == "$: dataset_uri is required"
    assert rows[5].error == "$.epochs: not of type number"
    assert rows[0].instruction == "Write the LaTeX representation for this image."


def test_benchmark_and_cache_parameters(spark):
    requests = requests_of(spark, [("gpt-oss-20b", {}), ("gpt-oss-20b", {"max_items": 5, "split": "dev"}),
                                   ("gpt-oss-20b", {"split": "train"})])
    rows = serving.checked_requests(
        requests, None, {"gpt-oss-20b": fixed.BENCHMARK_CONTRACT}, fixed.BENCHMARK_DEFAULTS, {}
    ).orderBy("req_id").collect()
    assert [(r.split, r.max_items, r.reasoning_level, r.error is None) for r in rows] == [
        ("test", 100, "low", True), ("dev", 5, "low", True), ("train", 100, "low", False)
    ]
    cache = requests_of(spark, [("qwen3-vl", None), ("qwen3-vl", {"dataset_uri": "a/b"})])
    rows = serving.checked_requests(
        cache, None, {"qwen3-vl": fixed.CACHE_CONTRACT}, fixed.CACHE_DEFAULTS, {}
    ).orderBy("req_id").collect()
    assert [r.dataset_uri for r in rows] == ["hf:unsloth/LaTeX_OCR", "a/b"]


def test_yaml_parameters(spark):
    pytest.importorskip("yaml")
    from evalmill.sources.params import params_json

    requests = requests_of(spark, [
        ("sdxl", "prompt: a cat\nsteps: 12\nguidance_scale: 2.5\n"),
        ("sdxl", '{"prompt": "json", "steps": 3}'),
        ("sdxl", "- a\n- b\n"),
        ("sdxl", "{broken: ["),
        ("sdxl", None),
    ]).withColumn("params", params_json(F.col("params")))
    rows = {r.req_id: r for r in serving.image_requests(requests).collect()}
    assert [(rows[i].prompt, rows[i].steps, rows[i].error) for i in (0, 1)] == [
        ("a cat", 12, None), ("json", 3, None)
    ]
    assert [rows[i].error for i in (2, 3, 4)] == [
        "params must be a JSON object", "params must be a JSON object", "$: prompt is required"
    ]
