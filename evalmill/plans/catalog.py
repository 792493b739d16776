"""The registered queries: one per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill import fixed_values as fixed
from evalmill.functions.answers import gold_error, gold_letter
from evalmill.functions.numbers import gibibytes, minutes, round_exact, seconds_between, utc_iso
from evalmill.functions.text import (
    blank_to_null,
    first_chars,
    is_level,
    last_chars,
    normalise_level,
)
from evalmill.operators import contract_rules as rule_table
from evalmill.operators import chat, contracts, listing, lookups, ordered, requests, scoring, state
from evalmill.operators.predict import batch_predict as predict_batches
from evalmill.plans import evaluation, indexing, serving, training, views
from evalmill.plans.views import table
from evalmill.session import shared_folder, written
from evalmill.sources import datasets, files, payloads, stored_index
from evalmill.streaming.run_status import read_rejects, stream_files
from evalmill.streaming.run_status import run_status_stream as stream_status

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

PROPS_CONTRACT = {
    "type": "object",
    "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}},
    "required": ["k"],
    "additionalProperties": False,
}


def query(function: Query) -> Query:
    """Register under the function's name, less the underscore that avoids a clash."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- Scans, sources, sinks -----------------------------------------------------------


@query
def dataset_scan(spark, sf_dir):
    return datasets.dataset_scan(
        spark, f"{sf_dir}/documents.parquet", "src3", "source", ["doc_id", "lang", "n_chars"]
    )


@query
def dataset_uri_normalise(spark, sf_dir):
    uri = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("hf:"), F.col("source")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/abs/"), F.col("source")))
        .otherwise(F.col("source"))
    )
    name = datasets.dataset_name(F.col("uri"))
    return table(spark, sf_dir, "documents").select("doc_id", uri.alias("uri")).select(
        "doc_id",
        name.alias("dataset"),
        F.when(~datasets.is_hub_uri(F.col("uri")), datasets.dataset_dir(name, "/data")).alias(
            "folder"
        ),
    )


@query
def dataset_materialise(spark, sf_dir):
    source = datasets.dataset_scan(spark, f"{sf_dir}/documents.parquet", "src3", "source")
    path = shared_folder(spark, "dataset")
    return datasets.dataset_materialise(spark, "src3", source, path).drop("cache_dir")


def _filled_params(spark, sf_dir):
    """A parameter per event; two of three name a file of the small tables, half are prompts."""
    events = table(spark, sf_dir, "events")
    names = F.element_at(
        F.array(F.lit("region"), F.lit("nation"), F.lit("missing")),
        (1 + F.col("event_id") % 3).cast("int"),
    )
    params = events.select(
        F.col("event_id").alias("req_id"),
        F.when(F.col("event_id") % 2 == 0, "file").otherwise("prompt").alias("key"),
        F.concat(F.lit(f"{sf_dir}/"), names, F.lit(".parquet")).alias("value"),
    )
    found = files.read_files(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"])
    return files.file_payload_scan(params, found, "key", "value")


@query
def file_payload_scan(spark, sf_dir):
    """File parameters that name rows of a table of files; each third of them names none."""
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    stored = table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    named = F.concat(F.lit("/data/"), (F.col("event_id") % 300).cast("string"), F.lit(".txt"))
    params = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"),
        F.when(F.col("event_id") % 2 == 0, "file").otherwise("prompt").alias("key"),
        F.when(F.col("event_id") % 3 == 0, F.lit("/none")).otherwise(named).alias("value"),
    )
    return files.file_payload_scan(params, stored, "key", "value").select(
        "req_id", "key", "from_file", F.length("value").alias("n_chars"),
        F.sha2("value", 256).alias("sha256"),
    )


@query
def file_payload_flags(spark, sf_dir):
    """Which parameters were replaced, and whether by base64 or left as a path."""
    base64_only = F.col("value").rlike("^[A-Za-z0-9+/]+=*$")
    return _filled_params(spark, sf_dir).select(
        "req_id", "key", "from_file",
        F.when(F.col("from_file"), base64_only & (F.length("value") % 4 == 0)).alias("is_base64"),
        F.substring_index("value", "/", -1).alias("_last"),
    ).select("req_id", "key", "from_file", "is_base64",
             F.when(~F.col("from_file"), F.col("_last")).alias("kept"))


@query
def content_manifest(spark, sf_dir):
    return files.content_manifest(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query
def file_manifest(spark, sf_dir):
    """Manifest of a nested folder that holds every document, empty files and hidden names too."""
    folder = shared_folder(spark, "tree")
    files.write_files(views.document_files(spark, sf_dir), folder, "name", "body")
    return files.file_manifest(spark, folder).select(
        F.substring_index("path", "/", -3).alias("name"), "sha256", "length", "error"
    )


@query
def payload_files(spark, sf_dir):
    """Every part of the payloads saved as a file of its own."""
    routed = payloads.payload_route(views.payload_parts(spark, sf_dir))
    saved = payloads.payload_files(routed, shared_folder(spark, "payload-files"), ["page_id"])
    return saved.select(
        "page_id", _long("part_no"), "kind", F.substring_index("path", "/", -2).alias("name"), "length", "sha256", "error"
    )


@query
def payload_write(spark, sf_dir):
    routed = payloads.payload_route(views.payload_parts(spark, sf_dir))
    parts = payloads.payload_write(routed, shared_folder(spark, "payloads"))
    return parts.select(
        "page_id",
        _long("part_no"),
        "content_type",
        F.col("kind").cast("string").alias("kind"),
        F.octet_length("body").cast("bigint").alias("n_bytes"),
    )


@query
def report_write(spark, sf_dir):
    scored = _scored_once(spark, sf_dir)
    report = scoring.eval_report(scored, "item_id", {"split": "test", "max_items": 0})
    rows = payloads.report_write(report, shared_folder(spark, "report"))
    return rows.select(
        "section", "subject", "ok", "items", "correct", "accuracy",
        F.transform("samples", lambda s: s["item_id"]).cast("string").alias("samples"),
        F.col("config.split").alias("split"),
    )


# --- Projections, filters, predicates ------------------------------------------------


@query
def request_defaults(spark, sf_dir):
    filled = requests.request_defaults(
        views.requests(spark, sf_dir), "model", fixed.IMAGE_DEFAULTS
    )
    return filled.select(
        "req_id", "model", "prompt", "negative_prompt", "width", "height", "steps",
        "guidance_scale", "seed", "lora_strength", "error",
    )


@query
def required_filter(spark, sf_dir):
    return requests.required_filter(views.requests(spark, sf_dir), prompt="text").select(
        "req_id", "model", "error"
    )


@query
def prompt_rewrite(spark, sf_dir):
    rows = requests.prompt_rewrite(
        views.requests(spark, sf_dir), "prompt", "negative_prompt", "model"
    )
    return rows.select("req_id", "model", "prompt", "negative_prompt")


@query
def system_message_inject(spark, sf_dir):
    return chat.system_message_inject(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "Medium"
    )


@query
def eval_prompt_build(spark, sf_dir):
    built = chat.eval_prompt_build(
        table(spark, sf_dir, "benchmark").withColumnRenamed("text", "prompt"), "prompt", "low"
    )
    return built.select("item_id", F.posexplode("messages").alias("pos", "m")).select(
        "item_id", _long("pos"), "m.role", "m.content"
    )


@query
def conversation_record(spark, sf_dir):
    samples = table(spark, sf_dir, "documents").withColumn("image", F.encode("source", "UTF-8"))
    records = chat.conversation_record(samples, "image", "text")
    user, assistant = F.col("messages")[0], F.col("messages")[1]
    return records.select(
        "doc_id",
        user.role.alias("first_role"),
        user.content[0].text.alias("instruction"),
        user.content[1].type.alias("image_type"),
        F.octet_length(user.content[1].image).cast("bigint").alias("image_bytes"),
        assistant.role.alias("second_role"),
        assistant.content[0].text.alias("answer"),
    )


@query
def kv_typed_parse(spark, sf_dir):
    return requests.kv_typed_parse(views.kv_params(spark, sf_dir), "kv").select(
        "req_id", _long("pos"), "key", "kind", "bool_value", "int_value", "float_value", "text"
    )


@query
def param_layering(spark, sf_dir):
    given = requests.kv_typed_parse(views.kv_params(spark, sf_dir), "kv").select(
        "req_id", "key", F.col("text").alias("value"), F.lit(1).alias("layer"), "pos"
    )
    defaults = requests.layer_defaults(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id")),
        {"on": "False", "k": "0", "arch": "trm", "lr": "1e-4"},
    ).withColumns({"layer": F.lit(0), "pos": F.lit(0)})
    layered = requests.param_layering(
        defaults.unionByName(given), ["req_id"], "key", ["value"], "layer", "pos"
    )
    return layered.select("req_id", "key", "value", _long("layer"))


@query
def contract_check(spark, sf_dir):
    checked = contracts.contract_check(table(spark, sf_dir, "events"), "props", PROPS_CONTRACT)
    return checked.select("event_id", "ok", F.array_join("errors", "; ").alias("errors"))


# --- Joins ---------------------------------------------------------------------------


@query
def contract_rules(spark, sf_dir):
    """Contracts that are rows of a table, a wide one and a narrow one, met by the same parameters."""
    narrow = {**PROPS_CONTRACT, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 20}}}
    rules = rule_table.contract_rules(spark, {"wide": PROPS_CONTRACT, "narrow": narrow})
    model = F.when(F.col("event_id") % 3 == 0, "wide").when(F.col("event_id") % 3 == 1, "narrow").otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", model.alias("model"), "props")
    checked = rule_table.check_rules(rows, "event_id", "model", "props", rules, depth=1)
    return checked.select("event_id", "model", "ok", F.array_join("errors", "; ").alias("errors"))


def _scored(spark, sf_dir):
    """Items, outputs and letters joined by id: what the scoring operators read."""
    preds = evaluation.letters(views.raw_outputs(spark, sf_dir))
    golds = evaluation.golds(views.eval_items(spark, sf_dir), ["prompt"])
    return lookups.aligned_score_join(preds, golds, ["item_id"])


def _scored_once(spark, sf_dir):
    """The same as a table that was written once, for reports that read it several times."""
    return written(_scored(spark, sf_dir), "scored")


def _letters_only(spark, sf_dir):
    """The same without the long texts."""
    preds = evaluation.letters(views.raw_outputs(spark, sf_dir)).select("item_id", "pred")
    golds = evaluation.golds(views.eval_items(spark, sf_dir))
    return lookups.aligned_score_join(preds, golds, ["item_id"])


@query
def aligned_score_join(spark, sf_dir):
    return _letters_only(spark, sf_dir).select("item_id", "subject", "pred", "gold")


@query
def aligned_score_full(spark, sf_dir):
    """Predictions and golds of which either may lack the other."""
    preds = evaluation.letters(views.raw_outputs(spark, sf_dir)).select("item_id", "pred")
    golds = evaluation.golds(views.eval_items(spark, sf_dir))
    joined = lookups.aligned_score_join(preds.where("item_id % 5 != 0"), golds.where("item_id % 7 != 0"), ["item_id"], "full")
    return joined.select("item_id", "subject", "pred", "gold", "alignment")


@query
def zip_scores(spark, sf_dir):
    """Predictions and golds written in item order, without their ids, put side by side by position."""
    order = lambda df: df.repartitionByRange("item_id").sortWithinPartitions("item_id")
    scored = _letters_only(spark, sf_dir).where("item_id % 9 != 4")
    left = written(order(scored).select("pred"), "predictions")
    right = written(order(scored.where("item_id < 900")).select("subject", "gold"), "golds")
    return ordered.zip_by_position(left, right).select("position", "subject", "pred", "gold", "alignment")


@query
def coverage_listing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return lookups.coverage_listing(documents, table(spark, sf_dir, "labels"), ["doc_id"])


@query
def required_set_check(spark, sf_dir):
    checked = lookups.required_set_check(
        table(spark, sf_dir, "conversations"), ["conv_id"], "role",
        ["system", "user", "assistant"],
    )
    return checked.select("conv_id", "ok", F.array_join("missing", ", ").alias("missing"))


@query
def lookup_with_fallback(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("adapter"), "c_mktsegment"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.lookup_with_fallback(
        orders,
        customers.where(F.col("c_mktsegment") == "BUILDING"),
        customers.where(F.col("c_mktsegment") == "FURNITURE"),
        ["o_custkey"],
        "adapter",
        "base",
    )


@query
def version_resolve(spark, sf_dir):
    index = state.index_upsert(None, views.index_updates(spark, sf_dir))
    return lookups.version_resolve(views.refs(spark, sf_dir), index, "ref").select(
        "req_id", "name", "version", "path", "sha256", "status"
    )


# --- Aggregations --------------------------------------------------------------------


@query
def overall_accuracy(spark, sf_dir):
    return scoring.overall_accuracy(_letters_only(spark, sf_dir))


@query
def accuracy_by_subject(spark, sf_dir):
    return scoring.accuracy_by_subject(_letters_only(spark, sf_dir))


@query
def accuracy_rollup(spark, sf_dir):
    return scoring.accuracy_rollup(_letters_only(spark, sf_dir))


@query
def coverage_counts(spark, sf_dir):
    return lookups.coverage_counts(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]
    )


@query
def batch_plan(spark, sf_dir):
    return listing.batch_plan(table(spark, sf_dir, "documents"), ["lang"], epochs=1.5)


@query
def eval_report(spark, sf_dir):
    report = scoring.eval_report(
        _scored_once(spark, sf_dir), "item_id", {"split": "test", "max_items": 0, "reasoning_level": "low"}
    )
    return report.select(
        "section", "subject", "ok", "items", "correct", "accuracy", F.size("samples").cast("bigint").alias("samples"),
        F.col("config.reasoning_level").alias("level"),
    )


@query
def member_listing(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    label = listing.device_label(
        F.col("role"), F.when(F.col("role") == "assistant", F.lit("A10G"))
    )
    return listing.member_listing(turns, ["conv_id"], "turn", label)


@query
def member_listing_text(spark, sf_dir):
    return listing.listing_text(member_listing(spark, sf_dir), ["conv_id"])


# --- Window, sorts, limits -----------------------------------------------------------


@query
def running_accuracy(spark, sf_dir):
    return scoring.running_accuracy(_letters_only(spark, sf_dir), ["subject"], "item_id")


@query
def head_n(spark, sf_dir):
    return ordered.head_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100)


@query
def sample_records(spark, sf_dir):
    return scoring.sample_records(_scored(spark, sf_dir), "item_id")


# --- Scalar functions ----------------------------------------------------------------


@query
def tagged_channels(spark, sf_dir):
    return evaluation.tagged_channels(views.raw_outputs(spark, sf_dir)).select(
        "item_id", "response", "analysis", "commentary"
    )


@query
def tagged_channels_text(spark, sf_dir):
    """The parser over whole document texts put into channels."""
    raw = F.concat(
        F.lit("<|channel|>analysis<|message|>"), F.col("text"),
        F.lit("<|end|><|start|>assistant<|channel|>commentary<|message|> "), F.col("lang"),
        F.lit("<|end|><|channel|>Final<|message|>\n"), F.col("text"), F.lit("<|return|>"),
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return evaluation.tagged_channels(documents).drop("raw")


@query
def choice_letter_(spark, sf_dir):
    return evaluation.letters(views.raw_outputs(spark, sf_dir)).select("item_id", "pred")


@query
def gold_letter_(spark, sf_dir):
    items = views.eval_items(spark, sf_dir).select(
        "item_id",
        F.when(F.col("item_id") % 3 != 0, F.col("answer_idx") + (F.col("item_id") % 5) - 1).alias(
            "answer_idx"
        ),
        F.concat(F.lit("\t"), F.substring("subject", 1, 1), F.lit(" \n")).alias("answer_str"),
    )
    return items.select(
        "item_id",
        gold_letter(F.col("answer_idx"), F.col("answer_str")).alias("gold"),
        gold_error(F.col("answer_idx")).alias("error"),
    )


@query
def level_normalise(spark, sf_dir):
    level = F.element_at(
        F.array(F.lit("LOW"), F.lit("Medium"), F.lit("high"), F.lit("max")),
        (1 + F.col("doc_id") % 4).cast("int"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", level.alias("given")).select(
        "doc_id", normalise_level(F.col("given")).alias("level"), is_level(F.col("given")).alias("valid")
    )


@query
def snippet(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        first_chars(text, 100).alias("head"),
        last_chars(text, 200).alias("tail"),
        first_chars(text, 500, "...").alias("preview"),
        blank_to_null(
            F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(first_chars(text, 100))
        ).alias("analysis"),
    )


@query
def image_payload_decode(spark, sf_dir):
    decoded = payloads.image_payload_decode(views.image_params(spark, sf_dir), "image")
    return decoded.select(
        "page_id",
        "image_format",
        F.octet_length("image_bytes").cast("bigint").alias("n_bytes"),
        F.sha2("image_bytes", 256).alias("sha256"),
        "error",
    )


@query
def payload_encode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    return payloads.payload_encode(pages, "body", "payload").drop("body")


@query
def utc_iso_(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", utc_iso(F.col("ts"), zoned=False).alias("iso")
    )


@query
def unit_round(spark, sf_dir):
    used = (F.floor("value") * 10_000_000 + F.col("event_id") * 7919).cast("bigint")
    start = F.floor(F.col("used") / 3).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "value", used.alias("used"))
        .select(
            "event_id",
            gibibytes(F.col("used")).alias("peak_gib"),
            gibibytes(start).alias("start_gib"),
            minutes(F.col("value")).alias("minutes"),
        )
        .withColumn("added_gib", round_exact(F.col("peak_gib") - F.col("start_gib"), 3))
        .drop("start_gib")
    )


# --- Stateful ------------------------------------------------------------------------


@query
def index_upsert(spark, sf_dir):
    index = state.index_upsert(
        views.index_base(spark, sf_dir), views.index_updates(spark, sf_dir)
    )
    return state.index_with_latest(index)


@query
def index_stored(spark, sf_dir):
    """The same upserts, in three steps, to an index that is kept in buckets on disk."""
    folder = shared_folder(spark, "index")
    updates = views.index_updates(spark, sf_dir)
    index = views.index_base(spark, sf_dir)
    for part in (index, updates.where("seq % 2 = 1"), updates.where("seq % 2 = 0")):
        stored_index.upsert_stored(part.select(index.columns), folder, buckets=16)
    return state.index_with_latest(stored_index.read_stored(spark, folder, index.schema))


def _status_rows(records: DataFrame) -> DataFrame:
    iso = lambda name: utc_iso(F.col(name), zoned=False).alias(name)
    return records.select(
        "run_id", "status", iso("started_at"), iso("finished_at"), "metric", iso("updated_at"),
        "updates",
        seconds_between(F.col("started_at"), F.col("finished_at")).alias("duration"),
    )


@query
def run_status_fold(spark, sf_dir):
    return _status_rows(
        state.run_status_fold(views.run_updates(spark, sf_dir), views.STATUS_FIELDS)
    )


@query
def run_status_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    events = stream_files(spark, path, spark.read.parquet(path).schema)
    folder = shared_folder(spark, "status")
    return _status_rows(
        stream_status(
            views.to_run_updates(events), views.STATUS_FIELDS, f"{folder}/table", f"{folder}/checkpoint"
        )
    )


@query
def run_status_rejects(spark, sf_dir):
    """The malformed updates of the same stream, some of whose rows lack a run, a time or a known status."""
    path = f"{sf_dir}/events.parquet"
    updates = views.spoilt_updates(stream_files(spark, path, spark.read.parquet(path).schema))
    folder = shared_folder(spark, "status")
    stream_status(updates, views.STATUS_FIELDS, f"{folder}/table", f"{folder}/checkpoint")
    iso = lambda name: utc_iso(F.col(name), zoned=False).alias(name)
    return read_rejects(spark, f"{folder}/table", updates.schema).select(
        "run_id", iso("ts"), "seq", "status", iso("started_at"), iso("finished_at"), "metric"
    )


# --- Predictor and composed plans ----------------------------------------------------


def stub_load() -> list[str]:
    """Stand-in for loading a model: the answer letters."""
    return list("ABCD")


def stub_predict(model: list[str], batch: pd.DataFrame) -> list[str]:
    """Stand-in for generation: same forms as :func:`views.raw_outputs`, from the prompt."""
    results = []
    for item, messages in zip(batch["item_id"], batch["messages"], strict=True):
        prompt = messages[-1]["content"]
        letter = model[len(prompt) % 4]
        results.append(
            [
                f"<|channel|>analysis<|message|>think<|end|><|start|>assistant"
                f"<|channel|>final<|message|>Answer: {letter}<|return|>",
                f"<|channel|>final<|message|>{letter} because<|return|>",
                f"<|channel|>FINAL<|message|>\nThe answer : {letter}\n<|end|>",
                "<|channel|>final<|message|>I cannot say<|return|>",
                f"<|channel|>analysis<|message|>so answer: {letter}",
                f"<|channel|>final<|message|>Answer: A<|end|>"
                f"<|channel|>final<|message|>Answer: {letter}<|return|>",
                f"<|channel|>analysis<|message|>x<|channel|>final<|message|>{letter}<|return|>",
            ][item % 7]
        )
    return results


@query
def batch_predict(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), chat.eval_messages(F.col("text"), "low").alias("messages")
    )
    return predict_batches(
        documents, stub_load, stub_predict, ["item_id", "messages"], ["item_id"]
    )


@query
def benchmark_eval(spark, sf_dir):
    scored = evaluation.evaluate(
        views.eval_items(spark, sf_dir), stub_load, stub_predict, "low", max_items=None
    )
    return scoring.accuracy_by_subject(scored)


def _benchmark(spark, sf_dir, report):
    items = views.eval_items(spark, sf_dir)
    splits = items.withColumn("split", F.when(F.col("item_id") % 4 == 0, "dev").otherwise("test"))
    run = evaluation.benchmark_run(splits, '{"max_items": 0}', stub_load, stub_predict)
    return evaluation.run_reports(*run)[report]


@query
def benchmark_by_subject(spark, sf_dir):
    """The flagship from its parameters to the scores of the split."""
    return _benchmark(spark, sf_dir, "by_subject")


@query
def benchmark_running(spark, sf_dir):
    """Running accuracy over the one whole run."""
    return _benchmark(spark, sf_dir, "running")


@query
def benchmark_samples(spark, sf_dir):
    return _benchmark(spark, sf_dir, "samples")


@query
def benchmark_report(spark, sf_dir):
    return _benchmark(spark, sf_dir, "report").select(
        "section", "subject", "items", "correct", "accuracy", F.size("samples").cast("bigint").alias("samples"),
        F.col("config.split").alias("split"), F.col("config.max_items").alias("max_items"),
        F.col("config.reasoning_level").alias("level"),
    )


@query
def run_requests(spark, sf_dir):
    """Merged, checked and completed image requests, rejected ones with their error."""
    return serving.image_requests(
        views.json_requests(spark, sf_dir), views.request_overrides(spark, sf_dir)
    )


@query
def chat_requests(spark, sf_dir):
    """Checked chat requests with the level's system message in front."""
    checked = serving.chat_requests(views.chat_params(spark, sf_dir))
    return checked.select(
        "req_id", "model", "max_tokens", "temperature", "reasoning_level",
        F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m.role, m.content)), "|").alias("turns"),
        "error",
    )


@query
def vision_requests(spark, sf_dir):
    """Checked vision requests: image read from text or file, adapter or the base model."""
    adapters = spark.createDataFrame([("run0", "adapter0")], "lora_run string, adapter string")
    ready = serving.vision_requests(
        views.vision_params(spark, sf_dir), None, views.vision_files(spark, sf_dir), adapters
    )
    return ready.select(
        "req_id", "prompt", "max_tokens", "image_format", F.sha2("image_bytes", 256).alias("image_sha256"),
        "adapter", "provenance", "error",
    )


def chat_predict(model: list[str], batch: pd.DataFrame) -> list[str]:
    """Stand-in for generation: an analysis and the last message's text back."""
    return [
        f"<|channel|>analysis<|message|>{item}<|end|><|channel|>final<|message|>{m[-1]['content']}<|return|>"
        for item, m in zip(batch["req_id"], batch["messages"], strict=True)
    ]


def _run_path(spark, sf_dir):
    return serving.run_path(
        views.referred_params(spark, sf_dir), views.chat_index(spark, sf_dir), views.params_files(spark, sf_dir),
        views.chat_overrides(spark, sf_dir), stub_load, chat_predict, shared_folder(spark, "run"),
    )


@query
def run_path_files(spark, sf_dir):
    """References, parameter files, YAML and overrides to the files that were saved."""
    saved, _ = _run_path(spark, sf_dir)
    return saved.select("req_id", "model", "version", F.substring_index("path", "/", -4).alias("name"), "length", "sha256", "error")


@query
def run_path_rejects(spark, sf_dir):
    """The requests of the same run that were rejected."""
    return _run_path(spark, sf_dir)[1].select("req_id", "version", "error")


@query
def run_to_payloads(spark, sf_dir):
    """Chat requests from parameters to the bytes that were written."""
    written = serving.run_chat(
        views.chat_params(spark, sf_dir), None, stub_load, chat_predict, shared_folder(spark, "chat")
    )
    return written.select(
        "req_id", "model", "content_type", F.col("kind").cast("string").alias("kind"),
        F.sha2("body", 256).alias("sha256"), "error",
    )


def _index(spark, sf_dir):
    return indexing.index_build(
        None, views.bundle_files(spark, sf_dir), ["config.json", "README.md"], {"weights-*.bin": r"^weights-.*\.bin$"}
    )


@query
def index_build(spark, sf_dir):
    """Complete bundles in the index."""
    return _index(spark, sf_dir)[0]


@query
def index_rejects(spark, sf_dir):
    """Incomplete bundles with what they lack."""
    return _index(spark, sf_dir)[1]


@query
def full_listing(spark, sf_dir):
    """Every source with status, bundle and members."""
    documents = table(spark, sf_dir, "documents")
    langs = documents.select("source", "lang").distinct()
    device = F.when(F.col("lang") == "en", F.lit("A10G"))
    members = listing.member_listing(
        langs.withColumnRenamed("source", "name"), ["name"],
        F.ascii(F.substring("lang", 1, 1)) * 256 + F.ascii(F.substring("lang", 2, 1)), listing.device_label(F.col("lang"), device),
    )
    sources = documents.select(F.col("source").alias("name")).union(
        table(spark, sf_dir, "region").select(F.lower("r_name"))
    ).distinct().withColumn("version", F.lit("1"))
    return indexing.full_listing(sources, index_build(spark, sf_dir), members)


@query
def training_requests(spark, sf_dir):
    """Checked training requests with the optimizer steps of their dataset."""
    examples = listing.batch_plan(table(spark, sf_dir, "documents"), ["source"])
    planned = training.training_requests(
        views.training_params(spark, sf_dir), None, examples.withColumnRenamed("source", "dataset")
    )
    return planned.select(
        "req_id", "dataset", "examples", "epochs", "steps", "max_train_samples", "batch_size",
        "gradient_accumulation_steps", "learning_rate", "instruction", "error",
    )


@query
def training_recipe(spark, sf_dir):
    """Recipe arguments per run: defaults, overlaid by the parameters of the run."""
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("codename"), F.col("c_mktsegment").alias("dataset_dir")
    )
    params = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("codename"),
        F.when(F.col("o_orderkey") % 2 == 0, "epochs").otherwise("note").alias("key"),
        F.col("o_orderkey").cast("string").alias("value"),
        F.col("o_orderkey").alias("pos"),
    )
    return training.recipe_arguments(runs, params, "/data", "/runs")


@query
def training_export(spark, sf_dir):
    samples = table(spark, sf_dir, "documents").withColumn("image", F.encode("source", "UTF-8"))
    return training.training_export(
        samples, "source", "doc_id", "image", "text", shared_folder(spark, "training"), epochs=1.0
    )


@query
def training_export_capped(spark, sf_dir):
    """Each dataset capped by itself."""
    samples = table(spark, sf_dir, "documents").withColumn("image", F.encode("source", "UTF-8"))
    return training.training_export(
        samples, "source", "doc_id", "image", "text", shared_folder(spark, "training"),
        max_train_samples=7, epochs=1.0,
    )

