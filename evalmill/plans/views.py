"""Inputs of the registered queries, derived from the test tables.

The tables have no requests, model outputs or run updates, so these views shape existing
columns into them; every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.binary import encode_base64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items: documents with the gold index made of both labels."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("subject"),
        F.col("text").alias("prompt"),
        (F.col("quality") + 2 * F.col("toxic")).alias("answer_idx"),
    )


def shaped_output(letter: Column, shape: Column) -> Column:
    """Stand-in for tagged model output, one form per way the parser can go."""
    forms = [
        ("<|channel|>analysis<|message|>think<|end|><|start|>assistant"
         "<|channel|>final<|message|>Answer: ", "<|return|>"),
        ("<|channel|>final<|message|>", " because<|return|>"),
        ("<|channel|>FINAL<|message|>\nThe answer : ", "\n<|end|>"),
        ("<|channel|>final<|message|>I cannot say<|return|>", None),
        ("<|channel|>analysis<|message|>so answer: ", ""),
        ("<|channel|>final<|message|>Answer: A<|end|><|channel|>final<|message|>Answer: ",
         "<|return|>"),
        ("<|channel|>analysis<|message|>x<|channel|>final<|message|>", "<|return|>"),
    ]
    text = F.lit(None).cast("string")
    for number, (before, after) in enumerate(forms):
        form = F.lit(before) if after is None else F.concat(F.lit(before), letter, F.lit(after))
        text = F.when(shape == number, form).otherwise(text)
    return text


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substr(F.lit("ABCD"), (1 + F.col("n_chars") % 4).cast("int"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), shaped_output(letter, F.col("doc_id") % 7).alias("raw")
    )


def kv_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ``key=value`` texts per event."""
    k = F.get_json_object("props", "$.k")
    texts = [
        F.lit("on=True"),
        F.concat(F.lit("k="), k),
        F.concat(F.lit("v="), F.col("value").cast("decimal(10,2)").cast("string")),
        F.lit("name=a=b"),
        F.lit("big=1_000"),
        F.lit("exp=1e5"),
        F.lit(" pad = 7 "),
        F.lit("malformed"),
    ]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), F.posexplode(F.array(*texts)).alias("pos", "kv")
    )


def requests(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One image request per event, with ``more`` columns of the event."""
    model = (
        F.when(F.col("event_id") % 3 == 0, "sdxl")
        .when(F.col("event_id") % 3 == 1, "sdxl-spo")
        .otherwise("sdxl-pixel-art")
    )
    prompt = (
        F.when(F.col("event_id") % 5 == 0, F.lit("  "))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("Pixel "), F.col("event_type")))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"),
        model.alias("model"),
        prompt.alias("prompt"),
        F.when(F.col("event_id") % 2 == 0, F.lit("")).alias("negative_prompt"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("int")).alias("steps"),
        *more,
    )


def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests with their parameters in a JSON object, some with a key too many."""
    rows = requests(spark, sf_dir, F.get_json_object("props", "$.k").cast("int").alias("k"))
    params = F.to_json(
        F.struct("prompt", "negative_prompt", "steps", F.when(F.col("k") > 90, F.col("k")).alias("k"))
    )
    return rows.select("req_id", "model", params.alias("params"))


def request_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ``key=value`` texts per event: a guidance scale, and a seed, a size or a strength."""
    guidance = F.concat(
        F.lit("guidance_scale="), F.col("value").cast("decimal(10,2)").cast("string")
    )
    other = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("seed = "), F.col("event_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, F.lit("width=tall"))
        .otherwise(F.lit("lora_strength=0.5"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), F.posexplode(F.array(guidance, other)).alias("pos", "kv")
    )


def training_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training requests per event: some by epochs, some by steps, some of an unknown dataset."""
    k = F.get_json_object("props", "$.k").cast("int")
    params = F.to_json(
        F.struct(
            F.concat(F.lit("hf:src"), (F.col("event_id") % 25).cast("string")).alias("dataset_uri"),
            F.when(F.col("event_id") % 2 == 0, k / 10).alias("epochs"),
            F.when(F.col("event_id") % 4 == 1, k).alias("steps"),
            F.when(F.col("event_id") % 3 == 0, k - 5).alias("max_train_samples"),
            F.when(F.col("event_id") % 5 == 0, F.lit(3)).alias("batch_size"),
        )
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), F.lit("qwen3-vl").alias("model"), params.alias("params")
    )


def chat_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests per event: some without messages, some too hot, some at a level of their own."""
    message = lambda role: F.struct(F.lit(role).alias("role"), F.col("event_type").alias("content"))
    messages = (
        F.when(F.col("event_id") % 5 == 0, F.array().cast("array<struct<role:string,content:string>>"))
        .when(F.col("event_id") % 5 == 1, F.array(message("system"), message("user")))
        .otherwise(F.array(message("user")))
    )
    params = F.to_json(
        F.struct(
            messages.alias("messages"),
            F.when(F.col("event_id") % 3 == 0, F.lit("high")).alias("reasoning_level"),
            F.when(F.col("event_id") % 7 == 0, F.lit(3)).alias("temperature"),
        )
    )
    model = F.when(F.col("event_id") % 2 == 0, "gpt-oss-20b").otherwise("gpt-oss-120b")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), model.alias("model"), params.alias("params")
    )


def referred_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat requests by reference: some to unknown models or versions; odd ones name a file."""
    inline = chat_params(spark, sf_dir).withColumnRenamed("req_id", "event_id")
    model = F.when(F.col("event_id") % 11 == 0, "nobody").otherwise(F.col("model"))
    version = F.concat(F.lit(":v"), (F.col("event_id") % 3).cast("string"))
    file = F.concat(F.lit("/params/"), F.col("event_type"), F.lit(".yaml"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return inline.join(events, "event_id").select(
        F.col("event_id").alias("req_id"),
        F.concat(model, F.when(F.col("event_id") % 4 == 0, "").otherwise(version)).alias("ref"),
        F.when(F.col("event_id") % 2 == 1, file).otherwise(F.col("params")).alias("params"),
    )


def params_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML file of parameters per type of event."""
    text = F.concat(F.lit("messages:\n- role: user\n  content: "), F.col("event_type"), F.lit("\nreasoning_level: high\n"))
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    path = F.concat(F.lit("/params/"), F.col("event_type"), F.lit(".yaml"))
    return kinds.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def chat_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third request asks for another level, every seventh is too hot."""
    given = F.array(
        F.when(F.col("event_id") % 3 == 0, "reasoning_level= low "),
        F.when(F.col("event_id") % 7 == 0, "temperature=3"),
    )
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), F.posexplode(given).alias("pos", "kv"))
    return events.where("kv is not null")


def chat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions v0 and v1 of each model that a request names; v1 was written last."""
    models = chat_params(spark, sf_dir).select(F.col("model").alias("name")).distinct()
    both = models.select("name", F.posexplode(F.array(F.lit("v0"), F.lit("v1"))).alias("seq", "version"))
    return both.select(
        "name", "version", F.concat_ws("/", "name", "version").alias("path"),
        F.sha2(F.concat_ws(":", "name", "version"), 256).alias("sha256"), "seq",
    )


def vision_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision requests per page: images as text, paths of files, and none; some name an adapter."""
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("url", "UTF-8"))
    image = (
        F.when(F.col("page_id") % 4 == 0, encode_base64(png))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/img/"), F.lpad(F.col("page_id").cast("string"), 10, "0"), F.lit("?")))
        .when(F.col("page_id") % 4 == 2, F.lit("?A?"))
    )
    run = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("run"), (F.col("page_id") % 6).cast("string")))
    params = F.to_json(F.struct(image.alias("image"), F.col("url").alias("prompt"), run.alias("lora_run")))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("req_id"), F.lit("qwen3-vl").alias("model"), params.alias("params")
    )


def vision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image files that every second of those paths names."""
    png = F.concat(F.unhex(F.lit("FFD8FFE0")), F.encode("url", "UTF-8"))
    path = F.concat(F.lit("/img/"), F.lpad(F.col("page_id").cast("string"), 10, "0"), F.lit("?"))
    return table(spark, sf_dir, "pages").where(F.col("page_id") % 8 == 1).select(path.alias("path"), png.alias("content"))


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of bundles: one per document, several of a name in most bundles, none in some."""
    member = (
        F.when(F.col("doc_id") % 5 == 0, "config.json")
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("weights-"), F.col("doc_id").cast("string"), F.lit(".bin")))
        .when(F.col("doc_id") % 5 == 2, "README.md")
        .when(F.col("doc_id") % 5 == 3, "handler.py")
        .otherwise("notes.txt")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("name"),
        F.col("lang").alias("version"),
        F.concat_ws("/", "source", "lang").alias("path"),
        member.alias("member"),
        F.sha2("text", 256).alias("sha256"),
        F.col("doc_id").alias("seq"),
    )


def payload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts per page: text, JSON, base64 and one without a content type."""
    def part(content_type: str | None, data: Column) -> Column:
        return F.struct(F.lit(content_type).cast("string").alias("content_type"), data.alias("data"))

    parts = F.array(
        part("text/html", F.col("html")),
        part("application/json",
             F.concat(F.lit('{"page_id": '), F.col("page_id").cast("string"), F.lit("}"))),
        part("image/png", encode_base64(F.encode("url", "UTF-8"))),
        part(None, F.col("url")),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(parts).alias("part_no", "_part")
    ).select("page_id", "part_no", "_part.*")


def image_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image parameters in every accepted form, plus text that is no image."""
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("url", "UTF-8"))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE0")), F.encode("url", "UTF-8"))
    image = (
        F.when(F.col("page_id") % 4 == 0, encode_base64(png))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit(" data:image/png;base64,"), encode_base64(png)))
        .when(F.col("page_id") % 4 == 2, F.rtrim(encode_base64(jpeg), F.lit("=")))
        .when(F.col("page_id") % 8 == 3, encode_base64(F.encode("url", "UTF-8")))
        .otherwise(F.lit("?A?"))
    )
    return table(spark, sf_dir, "pages").select("page_id", image.alias("image"))


def index_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are in the index before the updates: one per customer."""
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        name.alias("name"),
        F.lit("base").alias("version"),
        F.concat(name, F.lit("/base")).alias("path"),
        F.sha2("c_name", 256).alias("sha256"),
        F.lit(-1).cast("bigint").alias("seq"),
    )


def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        name.alias("name"),
        F.col("event_type").alias("version"),
        F.concat(name, F.lit("/"), F.col("event_type")).alias("path"),
        F.sha2("props", 256).alias("sha256"),
        F.col("event_id").alias("seq"),
    )


STATUS_FIELDS = ["status", "started_at", "finished_at", "metric"]


def to_run_updates(events: DataFrame) -> DataFrame:
    """Status updates from events, batch or stream; fields an event does not carry are NULL."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "not_started")
        .when(kind.isin("view", "click"), "running")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "errored")
    )
    return events.select(
        F.col("user_id").alias("run_id"),
        "ts",
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(kind == "signup", F.col("ts")).alias("started_at"),
        F.when(kind.isin("purchase", "error"), F.col("ts")).alias("finished_at"),
        F.when(kind == "purchase", F.col("value")).alias("metric"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a nested tree: ``name`` and ``body``; each tenth one's name hides it."""
    hidden = F.when(F.col("doc_id") % 10 == 0, "_").otherwise("")
    name = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), hidden, F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.encode(body, "UTF-8").alias("body"))


def spoilt_updates(events: DataFrame) -> DataFrame:
    """The updates of :func:`to_run_updates`, some of them without a run, a time or a known status."""
    updates = to_run_updates(events)
    return updates.select(
        F.when(F.col("seq") % 7 != 0, F.col("run_id")).alias("run_id"),
        F.when(F.col("seq") % 11 != 0, F.col("ts")).alias("ts"),
        "seq",
        F.when(F.col("seq") % 13 == 0, F.lit("lost")).otherwise(F.col("status")).alias("status"),
        "started_at", "finished_at", "metric",
    )


def run_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_run_updates(table(spark, sf_dir, "events"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    ref = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), user, F.lit(":"), F.col("event_type")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("u"), user))
        .otherwise(F.concat(F.lit("x"), user, F.lit(":none")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), ref.alias("ref"))
