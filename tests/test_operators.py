"""Joins, scores, windows, listings, chat records and state folds on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from evalmill.session import session_conf, written
from evalmill.operators import chat, listing, lookups, ordered, scoring, state
from evalmill.operators.predict import batch_predict
from evalmill.plans import evaluation


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- running totals and caps ---------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 5, 21])
def test_running_totals_equal_a_plain_loop(spark, bits):
    rng = random.Random(bits)
    ids = rng.sample(range(-500, 500), 400) + [10**12, -(2**62), 2**62]
    data = [(None if i % 7 == 0 else "big" if i % 3 else "small", i, rng.randint(0, 3)) for i in ids]
    df = spark.createDataFrame(data, "run string, id long, step int")
    got = ordered.running_totals(df, ["run"], "id", {"total": F.col("step"), "seen": F.lit(1)}, bits)
    expected = []
    for run in (None, "big", "small"):
        mine = sorted((i, s) for r, i, s in data if r == run)
        total = 0
        for seen, (i, s) in enumerate(mine, 1):
            total += s
            expected.append((run, i, total, seen, seen == len(mine)))
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 25, 30])
def test_running_accuracy_points(spark, n):
    df = spark.createDataFrame(
        [("r", i, "A" if i % 3 else "B", "A") for i in range(n)],
        "run string, item_id long, pred string, gold string",
    )
    got = rows_of(scoring.running_accuracy(df, ["run"], "item_id"))
    expected, correct = [], 0
    for i in range(n):
        correct += bool(i % 3)
        if (i + 1) % 10 == 0 or i + 1 == n:
            expected.append(("r", i, correct, i + 1, 100.0 * correct / (i + 1)))
    assert got == expected


def test_head_n(spark):
    df = spark.createDataFrame([(i * 3, f"t{i}") for i in range(50)], "id long, t string").repartition(5)
    ids = lambda n, **kw: [r.id for r in ordered.head_n(df, "id", n, **kw).orderBy("id").collect()]  # noqa: E731,E501
    everything = [i * 3 for i in range(50)]
    assert ids(1) == [0]
    assert ids(7) == everything[:7]
    assert ids(50) == ids(99) == ids(0) == ids(None) == everything
    assert ids(-5, lenient=True) == everything
    with pytest.raises(ValueError):
        ordered.head_n(df, "id", -1)
    assert ordered.head_n(df.where("id < 0"), "id", 3).count() == 0
    holes = spark.createDataFrame([(None,), (1,), (2,), (3,)], "id long")
    assert sorted(r.id for r in ordered.head_n(holes, "id", 2).collect()) == [1, 2]


@pytest.mark.parametrize("bits", [1, 3, 21])
def test_nth_ids_from_range_counts(spark, bits):
    ids = [(i % 3 if i % 5 else None, i * i - 50) for i in range(60)]
    df = spark.createDataFrame(ids, "g int, id long")
    for n in (1, 4, 17, 40, 100):
        (want,) = [sorted(i for _, i in ids)[n - 1 : n]]
        assert [r._limit for r in ordered._nth_per_group(df, [], "id", n, bits).collect()] == want
        groups = {g: sorted(i for h, i in ids if h == g) for g in {g for g, _ in ids}}
        got = {r.g: r._limit for r in ordered._nth_per_group(df, ["g"], "id", n, bits).collect()}
        assert got == {g: v[n - 1] for g, v in groups.items() if len(v) >= n}


def test_no_shuffle_of_all_ids_for_a_cap(spark):
    """Every exchange below the cap holds counts by range, or the ids of one range."""
    df = spark.range(100_000, numPartitions=4)
    limits = ordered._nth_per_group(df, [], "id", 50_000, bits=10)
    limits.collect()
    written = [
        int(line.split("shuffle records written:")[1].split(",")[0].strip().replace(",", ""))
        for line in limits._jdf.queryExecution().executedPlan().toString().splitlines() if "shuffle records written:" in line
    ]
    assert all(n < 5_000 for n in written)
    assert "hashpartitioning(_range" in limits._jdf.queryExecution().executedPlan().toString() or not written


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i * 7 % 50, None if i == 3 else i) for i in range(50)], "k int, v int")
    rows = ordered.numbered_rows(df, [F.col("k").desc()], "n", lambda d: written(d, "numbered")).collect()
    assert [r.n for r in sorted(rows, key=lambda r: -r.k)] == list(range(50)) and rows[0].__fields__ == ["k", "v", "n"]
    assert ordered.numbered_rows(df.limit(0), [F.col("k")], "n", lambda d: written(d, "numbered")).count() == 0


def test_head_per_group(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in range(5)] + [("c", 7), ("a", None)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = rows_of(ordered.head_per_group(df, ["g"], "id", 3).select(F.coalesce("g", F.lit("-")), "id"))
    assert got == sorted([(g, i) for g in ("a", "b", "-") for i in range(3)] + [("c", 7)])
    assert ordered.head_per_group(df, ["g"], "id", None).count() == len(rows)
    with pytest.raises(ValueError):
        ordered.head_per_group(df, ["g"], "id", -1)


# --- lookups -------------------------------------------------------------------------


def skewed(spark):
    keys = ["hot"] * 300 + [None] * 200 + ["warm"] * 60 + [f"k{i}" for i in range(100)]
    return spark.createDataFrame(list(enumerate(keys)), "id int, k string").repartition(6)


def test_lookup_equals_a_plain_left_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame(
        [("hot", 1), ("warm", 2), ("k3", 3), ("absent", 4), (None, 5)], "k string, v int"
    )
    plain = rows_of(left.join(right, "k", "left").select("id", F.coalesce("k", F.lit("-")), F.coalesce("v", F.lit(0))))
    found = lookups.lookup(left, right, ["k"])
    assert found.columns == ["id", "k", "v"]
    assert rows_of(found.select("id", F.coalesce("k", F.lit("-")), F.coalesce("v", F.lit(0)))) == plain


def test_hot_keys_are_split(spark):
    wide = F.sha2(F.col("id").cast("string"), 512)
    key = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id")))
    left = spark.range(0, 60_000, 1, 16).select("id", key.alias("k"), wide.alias("body"))
    right = left.select("k").distinct().select("k", F.xxhash64("k").alias("v"))
    small = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "128k",
    }
    with session_conf(spark, **small):
        found = lookups.lookup(left, right, ["k"])
        assert found.where("v IS NOT NULL").count() == 60_000
        found.write.format("noop").mode("overwrite").save()
        rows = found.select("id", "v", "body")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()


def test_version_resolve_statuses_with_hot_references(spark):
    index = spark.createDataFrame(
        [("a", "1.0", "a/1", "x", 1), ("a", "0.9", "a/0", "y", 2), ("b:c", "1", "b", "z", 3)],
        "name string, version string, path string, sha256 string, seq long",
    )
    refs = ["a"] * 40 + ["a:1.0", "a:", "a:7", "b:c:1", "b:c", "nope", "nope:1", None]
    df = spark.createDataFrame(list(enumerate(refs)), "id int, ref string")
    rows = {r.id: r for r in lookups.version_resolve(df, index, "ref").collect()}
    assert len(rows) == len(refs)
    assert all((rows[i].version, rows[i].path, rows[i].status) == ("0.9", "a/0", "ok") for i in range(40))
    tail = [(rows[i].name, rows[i].version, rows[i].status) for i in range(40, len(refs))]
    assert tail == [
        ("a", "1.0", "ok"), ("a", "0.9", "ok"), ("a", "7", "unknown version"),
        ("b:c", "1", "ok"), ("b", "c", "unknown name"), ("nope", None, "unknown name"),
        ("nope", "1", "unknown name"), (None, None, "unknown name"),
    ]


def test_version_resolve_breaks_ties_by_version(spark):
    index = spark.createDataFrame(
        [("a", v, f"a/{v}", "x", 1) for v in ("1", "3", "2")], "name string, version string, path string, sha256 string, seq long"
    )
    df = spark.createDataFrame([(1, "a")], "id int, ref string")
    assert lookups.version_resolve(df, index, "ref").first().version == "3"
    assert state.index_latest(index).first().latest == "3"


def test_lookup_with_fallback(spark):
    primary = spark.createDataFrame([("a", "pa"), ("hot", "ph")], "k string, v string")
    fallback = spark.createDataFrame([("a", "fa"), ("k1", "fb")], "k string, v string")
    got = lookups.lookup_with_fallback(skewed(spark), primary, fallback, ["k"], "v", "base")
    counts = {(r.k, r.v, r.provenance): r["count"] for r in got.groupBy("k", "v", "provenance").count().collect()}
    assert counts[("hot", "ph", "primary")] == 300
    assert counts[("k1", "fb", "fallback")] == 1
    assert counts[("warm", "base", "default")] == 60
    assert counts[(None, "base", "default")] == 200
    only = lookups.lookup_with_fallback(skewed(spark), primary, None, ["k"], "v")
    assert only.where("v IS NULL").count() == 360
    holes = spark.createDataFrame([("a", None), ("hot", "ph")], "k string, v string")
    asked = spark.createDataFrame([(1, "a")], "id int, k string")
    assert tuple(lookups.lookup_with_fallback(asked, holes, fallback, ["k"], "v", "base").first()) == (1, "a", "fa", "fallback")


def test_aligned_join_reports_rows_without_partner(spark):
    preds = spark.createDataFrame([(1, "A"), (2, "B")], "item_id long, pred string")
    golds = spark.createDataFrame([(2, "B"), (3, "C")], "item_id long, gold string")
    assert rows_of(lookups.aligned_score_join(preds, golds, ["item_id"])) == [(2, "B", "B")]
    full = lookups.aligned_score_join(preds, golds, ["item_id"], "full")
    assert rows_of(full.select("item_id", "alignment")) == [
        (1, "no gold"), (2, "matched"), (3, "no prediction")
    ]
    with pytest.raises(ValueError):
        lookups.aligned_score_join(preds, golds, ["item_id"], "left")


def test_coverage(spark):
    sources = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    targets = spark.createDataFrame([("a",), ("a",), ("z",)], "name string")
    listed = lookups.coverage_listing(sources, targets, ["name"]).collect()
    assert [tuple(r) for r in listed] == [
        ("a", True, "built"), ("b", False, "not built yet"), ("c", False, "not built yet")
    ]
    assert rows_of(lookups.coverage_counts(sources, targets, ["name"])) == [(1, 2, 3)]


def test_required_members(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", None), ("z", "q")], "g string, m string")
    got = {r.g: (r.missing, r.ok) for r in lookups.required_set_check(df, ["g"], "m", ["b", "a"]).collect()}
    assert got == {"x": ([], True), "y": (["a", "b"], False), "z": (["a", "b"], False)}


# --- scores --------------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(
        rows,
        "item_id long, subject string, pred string, gold string, prompt string, raw string, "
        "response string, analysis string, at timestamp",
    )


@pytest.fixture
def some_scores(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    return scored(spark, [
        (i, f"s{i % 3}", "ABC?"[i % 4], None if i == 5 else "ABCD"[i % 2], "p" * 300, "r" * 300,
         "x" * (i * 20), "" if i % 2 else "why" * 50, start + dt.timedelta(seconds=i, milliseconds=50))
        for i in range(23)
    ])


def test_accuracies_agree(spark, some_scores):
    overall = scoring.overall_accuracy(some_scores).first()
    subjects = scoring.accuracy_by_subject(some_scores).collect()
    assert sum(r.correct for r in subjects) == overall.correct
    assert sum(r.total for r in subjects) == overall.total == 23
    rollup = scoring.accuracy_rollup(some_scores)
    assert rows_of(rollup.where("level = 0").drop("level")) == rows_of(scoring.accuracy_by_subject(some_scores))
    assert [tuple(r) for r in rollup.where("level = 1").drop("subject", "level").collect()] == [tuple(overall)]
    running = scoring.running_accuracy(some_scores.withColumn("run", F.lit("r")), ["run"], "item_id")
    last = running.orderBy(F.desc("seen")).first()
    assert (last.correct, last.seen) == (overall.correct, overall.total)


def test_scores_of_nothing(spark):
    empty = scored(spark, [])
    assert tuple(scoring.overall_accuracy(empty).first()) == (0, 0, 0.0)
    assert scoring.accuracy_by_subject(empty).count() == 0


def test_samples(spark, some_scores):
    rows = scoring.sample_records(some_scores, "item_id").collect()
    assert [r.item_id for r in sorted(rows, key=lambda r: r.item_id)] == list(range(10))
    by_id = {r.item_id: r for r in rows}
    assert len(by_id[9].prompt_end) == len(by_id[9].generated_raw) == 200
    assert len(by_id[9].response) == 100
    assert by_id[1].analysis is None and by_id[0].analysis == ("why" * 50)[:100]


def test_report(spark, some_scores):
    rows = scoring.eval_report(some_scores, "item_id", {"split": "test", "max_items": 23}, ts="at").collect()
    report = next(r for r in rows if r.section == "summary")
    overall = scoring.overall_accuracy(some_scores).first()
    assert (report.items, report.correct) == (23, overall.correct)
    assert report.accuracy == round(overall.accuracy, 4)
    assert {r.subject: (r.accuracy, r.items) for r in rows if r.section == "subject"} == {
        r.subject: (round(r.accuracy, 4), r.total) for r in scoring.accuracy_by_subject(some_scores).collect()
    }
    assert [s.item_id for s in report.samples] == list(range(10))
    assert report.elapsed_seconds == 22.0
    assert report.config.asDict() == {"split": "test", "max_items": 23}
    given = scoring.eval_report(some_scores, "item_id", {"split": "dev"}, elapsed=1.26).where("section = 'summary'").first()
    assert given.elapsed_seconds == 1.3


def test_report_of_many_subjects(spark, some_scores):
    many = spark.range(20_000).select(
        F.col("id").alias("item_id"), F.concat(F.lit("s"), F.col("id")).alias("subject"),
        F.lit("A").alias("pred"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("gold"),
        *[F.lit("x").alias(c) for c in ("prompt", "raw", "response", "analysis")],
    )
    report = scoring.eval_report(many, "item_id", {"split": "t"})
    assert report.where("section = 'subject'").count() == 20_000
    assert report.where("section = 'summary'").first().accuracy == 0.5


# --- listings, chat, predictor -------------------------------------------------------


def test_batch_plan(spark):
    df = spark.createDataFrame([("a",)] * 17 + [("b",)], "d string")
    plan = lambda **kw: rows_of(listing.batch_plan(df, ["d"], **kw))
    assert plan(epochs=1.0) == [("a", 17, 3), ("b", 1, 1)]
    assert plan(epochs=0.5) == [("a", 17, 2), ("b", 1, 1)]
    assert plan(epochs=None, steps=30) == plan(epochs=0.0, steps=30) == [("a", 17, 30), ("b", 1, 30)]
    assert plan(epochs=2.0, batch_size=0) == [("a", 17, 34), ("b", 1, 2)]
    assert listing.batch_plan(df.limit(0), ["d"], epochs=1.0).count() == 0


def test_member_listing(spark):
    df = spark.createDataFrame(
        [("g", i, f"m{i}", "A10G" if i == 1 else "" if i == 2 else None) for i in range(5)] + [("h", 0, "x", None)],
        "g string, at long, name string, gpu string",
    ).repartition(4)
    rows = listing.member_listing(df, ["g"], "at", listing.device_label(F.col("name"), F.col("gpu")))
    assert rows_of(rows)[1] == ("g", 1, "m1 (A10G)")
    assert rows_of(listing.listing_text(rows, ["g"])) == [
        ("g", 5, "m0 (CPU), m1 (A10G), m2 (CPU), m3 (CPU), m4 (CPU)"), ("h", 1, "x (CPU)"),
    ]
    large = spark.range(5_000).select(F.lit("g").alias("g"), "id")
    text = listing.listing_text(listing.member_listing(large, ["g"], "id", F.col("id").cast("string")), ["g"]).first()
    assert text.listing == ", ".join(str(i) for i in range(5_000))


def test_inject_level_into_arrays(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (0, array(named_struct('role','user','content','hi')), 'HIGH'), "
        "(1, array(named_struct('role','system','content','s')), 'low'), "
        "(2, array(named_struct('role','user','content','hi')), 'max') AS t(i, messages, level)"
    )
    rows = df.select("i", chat.inject_level(F.col("messages"), F.col("level")).alias("m")).orderBy("i").collect()
    assert [[tuple(m) for m in r.m] for r in rows] == [
        [("system", "Reasoning: high"), ("user", "hi")], [("system", "s")], [("user", "hi")]
    ]


def test_system_rows_need_a_known_level(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "system", "b")], "c long, t long, role string, text string")
    assert chat.system_message_inject(df, "c", "t", "role", "text", "max").count() == 2
    got = rows_of(chat.system_message_inject(df, "c", "t", "role", "text", "LOW"))
    assert got == [(1, -1, "system", "Reasoning: low"), (1, 0, "user", "a"), (2, 0, "system", "b")]


def test_conversation_record_shape(spark):
    df = spark.createDataFrame([(b"img", "x^2")], "image binary, text string")
    user, assistant = chat.conversation_record(df, "image", "text").first().messages
    assert [(p.type, p.text, p.image) for p in user.content] == [
        ("text", "Write the LaTeX representation for this image.", None), ("image", None, b"img")
    ]
    assert [(p.type, p.text, p.image) for p in assistant.content] == [("text", "x^2", None)]


def test_predictor_is_loaded_once_per_task_and_ids_stay_exact(spark):
    def load():
        import uuid

        return uuid.uuid4().hex

    def predict(model, batch):
        return [f"{model} {q}" if q is not None else None for q in batch["q"]]

    big = 2**60 + 1
    data = [(big + i, None if i % 2 else i, f"q{i}" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(data, "id long, n long, q string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = batch_predict(df, load, predict, ["q"], ["id", "n"], tasks=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.id, r.n) for r in rows} == {(a, b) for a, b, _ in data}
    assert len({r.raw.split()[0] for r in rows if r.raw}) <= 3
    assert sum(r.raw is None for r in rows) == 40


def test_evaluation_shows_the_predictor_no_gold(spark):
    def predict(model, batch):
        assert list(batch.columns) == ["item_id", "messages"]
        roles = {m["role"] for ms in batch["messages"] for m in ms}
        assert roles == {"system", "user"}
        return ["<|channel|>final<|message|>B<|end|>" for _ in range(len(batch))]

    items = spark.createDataFrame(
        [(1, "x", "q", 1, None), (2, None, "q", None, " b"), (3, "x", "q", 9, None)],
        "item_id long, subject string, prompt string, answer_idx int, answer_str string",
    )
    result = evaluation.evaluate(items, lambda: None, predict, max_items=None)
    assert rows_of(scoring.accuracy_by_subject(result)) == [("unknown", 1, 1, 1.0), ("x", 1, 2, 0.5)]
    capped = evaluation.evaluate(items, lambda: None, predict, max_items=2)
    assert capped.count() == 2


# --- state ---------------------------------------------------------------------------

UPDATES = "run_id string, ts timestamp, seq long, status string, note string"


def test_status_fold_keeps_last_known_values(spark):
    df = spark.sql(
        "SELECT * FROM VALUES "
        "('a', TIMESTAMP'2024-01-01 00:00:02', 5L, 'completed', CAST(NULL AS STRING)), "
        "('a', TIMESTAMP'2024-01-01 00:00:01', 9L, 'running', 'late'), "
        "('a', TIMESTAMP'2024-01-01 00:00:02', 4L, 'running', 'tie'), "
        "('a', TIMESTAMP'2024-01-01 00:00:03', 10L, NULL, NULL), "
        "('b', TIMESTAMP'2024-01-01 00:00:00', 1L, NULL, NULL), "
        "('b', TIMESTAMP'2024-01-01 00:00:00', 2L, 'exploded', 'bad'), "
        "(NULL, TIMESTAMP'2024-01-01 00:00:00', 3L, 'running', 'bad') "
        "AS t(run_id, ts, seq, status, note)"
    )
    rows = {r.run_id: r for r in state.run_status_fold(df, ["status", "note"]).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].status, rows["a"].note, rows["a"].updates) == ("completed", "tie", 4)
    assert rows["a"].updated_at.second == 3
    assert (rows["b"].status, rows["b"].note, rows["b"].updates) == (None, None, 1)
    good, bad = state.split_updates(df)
    assert (good.count(), bad.count()) == (5, 2)


def test_index_upsert_keeps_the_last_written(spark):
    schema = "name string, version string, path string, sha256 string, seq long"
    index = spark.createDataFrame([("a", "2.0", "p", "old", 1), ("b", "1.0", "p", "b", 2)], schema)
    updates = spark.createDataFrame([("a", "2.0", "q", "new", 3), ("a", "1.0", "q", "late", 4)], schema)
    merged = state.index_upsert(index, updates)
    assert rows_of(merged) == [
        ("a", "1.0", "q", "late", 4), ("a", "2.0", "q", "new", 3), ("b", "1.0", "p", "b", 2)
    ]
    assert rows_of(state.index_latest(merged)) == [("a", "1.0", 2), ("b", "1.0", 1)]
    assert rows_of(state.index_upsert(merged, updates)) == rows_of(merged)
    assert rows_of(state.index_with_latest(merged).select("name", "version", "latest")) == [
        ("a", "1.0", "1.0"), ("a", "2.0", "1.0"), ("b", "1.0", "1.0")
    ]


# --- whole runs ----------------------------------------------------------------------


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    def load():
        import os

        open(f"{tmp_path}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return 1

    df = spark.range(400).repartition(100)
    predict = lambda model, batch: ["x"] * len(batch)
    assert batch_predict(df, load, predict, ["id"], ["id"]).count() == 400
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 30


def test_benchmark_run_predicts_once(spark, tmp_path):
    def predict(model, batch):
        import os

        with open(f"{tmp_path}/{os.urandom(8).hex()}", "w") as out:
            out.write(str(len(batch)))
        return ["<|channel|>final<|message|>Answer: A<|return|>"] * len(batch)

    rows = [(i, f"s{i % 2}", f"q{i}", i % 4, "test" if i % 5 else "dev") for i in range(50)]
    splits = spark.createDataFrame(rows, "item_id long, subject string, prompt string, answer_idx int, split string")
    run = evaluation.benchmark_run(splits, '{"max_items": 30}', lambda: None, predict)
    reports = {name: df.collect() for name, df in evaluation.run_reports(*run).items()}
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 30
    assert [r.seen for r in sorted(reports["running"], key=lambda r: r.seen)] == [10, 20, 30]
    assert sum(r.total for r in reports["by_subject"]) == 30 and len(reports["samples"]) == 10
    assert run[1] == {"split": "test", "max_items": 30, "reasoning_level": "low"}
    with pytest.raises(ValueError, match="split"):
        evaluation.benchmark_run(splits, '{"split": "other"}', lambda: None, predict)
