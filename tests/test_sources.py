"""Scans, files, payloads, exports and the status stream, in a folder of their own."""

import base64
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from evalmill.operators.ordered import file_positions, zip_by_position
from evalmill.operators.state import index_upsert, run_status_fold, split_updates
from evalmill.plans import training, views
from evalmill.session import session_conf, shared_folder, shared_root
from evalmill.sources import datasets, files, payloads, stored_index
from evalmill.sources.commits import commit, content, names, remove
from evalmill.streaming.run_status import (
    read_rejects,
    read_status,
    run_status_stream,
    status_folders,
    stream_files,
)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_scan_formats_and_splits(spark, folder, fmt):
    df = spark.createDataFrame([(1, "x", "test"), (2, "y", "dev")], "id long, t string, split string")
    df.write.format(fmt).option("header", True).save(folder)
    options = {"schema": "id long, t string, split string"}
    if fmt == "csv":
        options["header"] = "true"
    got = datasets.dataset_scan(spark, folder, "dev", columns=["id", "t"], fmt=fmt, **options)
    assert rows_of(got) == [(2, "y")]
    assert datasets.dataset_scan(spark, folder, fmt=fmt, **options).count() == 2


def test_scan_prunes_partitions_and_columns(spark, folder):
    df = spark.createDataFrame([(i, "x" * i, "test" if i % 2 else "dev") for i in range(6)], "id long, t string, split string")
    df.write.partitionBy("split").parquet(folder)
    got = datasets.dataset_scan(spark, folder, "dev", columns=["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert rows_of(got) == [(0,), (2,), (4,)]


def test_materialise_once_and_again_after_a_broken_write(spark, folder):
    one = spark.range(10)
    # What an interrupted write left behind has no name yet.
    spark.range(7).write.parquet(f"{folder}/copy-lost")
    first = datasets.dataset_materialise(spark, "d", one, folder).first()
    assert first[:3] == (True, "d", 10) and first.cache_dir.startswith(f"{folder}/copy-")
    assert datasets.dataset_materialise(spark, "d", spark.range(3), folder).first() == first
    remove(spark, f"{folder}/current")
    assert datasets.dataset_materialise(spark, "d", spark.range(3), folder).first().num_examples == 3


def test_materialise_with_two_writers_and_a_reader_between(spark, folder):
    """The second writer starts before the first is done, and ends after a reader came."""
    seen = []

    def first_writer(rows):
        seen.append(datasets.dataset_materialise(spark, "d", spark.range(10), folder).first())
        return rows

    class Late:
        """A dataset whose write lets the other writer go first."""

        def __init__(self, df):
            self.df = df

        @property
        def write(self):
            return first_writer(self.df).write

    late = datasets.dataset_materialise(spark, "d", Late(spark.range(3)), folder).first()
    assert late == seen[0] and late.num_examples == 10
    assert len([n for n in names(spark, folder) if n.startswith("copy-")]) == 1
    assert spark.read.parquet(late.cache_dir).count() == 10


def test_uri_parts(spark):
    df = spark.createDataFrame([("hf:org/set",), ("/abs/set",), ("rel",), (None,)], "u string")
    rows = df.select(
        datasets.dataset_name(F.col("u")), datasets.dataset_dir(F.col("u"), "/root/data/"), datasets.is_hub_uri(F.col("u"))
    ).collect()
    assert [tuple(r) for r in rows][1:] == [
        ("/abs/set", "/abs/set", False), ("rel", "/root/data/rel", False), (None, None, None)
    ]
    assert rows[0][0] == "org/set" and rows[0][2] is True


def test_file_manifest_and_payloads(spark, tmp_path):
    big = bytes(range(256)) * 5000
    for name, content in (("a.bin", big), ("b.txt", b"text"), ("empty", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r.path: (r.sha256, r.length) for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {
        str(tmp_path / n): ("sha256:" + hashlib.sha256(c).hexdigest(), len(c))
        for n, c in (("a.bin", big), ("b.txt", b"text"), ("empty", b""))
    }
    path = str(tmp_path / "a.bin")
    params = spark.createDataFrame(
        [(i, "IMAGE", f" {path} ") for i in range(30)]
        + [(30, "prompt", path), (31, "file", "/none"), (32, "attachment", f"file:{path}"), (33, "file", None)],
        "id int, key string, value string",
    )
    out = files.file_payload_scan(params, files.read_files(spark, str(tmp_path)), "key", "value")
    assert out.columns == ["id", "key", "value", "from_file"]
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 34
    encoded = base64.b64encode(big).decode()
    assert all(rows[i].value == encoded and rows[i].from_file for i in [*range(30), 32])
    assert [(rows[i].value, rows[i].from_file) for i in (30, 31, 33)] == [
        (path, False), ("/none", False), (None, False)
    ]


def test_manifest_of_a_very_long_file(spark, tmp_path):
    with (tmp_path / "long").open("wb") as out:
        out.truncate(2**31 + 5)
    digest = hashlib.sha256()
    for _ in range(2**31 >> 24):
        digest.update(bytes(1 << 24))
    digest.update(bytes(5))
    row = files.file_manifest(spark, str(tmp_path)).first()
    assert (row.sha256, row.length, row.error) == ("sha256:" + digest.hexdigest(), 2**31 + 5, None)
    assert files.read_files(spark, str(tmp_path)).first().content is None


def test_payload_routing_and_writing(spark, folder):
    text, blob = "grüße\n", bytes(range(200))
    document = '{"b": [1, 2.50, "ü"], "a": {}}'
    df = spark.createDataFrame(
        [
            (1, ("text/plain", text, None)),
            (2, ("application/json", document, None)),
            (3, ("image/png", base64.b64encode(blob).decode(), None)),
            (4, (None, None, [("text/html", "<p>"), ("", "skipped"), (None, "skipped"), ("text/x", None),
                              ("application/json", "{broken"), ("image/png", "A")])),
            (5, (None, None, [])),
            (6, ("text/plain", None, None)),
        ],
        "id int, result struct<content_type: string, data: string, "
        "parts: array<struct<content_type: string, data: string>>>",
    )
    routed = payloads.payload_route(payloads.explode_parts(df, ["id"], "result"))
    written = payloads.payload_write(routed, folder)
    got = {(r.id, r.part_no): (r.kind, bytes(r.body) if r.body is not None else None, r.error) for r in written.collect()}
    assert got == {
        (1, 0): ("text", text.encode(), None),
        (2, 0): ("json", json.dumps(json.loads(document), indent=2).encode(), None),
        (3, 0): ("binary", blob, None),
        (4, 0): ("text", b"<p>", None),
        (4, 4): ("rejected", None, "bad json"),
        (4, 5): ("rejected", None, "bad binary"),
    }


def test_envelopes_without_parts_or_without_single(spark):
    single = spark.createDataFrame([(1, ("text/plain", "x"))], "id int, r struct<content_type: string, data: string>")
    assert rows_of(payloads.explode_parts(single, ["id"], "r")) == [(1, 0, "text/plain", "x")]
    many = spark.createDataFrame([(1, ([("a", "x"), ("b", "y")],))], "id int, r struct<parts: array<struct<content_type: string, data: string>>>")
    assert rows_of(payloads.explode_parts(many, ["id"], "r")) == [(1, 0, "a", "x"), (1, 1, "b", "y")]


def test_image_parameters_from_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"rest"
    (tmp_path / "i.png").write_bytes(png)
    (tmp_path / "no.txt").write_bytes(b"no image")
    params = [base64.b64encode(png).decode(), str(tmp_path / "i.png"), str(tmp_path / "no.txt"), "??", None]
    df = spark.createDataFrame(list(enumerate(params)), "id int, image string")
    for source in (None, files.read_files(spark, str(tmp_path))):
        rows = {r.id: r for r in payloads.image_payload_decode(df, "image", source).collect()}
        found = [bytes(rows[i].image_bytes) if rows[i].image_bytes else None for i in range(5)]
        assert found == [png, png if source is not None else None, None, None, None]
        assert [rows[i].error is None for i in range(5)] == [f is not None for f in found]
        assert [rows[i].image for i in range(5)] == params


def test_report_keeps_text_and_nulls(spark, folder):
    df = spark.sql("SELECT true AS ok, map('ä', 0.5D, 'b', 1D) AS m, CAST(NULL AS STRING) AS none, array(named_struct('a', 1)) AS samples")
    back = payloads.report_write(df, folder)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.first() == df.first()
    raw = spark.read.text(folder).first()[0]
    assert "ä" in raw and '"none":null' in raw


@pytest.mark.parametrize("compact", [False, True])
def test_training_export(spark, folder, compact):
    df = spark.createDataFrame(
        [(i, "007" if i % 3 else "b", b"img%d" % i, f"t{i}") for i in range(40)],
        "id long, source string, image binary, text string",
    )
    plan = training.training_export(df, "source", "id", "image", "text", folder, max_train_samples=12, epochs=2.0, compact=compact)
    assert rows_of(plan) == [("007", 12, 3), ("b", 12, 3)]
    row = spark.read.parquet(folder).where("id = 4").first()
    assert row.messages[0].content[1].image == b"img4" and row.messages[1].content[0].text == "t4"


# --- status stream -------------------------------------------------------------------


def events_in_parts(spark, folder, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(parts, "event_id").write.parquet(f"{folder}/events.parquet")
    return f"{folder}/events.parquet", events


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, folder):
    path, events = events_in_parts(spark, folder, 5)
    stream = lambda: views.to_run_updates(stream_files(spark, path, events.schema, 2))
    args = (views.STATUS_FIELDS, f"{folder}/table", f"{folder}/checkpoint")
    first = run_status_stream(stream(), *args)
    batch = run_status_fold(views.to_run_updates(events), views.STATUS_FIELDS)
    assert rows_of(first.select(batch.columns)) == rows_of(batch)

    late = events.withColumns({
        "event_id": F.col("event_id") + 10_000,
        "ts": F.expr("ts - INTERVAL 1 DAY"),
    })
    late.write.mode("append").parquet(path)
    both = run_status_fold(views.to_run_updates(events.unionByName(late)), views.STATUS_FIELDS)
    second = run_status_stream(stream(), *args)
    assert rows_of(second.select(both.columns)) == rows_of(both)
    assert rows_of(read_status(spark, f"{folder}/table", views.STATUS_FIELDS)) == rows_of(second)


def test_stream_leaves_session_settings_alone(spark, folder):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    path, events = events_in_parts(spark, folder, 1)
    run_status_stream(views.to_run_updates(stream_files(spark, path, events.schema)), views.STATUS_FIELDS, f"{folder}/t", f"{folder}/c")
    assert spark.conf.get(name) == before
    with session_conf(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_shared_folder_is_the_one_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_root(spark) == root
        assert shared_folder(spark, "x").startswith(f"{root}/evalmill-x-")


def test_status_stream_without_updates(spark, folder):
    schema = "run_id string, ts timestamp, seq long, status string, started_at timestamp, finished_at timestamp, metric double"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    updates = stream_files(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    got = run_status_stream(updates, views.STATUS_FIELDS, f"{folder}/table", f"{folder}/checkpoint")
    assert got.columns == ["run_id", *views.STATUS_FIELDS, "updated_at", "updates"] and got.count() == 0


def test_stream_rejects_are_those_of_the_batch_split(spark, folder):
    path, events = events_in_parts(spark, folder, 4)
    updates = views.spoilt_updates(stream_files(spark, path, events.schema, 1))
    records = run_status_stream(updates, views.STATUS_FIELDS, f"{folder}/t", f"{folder}/c", snapshot_every=3)
    whole = views.spoilt_updates(events)
    _, malformed = split_updates(whole)
    assert rows_of(read_rejects(spark, f"{folder}/t", updates.schema)) == rows_of(malformed) and malformed.count() > 0
    assert rows_of(records) == rows_of(run_status_fold(whole, views.STATUS_FIELDS).select(records.columns))


def test_status_table_stays_small_over_many_batches(spark, folder):
    path, events = events_in_parts(spark, folder, 50)
    args = (views.STATUS_FIELDS, f"{folder}/t", f"{folder}/c")
    stream = lambda: views.to_run_updates(stream_files(spark, path, events.schema, 1))
    with session_conf(spark, spark__sql__shuffle__partitions="1"):
        got = run_status_stream(stream(), *args)
    assert len([n for n in names(spark, f"{folder}/c/commits") if n.isdigit()]) >= 50
    assert len(status_folders(spark, f"{folder}/t")) <= 10
    assert len(names(spark, f"{folder}/t/changes")) <= 20 and len(names(spark, f"{folder}/t/snapshot")) == 2
    want = run_status_fold(views.to_run_updates(events), views.STATUS_FIELDS)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_batch_without_its_marker_is_ignored_and_written_again(spark, folder):
    path, events = events_in_parts(spark, folder, 3)
    table, fields = f"{folder}/t", views.STATUS_FIELDS
    stream = lambda: views.to_run_updates(stream_files(spark, path, events.schema, 1))
    whole = rows_of(run_status_stream(stream(), fields, table, f"{folder}/c"))
    # As if the writer had been lost between the rows and the marker of the last batch.
    remove(spark, f"{table}/commits/batch-2")
    remove(spark, f"{folder}/c/commits/2")
    assert len(status_folders(spark, table)) == 2 and rows_of(read_status(spark, table, fields)) != whole
    assert rows_of(run_status_stream(stream(), fields, table, f"{folder}/c")) == whole
    with pytest.raises(Exception, match="another checkpoint"):
        run_status_stream(stream(), fields, table, f"{folder}/other")


def test_the_first_commit_wins(spark, folder):
    assert names(spark, f"{folder}/none") == []
    assert commit(spark, f"{folder}/m/one", {"a": [1, "é"]}) and not commit(spark, f"{folder}/m/one", 2)
    assert content(spark, f"{folder}/m/one") == {"a": [1, "é"]} and names(spark, f"{folder}/m") == ["one"]


# --- stored index, sink, listing, zip --------------------------------------------------


def index_rows(rows):
    return [(f"n{n}", f"v{v}", f"p{n}", f"s{q}", q) for n, v, q in rows]


INDEX = "name string, version string, path string, sha256 string, seq long"


def test_stored_index_reads_and_writes_only_touched_buckets(spark, folder):
    base = spark.createDataFrame(index_rows((n, v, n + v) for n in range(40) for v in range(2)), INDEX)
    assert len(stored_index.upsert_stored(base, folder, buckets=8)) == 8
    update = spark.createDataFrame(index_rows([(3, 0, 900), (3, 7, 901), (3, 1, 0)]), INDEX)
    before = stored_index._state(spark, folder)[1]["folders"]
    touched = stored_index.upsert_stored(update, folder)
    after = stored_index._state(spark, folder)[1]["folders"]
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == [str(touched[0])]
    now = stored_index.read_stored(spark, folder, base.schema)
    assert rows_of(now) == rows_of(index_upsert(base, update))
    some = stored_index.read_stored(spark, folder, base.schema, only=["n3"])
    assert all(f"bucket={touched[0]}" in f for f in some.inputFiles())
    assert rows_of(some) == rows_of(now.where("name = 'n3'"))


def test_stored_index_loses_no_update_to_another_writer(spark, folder, monkeypatch):
    schema = spark.createDataFrame([], INDEX).schema
    update = lambda n: spark.createDataFrame(index_rows([(n, 0, n)]), INDEX)
    real, rivals = stored_index.commit, [7, 8]

    def late(*args):
        if rivals:
            n = rivals.pop()
            stored_index.upsert_stored(update(n), folder)
        return real(*args)

    monkeypatch.setattr(stored_index, "commit", late)
    stored_index.upsert_stored(update(1), folder, buckets=2)
    assert {r.name for r in stored_index.read_stored(spark, folder, schema).collect()} == {"n1", "n7", "n8"}
    assert stored_index.read_stored(spark, f"{folder}/none", schema).count() == 0


def test_stored_index_forgets_old_states(spark, folder):
    for n in range(8):
        stored_index.upsert_stored(spark.createDataFrame(index_rows([(1, 0, n)]), INDEX), folder, buckets=1)
    assert len(stored_index.stored_folders(spark, folder)) <= stored_index.KEPT_STATES + 1
    (row,) = stored_index.read_stored(spark, folder, spark.createDataFrame([], INDEX).schema).collect()
    assert row.seq == 7


def test_write_files_leaves_one_whole_file_when_repeated(spark, folder):
    rows = spark.createDataFrame([(1, "a/x.txt", b"one"), (2, "a/b/y", b""), (3, "z", None)], "id int, name string, body binary")
    for _ in range(2):
        saved = files.write_files(rows, folder, "name", "body")
    found = {r.id: (r.path, r.length, r.sha256) for r in saved.collect()}
    assert found == {
        1: (f"{folder}/a/x.txt", 3, hashlib.sha256(b"one").hexdigest()),
        2: (f"{folder}/a/b/y", 0, hashlib.sha256(b"").hexdigest()),
        3: (None, None, None),
    }
    from pathlib import Path

    assert sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file()) == ["a/b/y", "a/x.txt"]
    assert (Path(folder) / "a/x.txt").read_bytes() == b"one"


def test_listing_level_by_level(spark, folder, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(files, "LISTED", 2)
    made = ["1", "a/2", "a/3", "a/4", "a/b/c/5", "a/b/_no/6", "_no/7", "a/.no", "é ü/8"]
    for name in made:
        (Path(folder) / name).parent.mkdir(parents=True, exist_ok=True)
        (Path(folder) / name).write_text("x" * (len(name) - 1))
    (Path(folder) / "empty").mkdir()
    found = {r.path.removeprefix(f"{folder}/"): r.length for r in files.list_files(spark, folder).collect()}
    assert found == {n: len(n) - 1 for n in made if "no" not in n}
    assert rows_of(files.list_files(spark, [f"{folder}/1", f"{folder}/a/b"]).select("length")) == [(0,), (6,)]
    assert files.list_files(spark, f"{folder}/empty").count() == 0


def test_saved_parts_have_names_by_content_type(spark, folder):
    parts = [(1, 0, "text/plain", "é"), (1, 1, "application/json", '{"b":[1]}'), (1, 2, "x/unknown", "AAEC"), (2, 0, "application/json", "{")]
    routed = payloads.payload_route(spark.createDataFrame(parts, "id int, part_no int, content_type string, data string"))
    saved = {(r.id, r.part_no): r for r in payloads.payload_files(routed, folder, ["id"]).collect()}
    assert [saved[1, n].path for n in range(3)] == [f"{folder}/1/artifact-{x}" for x in ("0.txt", "1.json", "2")]
    assert open(saved[1, 1].path).read() == json.dumps({"b": [1]}, indent=2)
    assert open(saved[1, 2].path, "rb").read() == b"\x00\x01\x02"
    assert saved[2, 0].error == "bad json" and saved[2, 0].path is None


def test_zip_by_position(spark, folder):
    spark.range(100).selectExpr("id * 3 as l").repartitionByRange(4, "l").sortWithinPartitions("l").write.parquet(f"{folder}/l")
    spark.range(90).selectExpr("id * 7 as r").repartitionByRange(3, "r").sortWithinPartitions("r").write.parquet(f"{folder}/r")
    left, right = spark.read.parquet(f"{folder}/l"), spark.read.parquet(f"{folder}/r")
    got = zip_by_position(left, right).orderBy("position").collect()
    assert [(r.position, r.l, r.r) for r in got] == [(i, 3 * i, 7 * i if i < 90 else None) for i in range(100)]
    assert {r.alignment for r in got[90:]} == {"no right"} and {r.alignment for r in got[:90]} == {"matched"}
    plan = file_positions(left, "n")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [l" not in plan and "rangepartitioning" not in plan
