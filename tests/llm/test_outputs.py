"""Packing, token files and the pipeline: invariants, round trips, brute force."""

import json
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from evalmill.llm import packing, tokenout

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def naive_best_fit(lengths, capacities):
    """The same choice by trying every open bin."""
    bins, rest = [], sum(lengths)
    for length in lengths:
        rest -= length
        fitting = [b for b in bins if b[0] >= length]
        if fitting:
            chosen = min(fitting, key=lambda b: b[0])
            chosen[0] -= length
            chosen[1] += length
        else:
            capacity = packing.open_capacity(length, rest, capacities, packing.OVERHEAD)
            bins.append([capacity - length, length])
    return sorted(b[1] for b in bins)


def test_best_fit_against_all_bins():
    random.seed(4)
    for capacities in ((64,), (16, 32, 64), (10, 25, 100)):
        lengths = sorted((random.randint(1, capacities[-1]) for _ in range(400)), reverse=True)
        bins, capacity = packing.best_fit(np.array(lengths), capacities)
        filled = np.bincount(bins, lengths).astype(int)
        assert sorted(filled.tolist()) == naive_best_fit(lengths, capacities)
        for f, c in zip(filled, capacity):
            assert f <= c and all(f > other for other in capacities if other < c)


def check_bins(found, capacities=packing.CAPACITIES):
    bins = defaultdict(list)
    for r in found:
        bins[(r.group, r.bin)].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
        assert {(r.capacity, r.bin_tokens) for r in rows} == {(min(c for c in capacities if c >= at), at)}


def test_packing_holds_every_token_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.op5_best_fit_packing(docs).collect()
    check_bins(found)
    total = Counter()
    for r in found:
        total[r.doc_id] += r.n_tokens
        assert r.start == r.piece * packing.CAPACITIES[-1]
    assert total == {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    room = sum({(r.group, r.bin): r.capacity for r in found}.values())
    assert sum(total.values()) / room > 0.97


def test_packing_edges(odd, spark):
    found = packing.op5_best_fit_packing(odd).collect()
    check_bins(found)
    assert sum(r.n_tokens for r in found) == sum(len((r.text or "").encode()) + 1 for r in odd.collect())
    assert packing.op5_best_fit_packing(odd.limit(0)).collect() == []
    many = spark.range(500).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    grouped = packing.pack(many, packing.byte_length(), group_pieces=100).collect()
    assert len(grouped) == 500 and len({r.group for r in grouped}) > 2
    nothing = packing.pack(many, F.lit(None).cast("int")).collect()
    assert {r.n_tokens for r in nothing} == {1}


def test_encoder_equals_the_library(spark):
    random.seed(1)
    alphabet = "ab Z'stredvml1 2\n\t .,!é\xa0ñ\x85ºª½²_-"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(4_000)]
    texts += [None, "", "it's  we're 've '  's", "x\n's", "'", "漢字 it's", "a<|endoftext|>b", " \n ", "I'LL a'llama"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    library = Tokenizer.from_file(TOKENIZER)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for memo in (tokenout.MEMO, 500):
        encoder = tokenout.Encoder(TOKENIZER, memo)
        got = [x.tolist() for i in range(0, len(texts), 300) for x in encoder.encode(texts[i : i + 300])]
        assert got == want


@pytest.mark.parametrize("by", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70_000])
def test_file_round_trip(by, n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    doc_ids = [None, 5, -3, 2**40][: max(1, min(4, n))]
    counts = np.full(len(doc_ids), n // len(doc_ids))
    data = tokenout.pack_file(ids, doc_ids, counts, by, block=512)
    back, back_ids, back_counts = tokenout.unpack_file(data)
    assert (back == ids).all() and back_ids == doc_ids and back_counts.tolist() == counts.tolist()
    with pytest.raises(ValueError):
        tokenout.unpack_file(b"x" + data[1:])


def test_token_files(spark, small, odd):
    library = Tokenizer.from_file(TOKENIZER)
    for docs in (small, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        got = sorted(map(tuple, tokenout.op10_token_files(docs).collect()), key=lambda r: r[1])
        want, start = [], 0
        for doc_id, text in rows:
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert tokenout.op10_token_files(odd.limit(0)).collect() == []


def test_small_files_keep_the_order(spark, small, monkeypatch):
    one = sorted(tuple(r) for r in tokenout.op10_token_files(small).collect())
    monkeypatch.setattr(tokenout, "FILE_IDS", 3_000)
    assert sorted(tuple(r) for r in tokenout.op10_token_files(small).collect()) == one


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing",
    ]
    before = docs
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert before.dtypes == docs.dtypes
        ids.append({r.doc_id for r in before.select("doc_id").collect()})
    assert ids[1] == ids[0]  # every text of these is in a known language
    copies = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert ids[2] <= {r.doc_id for r in copies.collect()} and len(ids[2]) > 0.9 * copies.count()
    assert ids[3] < ids[2] and ids[4] == ids[3] and ids[5] == ids[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids[5]


def test_pipeline_of_odd_rows(spark, odd):
    """What each stage does with odd rows, judged on its own input."""
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, "/root/testdata/sf0.001")
        assert name == "best_fit_packing" or rows.columns == odd.columns
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0
        found[name] = rows.collect()
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in found.items()}
    every = Counter(r.doc_id for r in odd.collect())
    # Null, empty and letterless texts are in no language; the others are in one that was learned.
    assert not ids["language_id"].keys() & {2, 3, 4} and ids["language_id"][1] == 2
    assert {r.lang for r in found["language_id"]} <= {"en", "fr"}
    assert ids["near_dedup"] == Counter([1, 2, 4, None, 6, 7, 8])
    assert ids["decontamination"] == ids["secret_scan"] == every
    masked = {r.doc_id: r.text for r in found["secret_scan"]}
    assert "abcdefghijkl0123" not in masked[None] and "[REDACTED]" in masked[None]
    untouched = {r.doc_id: r.text for r in odd.collect()}
    assert all(masked[i] == untouched[i] for i in (2, 3, 4, 6, 7, 8, 9))
    assert ids["best_fit_packing"].keys() == every.keys()


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    numbers = {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_entry_without_the_package(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    code = (
        "import sys, json, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('evalmill.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(json.dumps(sorted(e.queries())))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout)
    assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
