"""Exact repeated passages by prefix-free parsing: strings of 200 bytes that also start elsewhere.

Parse.  A rolling hash over ``GRAM`` bytes runs along every text.  A position is a trigger if its
hash is the smallest of the grams of some 200-byte string, so every string holds at least one, and
equal strings the same one at the same place.  Triggers cut a text into phrases; a phrase reaches
over the next trigger's gram, and no phrase is a prefix of another's end, as the parse needs.

Order.  Two strings are neighbours in the corpus's suffix order with 200 common bytes exactly if
they are equal from the end of the first one's phrase on and before it.  So the order is kept as
classes of equal rank, from coarse to fine, instead of one array of all suffixes:

1. the dictionary of triggers, with how often each occurs; what occurs once can't be repeated;
2. the parse around an occurrence, as far as its strings reach (its context): where a whole context
   occurs twice, all strings of the occurrence are repeated, and one of them stands for the rest;
3. the strings of the other occurrences, one by one, against those of the contexts of step 2 that
   share their trigger.

Highly repetitive text ends at step 2, where a context counts once however many copies it has.
Hashes have 64 bits; polynomial ones over random values of the bytes.

Texts are whole and taken as UTF-8; a null text is empty.  Strings never cross documents.  Rows
alike in id and text are copies of each other.  Tables without a repeated string give every text
back whole.  A trigger, context or string that a third of all texts share is one row per task before
the shuffle, and the joins that lead back to the texts can be split by AQE.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import over_batches, stored

#: Length of the repeated strings, and of the grams that the rolling hash covers.
LENGTH, GRAM = 200, 128
#: Bytes of a text whose triggers are found at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    name = str(base)
    if name not in _tables or len(_tables[name]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _tables[name] = np.cumprod(table)
    return _tables[name]


class Rolling:
    """Hashes of any substring of some bytes, by prefix sums."""

    def __init__(self, data: bytes):
        if "bytes" not in _tables:
            _tables["bytes"] = np.random.default_rng(200).integers(0, 1 << 64, 256, dtype=np.uint64)
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        values = _tables["bytes"][np.frombuffer(data, np.uint8)]
        np.cumsum(values * _powers(_BASE, n + 1)[:n], out=self.sums[1:])
        self.down = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)])
    tiles = padded.reshape(-1, width)
    forward = np.minimum.accumulate(tiles, axis=1).ravel()
    backward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def triggers(rolling: Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Position, hash, and first and last start of the strings that it stands for, of each trigger."""
    n = len(rolling.sums) - 1
    width = length - gram + 1
    place_bits = np.uint64((CHUNK + length).bit_length())
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    found = []
    for at in range(0, max(n - length + 1, 0), CHUNK):
        start = np.arange(at, min(at + CHUNK + length - 1, n) - gram + 1)
        marks = _mixed(rolling.between(start, start + gram))
        # The leftmost of the smallest: the place stands in the low bits.
        least = _sliding_min((marks & ~low) | (start - at).astype(np.uint64), width) & low
        owner = least.astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(owner)]]) - 1
        found.append((owner[first] + at, marks[owner[first]], first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(column) for column in zip(*found))


def contexts(rolling: Rolling, first: np.ndarray, last: np.ndarray, position: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hash of all bytes that the strings of a trigger cover, with where they lie around it."""
    shape = (position - first) * (2 * length) + (last - first)
    return _mixed(rolling.between(first, last + length) + shape.astype(np.uint64) * np.uint64(_BASE))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.col("text").cast("string").alias("text")
    )


def parse(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per trigger of ``docs`` (row, text): row, trigger, context, place, first, last."""

    def work(batch: pa.RecordBatch) -> dict:
        parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = _bytes(text)
            if len(data) < length:
                continue
            rolling = Rolling(data)
            position, mark, first, last = triggers(rolling, length, gram)
            around = contexts(rolling, first, last, position, length)
            found = (np.full(len(position), row), mark.view(np.int64), around.view(np.int64), position, first, last)
            for part, values in zip(parts, found):
                part.append(values)
        names = ("row", "trigger", "context", "place", "first", "last")
        return {n: np.concatenate(p) if p else [] for n, p in zip(names, parts)}

    schema = StructType.fromDDL("row bigint, trigger bigint, context bigint, place int, first int, last int")
    return over_batches(docs.select("row", "text"), work, schema, rows=128)


def dictionary(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """trigger and n, how often it occurs in ``docs`` (text)."""

    def work(batch: pa.RecordBatch) -> dict:
        marks = [triggers(Rolling(d), length, gram)[1] for d in map(_bytes, batch.column(0).to_pylist()) if len(d) >= length]
        mark, count = np.unique(np.concatenate(marks), return_counts=True) if marks else ([], [])
        return {"trigger": np.asarray(mark, np.uint64).view(np.int64), "n": count}

    found = over_batches(docs.select("text"), work, StructType.fromDDL("trigger bigint, n bigint"))
    return found.groupBy("trigger").agg(F.sum("n").alias("n"))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each row of ``docs`` (row, text) with any: row, and the runs of starts of repeated strings.

    A run is (first, last, mark): all strings that start there; ``mark`` is a hash of what they
    cover, by which a reader can tell a row's own runs.
    """
    # The texts are read again for the parse: that is less than to keep all triggers until then.
    repeated = stored(dictionary(docs, length, gram).where("n > 1").select("trigger"), "dictionary")
    # A join on a set of hashes: building its side is cheaper than sorting all triggers.
    several = stored(parse(docs, length, gram).join(repeated.hint("shuffle_hash"), "trigger"), "parse")
    one = F.struct("row", "place", "first", "last")
    classes = stored(
        several.groupBy("context", "trigger").agg(F.count("*").alias("n"), F.min(one).alias("one")), "contexts"
    )
    alone = classes.where("n = 1").select("trigger").distinct()
    open_classes = classes.join(alone.hint("shuffle_hash"), "trigger").select("one.*")
    runs = F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")
    to_compare = docs.select("row", "text").join(open_classes.groupBy("row").agg(runs), "row")

    def strings(batch: pa.RecordBatch) -> dict:
        parts: list[list[np.ndarray]] = [[], [], []]
        for row, text, own in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "runs"))):
            rolling = Rolling(_bytes(text))
            n = len(rolling.sums) - 1
            start = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in own])
            start = start[start <= n - length]
            parts[0].append(np.full(len(start), row))
            parts[1].append(start)
            parts[2].append(rolling.between(start, start + length).view(np.int64))
        return {n: np.concatenate(p) if p else [] for n, p in zip(("row", "start", "string"), parts)}

    schema = StructType.fromDDL("row bigint, start int, string bigint")
    compared = stored(over_batches(to_compare.select("row", "text", "runs"), strings, schema, rows=128), "strings")
    equal = compared.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    equal = stored(equal, "repeated-strings")
    single = compared.join(equal.hint("shuffle_hash"), "string").select(
        "row", F.col("start").alias("first"), F.col("start").alias("last"), F.col("string").alias("mark")
    )
    single = stored(single, "single-runs")
    copied = classes.where("n > 1").select("context", "trigger")
    whole = several.join(copied.hint("shuffle_hash"), ["context", "trigger"]).select(
        "row", "first", "last", F.col("context").alias("mark")
    )
    found = F.array_sort(F.collect_set(F.struct("first", "last", "mark"))).alias("runs")
    return stored(whole.union(single).groupBy("row").agg(found), "repeated-runs")


def covered(data: bytes, runs: list[dict], length: int = LENGTH) -> np.ndarray:
    """Which bytes the strings of some runs cover."""
    change = np.zeros(len(data) + 1, np.int64)
    first = np.array([r["first"] for r in runs], np.int64)
    last = np.array([r["last"] for r in runs], np.int64)
    fits = last + length <= len(data)
    np.add.at(change, first[fits], 1)
    np.add.at(change, last[fits] + length, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every removed run) and kept, the bytes that stay."""
    keyed = _keyed(docs)
    runs = repeated_strings(keyed, length, gram)
    joined = keyed.join(runs, "row", "left").select("doc_id", "text", "runs")

    def cut(batch: pa.RecordBatch) -> dict:
        sizes, spans, kept = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            data = _bytes(text)
            sizes.append(len(data))
            gone = covered(data, own or [], length)
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edge) else data)
        return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "spans": spans, "kept": kept}

    added = StructType.fromDDL("n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return over_batches(joined, cut, StructType([docs.schema["doc_id"], *added]), rows=128)


def op8_suffix_dedup(docs: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
