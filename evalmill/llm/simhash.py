"""SimHash near-duplicates by vantage-point trees, and groups of linked documents.

Fingerprints are partitioned by Hamming distance.  A tree of vantage points, built on the driver
from a bounded sample, cuts all fingerprints into shards: at a node, a fingerprint within the median
distance of the vantage point goes inside, another outside.  A pair within ``radius`` may be parted
there, but by the triangle inequality only if the inner one lies within ``radius`` of the border, so
that one is sent across as a visitor; a visitor is sent to every side that its ball can touch.  In a
shard the same rule goes on down a tree of its own until few fingerprints are left, which are
compared.  So every pair is found, and equal fingerprints are one before any of it.

A median of distances leaves uneven shards, and each level sends more visitors across.  So the tree
is at most ``DEPTH`` deep, and a shard of more than ``SHARD`` rows is cut into blocks by a hash; a
task gets two blocks (or one with itself), so it never holds more than about ``2 * SHARD`` rows, and
every pair of rows meets in some task.

Links leave a task as a forest (a tree per group), never as all pairs, and connected
components are found by alternating large-star and small-star steps, each written to the shared
folder.

``op3_simhash`` gives groups, ``drop_near_duplicates`` keeps one document of each; both take 64 bits
of three-word shingles and link at two bits, as the contract says.

Null and empty texts, and those without words, have fingerprint zero.  Null ids never become a
component's name unless all its ids are null.  Repeated rows share a fingerprint and so a component.
A very long text is hashed whole, in memory of some 100 bytes a word.  Ties of a border go inside.
An empty table gives an empty result.  Columns beside id and text play no part in the groups, and
``drop_near_duplicates`` keeps them all, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import BATCH_BYTES, over_batches, stored

#: Contract: words of a shingle, and bits that linked fingerprints may differ in.
WORDS, RADIUS = 3, 2
#: Fingerprints in a shard or block, levels of the shards' tree, fingerprints in a leaf of a shard's
#: own tree, and the sample that the shards' tree takes.
SHARD, DEPTH, LEAF, SAMPLE = 60_000, 8, 96, 16_384

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    if len(found) > words:
        starts, stops = starts[: len(found) - words + 1], stops[words - 1 :]
    else:
        starts, stops = starts[:1], stops[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(line[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts)
    )


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [majority_bits(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": np.array(found, np.uint64).view(np.int64)}

    schema = StructType([source.schema["doc_id"], *StructType.fromDDL("fp bigint")])
    return over_batches(source, work, schema, most=BATCH_BYTES)


# A tree is a nested tuple (vantage point, border, inside, outside); a leaf is its shard's number.


def _split(codes: np.ndarray, salt: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a border that part ``codes`` evenly, None if none of a few does at all."""
    best = None
    for attempt in range(4):
        point = codes[(salt * 7919 + attempt * 104729) % len(codes)]
        near = np.bitwise_count(codes ^ point)
        border = int(np.median(near))
        for edge in (border, border - 1):
            inside = int((near <= edge).sum())
            balance = min(inside, len(codes) - inside)
            # Fewer at the border means fewer visitors.
            crowd = int(((near >= edge - 1) & (near <= edge + 2)).sum())
            if balance and (best is None or crowd - balance < best[0]):
                best = (crowd - balance, point, edge)
    return best and best[1:]


def _top_tree(codes: np.ndarray, depth: int, next_leaf: list[int]):
    found = _split(codes, depth) if depth and len(codes) > 1 else None
    if found is None:
        next_leaf[0] += 1
        return next_leaf[0] - 1
    point, edge = found
    near = np.bitwise_count(codes ^ point)
    return (
        int(point), edge,
        _top_tree(codes[near <= edge], depth - 1, next_leaf),
        _top_tree(codes[near > edge], depth - 1, next_leaf),
    )


def _route(tree, codes: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places in ``codes``, whether at home there) for every shard that has any."""
    out = []

    def down(node, home: np.ndarray, visiting: np.ndarray) -> None:
        if not len(home) and not len(visiting):
            return
        if not isinstance(node, tuple):
            places = np.concatenate([home, visiting])
            out.append((node, places, np.arange(len(places)) < len(home)))
            return
        point, edge, inside, outside = node
        near, far = np.bitwise_count(codes[home] ^ np.uint64(point)), np.bitwise_count(codes[visiting] ^ np.uint64(point))
        near, far = near.astype(int), far.astype(int)
        down(inside, home[near <= edge], visiting[far <= edge + radius])
        crossing = home[(near <= edge) & (near > edge - radius)]
        down(outside, home[near > edge], np.concatenate([visiting[far > edge - radius], crossing]))

    down(tree, np.arange(len(codes)), np.zeros(0, np.int64))
    return out


def _leaf_links(codes: np.ndarray, members: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """Links (unlike bits, a, b) of a leaf: each of its parts meets each of its queries once at most."""
    out: list[tuple[int, int, int]] = []
    label = np.arange(len(members))
    queries = np.concatenate([members, visitors])
    block = max(1, (1 << 21) // len(members))
    for at in range(0, len(queries), block):
        near = np.bitwise_count(codes[queries[at : at + block]][:, None] ^ codes[members][None, :])
        rows, columns = np.nonzero(near <= radius)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for found, row in zip(np.split(columns, cuts), rows[np.concatenate([[0], cuts])] if len(rows) else []):
            place = at + int(row)
            if place < len(members):
                found = found[found < place]
            if not len(found):
                continue
            apart = near[row, found].astype(int)
            closest = np.argsort(apart, kind="stable")
            parts, first = np.unique(label[found[closest]], return_index=True)
            for i in closest[first].tolist():
                out.append((int(apart[i]), int(queries[place]), int(members[found[i]])))
            if place < len(members):
                label[np.isin(label, parts)] = label[place]
    return out


def _leaves(codes: np.ndarray, home: np.ndarray, radius: int):
    """(members, visitors) of every leaf of a shard's own tree."""
    stack = [(np.flatnonzero(home), np.flatnonzero(~home), 0)]
    while stack:
        members, visitors, depth = stack.pop()
        if not len(members):
            continue
        found = _split(codes[members], depth) if len(members) > LEAF else None
        if found is None:
            yield members, visitors
            continue
        point, edge = found
        near = np.bitwise_count(codes[members] ^ point).astype(int)
        far = np.bitwise_count(codes[visitors] ^ point).astype(int)
        crossing = members[(near <= edge) & (near > edge - radius)]
        stack.append((members[near <= edge], visitors[far <= edge + radius], depth + 1))
        stack.append((members[near > edge], np.concatenate([visitors[far > edge - radius], crossing]), depth + 1))


def shard_links(codes: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among a shard's fingerprints over their places: a forest of the closest pairs."""
    found_links: list[tuple[int, int, int]] = []
    for members, visitors in _leaves(codes, home, radius):
        found_links += _leaf_links(codes, members, visitors, radius)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    forest = []
    for _, x, y in sorted(found_links):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            forest.append((x, y))
    return forest


def dealt(codes: DataFrame, count: int, radius: int) -> DataFrame:
    """Rows (shard, i, j, code, home): which task (shard, i, j) gets which of ``codes`` (code).

    ``count`` is their number.
    """
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, count / SHARD)))))
    few = codes.orderBy(F.xxhash64("code")).limit(SAMPLE).select("code").toPandas()
    tree = _top_tree(np.unique(few["code"].to_numpy().view(np.uint64)), depth, [0])

    def route(batch: pa.RecordBatch) -> dict:
        codes = batch.column(0).to_numpy().view(np.uint64)
        parts = _route(tree, codes, radius)
        return {
            "shard": np.concatenate([np.full(len(p), s) for s, p, _ in parts]) if parts else [],
            "code": np.concatenate([codes[p] for _, p, _ in parts]).view(np.int64) if parts else [],
            "home": np.concatenate([h for _, _, h in parts]) if parts else [],
        }

    schema = StructType.fromDDL("shard int, code bigint, home boolean")
    routed = stored(over_batches(codes.select("code"), route, schema, rows=20_000), "routed")
    # At most 2**DEPTH rows.
    sizes = routed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = routed.join(F.broadcast(sizes), "shard").select("shard", "code", "home", own.alias("own"), other.alias("other"))
    return met.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "code", "home")


def vp_links(codes: DataFrame, count: int, radius: int) -> DataFrame:
    """Links (a, b) among ``codes`` (code), different fingerprints, within ``radius``.

    ``count`` is their number.
    """

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        codes = frame["code"].to_numpy()
        pairs = np.array(shard_links(codes.view(np.uint64), frame["home"].to_numpy(), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": codes[pairs[:, 0]], "b": codes[pairs[:, 1]]})

    tasks = dealt(codes, count, radius).groupBy("shard", "i", "j")
    return tasks.applyInPandas(link, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node linked to it, for every node of ``links`` (a, b)."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links"
    )
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, mark(edges)
    while now != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        edges = stored(small.where("u != v").distinct(), "small-star")
        before, now = now, mark(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(roots)


def grouped(marked: DataFrame, first: Column) -> DataFrame:
    """fp, root (its group's least fingerprint) and first, the least of ``first`` over the rows with
    it, for every fingerprint of ``marked``."""
    distinct = stored(marked.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    found = components(vp_links(distinct.select(F.col("fp").alias("code")), distinct.count(), RADIUS))
    named = distinct.join(found, distinct.fp == found.node, "left")
    return stored(named.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "named-fingerprints")


def op3_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    marked = stored(fingerprints(docs), "fingerprints")
    named = grouped(marked, F.col("doc_id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    component = named.join(least, "root").select("fp", "component_id")
    return marked.join(component, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id, then hash of row.

    Null ids come last; rows alike in id and text are one document.  Columns keep their names and
    order.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.xxhash64("doc_id", text).alias("key_a"), F.xxhash64(text, "doc_id", F.lit(1)).alias("key_b")]
    source = docs.select(*key, "doc_id", text.alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [majority_bits(shingle_hashes(t, WORDS)) for t in batch.column(3).to_pylist()]
        own = {n: batch.column(i) for i, n in enumerate(("key_a", "key_b", "doc_id"))}
        return own | {"fp": np.array(found, np.uint64).view(np.int64)}

    schema = StructType([*source.schema[:3], *StructType.fromDDL("fp bigint")])
    marked = stored(over_batches(source, work, schema, most=BATCH_BYTES), "fingerprints")
    named = grouped(marked, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b"))
    kept = stored(
        named.groupBy("root").agg(F.min("first").alias("first")).select("first.key_a", "first.key_b"), "kept-documents"
    )
    rows = docs.select(*key, F.struct(*columns).alias("row"))
    once = rows.join(kept.hint("shuffle_hash"), ["key_a", "key_b"], "left_semi")
    # Rows alike in id and text lie together already.
    copy = Window.partitionBy("key_a", "key_b").orderBy("key_a")
    return once.withColumn("copy", F.row_number().over(copy)).where("copy = 1").select("row.*")
