"""Prefix trie of conversations: SQL ROLLUP over positional turn-id columns.

A turn's id is a digest of role and text.  A conversation's ids stand side by side in blocks of
``BLOCK`` positional columns, one row per block, keyed by the trie node that the block before it
ends in.  One ROLLUP over the key and the columns of all blocks aggregates all prefixes together;
``grouping_id`` tells how many columns a row of it holds, and with them the depth.  A node is named
by sums of hashes of its turns and their places, so that a block's key is the sum of the blocks
before it, whatever their number, and a row of the ROLLUP names its parent without a join.

The nodes a conversation is the smallest member of are the end of its path.  So a subtree's figures
are sums over its members: each brings what its own nodes hold from that depth on, and a leaf, if it
ends in one of its own.  These sums are a second ROLLUP over the same columns.

No task holds a conversation: its turns are sorted by ranges over the whole table and numbered from
counts, blocks hold ``BLOCK`` turns, and sums along a conversation go through ``running_totals``.
Members that end at a node are hashed in order piece by piece, so one popular node is a few rows of
packed ids.  Frequent turns combine before the shuffle.

Turns are ordered by number, null first; turns of one number by their role and text's digest, and
repeated rows are turns of their own.  Null roles and texts are empty.  Rows without a conv_id
belong to no conversation.  Conversations without turns are members of the root alone; an empty
table has no node at all.  Texts are whole and of any length.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalmill.llm.common import found_by_workers, stored
from evalmill.operators.ordered import numbered_rows, running_totals

#: Turns in a row of positional columns.
BLOCK = 8
#: Members of a node that are hashed as one piece.
PIECE = 8192
SLOTS = [f"t{i}" for i in range(1, BLOCK + 1)]
PARTS = ["a", "b", "c", "d"]
_LOW = (1 << 31) - 1


def _parts(turn: Column, depth: Column) -> list[Column]:
    """Four numbers of 31 bits for a turn at a depth, 0 for no turn; their sums name a sequence."""
    one, two = F.xxhash64(turn, depth), F.xxhash64(F.lit(7), depth, turn)
    halves = [F.shiftrightunsigned(one, 33), one.bitwiseAND(_LOW), F.shiftrightunsigned(two, 33), two.bitwiseAND(_LOW)]
    return [F.when(turn.isNotNull(), half).otherwise(F.lit(0)).cast("bigint") for half in halves]


def _names(block: Column, slot: Column, key: list[Column], full: list[Column], prefix: str = "") -> list[Column]:
    """Two columns that name the node of a block's first ``slot`` columns.

    ``key`` holds the sums before the block; ``full``, those behind it, name the node of a full one.
    """
    held = [F.when(slot > i, F.col(t)) for i, t in enumerate(SLOTS[:-1])]
    at = block * BLOCK + slot
    bounds = [F.when(slot == 0, k).otherwise(f) for k, f in zip(key, full)]
    inside = ~slot.isin(0, BLOCK)
    names = (
        F.when(inside, F.xxhash64(at, *key, *held)).otherwise(F.xxhash64(at, *bounds)),
        F.when(inside, F.xxhash64(*reversed(held), *key, at)).otherwise(F.xxhash64(*reversed(bounds), at)),
    )
    return [name.alias(f"{prefix}{x}") for name, x in zip(names, "uv")]


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, place, turn_id) and the conversations (conv_id, n), both stored.

    ``turn_id`` is half a SHA-256 of role and text, then the text's bytes as four more.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.concat(F.substring(digest, 1, 32), size)).alias("turn_id"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")]
    sorted_turns = numbered_rows(turns, order, "at", lambda df: stored(df, "turns"))
    convs = stored(sorted_turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")), "convs")
    placed = sorted_turns.join(convs, "conv_id").select(
        "conv_id", (F.col("at") - F.col("first")).alias("place"), "turn_id"
    )
    return stored(placed, "placed-turns"), convs.select("conv_id", "n")


def blocks_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (conv_id, block, key, sums, t1 to t8, length) of conversations (conv_id, length).

    ``key`` holds the sums of all turns before the block, ``a`` to ``d`` those of its own.
    """
    block, slot = F.floor(F.col("place") / BLOCK).cast("bigint"), F.col("place") % BLOCK
    own = turns.select(
        "conv_id", block.alias("block"), slot.alias("slot"), "turn_id", "length",
        *[p.alias(n) for p, n in zip(_parts(F.col("turn_id"), F.col("place")), PARTS)],
    )
    rows = own.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("turn_id"))).alias(t) for i, t in enumerate(SLOTS)],
        F.max("length").alias("length"),
        *[F.sum(p).alias(p) for p in PARTS],
    )
    rows = stored(rows, "blocks")
    none = [F.lit(None).cast("binary").alias(t) for t in SLOTS]
    turnless = lengths.where("length = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), *none, "length", *[F.lit(0).cast("bigint").alias(p) for p in PARTS]
    )
    start = F.struct("block", *[F.lit(0).cast("bigint").alias(p) for p in PARTS]).alias("key")
    short = rows.where(F.col("length") <= BLOCK).unionByName(turnless).select("*", start)
    long = rows.where(F.col("length") > BLOCK)
    until = running_totals(long, ["conv_id"], "block", {f"until_{p}": F.col(p) for p in PARTS}).drop("is_last")
    before = F.struct("block", *[(F.col(f"until_{p}") - F.col(p)).alias(p) for p in PARTS]).alias("key")
    long = long.join(until, ["conv_id", "block"]).select(*rows.columns, before)
    return stored(short.unionByName(long), "keyed-blocks")


def prefixes(blocks: DataFrame, *figures: Column) -> DataFrame:
    """One row per node of the trie: u and v (its name), pu and pv (its parent's), depth, the text
    bytes of its last turn, ``slot`` (its columns in the block) and the figures over its members."""
    behind = [F.max(F.col(f"key.{p}") + F.col(p)).alias(f"full_{p}") for p in PARTS]
    rolled = blocks.rollup("key", *SLOTS).agg(F.grouping_id().alias("open"), *behind, *figures)
    # Of the columns, the last log2(open + 1) are rolled up; open has one more bit for the key.
    held = F.lit(BLOCK) - F.length(F.regexp_replace(F.bin("open"), "0", ""))
    last = F.element_at(F.array(*SLOTS), F.greatest(F.col("slot"), F.lit(1)))
    nodes = rolled.where(F.col("open") < 1 << BLOCK).withColumn("slot", held).withColumn("last", last)
    # A row that ends in a missing turn repeats the one above it; one without turns is the root,
    # or repeats the end of the block before.
    nodes = nodes.where(F.when(F.col("slot") == 0, F.col("key.block") == 0).otherwise(F.col("last").isNotNull()))
    block, slot = F.col("key.block"), F.col("slot")
    key, full = [F.col(f"key.{p}") for p in PARTS], [F.col(f"full_{p}") for p in PARTS]
    # The members of a row of all columns share a full block, so any one's sums are the row's.
    bytes_ = F.conv(F.hex(F.substring("last", 17, 4)), 16, 10).cast("bigint")
    inner = [f for f in rolled.columns if f not in ("key", *SLOTS, "open", *[f"full_{p}" for p in PARTS])]
    return nodes.select(
        *_names(block, slot, key, full),
        *[F.when(slot > 0, n).alias(a) for n, a in zip(_names(block, slot - 1, key, full), ("pu", "pv"))],
        (block * BLOCK + slot).alias("depth"),
        F.when(slot > 0, bytes_).otherwise(F.lit(0)).alias("last_bytes"),
        "slot",
        *inner,
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """u, v and ends_sha256 of nodes (u, v, conv_id): SHA-256 of the ids, ascending, comma-joined."""
    pieces = StructType.fromDDL("u bigint, v bigint, first bigint, ids string")
    digests = StructType.fromDDL("u bigint, v bigint, ends_sha256 string")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        rows: list[tuple] = []
        for batch in batches:
            for u, v, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if (u, v) != node or len(ids) == PIECE:
                    if ids:
                        rows.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (u, v), []
                ids.append(conv_id)
            yield _as_batch(rows, pieces)
            rows = []
        yield _as_batch([(*node, ids[0], ",".join(map(str, ids)))] if ids else [], pieces)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for u, v, ids in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "ids"))):
                if (u, v) != node:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (u, v), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _as_batch(rows, digests)
        yield _as_batch([(*node, digest.hexdigest())] if node else [], digests)

    found_by_workers(ends.sparkSession)
    order = ["u", "v", "conv_id"]
    spread = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    few = spread.mapInArrow(packed, pieces)
    return few.repartition("u", "v").sortWithinPartitions("u", "v", "first").mapInArrow(hashed, digests)


def _as_batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations: ``turns`` (conv_id, place, turn_id, length), ``lengths`` (conv_id,
    length, also of those without turns).

    One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    blocks = blocks_of(turns, lengths)
    nodes = prefixes(blocks, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(
        F.count("*").alias("n_children")
    )
    nodes = nodes.join(children, ["u", "v"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = stored(nodes, "nodes-with-children")

    saved, leaf = (F.col("n_convs") - 1) * F.col("last_bytes"), (F.col("n_children") == 0).cast("bigint")
    # What a conversation brings in each block: of its own nodes, and whether it ends in a leaf of its own.
    own = nodes.where((saved > 0) | (leaf > 0)).groupBy(
        "conv_id", F.greatest(F.floor((F.col("depth") - 1) / BLOCK), F.lit(0)).cast("bigint").alias("block")
    ).agg(
        *[F.sum(F.when(F.col("slot") == i + 1, saved).otherwise(F.lit(0))).alias(f"s{i + 1}") for i in range(BLOCK)],
        F.sum(saved).alias("rest"), F.sum(leaf).alias("leaf"),
    )
    figures = [*[f"s{i + 1}" for i in range(BLOCK)], "rest", "leaf"]
    brought = blocks.select("conv_id", "block", "key", *SLOTS, "length", *PARTS).join(own, ["conv_id", "block"], "left")
    brought = stored(brought.na.fill(0, figures), "brought")
    short, long = brought.where(F.col("length") <= BLOCK), brought.where(F.col("length") > BLOCK)
    # From the last block back: everything from this block on.
    onward = running_totals(
        long.withColumn("from_end", -F.col("block")), ["conv_id"], "from_end",
        {"rest_on": F.col("rest"), "leaf_on": F.col("leaf")},
    ).drop("is_last")
    onward = onward.select("conv_id", (-F.col("from_end")).alias("block"), "rest_on", "leaf_on")
    long = long.join(onward, ["conv_id", "block"]).withColumn("rest", F.col("rest_on")).withColumn("leaf", F.col("leaf_on"))
    brought = short.unionByName(long.select(*short.columns)).where("rest > 0 or leaf > 0")
    from_slot = [F.col("rest")]
    for i in range(1, BLOCK):
        from_slot.append(from_slot[-1] - F.col(f"s{i}"))
    sums = prefixes(brought, *[F.sum(x).alias(f"from{i + 1}") for i, x in enumerate(from_slot)], F.sum("leaf").alias("n_leaves"))
    here = F.element_at(F.array(*[f"from{i + 1}" for i in range(BLOCK)]), F.greatest(F.col("slot"), F.lit(1)))
    sums = sums.select("u", "v", "n_leaves", here.alias("saved_tokens"))

    full = [F.col(f"key.{p}") + F.col(p) for p in PARTS]
    own_slot = F.col("length") - F.col("block") * BLOCK
    last_names = _names(F.col("block"), own_slot, [F.col(f"key.{p}") for p in PARTS], full)
    ends = end_digests(blocks.where(F.col("length") <= (F.col("block") + 1) * BLOCK).select(*last_names, "conv_id"))

    parents = nodes.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, ["u", "v"]).join(ends, ["u", "v"], "left").join(parents, ["pu", "pv"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see :func:`prefix_trie`."""
    turns, convs = numbered_turns(conversations)
    lengths = convs.withColumnRenamed("n", "length")
    return prefix_trie(turns.join(lengths, "conv_id"), lengths)


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilding: the first h turns of conversation c - c % 5, then c's own after h.

    ``turns`` (conv_id, place, turn_id) and ``convs`` (conv_id, n) as numbered; returns ``turns``
    with their length and ``lengths``, as :func:`prefix_trie` takes them.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    planned = convs.select("conv_id", "n", head.alias("head"), base.alias("base"))
    bases = convs.where(F.pmod("conv_id", F.lit(5)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    planned = planned.join(bases, "base", "left").withColumn(
        "taken", F.least("head", F.coalesce("base_n", F.lit(0).cast("bigint")))
    )
    planned = planned.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    planned = stored(planned.select("conv_id", "head", "taken", "length"), "planned")
    own = turns.join(planned, "conv_id").where("place >= head").select(
        "conv_id", (F.col("taken") + F.col("place") - F.col("head")).alias("place"), "turn_id", "length"
    )
    heads = turns.where((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("place") < 8))
    heads = heads.select(
        F.explode(F.array(*[F.col("conv_id") + k for k in range(5)])).alias("conv_id"), "place", "turn_id"
    )
    heads = heads.join(planned, "conv_id").where("place < head").select("conv_id", "place", "turn_id", "length")
    return own.unionByName(heads), planned.select("conv_id", "length")


def op13_conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(*numbered_turns(conversations)))


ORACLE = """
WITH turns AS (
    SELECT conv_id, list(struct_pack(id := md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')),
                                     size := octet_length(encode(coalesce(text, '')))) ORDER BY turn NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
    -- CRC-32 of the decimal id, bit by bit.
    SELECT conv_id, own, conv_id - conv_id % 5 AS base,
        xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, c: list_reduce(
                list_prepend(xor(crc, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                lambda a, b: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)))
        ), CAST(4294967295 AS BIGINT)) % 9 AS h
    FROM turns
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), coalesce(list_slice(c.own, c.h + 1, len(c.own)), [])) AS path
    FROM headed c LEFT JOIN turns b ON b.conv_id = c.base
), prefixes AS (
    SELECT conv_id, len(path) AS n, d AS depth, list_slice(path, 1, d) AS path
    FROM rebuilt, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
    FROM prefixes GROUP BY path, depth
), families AS (
    SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
    SELECT n.*, coalesce(f.n_children, 0) AS n_children,
        CASE WHEN depth > 0 THEN (n_convs - 1) * n.path[depth].size ELSE 0 END AS saved
    FROM nodes n LEFT JOIN families f ON f.path = n.path
), subtrees AS (
    SELECT list_slice(path, 1, d) AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM counted, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY 1
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN subtrees s ON s.path = c.path
LEFT JOIN nodes p ON c.depth > 0 AND p.path = list_slice(c.path, 1, c.depth - 1)
"""
