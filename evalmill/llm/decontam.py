"""Benchmark decontamination: containment of short test items in long documents.

Items are sets of five-word shingles; an item counts as leaked into a document that holds at least
``containment`` of its shingles.  Items are partitioned by size.  A partition's items share the
length of their MinHash sketch, the bottom k of the shingles with k = n - ceil(c * n) + 1 for
the largest n of the partition, never more than a given item needs: a document with that containment
misses at most n - ceil(c * n) shingles, so it holds one of any k of them, and the search loses
nothing.  The order that makes a bottom is how many documents hold a shingle, then its hash, so that
a passage everybody shares is in the sketch of no item that has others.  The sketch's shingles are
looked for in the documents, whatever the documents' length, and only the documents found meet all
shingles of the item, which are counted exactly, as text.

Documents are scanned once.  A bitmap of fixed size holds the hashes of all items' shingles; it is
all that is sent to the tasks.  What passes it is joined with the items' shingles by text, so an
item set of any size works; a larger one only lets more pass by chance.

Words are runs of letters and digits in lower case, so punctuation, spacing and case don't matter.
Null texts and texts or items of fewer than five words have no shingle and match nothing.  A shingle
that repeats counts once.  Repeated rows of documents are each reported; equal items under several
ids are each reported, items alike in id and text once, null item ids as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import over_batches, stored

WORDS, CONTAINMENT = 5, 0.8
#: Bits of the bitmap, 8 MB: a 32nd of its bits is set by two million shingles.
BITMAP_BITS = 1 << 26
#: Rows of items that a task turns into bitmap places at a time.
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_alnum: np.ndarray | None = None
_powers: np.ndarray | None = None


def _word_signs() -> np.ndarray:
    """For every code point, whether it belongs to a word; built once in a process."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _alnum


def _power_table(n: int) -> np.ndarray:
    global _powers
    if _powers is None or len(_powers) < n:
        table = np.full(max(n, 1 << 12), _P, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table)
    return _powers


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """All shingles of some texts: row, hash, and start and end in the joined lower-case texts."""
    lower = [(t or "").lower() for t in texts]
    joined = "\n".join(lower)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if not len(points):
        return none, none.astype(np.uint64), none, none, joined
    inside = _word_signs()[np.minimum(points, 0x10FFFF)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin) < words:
        return none, none.astype(np.uint64), none, none, joined
    # A word's hash is a polynomial of its signs, a shingle's one of its words' hashes.
    sizes = end - begin
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    signs = points[inside].astype(np.uint64) + np.uint64(1)
    table = _power_table(int(sizes.max()) + 1)
    word = np.add.reduceat(signs * table[place], np.cumsum(sizes) - sizes)
    word = (word ^ (word >> np.uint64(29))) * np.uint64(_Q)
    count = len(begin) - words + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(words):
        mixed = mixed * np.uint64(_P) + word[k : k + count]
    mixed ^= mixed >> np.uint64(32)
    stops = np.cumsum([len(t) + 1 for t in lower])
    row = np.searchsorted(stops, begin, side="right")
    whole = row[:count] == row[words - 1 :]
    at = np.flatnonzero(whole)
    return row[at], mixed[at], begin[at], end[at + words - 1], joined


def _shingle_text(joined: str, begin: int, end: int) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in joined[begin:end]).split())


def item_shingles(items: DataFrame, words: int = WORDS) -> DataFrame:
    """item_id, item (a hash of id and text), shingle, place (its bitmap hash): distinct per item."""
    source = items.select(
        F.col("item_id"), F.xxhash64("item_id", "text").alias("item"), F.col("text").cast("string").alias("text")
    ).distinct()

    def work(batch: pa.RecordBatch) -> dict:
        row, mixed, begin, end, joined = shingles(batch.column(2).to_pylist(), words)
        return {
            "item_id": batch.column(0).take(pa.array(row)),
            "item": batch.column(1).take(pa.array(row)),
            "shingle": [_shingle_text(joined, a, b) for a, b in zip(begin.tolist(), end.tolist())],
            "place": mixed.view(np.int64),
        }

    schema = StructType(
        [source.schema["item_id"], *StructType.fromDDL("item bigint, shingle string, place bigint")]
    )
    return over_batches(source, work, schema).distinct()


def bitmap(places: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of the column ``place``, gathered as its non-zero bytes, never more than its size."""
    spot = F.pmod(F.col("place"), F.lit(bits))
    byte, bit = F.floor(spot / 8), F.pmod(spot, F.lit(8)).cast("int")
    set_bytes = (
        places.select(byte.alias("byte"), F.expr("1").alias("one"), bit.alias("bit"))
        .groupBy("byte")
        .agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("value"))
        .toArrow()
    )
    out = np.zeros(bits // 8, np.uint8)
    out[set_bytes.column("byte").to_numpy()] = set_bytes.column("value").to_numpy().astype(np.uint8)
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS
) -> DataFrame:
    """One row per document and item it holds: row_id, doc_id, item_id, n_shared, n_item, containment.

    ``row_id`` numbers the rows of ``docs`` as they are read.
    """
    spark = docs.sparkSession
    known = stored(item_shingles(items, words), "item-shingles")
    sent = spark.sparkContext.broadcast(bitmap(known))
    source = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("text").cast("string").alias("text")
    )

    def scan(batch: pa.RecordBatch) -> dict:
        row, mixed, begin, end, joined = shingles(batch.column(2).to_pylist(), words)
        spot = mixed % np.uint64(BITMAP_BITS)
        at = np.flatnonzero((sent.value[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
        # The same shingle of a text once.
        key = np.stack([row[at].astype(np.uint64), mixed[at]], axis=1)
        _, first = np.unique(key, axis=0, return_index=True)
        at = at[np.sort(first)]
        take = pa.array(row[at])
        return {
            "row_id": batch.column(0).take(take),
            "doc_id": batch.column(1).take(take),
            "shingle": [_shingle_text(joined, a, b) for a, b in zip(begin[at].tolist(), end[at].tolist())],
        }

    schema = StructType([*source.schema.fields[:2], *StructType.fromDDL("shingle string")])
    hits = stored(over_batches(source, scan, schema), "shingle-hits")
    sizes = known.groupBy("item").agg(F.count("*").alias("n_item"))
    needed = F.ceil(F.lit(containment) * F.col("n_item") - 1e-9)
    # Size partitions: sizes between powers of two share k, cut to what the item itself needs.
    sizes = sizes.withColumn("least", F.greatest(needed, F.lit(1))).withColumn(
        "size_class", F.floor(F.log2("n_item"))
    )
    widest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    k = F.least(widest - F.ceil(widest * containment - 1e-9) + 1, F.col("n_item") - F.col("least") + 1)
    sizes = stored(sizes.withColumn("k", k.cast("bigint")), "item-sizes")
    by_item = known.join(sizes, "item")
    # The rarest k in the documents, equally rare ones by their hash; what no document holds finds none.
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy("item").orderBy(F.coalesce("n_rows", F.lit(0)), F.xxhash64("shingle"), "shingle")
    ranked = by_item.select("item", "shingle", "k").distinct().join(rarity, "shingle", "left")
    bottom = ranked.withColumn("rank", F.row_number().over(order)).where(
        (F.col("rank") <= F.col("k")) & F.col("n_rows").isNotNull()
    )
    candidates = stored(hits.join(bottom, "shingle").select("row_id", "item").distinct(), "candidates")
    # Only candidates meet all shingles of their item, and then the same row's hits.
    asked = candidates.join(by_item.select("item", "item_id", "shingle", "n_item", "least"), "item")
    shared = (
        asked.join(hits, ["row_id", "shingle"])
        .groupBy("row_id", "doc_id", "item", "item_id", "n_item", "least")
        .agg(F.count_distinct("shingle").alias("n_shared"))
        .where("n_shared >= least")
    )
    return shared.select(
        "row_id", "doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; rows alike in id and text go together."""
    numbered = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("mark"))
    found = contaminated(
        docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), items
    ).select(F.col("doc_id").alias("mark")).distinct()
    return numbered.join(stored(found, "leaks"), "mark", "left_anti").select("row.*")


def op2_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).select("doc_id", "item_id", "n_shared", "n_item", "containment")


ORACLE = """
WITH item_words AS (
    SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark
), item_shingles AS (
    SELECT DISTINCT item_id, text, array_to_string(w[i:i+4], ' ') AS shingle
    FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
), items AS (
    SELECT item_id, text, count(*) AS n_item FROM item_shingles GROUP BY ALL
), doc_words AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w
    FROM documents
), doc_shingles AS (
    SELECT DISTINCT row_id, doc_id, array_to_string(w[i:i+4], ' ') AS shingle
    FROM doc_words, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
), shared AS (
    SELECT row_id, doc_id, item_id, text, count(*) AS n_shared
    FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN items USING (item_id, text)
WHERE n_shared >= greatest(ceil(0.8 * n_item - 1e-9), 1)
"""
