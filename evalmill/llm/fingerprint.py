"""Document fingerprints: one-permutation MinHash with optimal densification, in built-in functions.

Each five-word shingle is hashed once.  The top bits of the hash name one of ``BINS`` bins, and a bin
keeps its smallest hash.  An empty bin takes the value of a filled one: every bin has its own random
sequence of bins, and the first filled one in it is copied, so two texts that share a bin early in
the sequence agree.  Of each value, the low ``BITS`` bits are stored, two hexadecimal
digits per bin.  Unlike values agree in those bits by chance once in 2^BITS, which the likeness
takes off again.

Words are runs of letters and digits in lower case; a text of one to four words has one shingle, all
its words.  Texts without words, null and empty ones have the empty fingerprint, which is like
itself (1.0) and unlike any other (0.0).

For the query, documents are ordered by descending id; ties are ordered by hashes of id and text,
and null ids come last.  Rows alike in id and text follow each other, so the next document of such a
row is its copy.  A single document is its own next one.  Texts of any length are hashed whole, in memory
of some 100 bytes a word; an empty table gives an empty one.  Columns other than id and text are never
read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.common import row_key

WORDS = 5
BINS_LOG2, BITS = 7, 8
BINS = 1 << BINS_LOG2
#: Random bins that an empty bin asks before it orders all filled ones.
ASKED = 4
WORD = r"[\p{L}\p{N}]+"


def _bin(h: Column) -> Column:
    # The arithmetic shift keeps the order of signed hashes, so sorted hashes come by bin.
    return (F.shiftright(h, 64 - BINS_LOG2) + BINS // 2).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` as column ``out``.

    Each step is a column of its own, so that no step is computed once per element of the next.
    """
    t = f"_{out}_"
    one, two, four = F.col(f"{t}one"), F.col(f"{t}two"), F.col(f"{t}four")
    sorted_, mins = F.col(f"{t}sorted"), F.col(f"{t}mins")

    def with_later(hashes: Column, others: Column, steps: int) -> Column:
        # Hashes of two neighbours; at the end, where there is no later one, of the first alone.
        return F.zip_with(hashes, F.slice(others, F.lit(steps + 1), F.size(others)), lambda x, y: F.xxhash64(x, y))

    count = F.greatest(F.size(one) - (WORDS - 1), F.least(F.size(one), F.lit(1)))
    shingles = F.slice(with_later(four, one, 4), F.lit(1), count)
    first_of_bin = F.filter(
        sorted_, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_, i - 1)))
    )
    held, slots = F.col(f"{t}held"), F.col(f"{t}slots")
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def densified(own: Column, b: Column) -> Column:
        # The bins that an empty one asks in turn; then all filled ones, in a random order of its own.
        asked = [F.get(slots, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ASKED)]
        places = F.transform(
            F.map_keys(held), lambda j: F.xxhash64(b, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("bigint"))
        )
        first = F.array_min(places).bitwiseAND(F.lit(BINS - 1)).cast("int")
        return F.coalesce(own, *asked, F.get(slots, first))

    def low_bits(h: Column, b: Column) -> Column:
        # Hashed with the bin, so that the copies of one value differ from bin to bin.
        return F.xxhash64(h, b).bitwiseAND(F.lit((1 << BITS) - 1))

    dense = F.when(F.size(mins) == BINS, mins).otherwise(F.transform(slots, densified))
    packed = F.array_join(
        F.transform(F.col(f"{t}dense"), lambda h, b: F.lpad(F.lower(F.hex(low_bits(h, b))), BITS // 4, "0")), ""
    )
    lowered = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return (
        df.withColumn(f"{t}words", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)))
        .withColumn(f"{t}one", F.transform(f"{t}words", lambda w: F.xxhash64(w)))
        .withColumn(f"{t}two", with_later(one, one, 1))
        .withColumn(f"{t}four", with_later(two, two, 2))
        .withColumn(f"{t}sorted", F.sort_array(shingles))
        .withColumn(f"{t}mins", first_of_bin)
        .withColumn(f"{t}held", F.map_from_arrays(F.transform(mins, _bin), mins))
        .withColumn(f"{t}slots", F.transform(bins, lambda b: F.element_at(held, b)))
        .withColumn(f"{t}dense", dense)
        .withColumn(out, F.when(F.size(mins) > 0, packed).otherwise(F.lit("")))
        .drop(*[f"{t}{c}" for c in ("words", "one", "two", "four", "sorted", "mins", "held", "slots", "dense")])
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, without the agreement due to chance."""
    digits = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0),
        lambda n, i: n
        + (F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))).cast("int"),
    )
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest((same / F.lit(float(BINS)) - chance) / (1.0 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie at or below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.get(held, low + step - 1) <= value), low + step
        ).otherwise(low),
    )


def with_next(rows: DataFrame, buckets: int, taken: list[str]) -> DataFrame:
    """``rows`` (doc_id, key_a, key_b, ...) with ``next``, the ``taken`` columns of the next row.

    The order is descending id, then the keys.  Rows are dealt into ranges of ids, so they are
    shuffled once, and the next row is a window's over a range.  The first row of every range is
    also sent to the range before it (of the first, to the last one), behind all others; these first
    rows are found on the keys alone, one per range, and only their keys are broadcast.
    """
    turned = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit((1 << 63) - 1))
    rows = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("turned", turned)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.select(F.percentile_approx("turned", shares or [0.5], 20_000)).first()[0] or []
    bounds = sorted(set(cuts)) if shares else []
    order = ["no_id", "turned", "key_a", "key_b"]
    rows = rows.withColumn("bucket", _bucket(F.col("turned"), bounds))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(*order)).alias("first"))
    by_bucket = Window.orderBy("bucket")
    every = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(by_bucket), F.last("bucket").over(every))
    border = firsts.select("first.key_a", "first.key_b", before.alias("before"))
    spread = rows.join(F.broadcast(border), ["key_a", "key_b"], "left")
    own = F.struct(F.lit(False).alias("border"), F.col("bucket").alias("at"))
    other = F.struct(F.lit(True).alias("border"), F.col("before").alias("at"))
    dealt = spread.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))))
    following = Window.partitionBy("to.at").orderBy("to.border", *order)
    return dealt.withColumn("next", F.lead(F.struct(*taken)).over(following)).where("not to.border")


def op6_fingerprints(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    marked = with_fingerprint(rows, "text", "fingerprint")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    third = F.floor(F.length("text") / 3).cast("int")
    joined = with_next(marked, buckets, ["text", "fingerprint"]).select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        "fingerprint",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - third),
            F.substring(F.col("next.text"), F.lit(1), third),
        ).alias("edited"),
        F.col("next.fingerprint").alias("next_fingerprint"),
    )
    return with_fingerprint(joined, "edited", "edited_fingerprint").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
