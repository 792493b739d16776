"""Best-fit packing with several permitted sequence lengths.

Texts longer than the largest capacity are cut into pieces of that capacity and a rest.  Pieces are
dealt into groups by a hash of document and piece; a group holds about ``GROUP_PIECES`` pieces
whatever the corpus's size, and is packed by itself.  Within a group, pieces go from the longest to
the shortest into the open bin with the least room that still holds them.  Where none does, a bin is
opened at the capacity that costs least per token that it is expected to hold: the piece, and of the
shorter pieces still to come as much as fits.  When all pieces are placed, every bin is cut down to
the smallest permitted capacity that holds its contents.

Lengths are taken from ``length_column``; the query counts the bytes of the text and one end mark,
which is what a byte-level model reads.  Null and empty texts have the end mark only.  Null or
non-positive lengths count as one.  Null ids are packed like others; repeated rows are separate
documents.  Ties are broken by document, piece and row.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import found_by_workers, stored

#: Permitted sequence lengths.
CAPACITIES = (1024, 2048, 4096, 8192)
#: Cost of a sequence of length c, in tokens: c + c * c / ATTENTION + OVERHEAD.
OVERHEAD, ATTENTION = 64, 32_768
#: Pieces packed together, on average.
GROUP_PIECES = 20_000


def open_capacity(length: int, rest: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted capacity of least cost per token for a piece with ``rest`` tokens to follow."""
    fitting = [c for c in capacities if c >= length]
    return min(fitting, key=lambda c: ((c + c * c / ATTENTION + overhead) / min(c, length + rest), c))


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece, and each bin's final capacity. ``lengths`` descend and fit the largest."""
    rest = int(lengths.sum())
    # Open bins by room, and which rooms have any, as the bits of one number.
    by_room: dict[int, list[int]] = {}
    rooms = 0
    filled: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        rest -= length
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            number = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            number, room = len(filled), open_capacity(length, rest, capacities, overhead)
            filled.append(0)
        bins[i] = number
        filled[number] += length
        if left := room - length:
            by_room.setdefault(left, []).append(number)
            rooms |= 1 << left
    return bins, np.array([capacities[bisect.bisect_left(capacities, f)] for f in filled], np.int64)


def pieces(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """doc_id, piece, start and n_tokens: documents cut where they exceed the largest capacity."""
    whole = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("bigint").alias("n"))
    return whole.select(
        "doc_id",
        "n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / largest))).alias("piece"),
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("n_tokens"),
    )


def pack(
    docs: DataFrame,
    length: Column,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: where it lies in its document, its bin, its offset there, the capacity."""
    capacities = tuple(sorted(capacities))
    found_by_workers(docs.sparkSession)
    # The row number parts rows that are alike; it only spreads them and breaks ties.
    cut = stored(
        pieces(docs, length, capacities[-1]).withColumn("row_no", F.monotonically_increasing_id()), "pieces"
    )
    groups = max(1, math.ceil(cut.count() / group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row_no"), F.lit(groups)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece", "row_no"], ascending=[False, True, True, True])
        bins, capacity = best_fit(frame["n_tokens"].to_numpy(), capacities, overhead)
        frame = frame.assign(bin=bins, capacity=capacity[bins])
        frame["offset"] = frame.groupby("bin")["n_tokens"].cumsum() - frame["n_tokens"]
        frame["bin_tokens"] = frame.groupby("bin")["n_tokens"].transform("sum")
        return frame[["doc_id", "piece", "start", "n_tokens", "group", "bin", "offset", "capacity", "bin_tokens"]]

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("group").applyInPandas(
        run,
        f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, group bigint, bin bigint, "
        "offset bigint, capacity bigint, bin_tokens bigint",
    )


def byte_length(text: str = "text") -> Column:
    return F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1


def op5_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs, byte_length())
