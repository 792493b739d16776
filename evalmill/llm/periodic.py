"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

The words of some texts stand in one array, each text behind it closed by a mark of its own, so
that no two suffixes of different texts share even one word.  Prefix doubling sorts the suffixes
and keeps, for every power of two, the class of the substring of that many words at every place;
two equal classes are equal words, never only equal hashes.  The classes give the LCP of neighbours
in the suffix array, and how far two places agree to the left.

An LCP interval of depth d holds the suffixes that share d words; its boundaries part it into
children.  A suffix i starts a branching square of period d exactly if i + d lies in the interval
but in another child.  That is asked for the suffixes of all children but the largest, of i + d and
of i - d, by the inverse suffix array: at most log2 n questions for each suffix, and no tree nodes,
for the intervals are ranges of the array.  The rightmost square of every run is a branching one;
rotated to the left while the words agree it becomes the whole run, and of runs over the same words
the one of the smallest period stays.

A run here is a stretch with smallest period q of at least ``max(least_words, times * q)`` words
that no neighbouring word extends.

Texts are whole.  Null, empty and blank texts have no words and no runs.  Each row is a text of its
own, so repeated rows repeat their result; an empty table gives an empty one.  Columns of the
input beside the id and the text play no part, whatever their names.  Work memory is about 250
bytes a word of the longest text of a task, as a text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalmill.llm.common import over_batches

#: What counts as a run.
LEAST_WORDS, TIMES = 6, 4
#: Words whose suffixes are sorted together; a longer text is sorted alone.
WORDS_TOGETHER = 1 << 17

#: For (doc_id, number of words): where the words become periodic and with which period, or None.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def words_of(text: str | None) -> list[bytes]:
    """Words are parted by ASCII blanks alone."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and for each k the classes of substrings of 2**k symbols.

    No substring that reaches the last symbol of a text may occur twice, which closing marks see to.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    suffixes, levels = order.copy(), [rank.astype(np.int32)]
    active, span = order, 1
    while True:
        several = ~(new & np.concatenate([new[1:], [True]]))
        active, slot = active[several], slot[several]
        if not len(active):
            return suffixes, rank, levels
        key = rank[active] * n + rank[active + span]
        place = np.argsort(key, kind="stable")
        active, key = active[place], key[place]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[active] = np.maximum.accumulate(np.where(new, slot, 0))
        suffixes[slot] = active
        levels.append(rank.astype(np.int32))
        span *= 2


def agreeing(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` (different places) share."""
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        shared += (level[a + shared] == level[b + shared]).astype(np.int64) << k
    return shared


def agreeing_left(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before ``a`` and ``b`` (a < b) are alike."""
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, left = levels[k], a - shared - (1 << k)
        alike = (left >= 0) & (level[np.maximum(left, 0)] == level[np.maximum(left, 0) + b - a])
        shared += alike.astype(np.int64) << k
    return shared


def intervals(lcp: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of ``lcp`` above zero: the place, and first and last suffix of its interval.

    ``lcp[j]`` is what suffixes j - 1 and j of the array share; an interval holds at most ``longest``.
    """
    place = np.flatnonzero(lcp)
    depth = lcp[place]
    ahead = [lcp]  # ahead[k][j]: the least of 2**k entries from j on
    while 1 << len(ahead) <= longest:
        last, step = ahead[-1], 1 << (len(ahead) - 1)
        ahead.append(np.minimum(last, np.concatenate([last[step:], np.zeros(min(step, len(last)), last.dtype)])))
    right, left = place + 1, place - 1
    for k in range(len(ahead) - 1, -1, -1):
        least, step = ahead[k], 1 << k
        inside = (right < len(lcp)) & (least[np.minimum(right, len(lcp) - 1)] >= depth)
        right = np.where(inside, right + step, right)
        low = left - step + 1
        left = np.where((low >= 0) & (least[np.maximum(low, 0)] >= depth), left - step, left)
    return place, left, right - 1


def branching_squares(
    lcp: np.ndarray, suffixes: np.ndarray, inverse: np.ndarray, longest: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching squares in LCP intervals of at least ``least`` suffixes."""
    n = len(suffixes)
    place, left, right = intervals(lcp, longest)
    large = right - left + 1 >= least
    place, left, right = place[large], left[large], right[large]
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none
    # The boundaries of an interval, side by side and from left to right.
    owner = left * n + right
    order = np.argsort(owner, kind="stable")
    place, left, right, owner = place[order], left[order], right[order], owner[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    last = np.concatenate([first[1:], [True]])
    # A child begins at every boundary, and one more at each interval's first suffix.
    begin = np.concatenate([left[first], place])
    end = np.concatenate([place[first] - 1, np.where(last, right, np.concatenate([place[1:], [0]]) - 1)])
    number = np.cumsum(first) - 1
    interval = np.concatenate([number[first], number])
    width = end - begin + 1
    most = np.zeros(number[-1] + 1, np.int64)
    np.maximum.at(most, interval, width)
    # Of several largest children one is left out, the first.
    widest = np.flatnonzero(width == most[interval])
    _, once = np.unique(interval[widest], return_index=True)
    small = np.ones(len(width), bool)
    small[widest[once]] = False
    begin, end, interval, width = begin[small], end[small], interval[small], width[small]
    low, high, depth = left[first][interval], right[first][interval], lcp[place[first]][interval]
    each = np.repeat(np.arange(len(width)), width)
    member = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width) + begin[each]
    at, step = suffixes[member], depth[each]
    starts, periods = [], []
    for other, start in ((at + step, at), (at - step, at - step)):
        inside = (other >= 0) & (other < n)
        spot = inverse[np.where(inside, other, 0)]
        inside &= (spot >= low[each]) & (spot <= high[each]) & ((spot < begin[each]) | (spot > end[each]))
        starts.append(start[inside])
        periods.append(step[inside])
    pairs = np.unique(np.concatenate(starts) * n + np.concatenate(periods))
    return pairs // n, pairs % n


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, times: int = TIMES) -> list[np.ndarray]:
    """For each text, an array of its words' numbers, its runs: rows (start, length, period), sorted.

    ``times`` is at least 2.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    if not sizes.sum():
        return [np.zeros((0, 3), np.int64) for _ in texts]
    known = int(max(t.max() for t in texts if len(t))) + 2
    symbols = np.zeros(offset[-1], np.int64)
    for text, start in zip(texts, offset.tolist()):
        symbols[start : start + len(text)] = text + 1
    symbols += np.repeat(np.arange(len(texts)), sizes + 1) * known
    suffixes, inverse, levels = suffix_array(symbols)
    lcp = np.zeros(len(symbols), np.int64)
    near = np.flatnonzero(symbols[suffixes[1:]] == symbols[suffixes[:-1]]) + 1
    lcp[near] = agreeing(levels, suffixes[near - 1], suffixes[near])
    start, period = branching_squares(lcp, suffixes, inverse, int(sizes.max()) + 1, times)
    grown = agreeing_left(levels, start, start + period)
    length = 2 * period + grown
    long = length >= np.maximum(least_words, times * period)
    start, length, period = (start - grown)[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # Over the same words the smallest period counts.
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([start, length, period], axis=1)[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(offset, found[:, 0], side="right") - 1
    found[:, 0] -= offset[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _groups(texts: list[list[bytes]]) -> Iterator[range]:
    """Ranges of texts of at most ``WORDS_TOGETHER`` words in all, or of one longer text."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > WORDS_TOGETHER:
            yield range(start, i)
            start, held = i, 0
        held += len(text)
    yield range(start, len(texts))


def periodic_runs(
    docs: DataFrame, rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS, times: int = TIMES
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, sorted) and collapsed, the kept words in a row.

    A run keeps its first period only.  ``rewrite`` may make a text's tail periodic before.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    added = StructType.fromDDL(
        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )

    def work(batch: pa.RecordBatch) -> dict:
        texts = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            change = rewrite(doc_id, len(words)) if rewrite and words else None
            if change:
                tail, period = change
                copies = -(-(len(words) - tail) // period)
                words = (words[:tail] + words[tail : tail + period] * copies)[: len(words)]
            texts.append(words)
        runs, collapsed = [], []
        for some in _groups(texts):
            numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts[i] for i in some)))}
            coded = [np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i])) for i in some]
            for i, found in zip(some, runs_of(coded, least_words, times)):
                words = texts[i]
                if len(found):
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {
            "doc_id": batch.column(0),
            "n_words": [len(t) for t in texts],
            "runs": runs,
            "collapsed": collapsed,
        }

    return over_batches(source, work, StructType([source.schema["doc_id"], *added]))


def every_tenth(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's rewriting: texts whose crc32 of the id ends in 0 get a periodic tail."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    tail = g % n
    return tail, 1 + (n - tail) // (3 + g % 8)


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text, after every tenth one's tail was made periodic.

    A null id counts as one whose text is not rewritten.
    """
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # The greatest length first, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = periodic_runs(docs, every_tenth).select(
        "doc_id", "runs", best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
