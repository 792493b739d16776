"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are runs of letters in lower case.  A token's weight is its log-odds of standing in a toxic
text, with a Dirichlet prior: the counts of texts of either class that hold it are added to
``STRENGTH`` pseudo-counts from its longest prefix, whose own come from the next shorter one, down
to the share of toxic texts.  At each prefix only texts that hold no longer one count, so nothing
counts twice, and a word never seen takes the weight of the words that begin like it.

Each weight less a constant drift, so that clean text loses as it goes on, is a step of a walk.
Ruzzo and Tompa's scan finds all maximal scoring segments in one pass; it works on the runs of
positive steps alone, as a segment begins and ends with those.  In clean text, the best segment of n
tokens has an extreme-value distribution: E = K n exp(-lambda S), where lambda solves
mean(exp(lambda step)) = 1 over clean calibration texts and K is the maximum likelihood fit to
their best segments.  Segments of E at most ``SIGNIFICANT`` are passages.  A text's statistics, the
best segment's -ln E and the sum of those of its passages, go through a logistic regression on
calibration texts to a probability.

Learned from at most ``LABELLED`` labelled rows, chosen by a hash of their id if there are more;
equal texts count once, toxic if any copy is.  Three in four of them are counted, the others
calibrate.  Counts are kept by ``2**BUCKET_BITS`` hash buckets, which bounds the model to 32 MB; a
token of fewer than ``LEAST_TEXTS`` texts is known by its prefixes alone.  A token that comes again
soon is the same evidence and only costs the drift.  Rows with
a null id or label teach nothing.  Without texts of both classes every score is the share of toxic
ones, 0 if there are none.

Texts are whole.  Null, empty and letterless texts hold no token and get the score of no evidence.
Repeated rows each get their own result; repeated or contradicting labels of an id count as toxic
if any does; an empty table gives an empty one.  Other columns play no part, whatever their names.  Ties of
equal segments stay separate passages, from left to right.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalmill.llm.common import found_by_workers, over_batches, stored
from evalmill.llm.langid import held_out

#: Bound of the labelled rows that are learned from, and how many of them count and calibrate.
LABELLED, FOLDS = 200_000, 4
#: Lengths of the prefixes that lend their counts to a word, pseudo-counts of each, and buckets.
PREFIXES, STRENGTH, BUCKET_BITS = (3, 4, 5, 6, 7, 8), 4.0, 22
#: Loss of a step, and the E-value up to which a segment is a passage.
DRIFT, SIGNIFICANT = 1.0, 0.05
#: Texts that hold a token or prefix for it to be told from one never seen.
LEAST_TEXTS = 2
#: A token that comes again within so many others is the same evidence.
APART = 64
#: Contract: a text counts as toxic from this score on.
THRESHOLD = 0.3
#: Words whose weights a worker remembers.
REMEMBERED = 1 << 20

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    text = text or ""
    lower = text.lower()
    # A letter whose lower case is longer would move or cut the tokens.
    return _TOKEN.findall(lower) if len(lower) == len(text) else [t.lower() for t in _TOKEN.findall(text)]


def chain(word: str) -> list[int]:
    """Buckets of a word's prefixes, shorter ones first, and of the word itself."""
    import xxhash

    parts = [word[:n] for n in PREFIXES if n < len(word)] + [word + "$"]
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1) for p in parts]


def segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), from left to right."""
    up = steps > 0
    edges = np.flatnonzero(np.diff(up, prepend=False, append=False))
    if not len(edges):
        return []
    total = np.concatenate([[0.0], np.cumsum(steps)])
    found: list[list] = []  # start, end, total before, total behind
    for start, end in edges.reshape(-1, 2).tolist():
        before, behind = total[start], total[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= behind:
                found.append([start, end, before, behind])
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(r - b)) for s, e, b, r in found]


@dataclass
class Model:
    """Counts of texts by bucket, the extreme-value parameters and the regression."""

    toxic: np.ndarray
    clean: np.ndarray
    share: float
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, float, float] | None = None

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}
        self._views = memoryview(self.toxic), memoryview(self.clean)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_views")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, word: str) -> float:
        if not 0 < self.share < 1:
            return 0.0
        toxic, clean = self._views
        share = self.share
        places = chain(word)
        t, c = toxic[places[0]], clean[places[0]]
        for longer in [*places[1:], None]:
            if not t and not c:
                break  # no text holds this prefix, nor a longer one
            more_t, more_c = (toxic[longer], clean[longer]) if longer is not None else (0, 0)
            # Texts that hold the longer prefix count there.
            own_t, own_c = max(t - more_t, 0), max(c - more_c, 0)
            share = (own_t + STRENGTH * share) / (own_t + own_c + STRENGTH)
            t, c = more_t, more_c
        return math.log(share / (1 - share)) - math.log(self.share / (1 - self.share))

    def steps(self, words: list[str]) -> np.ndarray:
        """What each token adds; one that stood in the last ``APART`` tokens only costs the drift."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.weight(word)
        weights = np.fromiter(map(known.__getitem__, words), float, len(words))
        seen: dict[str, int] = {}
        for i in np.flatnonzero(weights > DRIFT).tolist():
            if i - seen.get(words[i], -APART - 1) <= APART:
                weights[i] = 0.0
            seen[words[i]] = i
        return weights - DRIFT

    def evidence(self, steps: np.ndarray) -> tuple[list[tuple[int, int, float, float]], float, float]:
        """Passages (start, end, score, E), the best segment's -ln E, and the passages' sum of it."""
        found = segments(steps)
        size = np.log(self.scale * max(len(steps), 1))
        best = self.rate * max((s for _, _, s in found), default=0.0) - size
        limit = -np.log(SIGNIFICANT)
        rated = [(a, b, s, self.rate * s - size) for a, b, s in found]
        passages = [(a, b, s, float(np.exp(-x))) for a, b, s, x in rated if x >= limit]
        return passages, float(best), float(sum(x for *_, x in rated if x >= limit))

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(best), self.share)
        return 1 / (1 + np.exp(-np.clip(_features(best, total) @ np.array(self.weights), -50, 50)))


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -20, 20) / 10, np.log1p(np.maximum(total, 0))], axis=1)


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, digest, toxic and fold of at most ``bound`` different texts of ``docs`` with a label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Few more than are wanted come by the hash alone, the rest go by their order.
    share = 1.25 * bound / max(known.count(), 1)
    some = known.where(spot < int(min(share, 1.0) * (1 << 30)) + 1).orderBy(spot, "doc_id").limit(bound)
    some = stored(some, "labelled-ids")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # At most ``bound`` ids of a few bytes each.
    rows = docs.select("doc_id", digest.alias("digest")).join(F.broadcast(some), "doc_id")
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    fold = F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int").alias("fold")
    return stored(distinct.select("doc_id", "digest", "toxic", fold), "labelled-texts")


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """toxic and text of the labelled rows, each text once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # One row per different text among the labelled ids: bounded by their number.
    found = docs.select("doc_id", F.md5(text).alias("digest"), text.alias("text")).join(
        F.broadcast(rows), ["doc_id", "digest"]
    )
    return found.select("toxic", "text")


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, toxic and clean: how many of ``texts`` (toxic, text) hold a token or prefix of it."""
    schema = StructType.fromDDL("bucket int, toxic bigint, clean bigint")
    fields = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(tokens(text))
                if len(known) > REMEMBERED:
                    known.clear()
                for word in words.difference(known):
                    known[word] = chain(word)
                places = [b for w in words for b in known[w]]
                held[1 - toxic, np.unique(places) if places else []] += 1
        bucket = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((bucket, held[0, bucket], held[1, bucket]), fields)], schema=fields
        )

    found_by_workers(texts.sparkSession)
    return texts.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(step: np.ndarray, count: np.ndarray) -> float:
    """The positive lambda of mean(exp(lambda step)) = 1."""
    share = count / count.sum() if count.sum() else count
    if not (share[step > 0] > 0).any() or float(share @ step) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(high * step) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * step) < 1 else (low, middle)
    return max((low + high) / 2, 1e-3)


def _regression(features: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Logistic regression with a weak ridge, by Newton steps."""
    weights = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -50, 50)))
        ridge = 1e-2 * np.eye(len(weights))
        step = np.linalg.solve(
            (features * (p * (1 - p))[:, None]).T @ features + ridge, features.T @ (truth - p) - ridge @ weights
        )
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    The driver gets a row per bucket, a histogram of steps and two numbers per calibration text.
    """
    spark = docs.sparkSession
    rows = labelled_rows(docs, labels, bound)
    # A third of the labelled texts or none may calibrate by chance; few texts do both.
    calibrating = rows.where("fold = 0")
    sizes = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("fold") == 0).alias("aside")).collect()
    if any(r["aside"] < 5 or r["n"] - r["aside"] < 5 for r in sizes):
        calibrating, counting = rows, rows
    else:
        counting = rows.where("fold > 0")
    of = {r["toxic"]: r["n"] for r in sizes}
    toxic, clean = (np.zeros(1 << BUCKET_BITS, np.int32) for _ in range(2))
    share = of.get(1, 0) / max(sum(of.values()), 1)
    if not of.get(1) or not of.get(0):
        return Model(toxic, clean, share)
    table = bucket_counts(_texts_of(docs, counting)).where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).toArrow()
    bucket = table.column("bucket").to_numpy()
    toxic[bucket], clean[bucket] = table.column("toxic").to_numpy(), table.column("clean").to_numpy()
    model = Model(toxic, clean, share)
    texts = _texts_of(docs, calibrating)

    shared = spark.sparkContext.broadcast(model)
    schema = StructType.fromDDL("toxic int, size bigint, best double, bins array<int>, counts array<bigint>")

    def walk(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            steps = shared.value.steps(tokens(text))
            bins, counts = np.unique(np.rint(steps * 20).astype(int), return_counts=True)
            best = max((s for _, _, s in segments(steps)), default=0.0)
            for name, value in zip(out, (toxic, len(steps), best, bins.tolist(), counts.tolist())):
                out[name].append(value)
        return out

    walked = stored(over_batches(texts, walk, schema), "walks")
    clean_walks = walked.where("toxic = 0")
    bins = clean_walks.select(F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy(F.col("b.bins").alias("bin"))
    found = bins.agg(F.sum("b.counts").alias("n")).toArrow()
    model.rate = _rate(found.column("bin").to_numpy() / 20, found.column("n").to_numpy().astype(float))
    fit = clean_walks.where("size > 0").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * F.exp(-model.rate * F.col("best"))).alias("s")
    ).first()
    model.scale = fit["n"] / fit["s"] if fit["n"] and fit["s"] else 1.0

    rated = spark.sparkContext.broadcast(model)

    def rate(batch: pa.RecordBatch) -> dict:
        found = [rated.value.evidence(rated.value.steps(tokens(t)))[1:] for t in batch.column(1).to_pylist()]
        return {"toxic": batch.column(0), "best": [b for b, _ in found], "total": [s for _, s in found]}

    seen = over_batches(texts, rate, StructType.fromDDL("toxic int, best double, total double")).toArrow()
    best, total = seen.column("best").to_numpy(), seen.column("total").to_numpy()
    model.weights = tuple(_regression(_features(best, total), seen.column("toxic").to_numpy()).tolist())
    return model


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (start and end in code points, score, e_value) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    added = StructType.fromDDL(
        "score double, passages array<struct<start:bigint,end:bigint,score:double,e_value:double>>"
    )

    def work(batch: pa.RecordBatch) -> dict:
        model, best, total, passages = shared.value, [], [], []
        for text in batch.column(1).to_pylist():
            found, x, s = model.evidence(model.steps(tokens(text)))
            best.append(x)
            total.append(s)
            places = [m.span() for m in _TOKEN.finditer(text)] if found else []
            passages.append(
                [{"start": places[a][0], "end": places[b - 1][1], "score": v, "e_value": e} for a, b, v, e in found]
            )
        score = model.probability(np.array(best, float), np.array(total, float))
        return {"doc_id": batch.column(0), "score": score, "passages": passages}

    return over_batches(source, work, StructType([source.schema["doc_id"], *added]))


def op11_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return toxic_passages(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"),
    )
