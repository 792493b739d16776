import random
from collections import Counter

import numpy as np
import pytest

from evalmill.llm import toxicity


def brute_segments(steps):
    """Ruzzo and Tompa's definition: the best segment (shortest, then first), then left and right of it."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += steps[j]
                key = (-total, j - i, i)
                if total > 0 and (found is None or key < found[0]):
                    found = (key, i, j + 1)
        if found is None:
            return []
        _, i, j = found
        return best(a, i) + [(i, j)] + best(j, b)

    return best(0, len(steps))


def test_segments_equal_the_recursive_definition():
    rng = random.Random(3)
    for _ in range(400):
        steps = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() * 0.5 for _ in range(rng.randint(0, 25))]
        found = toxicity.segments(np.array(steps))
        assert [(a, b) for a, b, _ in found] == brute_segments(steps)
        assert all(abs(sum(steps[a:b]) - s) < 1e-9 for a, b, s in found)


def test_segments_of_no_steps():
    assert toxicity.segments(np.zeros(0)) == [] == toxicity.segments(np.array([-1.0, -0.5]))
    assert [s[:2] for s in toxicity.segments(np.array([2.0, -3.0, 2.0]))] == [(0, 1), (2, 3)]


def test_rate_solves_its_equation():
    step, count = np.array([-1.0, 0.5, 2.0]), np.array([90.0, 8.0, 2.0])
    rate = toxicity._rate(step, count)
    assert abs((count / 100) @ np.exp(rate * step) - 1) < 1e-9


def _weight(word, share, rows):
    """The weight by its definition, over texts as sets of words."""
    parts = [word[:n] for n in toxicity.PREFIXES if n < len(word)] + [None]
    kinds = [Counter(), Counter()]
    for toxic, text in rows:
        words = set(toxicity.tokens(text))
        for part in parts:
            kinds[toxic][part] += word in words if part is None else any(w.startswith(part) and len(w) > len(part) for w in words)
    p = share
    for part, longer in zip(parts, parts[1:] + [...]):
        t, c = (max(k[part] - (k[longer] if longer is not ... else 0), 0) for k in (kinds[1], kinds[0]))
        p = (t + toxicity.STRENGTH * p) / (t + c + toxicity.STRENGTH)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def test_weights_equal_their_definition(spark):
    rows = [(1, "idiots Idiot, good day"), (1, "idiotic idea"), (0, "good ideas all day"), (0, "a good idea é"), (0, "")]
    table = toxicity.bucket_counts(spark.createDataFrame(rows, "toxic int, text string")).toPandas()
    counts = np.zeros((2, 1 << toxicity.BUCKET_BITS), np.int32)
    counts[0, table.bucket], counts[1, table.bucket] = table.toxic, table.clean
    model = toxicity.Model(counts[0], counts[1], 0.4)
    for word in ("idiot", "idiots", "idea", "ideas", "good", "day", "unseen", "idio", "é"):
        assert abs(model.weight(word) - _weight(word, 0.4, rows)) < 1e-9, word
    assert model.weight("idiotical") > 0.5 > model.weight("idea") and abs(model.weight("xyz")) < 1e-12


@pytest.fixture(scope="module")
def scored(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op11_toxicity(docs, labels).join(labels, "doc_id", "left")
    return rows.select("doc_id", "held_out", "score", "predicted", "toxic").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out & scored.toxic.notna()]
    toxic, found = held.toxic == 1, held.predicted == 1
    assert (toxic & found).sum() / toxic.sum() > 0.85 and (toxic & found).sum() / found.sum() > 0.9
    assert abs(held.score.mean() - held.toxic.mean()) < 0.05
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert len(scored) == 10_000


def test_labels_and_ids_are_no_inputs_of_a_score(spark):
    """Held-out labels change nothing, and equal texts have equal scores."""
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(labels.doc_id)
    flipped = labels.withColumn("toxic", toxicity.F.when(held, 1 - labels.toxic).otherwise(labels.toxic))
    one = {r.doc_id: r.score for r in toxicity.op11_toxicity(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.op11_toxicity(docs.drop("lang", "source"), flipped).collect()}
    assert one == two
    by_text = {}
    for r in docs.collect():
        assert by_text.setdefault(r.text, one[r.doc_id]) == one[r.doc_id]


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (None, 1, 0), (8, None, 0)], "doc_id bigint, toxic int, quality int")
    rows = toxicity.op11_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.op11_toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert toxicity.op11_toxicity(odd.limit(0), labels).count() == 0


def test_bound_of_labelled_rows_is_exact(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('text ', id % 400) as text")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert toxicity.labelled_rows(docs, labels, 50).count() <= 50
    assert toxicity.labelled_rows(docs, labels).count() == 400


def test_passages_point_into_the_text(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    words = ["the", "that", "and", "with", "for"]
    clean = " ".join(words[i % 5] for i in range(300))
    text = clean + " You IDIOT and worthless scum, moron! " + clean
    (row,) = toxicity.toxic_passages(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).collect()
    (passage,) = row.passages
    assert text[passage.start : passage.end] == "IDIOT and worthless scum, moron"
    assert passage.e_value < toxicity.SIGNIFICANT and row.score > 0.5
