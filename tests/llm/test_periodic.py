import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from evalmill.llm import periodic


def brute(words, least=periodic.LEAST_WORDS, times=periodic.TIMES):
    """Every stretch of every period, the smallest period of each."""
    found = {}
    for period in range(1, len(words) // times + 1):
        start = 0
        for i in range(len(words) - period + 1):
            if i + period == len(words) or words[i] != words[i + period]:
                length = i - start + period
                if length >= max(least, times * period):
                    found.setdefault((start, length), period)
                start = i + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), s, n, p, runs and 1000 * n // p or None, digest(lines.encode()), digest(kept))


@pytest.mark.parametrize("least, times", [(2, 2), (6, 4), (6, 2), (1, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 50), rng.randint(1, 3)
            text = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 3 + 1)
                text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(text, np.int64))
        for text, runs in zip(texts, periodic.runs_of(texts, least, times)):
            assert [tuple(r) for r in runs.tolist()] == brute(text.tolist(), least, times)


def test_suffix_array_and_lcp():
    text = np.array([3, 1, 2, 1, 2, 1, 2, 2, 1, 0])
    suffixes, inverse, levels = periodic.suffix_array(text)
    assert suffixes.tolist() == sorted(range(10), key=lambda i: text[i:].tolist())
    assert inverse[suffixes].tolist() == list(range(10))
    a, b = np.array([1, 3, 1]), np.array([3, 5, 8])
    assert periodic.agreeing(levels, a, b).tolist() == [4, 2, 1]


def test_texts_do_not_meet_and_batches_do_not_matter(monkeypatch):
    words = [np.array([0, 1] * 3), np.array([0, 1] * 3), np.array([0] * 5), np.array([0] * 5)]
    assert all(not len(r) for r in periodic.runs_of(words))
    texts = [("a b " * 5).encode().split(), ("a " * 9).encode().split(), []]
    whole = list(periodic._groups(texts))
    monkeypatch.setattr(periodic, "WORDS_TOGETHER", 1)
    assert [list(g) for g in periodic._groups(texts)] == [[0], [1], [2]] and [list(g) for g in whole] == [[0, 1, 2]]


def test_long_text_of_one_word():
    (runs,) = periodic.runs_of([np.zeros(300_000, np.int64)])
    assert runs.tolist() == [[0, 300_000, 1]]


def test_query_equals_brute_force(small, small_rows):
    got = {tuple(r) for r in periodic.op12_periodic_runs(small).collect()}
    assert got == {expected(i, t) for i, t in small_rows}
    assert sum(1 for r in got if r[1]) > 10


def test_query_on_odd_rows(odd):
    got = sorted((tuple(r) for r in periodic.op12_periodic_runs(odd).collect()), key=str)
    slim = [r for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 10_000]
    want = sorted((expected(r.doc_id, r.text) for r in slim), key=str)
    assert [r for r in got if r[0] != 6] == want
    (long,) = [r for r in got if r[0] == 6]
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert long[7] == hashlib.sha256(b"word").hexdigest()
    empty = periodic.op12_periodic_runs(odd.limit(0))
    assert empty.count() == 0 and empty.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]


def test_operator_returns_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "p p p p p p")], "doc_id int, text string")
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert rows[1].collapsed == "x a b y" and [tuple(r) for r in rows[1].runs] == [(1, 8, 2)]
    assert rows[2].collapsed == "p" and rows[2].n_words == 6
