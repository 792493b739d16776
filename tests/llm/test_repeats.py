"""SimHash groups, contamination, fingerprints, repeated passages: brute force and edge tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from evalmill.llm import decontam, fingerprint, simhash, suffix


def groups(codes, ids, radius):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius):
            parent[root(int(i + 1 + j))] = root(i)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least[r] is None else min(least[r], d) if d is not None else least[r]
    return [least[root(i)] for i in range(len(codes))]


def simhash_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter()
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(parts))


@pytest.mark.parametrize("shard", [20_000, 20])
def test_simhash_groups(small, small_rows, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", 4)
    found = {r.doc_id: r for r in simhash.op3_simhash(small).collect()}
    codes = np.array([simhash_of(t) for _, t in small_rows], np.uint64)
    ids = [i for i, _ in small_rows]
    assert [found[i].fingerprint for i in ids] == [f"{c:016x}" for c in codes.tolist()]
    assert [found[i].component_id for i in ids] == groups(codes, ids, 2)


def test_vantage_trees_find_every_pair():
    random_codes = np.random.default_rng(3)
    centres = random_codes.integers(0, 1 << 64, 300, dtype=np.uint64)
    codes = [centres]
    for bits in (1, 2, 3):
        flips = np.zeros(300, np.uint64)
        for _ in range(bits):
            flips |= np.uint64(1) << random_codes.integers(0, 64, 300).astype(np.uint64)
        codes.append(codes[-1] ^ flips)
    codes = np.unique(np.concatenate(codes))
    tree = simhash._top_tree(codes, 4, [0])
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    homes = 0
    for _, places, home in simhash._route(tree, codes, 2):
        homes += int(home.sum())
        for a, b in simhash.shard_links(codes[places], home, 2):
            parent[root(int(places[a]))] = root(int(places[b]))
    assert homes == len(codes)
    mine = [root(i) for i in range(len(codes))]
    want = groups(codes, list(range(len(codes))), 2)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 1001)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(chain).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 1000}


def test_simhash_edges(odd):
    found = simhash.op3_simhash(odd).collect()
    assert len(found) == odd.count()
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.fingerprint, r.component_id))
    assert by_id[2] == by_id[3] == {("0" * 16, 2)}
    assert {c for _, c in by_id[8]} == {c for _, c in by_id[9]} == {8}
    assert {c for _, c in by_id[None]} == {None}
    assert simhash.op3_simhash(odd.limit(0)).collect() == []


def test_random_codes_in_bounded_tasks(spark, monkeypatch):
    """No task gets more than two blocks, however uneven the shards, and no link is lost."""
    monkeypatch.setattr(simhash, "SHARD", 200)
    monkeypatch.setattr(simhash, "DEPTH", 3)
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 64, 2500, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    crowd = centres[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    codes = np.unique(np.concatenate([centres, centres[:500] ^ flips, crowd]))
    df = spark.createDataFrame([(c,) for c in codes.view(np.int64).tolist()], "code bigint")
    dealt = simhash.dealt(df, len(codes), 2)
    largest = dealt.groupBy("shard", "i", "j").count().agg({"count": "max"}).first()[0]
    assert largest <= 2.5 * simhash.SHARD
    routed = dealt.select("shard", "code", "home").distinct()
    assert routed.count() <= 2.5 * len(codes) and routed.where("home").count() == len(codes)
    found = simhash.components(simhash.vp_links(df, len(codes), 2)).collect()
    roots = {r.node: r.root for r in found}
    mine = [roots.get(c, c) for c in codes.view(np.int64).tolist()]
    want = groups(codes, list(range(len(codes))), 2)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_one_document_of_each_group_stays(small, small_rows):
    codes = np.array([simhash_of(t) for _, t in small_rows], np.uint64)
    want = set(groups(codes, [i for i, _ in small_rows], 2))
    kept = simhash.drop_near_duplicates(small).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want) and len(want) < len(small_rows)
    texts = dict(small_rows)
    assert all(r.text == texts[r.doc_id] for r in kept)


def test_near_duplicate_edges(odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 4, None, 6, 7, 8])
    assert simhash.drop_near_duplicates(odd.limit(0)).collect() == []


def test_contamination_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, decontam.op2_decontamination(docs, items).collect()))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert got == sorted(con.execute(decontam.ORACLE).fetchall())
    assert got


def test_a_shared_shingle_makes_no_pairs(spark, monkeypatch):
    """2,000 documents and 2,000 items that share one shingle and nothing else."""
    common = "all of them share this"
    docs = spark.createDataFrame([(i, f"{common} d{i} " + " ".join(f"w{i}x{j}" for j in range(8))) for i in range(2000)], "doc_id int, text string")
    items = spark.createDataFrame([(i, f"{common} " + " ".join(f"v{i}x{j}" for j in range(8))) for i in range(2000)], "item_id int, text string")
    sizes, real = {}, decontam.stored

    def counted(df, purpose):
        sizes[purpose] = (out := real(df, purpose)).count()
        return out

    monkeypatch.setattr(decontam, "stored", counted)
    assert decontam.contaminated(docs, items).collect() == []
    # Everything behind the candidates is a row per candidate and shingle.
    assert sizes["candidates"] == 0 and 2000 <= sizes["shingle-hits"] < 2100  # the bitmap lets a few more pass
    leaked = decontam.contaminated(docs.union(items.select("item_id", "text").where("item_id < 5")), items)
    assert sorted(r.item_id for r in leaked.collect()) == list(range(5))


def test_contamination_at_the_border(spark):
    item = " ".join(f"w{i}" for i in range(44))  # 40 shingles, 32 are needed
    enough = "x y " + " ".join(f"W{i}," for i in range(36)) + " end"
    less = "x y " + " ".join(f"w{i}" for i in range(35)) + " end"
    docs = spark.createDataFrame([(1, enough), (2, less), (3, "tail " * 50_000 + item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.n_shared, r.n_item) for r in decontam.op2_decontamination(docs, items).collect()) == [(1, 32, 40), (3, 40, 40)]


def test_contamination_edges(spark, odd):
    items = spark.createDataFrame(
        [(1, "A, b c\nd e f"), (1, "A, b c\nd e f"), (2, None), (3, ""), (4, "one"), (None, "l m n o p")],
        "item_id bigint, text string",
    )
    got = Counter((r.doc_id, r.item_id) for r in decontam.op2_decontamination(odd, items).collect())
    assert got == Counter([(8, 1), (9, 1), (8, None), (9, None)])
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontam.op2_decontamination(odd, items.limit(0)).collect() == []
    assert decontam.op2_decontamination(odd.limit(0), items).collect() == []


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints(small, small_rows):
    rows = sorted(small_rows, reverse=True)
    found = {r.doc_id: r for r in fingerprint.op6_fingerprints(small).collect()}
    edited_error, next_error = [], []
    for n, (doc_id, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        edited_error.append(r.near_edited - jaccard(text, edited))
        next_error.append(r.near_next - jaccard(text, following))
    assert abs(np.mean(edited_error)) < 0.02 and np.std(edited_error) < 0.07
    assert abs(np.mean(next_error)) < 0.02 and np.std(next_error) < 0.03
    by_text = defaultdict(set)
    for doc_id, text in rows:
        by_text[text].add(found[doc_id].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_edges(odd, spark):
    found = fingerprint.op6_fingerprints(odd).collect()
    assert len(found) == odd.count()
    marks = defaultdict(set)
    for r in found:
        marks[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert marks[2] == marks[3] == {""} and marks[8] == marks[9] and len(marks[1]) == 1
    assert fingerprint.op6_fingerprints(odd.limit(0)).collect() == []
    one = fingerprint.op6_fingerprints(odd.where("doc_id = 8")).first()
    assert one.near_next == 1.0
    assert one.edited_sha256 == hashlib.sha256(b"a b c d e f g h i j ka b c d e ").hexdigest()


def removed(texts, length=200):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = len(np.flatnonzero(np.diff(gone, prepend=False, append=False))) // 2
        kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((len(d), int(gone.sum()), runs, kept))
    return out


def test_repeated_passages(small, small_rows):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.op8_suffix_dedup(small).collect()}
    want = removed([t for _, t in small_rows])
    assert got == {i: w for (i, _), w in zip(small_rows, want)}
    assert sum(w[1] for w in want) > 0


def test_repeated_passage_edges(spark):
    random.seed(2)
    noise = lambda n: "".join(random.choices("abcdefgh ", k=n))
    shared, exact = noise(400), noise(200)
    texts = [
        None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "é" * 150, noise(80) + shared + noise(90),
        noise(30) + shared[100:350] + noise(10), shared[:199], exact + noise(50), noise(70) + exact, noise(500),
    ]
    texts.append(texts[12][:300])
    rows = [(i, t, 0, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int, first int")
    got = sorted(tuple(r) for r in suffix.op8_suffix_dedup(docs).collect())
    assert got == [(i, *w) for i, w in enumerate(removed(texts))]
    twice = docs.union(docs)
    assert all(r.n_removed == r.n_bytes for r in suffix.op8_suffix_dedup(twice).collect() if r.n_bytes >= 200)
    assert suffix.op8_suffix_dedup(docs.limit(0)).collect() == []


def test_repeated_passages_of_odd_tables(odd):
    texts = [r.text for r in odd.collect()]
    got = sorted(tuple(r)[1:] for r in suffix.op8_suffix_dedup(odd).collect())
    assert got == sorted(removed([t for t in texts]))


def test_triggers_over_chunks(monkeypatch):
    random.seed(8)
    data = "".join(random.choices("abcde", k=5_000)).encode()
    whole = suffix.triggers(suffix.Rolling(data))
    monkeypatch.setattr(suffix, "CHUNK", 1_000)
    cut = suffix.triggers(suffix.Rolling(data))
    assert set(whole[0].tolist()) <= set(cut[0].tolist())
    starts = sorted(s for a, b in zip(cut[2].tolist(), cut[3].tolist()) for s in range(a, b + 1))
    assert starts == list(range(5_000 - 200 + 1))
