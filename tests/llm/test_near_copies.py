"""Near copies of the pipeline's third stage against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from foliant.llm import near_copies


def slow_groups(texts):
    """id -> smallest id of its group, by comparing all pairs."""
    sets = {i: near_copies.shingles(t) for i, t in texts.items()}
    ids, root = sorted(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(5), {}
    vocabulary = [f"w{k}" for k in range(3000)]
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 40, 150, 400]))
        out[len(out)] = " ".join(base)
        for _ in range(10):
            w = list(base)
            for _ in range(max(1, round(len(w) * rng.choice([0.01, 0.015, 0.02, 0.025, 0.03])))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out[len(out)] = " ".join(w)
    for t in (None, "", " \n", "One", "one", "a b c"):
        out[len(out)] = t
    return out


def test_shingles():
    assert near_copies.shingles("A b\tC d e F") == {b"a b c d e", b"b c d e f"}
    assert near_copies.shingles("x Y") == {b"x y"} and near_copies.shingles(" ") == near_copies.shingles(None) == set()


def test_stage_keeps_one_of_each_group(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = slow_groups(texts)
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == {i for i, c in want.items() if i == c}
    assert len(set(want.values())) < len(want) - 20  # groups that four SimHash bits leave apart are there
    found = near_copies.near_copies(docs)
    assert {r["id"]: r["component_id"] for r in found.collect()} == want


def test_sketch_by_brute_force():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 64, 700, np.uint64)
    with np.errstate(over="ignore"):
        x = (h[:, None] ^ near_copies._XOR) * near_copies._ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in column) > len(h)) for column in x.T]
    assert [int(v) for v in near_copies.sketch(h)] == want


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.81, each of 70 to 500 shingles: all but a few in a thousand meet."""
    rng, out = random.Random(9), {}
    for pair in range(300):
        n = rng.choice([70, 140, 500])
        base = [f"p{pair}w{k}" for k in range(n + 4)]
        other = list(base)
        gone, k = 0, 0
        while True:  # each changed word takes five shingles
            k += 12
            x, y = near_copies.shingles(" ".join(base)), near_copies.shingles(" ".join([*other[: k % len(other)], "new", *other[k % len(other) + 1 :]]))
            if len(x & y) < 0.8 * len(x | y) or k >= len(other):
                break
            other[k % len(other)] = f"new{pair}x{gone}"
            gone += 1
        out[2 * pair], out[2 * pair + 1] = " ".join(base), " ".join(other)
    docs = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    sets = {i: near_copies.shingles(t) for i, t in out.items()}
    want = sum(5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1]) for i in range(0, len(out), 2))
    got = near_copies.near_copies(docs).where("id <> component_id").count()
    assert want > 250 and want - got <= 2


def test_ids_with_several_texts(spark):
    rows = [(5, "one text of its own here now", "x"), (5, "another text that is quite different from it", "y"), (5, "one text of its own here now", "z"), (6, "one text of its own here now", "x")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, th string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({(5, rows[0][1]), (5, rows[1][1])})


def test_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b"), (1, "A  b"), (1, "A  b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, corpus_pipeline.keep_one_of_each(spark, docs, "").collect()))
    assert got == sorted(["Row(doc_id=1, text='A  b')", "Row(doc_id=None, text='c')", "Row(doc_id=None, text=None)"])
    assert near_copies.near_copies(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def dense():
    """One group of copies of a text, half of them just under the similarity to all others."""
    rng, base = random.Random(11), [f"w{k}" for k in range(140)]
    out = {}
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6, 7])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        out[i] = " ".join(w)
    return out, slow_groups(out)


def test_a_dense_group_makes_no_rows_for_its_pairs(spark, dense, monkeypatch):
    texts, want = dense
    assert 100 < len(set(want.values())) < 400  # one large component and many texts that are alike none
    made, links = [], near_copies.sketch_links
    monkeypatch.setattr(near_copies, "sketch_links", lambda *a, **how: made.append(links(*a, **how)) or made[-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want
    assert sum(x.count() for x in made) <= 96 * len(texts)  # a forest of each trie; all pairs are 124,750


def test_chunks_of_a_dense_group_decide_all_pairs(spark, dense):
    texts, want = dense
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for how in ({"chunk_rows": 130}, {"chunk_shingles": 20_000}):
        assert {r["id"]: r["component_id"] for r in near_copies.near_copies(docs, **how).collect()} == want
