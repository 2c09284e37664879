"""The operators of foliant.llm against brute force, round trips, held-out labels and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import ann, html_blocks, html_text, line_dedup, mixing, packing, quality_knn, quality_rules, queries, sharding, simhash, toxicity
from tests.oracle import connect, difference

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def words(t):
    return WORDS.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").cache()


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    rows = [(1, "a b c d e", "s"), (2, None, None), (3, "", "s"), (4, "x " * 30_000, "t"), (5, "a b c d e", None), (5, "a b c d e", None), (None, "a b c d e", "s"), (None, None, "t"), (8, "\n\n\n\n", "s"), (9, "Été " * 60 + "\n" + "z" * 5000, "u")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) == ""


# 1 ---------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array([prints[i] for i in ids], np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[k] ^ a[k + 1 :]) <= radius) + k + 1:
            x, y = find(ids[k]), find(ids[int(j)])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, plain):
    want = {i: slow_fingerprint(t) for i, t in plain.items()}
    comp = slow_components(want, 4)
    got = simhash.near_duplicates(docs).collect()
    assert {r["id"]: r["fp"] % (1 << 64) for r in got} == want
    assert {r["id"]: r["component_id"] for r in got} == comp


@pytest.mark.parametrize("subtrie_rows", [200_000, 40])
def test_trie_join_on_dense_prints(spark, subtrie_rows):
    r = random.Random(1)
    centre = r.getrandbits(64)
    prints = {i: r.getrandbits(64) for i in range(300)}
    for i in range(300, 900):
        x = centre
        for b in r.sample(range(64), r.randint(0, 9)):
            x ^= 1 << b
        prints[i] = x
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").withColumn("node", F.col("fp")), 4, subtrie_rows).collect()
    assert all((r["u"] ^ r["v"]).__and__((1 << 64) - 1).bit_count() > 0 for r in links)
    by = {v: v for v in prints.values()}

    def find(x):
        while by[x] != x:
            x = by[x]
        return x

    for e in links:
        a, b = find(e["u"] % (1 << 64)), find(e["v"] % (1 << 64))
        by[max(a, b)] = min(a, b)
    groups = slow_components({v: v for v in by}, 4)
    assert {v: find(v) for v in by} == groups


def test_simhash_odd(spark):
    got = [(r["id"], r["component_id"]) for r in simhash.near_duplicates(odd(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (5, 1), (5, 1), (None, 1), (2, 2), (3, 2), (None, 2), (8, 2), (4, 4), (9, 9)], key=str)
    assert simhash.near_duplicates(odd(spark).withColumn("fp", F.lit(1)).withColumn("first", F.lit("x"))).count() == 10
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    named = odd(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(str(r["component_id"]) for r in simhash.near_duplicates(named).collect()) == sorted(["d1"] * 4 + ["d2"] * 4 + ["d4", "d9"])
    lone = spark.createDataFrame([(None, "q w e r t"), (None, "q w e r t y u i"), (1, "something else entirely")], "doc_id long, text string")
    assert {(r["id"], r["component_id"]) for r in simhash.near_duplicates(lone).collect()} == {(None, None), (1, 1)}


# 2 ---------------------------------------------------------------------------------------------


def test_sharding(docs, plain):
    got = sharding.shard_records(docs, bucket_bytes=200_000).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in plain.items()}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert [r["text"] for r in got if r["doc_id"] == 7] == [plain[7]]


@pytest.mark.parametrize("buckets", [1, 7])
def test_order_does_not_depend_on_partitions(spark, docs, buckets):
    """The order is that of the buckets, each shuffled by itself: equal at any partitioning, a permutation of its bucket."""
    d = docs.unionByName(docs.where("doc_id % 10 = 3")).unionByName(docs.where("doc_id % 10 = 3"))
    size = d.selectExpr("sum(octet_length(coalesce(text, '')) + 8)").first()[0]
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = sharding.shard_records(d.repartition(n), bucket_bytes=-(-size // buckets)).select("doc_id", "shard", "slot").collect()
            seen.append(sorted((r["shard"], r["slot"], r["doc_id"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == d.count()
    assert sorted(i for _, _, i in seen[0]) == sorted(r[0] for r in d.select("doc_id").collect())
    again = [i for _, _, i in sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_records(d, seed=43, bucket_bytes=-(-size // buckets)).collect())]
    assert sum(a == b for a, (_, _, b) in zip(again, seen[0], strict=True)) < 30


def test_buckets_by_brute_force(spark, docs, plain):
    """Each bucket holds the rows of one residue of the hash; the buckets follow one another in the global order."""
    keys = docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", F.col("text").cast("binary")).alias("k"))
    size = sum(len(t.encode()) + 8 for t in plain.values())
    b = {r[0]: r[1] for r in keys.select("doc_id", F.pmod(F.xxhash64("k", F.lit(0).cast("long")), F.lit(5)).alias("b")).collect()}
    got = sharding.shard_records(docs, bucket_bytes=-(-size // 5)).collect()
    order = [b[r["doc_id"]] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order) and set(order) == set(range(5))


def test_a_hundred_thousand_repeats(spark):
    d = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words").alias("text"), F.lit("s").alias("source")).unionByName(spark.createDataFrame([(2, "b", "s"), (None, None, "s"), (None, None, "s")], DOCS))
    got = sharding.shard_records(d, bucket_bytes=100_000).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("u"), F.max("slot").alias("m")).collect()
    assert len(got) == 24 and all(r["n"] == r["u"] == r["m"] + 1 for r in got) and sum(r["n"] for r in got) == 100_003
    mixed = mixing.mix_sources(d.withColumn("source", (F.xxhash64(F.rand(3)) % 2 == 0).cast("string")))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r["t"] - r["w"]) <= 2


def test_sharding_odd(spark, tmp_path):
    d = odd(spark).withColumns({"slot": F.lit("clash"), "_h": F.lit("x"), "Row": F.lit("y"), "_bucket": F.lit(1)})
    assert {(r["_h"], r["Row"], r["_bucket"]) for r in sharding.shard_records(d).collect()} == {("x", "y", 1)}
    got = sharding.shard_records(d).collect()
    assert len(got) == 10 and all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == 10
    assert sharding.shard_records(d.limit(0)).count() == 0
    sharding.write_shards(sharding.shard_records(d, shards=3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10


# 3 ---------------------------------------------------------------------------------------------


def test_nearest_is_exact_here(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16))
    x[600:] = x[0]  # many equal vectors
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(d, F.col("vec_id") % 20 == 0, block_rows=150, query_rows=10).orderBy("rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = sorted(((-v, i) for i, v in enumerate(s) if i != q))[:20]
        assert np.allclose([-v for v, _ in want], [v for _, v in got[q]])
        if np.min(np.diff([v for v, _ in want])) > 1e-9:
            assert [i for _, i in want] == [i for i, _ in got[q]]
    equal = [i for i, v in got[0] if abs(v - x[0] @ x[0]) < 1e-9]
    assert equal == sorted(equal) and equal[0] == 600


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, []), (20, [2.0, 0.0]), (20, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit("x"))
    got = sorted(map(tuple, ann.nearest(d, F.col("vec_id") % 20 == 0).collect()))
    own = [[(1, 20, 2.0), (2, 20, 1.0), (3, 6, 0.5), (4, 6, 0.5)], [(1, 0, 2.0), (2, 20, 2.0), (3, 6, 1.0), (4, 6, 1.0)], [(1, 20, 2.0), (2, 0, 1.0), (3, 6, 1.0), (4, 6, 1.0)]]
    assert got == sorted((q, *x) for q, rows in zip((0, 20, 20), own, strict=True) for x in rows)
    assert ann.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_skipped_where_vectors_lie_in_clusters(spark):
    """Far clusters are never visited, and nothing is lost by it."""
    r = np.random.default_rng(5)
    centre = r.normal(size=(30, 24)) * 4
    x = np.concatenate([c + r.normal(size=(60, 24)) * 0.05 for c in centre])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(d, F.col("vec_id") % 20 == 0, block_rows=60, query_rows=20).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    for q in range(0, 1800, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s, kind="stable")[:20].tolist())
    c = ann.centroids(x, 30, 42)
    near = ann._nearest(x, c)
    radius = {24: {int(k): float(np.linalg.norm(x[near == k] - c[k], axis=1).max()) for k in np.unique(near)}}
    floor = np.sort(x[::20] @ x.T, axis=1)[:, -21]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(90)), pa.array(x[::20].tolist()), pa.array(floor)], ["row", "v", "floor"])
    assert sum(b.num_rows for b in ann._visits({24: c}, radius, 2, True)([batch])) < 90 * 3  # of 30 blocks each


# 4, 5 ------------------------------------------------------------------------------------------


def slow_window(text, at=0):
    """Feature vector of the window of a text that begins at its ``at``-th letter, by the kernel's definition."""
    import itertools

    plain = re.sub(r"[\W_]+", " ", f" {text} ".lower()).split(" ")
    pieces = ""
    for k, w in enumerate(plain):
        pieces += ("" if k and len(w) == 1 and len(plain[k - 1]) == 1 else " " * bool(k)) + w
    letters = [toxicity.number_of(c) for c in pieces]
    out = {}
    for first in range(at, min(at + toxicity.WINDOW, len(letters))):
        for places in itertools.combinations(range(first + 1, min(first + toxicity.SPAN, len(letters))), toxicity.N - 1):
            u = tuple(letters[i] for i in (first, *places))
            if toxicity.GAP not in u[1:-1]:
                out[u] = out.get(u, 0.0) + toxicity.DECAY ** (places[-1] - first + 1)
    return out


def dot(a, b):
    return sum(v * b.get(u, 0.0) for u, v in a.items())


def test_kernel_by_brute_force():
    """Kernels of whole sentences' windows with landmark sentences, and a machine's values, against the definition."""
    sentences = ["you are an idixot, sir", "what a m o r o n", "the quiet river walks on", "la la la la la la", "idiot", "un été très déçu!", "x"]
    codes = toxicity.window_codes(*toxicity.streams(sentences))
    marks = toxicity.Landmarks(codes[:5])
    slow = [slow_window(t) for t in sentences]
    length = [dot(v, v) ** 0.5 for v in slow]
    want = np.array([[dot(v, u) / n / max(1.0, m / toxicity.PLAIN) for u, n in zip(slow[:5], length, strict=False)] for v, m in zip(slow, length, strict=True)])
    assert np.allclose(marks.kernels(codes), want, atol=1e-4)
    alpha = np.array([1.0, -0.5, 0.25, 0.7, 2.0])
    machine = toxicity.Machine(marks.table(alpha), bias=-1.5)
    texts = ["an idiot walks", "la la la la la la la la la la la la idiot la la la", "", "m.o.r.o.n and more", "quiet"]
    best = []
    for t in texts:
        values = []
        for at in range(len(toxicity.streams([t])[0]) - toxicity.WINDOW if t else 0):
            v = slow_window(t, at)
            raw = sum(a * dot(v, u) / n for a, u, n in zip(alpha, slow, length, strict=False))
            values.append(raw / max(1.0, dot(v, v) ** 0.5 / toxicity.PLAIN) if raw > 0 else raw)
        best.append(max(values, default=0.0) - 1.5)
    assert np.allclose(machine.of_texts(pa.array(texts)), best, atol=1e-4)


FILLER = ["the", "and", "river", "stone", "walks", "green", "morning", "letter", "window", "quiet", "table", "seven"]


def marked(words_, n=240, seed=2):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = [r.choice(FILLER) for _ in range(30)]
        if k % 3 == 0:
            w.insert(r.randrange(30), r.choice(words_))
        out.append((" ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_tolerates_gaps():
    machine = toxicity.train(marked(["idiot", "moron", "scumbag"]))
    texts = ["you are an idixot here", "quiet i.d.i.o.t table", "green m o r o n walks", "table s-c-u-m-b-a-g", "scumbagz river", "the river walks", "seven green windows and a stone", "", None, "..."]
    p = machine.probability(machine.of_texts(pa.array(texts, pa.string())))
    assert (p[:5] > 0.5).all() and (p[5:] < 0.5).all()


@pytest.mark.parametrize("word", ["zq", "abominationofunspeakableignorance", "\u0434\u0443\u0440\u0430\u043a"])
def test_short_long_and_foreign_words_are_learnt(word):
    machine = toxicity.train(marked([word]))
    held = marked([word], seed=3)
    p = machine.probability(machine.of_texts(pa.array([t for t, _ in held])))
    assert all((v >= 0.5) == bool(y) for v, (_, y) in zip(p, held, strict=True))


def test_held_out_quality_and_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, label, least in (("op5_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.8)):
        got = queries.QUERIES[name](spark, sf_dir)
        assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1").count() == 0
        rows = got.where("held_out").join(labels, "doc_id").select("score", label).collect()
        pos, neg = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
        auc = np.mean([[(a > b) + 0.5 * (a == b) for b in neg] for a in pos])
        assert auc >= least


def test_scores_odd(spark):
    d = odd(spark).withColumn("toxicity", F.lit("clash")).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for got, c in ((toxicity.score_toxicity(d, labels), "toxicity"), (quality_knn.score_quality(d, labels), "quality")):
        assert got.count() == 10 and got.where(f"{c} between 0 and 1").count() == 10
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(d, labels).where("toxicity >= 0.5 and coalesce(trim(text), '') = ''").count() == 0
    assert quality_knn.score_quality(d, labels.limit(0)).where("quality = 0").count() == 10
    assert toxicity.score_toxicity(d, labels.limit(0)).count() == 10


def test_votes_by_brute_force():
    r = random.Random(4)
    sample = [(" ".join(r.choice(["ab", "Cd", "x1", "%%%", "lorem", "IPSUM!!"]) for _ in range(r.randint(3, 40))), r.randint(0, 1)) for _ in range(80)]
    m = quality_knn.train(sample, dim=8, k=5)
    texts = pa.array([t for t, _ in sample[:20]] + ["", None], pa.string())
    x = m.latent(texts)
    for v, got in zip(x, m.vote(texts), strict=True):
        c = np.array([round(float(sum(a * b for a, b in zip(u, v, strict=True))), 12) for u in m.vectors])
        best = sorted(range(len(c)), key=lambda i: (-c[i], i))[:5]
        w = [max(c[i], 0.0) ** m.power for i in best]
        want = sum(a * m.y[i] for a, i in zip(w, best, strict=True)) / sum(w) if sum(w) else 0.0
        assert got == pytest.approx(want, abs=1e-9)


def test_vote_ties_go_to_the_first():
    sample = [("ab cd", 1), ("ab cd", 0), ("ab cd", 0), ("zz yy", 1)]
    assert quality_knn.train(sample, dim=3, k=2).vote(pa.array(["ab cd"]))[0] == pytest.approx(0.5)
    assert quality_knn.train(sample, dim=3, k=1).vote(pa.array(["ab cd"]))[0] == pytest.approx(1.0)


def test_long_shapes_stay_apart():
    assert quality_knn.shape("a1" * 10) != quality_knn.shape("a1" * 10 + "%")


# 6, 8 ------------------------------------------------------------------------------------------


def test_shared_lines(spark):
    def own(i, n):
        return " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))

    body = [own(i, 40) for i in range(60)]
    rows = [(i, f"{body[i]}\nSubscribe   NOW to our letter!\n{'more words here ' * 6}", "h") for i in range(60)] + [(100 + i, "Subscribe now, to our letter\n" * 12 + own(100 + i, 30), "h") for i in range(3)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r for r in quality_rules.apply_rules(d, most=20, share=0.0).collect()}
    assert all(got[i]["shared_words"] == 5 + 18 for i in range(60)) and all(got[i]["kept"] for i in range(60))
    assert all(got[100 + i]["shared_words"] == 60 and not got[100 + i]["kept"] for i in range(3))
    assert quality_rules.apply_rules(d, most=20, share=0.0).where("shared_words > 0").count() == 63
    other = quality_rules.apply_rules(d.withColumn("source", F.lit(None).cast("string")), most=100, share=0.0)
    assert other.where("shared_words > 0").count() == 0


def test_repeated_rows_are_one_document(spark, tmp_path):
    """One document sixty times is one; the SQL agrees on repeated rows."""
    r = random.Random(7)
    common = ["join our list today please and thank you all", "subscribe to the letter of the house now", "only two of us say this line here"]
    rows = [(7, "\n".join([common[2], *(f"own{k} words{k} of{k} a{k} single{k} text{k}" for k in range(12))]), "h")] * 60
    for i in range(100, 300):
        body = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 999)) for _ in range(8)) for _ in range(6)]
        rows += [(i, "\n".join([*body, *r.sample(common[:2], 1)]), r.choice(["h", "h", "h", "g"]))] * r.choice([1, 1, 3])
    d = spark.createDataFrame(rows, DOCS)
    got = quality_rules.apply_rules(d)
    assert got.where("id = 7 and (shared_words > 0 or not kept)").count() == 0 and got.where("shared_words > 0").count() > 50
    d.write.parquet(str(tmp_path / "documents.parquet"))
    d.toPandas().to_parquet(tmp_path / "one.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT DISTINCT * FROM read_parquet('{tmp_path}/one.parquet')")
    assert difference(quality_rules.op6_quality_rules(spark, str(tmp_path)).distinct(), con, quality_rules.OP6_SQL) == ""
    unnamed = spark.createDataFrame([(None, f"{common[0]}\n{'x y z ' * k}", "h") for k in range(60)] + [(None, common[1], "h")] * 60, DOCS)
    shared = quality_rules.apply_rules(unnamed)
    assert shared.where("shared_words = 9").count() == 60 and shared.where("shared_words = 0").count() == 60


def test_measures_by_brute_force():
    r = random.Random(6)
    for _ in range(200):
        t = "".join(r.choice("ab #é\n\t%|") for _ in range(r.randint(0, 60)))
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        assert quality_rules.measures(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
    assert quality_rules.measures(None) == (0,) * 5


def test_rules_and_lines_odd(spark):
    d = odd(spark).withColumn("kept", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumns({"_lines": F.lit("x"), "_id": F.lit("y"), "th": F.lit(1), "starts": F.lit(2)})
    got = quality_rules.apply_rules(d).collect()
    assert len(got) == 10 and not any(r["kept"] for r in got if r["id"] != 9)
    assert quality_rules.apply_rules(d.limit(0)).count() == 0
    same = line_dedup.dedup_lines(d)
    assert same.count() == 10 and same.where("n_removed > 0 or _lines <> 'x' or _id <> 'y' or th <> 1 or starts <> 2").count() == 0
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_line_windows(spark):
    block = "one\ntwo\nthree\nfour"
    rows = [(1, block + "\nA", "s"), (2, "B\n" + block + "\nC", "s"), (3, "two\nthree", "s"), (4, block + "\n" + block, "s"), (None, block, "s"), (6, "\n\n\n\n\n\n", "s"), (7, None, "s")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (block + "\nA", 5, 0), 2: ("B\nC", 6, 4), 3: ("two\nthree", 2, 0), 4: ("", 8, 8), None: ("", 4, 4), 6: ("\n" * 6, 7, 0), 7: (None, 0, 0)}


# 7 ---------------------------------------------------------------------------------------------


def slow_bins(lengths, capacity):
    """Best-two-fit, document by document."""
    left = sorted(lengths)
    bins = []
    while left:
        bin_, gap = [], capacity
        while True:
            fit = [x for x in left if x <= gap]
            if not fit:
                break
            left.remove(fit[-1])
            bin_.append(fit[-1])
            gap -= fit[-1]
        if gap > 0 and len(bin_) > 1:
            s = bin_[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if s < a + b <= gap + s]
            if pairs:
                best = max(p[0] for p in pairs)
                _, a, b = min((p for p in pairs if p[0] == best), key=lambda p: min(p[1], p[2]))
                left.remove(a)
                left.remove(b)
                bin_ = bin_[:-1] + [a, b]
                left = sorted([*left, s])
        bins.append(sorted(bin_, reverse=True))
    return bins


def test_bins_like_one_by_one():
    r = random.Random(8)
    for _ in range(60):
        lengths = [r.randint(1, 30) for _ in range(r.randint(1, 60))]
        counts = {x: lengths.count(x) for x in lengths}
        got = [b for times, b in packing.best_two_fit(counts, 30) for _ in range(times)]
        assert sorted(x for b in got for x in b) == sorted(lengths) and all(sum(b) <= 30 for b in got)
        assert len(got) == len(slow_bins(lengths, 30))


def test_packing_round_trip(docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_sequences(docs, with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["id"], {})[r["start"]] = r
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, text in plain.items():
        parts = [by_doc[i][s] for s in sorted(by_doc[i])]
        assert [x for p in parts for x in p["ids"]] == [*t.encode(text, add_special_tokens=False).ids, 0]
        assert [p["piece"] for p in parts] == list(range(len(parts))) and all(p["length"] == 2048 for p in parts[:-1])
    for b in by_bin.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for b in by_bin.values() for _, n in b)
    assert len(by_bin) <= total / 2048 * 1.01 + 1


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokens(packing.default_tokenizer(), most=500)
    r = random.Random(9)
    letters = "aBcİıΣσßéÉñÇ'`.,!%#019 \t\n\x0b\x1c\x85  　ไทยก็中文🙂éÅ|<>s't're"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["it's WE'RE 'S <|endoftext|> a<|startoftext|>b", "", None, "x" * 5000]
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        flat, cut = own(pa.array(part, pa.string()))
        for text, a, b in zip(part, cut, cut[1:], strict=False):
            assert list(flat[a:b]) == t.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    import pathlib

    folder = pathlib.Path(packing.default_tokenizer()).parent
    others = [p for p in folder.glob("*.json") if p.name != "word_bpe_49k.json"]
    refused = 0
    for p in others:
        try:
            packing.WordTokens(str(p))
        except ValueError:
            refused += 1
        except Exception:  # not a tokenizer's file
            refused += 1
    assert refused == len(others)


def test_packing_odd(spark):
    d = odd(spark).withColumn("length", F.lit("clash"))
    got = packing.pack_sequences(d).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sorted(r["length"] for r in got if r["id"] in (2, 3, 8)) == [1, 1, 1]
    assert sum(r["length"] for r in got if r["id"] == 4) == 30_001
    assert packing.pack_sequences(d.limit(0)).count() == 0


# 9 ---------------------------------------------------------------------------------------------


def slow_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in fixed)
        live = [s for s in names if s not in fixed]
        for s in live:
            target[s] = rest * weight[s] / sum(weight[x] for x in live)
        over = [s for s in live if target[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in fixed else target[s] for s in names}
        fixed |= set(over)


def test_mixing(spark):
    r = random.Random(10)
    rows = []
    for i in range(3000):
        s = r.choices(["a", "b", "c", "d", "é", None], [40, 5, 1, 30, 20, 4])[0]
        rows.append((i, " ".join(["w"] * r.choice([0, 3, 20, 50, 400])), s))
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(d).collect()
    sizes, taken = {}, {}
    for row in got:
        assert row["size"] == len(words(row["text"])) and row["taken"] == row["copies"] * row["size"] and row["copies"] <= 3
        sizes[row["source"]] = sizes.get(row["source"], 0) + row["size"]
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    want = slow_targets(sizes)
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and row["target"] == pytest.approx(want[row["source"]])
    assert all(abs(taken[s] - want[s]) <= 400 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(d.repartition(5)).collect()))


def slow_copies(sizes, target, most=3):
    """Expected copies by bisection for the level."""
    w = {n: mixing.TILT + n.bit_length() for n in sizes}
    lo, hi = 0.0, float(most)
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(most, c * w[n]) * n for n in sizes) < target else (lo, c)
    return {n: min(most, lo * w[n]) for n in sizes}


def test_mixing_by_brute_force(spark):
    """Every document's copies by plain Python: certain ones, and Pareto's order for the rest."""
    import hashlib

    r = random.Random(12)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 20, 50, 400, 1500])), r.choices(["a", "b", "c", "d"], [6, 4, 1, 9])[0]) for i in range(1500)]
    got = {x["doc_id"]: x["copies"] for x in mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    size = {i: len(words(t)) for i, t, _ in rows}
    totals = {s: sum(size[i] for i, _, x in rows if x == s) for s in "abcd"}
    targets = slow_targets(totals)
    for s in "abcd":
        docs = [(i, t) for i, t, x in rows if x == s and size[i]]
        want = slow_copies([size[i] for i, _ in docs], targets[s])
        base = {i: int(want[size[i]] + 1e-9) for i, _ in docs}
        rest = targets[s] - sum(base[i] * size[i] for i, _ in docs)

        def rank(d):
            u = int(hashlib.md5(f"42|{d[0]}|{hashlib.md5(d[1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
            p = want[size[d[0]]] - base[d[0]]
            return (u / (1 - u)) / (p / (1 - p))

        upto = 0
        for d in sorted((d for d in docs if want[size[d[0]]] - base[d[0]] > 1e-7), key=rank):
            upto += size[d[0]]
            base[d[0]] += upto - size[d[0]] / 2 <= rest
        assert all(got[i] == n for i, n in base.items())
    assert all(got[i] == 0 for i, n in size.items() if not n)


def test_inclusion_rates(spark):
    """Over many seeds, a document is taken about as often as its expected copies say, which differ from length to length."""
    r = random.Random(13)
    rows = [(i, " ".join(["w"] * r.choice([2, 30, 500])), r.choice(["a", "b", "b"])) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS).coalesce(1).cache()
    size = {i: len(words(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    seeds, seen = 24, {}
    for seed in range(seeds):
        for x in mixing.mix_sources(d, seed=seed).collect():
            seen[x["doc_id"]] = seen.get(x["doc_id"], 0) + x["copies"]
    totals = {s: sum(n for i, n in size.items() if source[i] == s) for s in "ab"}
    targets = slow_targets(totals)
    spread = set()
    for s in "ab":
        want = slow_copies([n for i, n in size.items() if source[i] == s], targets[s])
        for n in (2, 30, 500):
            docs = [i for i in size if source[i] == s and size[i] == n]
            assert abs(sum(seen[i] for i in docs) / len(docs) / seeds - want[n]) < 0.06
            spread.add(round(want[n] % 1, 3))
    assert len(spread) >= 3


def test_mixing_odd(spark):
    d = odd(spark).withColumns({"SIZE": F.lit("clash"), "_key": F.lit("x"), "_source": F.lit("y"), "_rank": F.lit(1)})
    assert {(r["_key"], r["_source"], r["_rank"]) for r in mixing.mix_sources(d).collect()} == {("x", "y", 1)}
    assert mixing.mix_sources(d).where("copies between 0 and 3").count() == 10
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "x")], DOCS)).where("taken = 0 and target = 0").count() == 2


# 10 --------------------------------------------------------------------------------------------


def test_blocks_of_labelled_pages():
    c = html_blocks.Contexts()
    for seed in range(150):
        page, labels = html_blocks.labelled_page(seed)
        assert [b[0] for b in html_blocks.blocks(page, c)] == [t for t, _ in labels]


def test_crf_on_held_out_pages():
    m = html_text.default_field()
    wrong = total = 0
    for seed in range(20_000, 20_100):
        page, labels = html_blocks.labelled_page(seed)
        got = m.decode([m.margins(html_blocks.blocks(page, m.contexts))])[0]
        wrong += sum(int(a != b) for a, (_, b) in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.03


def test_viterbi_by_brute_force():
    import itertools

    m, r = html_text.default_field(), np.random.default_rng(3)
    pages = [r.normal(size=n).tolist() for n in (1, 2, 5, 8, 0)]
    for margins, got in zip(pages, m.decode(pages), strict=True):
        def score(y):
            return sum(v * x for v, x in zip(margins, y, strict=True)) + (m.start[y[0]] + m.end[y[-1]] if y else 0) + sum(m.move[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product([0, 1], repeat=len(margins)), key=score)
        assert tuple(got) == best


def test_html_odd(spark):
    page = "<html><head><title>T</title><script>if (a < b) {'<p>no</p>'}</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First  line\n of text, and more of it here.<p>Caf&eacute; &#233; is open.</article><footer>&copy; 2024</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 50_000 + "."), (5, "u", "<<<>>><p class='x"), (6, "u", "<" * 5000), (1, "u", page)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_text.extract_text(d, keep=["page_id", "url"]).collect()}
    assert got[1]["text"] == "A & B\n\nFirst line of text, and more of it here.\n\nCafé é is open." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 6
    assert html_text.extract_text(d.limit(0)).count() == 0
