"""The pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from foliant.llm import packing
from tests.llm.test_near_copies import slow_groups
from tests.llm.test_operators import marked, slow_copies, slow_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        out[name] = (docs, made)
        docs = made
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(staged):
    columns = staged["toxicity"][0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(made.columns == columns for name, (_, made) in staged.items() if name != "packing")


def test_toxicity_stage(spark, staged, tmp_path):
    given, made = staged["toxicity"]
    assert set(by_id(made)) <= set(by_id(given)) and all(r == by_id(given)[i] for i, r in by_id(made).items())
    # Which documents go is known where they are made: 300 labelled ones, and others with insults as learnt, gapped or with letters put in.
    docs = list(enumerate(t for t, _ in marked(["idiot", "moron", "scumbag", "halfwit"], 600)))
    labels = [(i, 1, int(i % 3 == 0)) for i, _ in docs]
    insults = ["idiot", "m o r o n", "s.c.u.m.b.a.g", "halfxwit", "MORON!", "idioot"]
    toxic = {1000 + i: f"the river {w} walks" for i, w in enumerate(insults)}
    clean = {2000 + i: t for i, t in enumerate(["the river walks", "a morning letter", "", None, "seven stone tables and a green window", "1234 5678"])}
    table = spark.createDataFrame([*docs, *toxic.items(), *clean.items()], "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r[0] for r in corpus_pipeline.drop_toxic(spark, table, str(tmp_path)).select("doc_id").collect()}
    assert kept == {i for i, _ in docs if i % 3} | set(clean)


def test_line_stage(staged):
    given, made = (by_id(x) for x in staged["line_dedup"])
    seen, gone = set(), {}
    for i in sorted(given):
        lines = given[i]["text"].split("\n")
        gone[i] = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if words("".join(w)):
                if w in seen:
                    gone[i] |= {k, k + 1, k + 2}
                seen.add(w)
    for i, r in given.items():
        want = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[i])
        assert made[i]["text"] == want and made[i]["n_chars"] == (len(want) if gone[i] else r["n_chars"])


def test_near_stage(staged):
    given, made = (by_id(x) for x in staged["near_dedup"])
    comp = slow_groups({i: r["text"] for i, r in given.items()})
    assert set(made) == {i for i, c in comp.items() if i == c} and all(made[i] == given[i] for i in made)


def test_mixing_stage(staged):
    given, made = staged["mixing"]
    given = by_id(given)
    copies = Counter(r["doc_id"] for r in made.collect())
    size = {i: len(words(r["text"])) for i, r in given.items()}
    source = {i: r["source"] for i, r in given.items()}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    targets = slow_targets(dict(sizes))
    for s in sizes:
        docs = [i for i in given if source[i] == s and size[i]]
        want = slow_copies([size[i] for i in docs], targets[s])
        whole = {i: int(want[size[i]] + 1e-9) for i in docs}
        rest = targets[s] - sum(whole[i] * size[i] for i in docs)

        def rank(i):
            text = hashlib.md5(given[i]["text"].encode()).hexdigest()
            u = int(hashlib.md5(f"42|{i}|{text}".encode()).hexdigest()[:13], 16) / 2**52
            p = want[size[i]] - whole[i]
            return (u / (1 - u)) / (p / (1 - p))

        upto = 0
        for i in sorted((i for i in docs if want[size[i]] - whole[i] > 1e-7), key=rank):
            upto += size[i]
            whole[i] += upto - size[i] / 2 <= rest
        assert all(copies[i] == whole[i] for i in docs)
    assert all(copies[i] <= 3 for i in copies) and all(size[i] for i in copies)


def test_packing_stage(staged):
    from tokenizers import Tokenizer

    given, made = staged["packing"]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in given.collect():
        n = len(t.encode(r["text"], add_special_tokens=False).ids) + 1
        for p, s in enumerate(range(0, n, 2048)):
            want[(r["doc_id"], p, s, min(2048, n - s))] += 1
    rows = made.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_all_stages(spark, staged):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, staged["packing"][1].collect()))


CLASHING = ["toxicity", "n_lines", "n_removed", "SIZE", "source_size", "target", "copies", "taken", "_copy", "copy", "others", "th", "_th", "group", "node", "row", "_row", "_key", "lines"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, "a b c d e f g h", "s", 15), (1, "a b c d e f g h", "s", 15), (2, None, None, None), (3, "", "s", 0), (None, "a  B c d e f g h", "s", 15), (None, None, "t", None), (4, "word " * 40_000, "t", 200_000), (5, "x\ny z\nw\nx\ny z\nw", None, 17), (6, "x\ny z\nw", "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return docs.select("*", *[docs["n_chars"].cast("string").alias(c) for c in CLASHING])


def test_stages_on_odd_tables(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns with the stages' own names."""
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, step in corpus_pipeline.STAGES:
        out[name] = got = step(spark, odd_docs, str(tmp_path))
        if name != "packing":
            assert got.columns == odd_docs.columns and got.dtypes == odd_docs.dtypes
            assert all(r[c] == (None if r["n_chars"] is None else str(r["n_chars"])) for r in got.collect() for c in CLASHING if name != "line_dedup")
        assert step(spark, odd_docs.limit(0), str(tmp_path)).count() == 0
    assert out["toxicity"].count() == 9
    lines = {(r["doc_id"], r["text"]): r["n_chars"] for r in out["line_dedup"].collect()}
    assert out["line_dedup"].count() == 9 and lines[(5, "x\ny z\nw")] == 7 and lines[(6, "")] == 0 and lines[(3, "")] == 0
    assert sorted((r["doc_id"] for r in out["near_dedup"].collect()), key=str) == [1, 2, 4, 5, 6]
    assert all(r["text"].split() for r in out["mixing"].collect())
    assert out["packing"].where("length > 2048").count() == 0 and out["packing"].where("doc_id = 4").agg({"length": "sum"}).first()[0] == 40_001


def test_used_stages_leave_no_folder(spark):
    from pathlib import Path

    from foliant.session import shared_folder

    made = Path(shared_folder(spark).removeprefix("file:"))
    corpus_pipeline.run(spark, SF)
    assert made.is_dir() and all([x.name for x in p.iterdir()] == ["packing"] for p in made.glob("pipeline-*"))
