"""SimHash near-dedup at a similarity: texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

One fingerprint can't say it: at five words and 0.8 two texts differ in some ten of 64 bits, give or take three. So a text has
``WORDS`` fingerprints by independent hashes, the tries of ``simhash`` join them within a wide error budget, and the texts so
linked are candidates, which are decided by their shingles themselves. A pair of similarity
0.8 shares a block of bits with a chance of 0.15 to 0.07 a trie and misses all tries less than once in a thousand times;
at 0.9 once in some ten million.

Texts of one set are one node. The forests of the tries, which are in proportion to the texts, tie the nodes into groups, and every link
of the tries lies inside one (where texts are equal in a trie's word, their links count as the first one's). A group goes to a task as it is,
in chunks if it is large, and there its pairs are decided; only a forest of the links found comes out. So neither a dense group of
true copies nor one of texts just under the similarity makes rows for its pairs. In a task neighbours by each fingerprint are decided first, which joins most of a group;
after that all pairs of different components, so that no pair is left undecided but those whose answer can't change a component.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.graph import connected_components

from .common import fresh, joined_hot, map_arrow, map_texts, slices, stage
from .simhash import _united, sketch_links

SEED, WORDS = 42, 24
MOST_APART = 295  # of all 1536 bits; two texts of similarity 0.8 differ in 233, give or take 14
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
#: Of each byte, its bits in eight lanes of a byte: sums of up to 255 of them count eight bits at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: str | None, size: int = 5) -> set[bytes]:
    """The distinct word shingles of ``simhash.fingerprint``: a text of fewer words is one, without a word there is none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def sketch(h: np.ndarray) -> np.ndarray:
    """``WORDS`` SimHash fingerprints of a set of 64-bit hashes: a bit is 1 if set in over half of the set."""
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(h), 255):
        x = (h[at : at + 255, None] ^ _XOR) * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        counts += _LANES[x.view(np.uint8)].sum(0).view(np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def _nodes(size: int, field: pa.DataType):
    """(id, th, text) -> (id, th, node, n, words): ``node`` is a hash of the whole set, ``n`` its size."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh64_intdigest
        for b in batches:
            node, n, words = [], [], []
            for at, m in slices(b.column(2)):
                for t in b.column(2).slice(at, m):
                    own = shingles(t.as_py(), size)
                    h = np.sort(np.fromiter((hashed(s, SEED) for s in own), np.uint64, len(own)))
                    node.append(hashed(h.tobytes(), SEED))
                    n.append(len(own))
                    words.append(sketch(h))
            flat = pa.array(np.concatenate(words).view(np.int64)) if words else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * WORDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists], ["id", "th", "node", "n", "words"])

    return run


def _united_group(mine: np.ndarray, words: np.ndarray, sets: list[set], similarity: float, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a forest of the links between sets that are alike.

    If ``mine`` has two values, the rest within each may be left to other tasks. About ``most`` pairs are held at a time.
    """
    n = np.array([len(x) for x in sets], np.int64)
    # What two texts share is in both, so it is no more than the lesser has in common with any other of them.
    times = Counter(itertools.chain.from_iterable(sets))
    shared = np.array([sum(times[k] > 1 for k in x) for x in sets], np.int64)
    label = np.arange(len(sets))

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        return sizes & (label[i] != label[j]) & ((1 + similarity) * np.minimum(shared[i], shared[j]) >= similarity * (n[i] + n[j]) - 1e-9)

    def decide(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        apart = np.zeros(len(i), np.int64)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[i, k] ^ words[j, k])
        near = np.flatnonzero(apart <= MOST_APART)
        near = near[np.argsort(apart[near], kind="stable")]
        for cut in range(0, len(near), 1024):  # the nearest first: most of the others are united then
            a, b = i[near[cut : cut + 1024]], j[near[cut : cut + 1024]]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            both = np.array([len(sets[x] & sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
            alike = both >= similarity * (n[a] + n[b] - both) - 1e-9
            label = _united(label, a[alike], b[alike])

    for k in range(words.shape[1]):
        order = np.argsort(words[:, k], kind="stable")
        i, j = order[:-1], order[1:]
        able = possible(i, j)
        decide(i[able], j[able])
    # The largest component goes first: none of its own pairs is looked at.
    m = np.bincount(label, minlength=len(label))
    order = np.lexsort((label, -m[label]))
    across, at = mine.min() != mine.max(), int(m.max())
    while at < len(order):
        to = min(len(order), at + max(1, most // len(order)))
        rows, cols = order[at:to][:, None], order[None, :to]
        open_ = possible(rows, cols) & (np.arange(to)[None, :] < np.arange(at, to)[:, None])
        if across:
            open_ &= mine[rows] != mine[cols]
        i, j = np.nonzero(open_)
        decide(order[at + i], order[j])
        at = to
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _united_groups(size: int, similarity: float):
    """Tasks' rows (key, mine, node, words, text), in order of the key -> (u, v): links of nodes that unite what is alike in a key."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node = t.column("node").to_numpy()
        words = t.column("words").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        number: dict[bytes, int] = {}
        sets = [{number.setdefault(s, len(number)) for s in shingles(x.as_py(), size)} for x in t.column("text")]
        i, j = _united_group(t.column("mine").to_numpy(), words, sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else []
            for at, to in itertools.pairwise(cuts):
                if held and held[0].column(0)[0].as_py() != key[at]:
                    yield links(held)
                    held = []
                held.append(b.slice(at, to - at))
        if held:
            yield links(held)

    return run


def _links_in_groups(groups: DataFrame, first: DataFrame, slim: DataFrame, size: int, similarity: float, chunk_rows: int, chunk_shingles: int) -> DataFrame:
    """(u, v) that unite the nodes of each group (node, group) by all links in it.

    A group above ``chunk_rows`` nodes or ``chunk_shingles`` shingles is dealt into chunks, and each pair of chunks is a task's unit.
    """
    of = stage(groups.join(first.select("node", "n", "th"), "node"))
    sizes = of.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sizes = stage(sizes.select("group", "rows", F.ceil(F.greatest(F.col("rows") / chunk_rows, F.col("n") / chunk_shingles)).cast("long").alias("chunks")))
    of = joined_hot(of.drop("n"), sizes, "group", "rows", of.count())
    texts = slim.join(of.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))
    of = of.join(first.select("node", "words"), "node").join(texts, "th")
    of = of.withColumn("mine", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    of = of.withColumn("key", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")))
    tasks = of.select("key", "mine", "node", "words", "text").repartition("key").sortWithinPartitions("key")
    return stage(map_arrow(tasks, _united_groups(size, similarity), "u long, v long"))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _whole(roots: DataFrame) -> DataFrame:
    """(node, root) with a row for each root too."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, chunk_rows: int = 4_000, chunk_shingles: int = 500_000) -> DataFrame:
    """One row for each row of ``df``: (id, th, group, component_id), a name of its component and the smallest id in it.

    ``th`` is xxhash64 of the text. Null and wordless texts have one empty set and are copies of each other. Null ids
    never become a component_id unless no id is there. Other columns are not read. Empty in, empty out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    slim = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    prints = stage(map_texts(slim, _nodes(shingle, to_arrow_type(kind)), f"id {kind.simpleString()}, th long, node long, n long, words array<long>"))
    first = prints.groupBy("node").agg(F.min("id").alias("first"), F.min("th").alias("th"), F.min("n").alias("n"), F.first("words").alias("words"), F.count("*").alias("rows"))
    first = stage(first)
    sketches = first.where("n > 0").select("node", "words")
    forest = stage(_distinct(sketch_links(sketches, WORDS)))
    roots = None
    if not forest.isEmpty():
        groups = _whole(connected_components(forest)).select("node", F.col("root").alias("group"))
        links = _links_in_groups(groups, first, slim.select("th", "text"), shingle, similarity, chunk_rows, chunk_shingles)
        if not links.isEmpty():
            roots = connected_components(links)
    member = first.select("node", "rows", F.col("node").alias("group"), F.col("first").alias("component_id"))
    if roots is not None:
        # Only nodes that are alike others have a group; the nodes of one are few beside its rows.
        linked = first.select("node", "first").join(_whole(roots), "node")
        least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        least = stage(linked.select("node", "root").join(F.broadcast(least) if least.count() <= 1_000_000 else least, "root").select("node", F.col("root").alias("_root"), F.col("component_id").alias("_least")))
        member = member.join(least, "node", "left").select("node", "rows", F.coalesce("_root", "group").alias("group"), F.when(F.col("_root").isNotNull(), F.col("_least")).otherwise(F.col("component_id")).alias("component_id"))
    return joined_hot(prints.select("id", "th", "node"), stage(member), "node", "rows", prints.count()).select("id", "th", "group", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with one of each group of near copies: that of the smallest id.

    All columns stay. Rows without an id can't be named: they stay, unless their
    group has a row with an id. Rows that repeat id and text leave one; rows of one id with different texts
    stand each for itself, and the smallest hash of the text stays in a group.
    """
    found = near_copies(df, id_col, text_col, **how)
    th = fresh(df, "_th")
    named = df.where(F.col(id_col).isNotNull()).withColumn(th, F.xxhash64(F.col(text_col))).dropDuplicates([id_col, th])
    stay = found.where("id = component_id").groupBy(F.col("id").alias(id_col), "group").agg(F.min("th").alias(th)).drop("group")
    kept = named.join(stay, [id_col, th], "left_semi").drop(th)
    lone = found.where("id is null and component_id is null").select(F.col("th").alias(th)).distinct()
    unnamed = df.where(F.col(id_col).isNull()).withColumn(th, F.xxhash64(F.col(text_col))).join(lone, th, "left_semi").drop(th)
    return kept.unionByName(unnamed)
