"""Near-duplicate groups: SimHash fingerprints joined by a binary trie.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. The join
walks pairs of trie nodes together, adds up the bits in which their paths
differ, and drops a pair as soon as the sum is above the radius.

To spread the trie over a cluster, it is built ``radius + 1`` times with the
bits rotated, so that each block of bits is on top once: two fingerprints within
the radius agree in at least one block. All that share a top block
form one subtrie and go to one task. Equal fingerprints are one leaf, so copies
cost nothing here. A subtrie above ``subtrie_rows`` leaves is dealt
into chunks, and every pair of chunks is a task, so no task holds more
than twice that. From each subtrie only a spanning forest of its links goes out:
all that components need, and never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.graph import connected_components

from .common import joined_hot, map_arrow, map_texts, read, slices, stage

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of the text's word shingles; 0 without a word.

    A-Z become lower case, words are runs of characters outside space and
    tab..CR, shingles are joined by one space and hashed by XXH64 with seed 42,
    repeats included. A text of fewer words is one shingle.
    """
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n, hashed = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - shingle + 1], ends[shingle - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], SEED) for a, b in part], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int, field: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t for at, n in slices(b.column(1)) for t in b.column(1).slice(at, n).to_pylist())
            out = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64), pa.int64())], ["id", "fp"])

    return run


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each index's smallest known companion) after linking i to j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def trie_forest(value: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int, more: np.ndarray | None = None, budget: int = 0, most: int = 1 << 20) -> np.ndarray:
    """Labels of a spanning forest of all links inside each root range.

    With ``more`` bits, another word for each value, two values link if they differ in ``radius`` bits at most and in
    ``budget`` bits of both words together.

    ``value``: uint64, ascending and distinct inside each range [start, end), a
    trie in itself: a node of depth d is the run of values with one d-bit prefix.
    Node pairs advance level by level; at most about ``most`` pairs are held at a
    time, the rest waits on a stack.
    """
    label = np.arange(len(value))
    stack = [(0, start, end, start, end, np.zeros(len(start), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > most:
            half = len(a0) // 2
            for cut in (slice(0, half), slice(half, None)):
                stack.append((depth, a0[cut], a1[cut], b0[cut], b1[cut], err[cut]))
            continue
        small = (a1 - a0) * (b1 - b0) <= (64 if depth < 60 else 256)
        label = _leaf_links(value, label, a0[small], a1[small], b0[small], b1[small], radius, more, budget, most)
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        ones = np.concatenate([[0], np.cumsum((value >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        rest = ~same
        kids = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            (am[rest], a1[rest], b0[rest], bm[rest], err[rest] + 1),
        ]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        live = (err <= radius) & (a1 > a0) & (b1 > b0)
        stack.append((depth + 1, a0[live], a1[live], b0[live], b1[live], err[live]))
    return label


def _leaf_links(value, label, a0, a1, b0, b1, radius: int, more, budget: int, most: int) -> np.ndarray:
    pairs = (a1 - a0) * (b1 - b0)
    whole = np.cumsum(pairs)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + most, "right")))
        n = pairs[at:to]
        which = np.repeat(np.arange(at, to), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[which]
        i, j = a0[which] + k // wide, b0[which] + k % wide
        apart = np.bitwise_count(value[i] ^ value[j])
        near = (i < j) & (apart <= radius)
        if more is not None:
            near &= apart + np.bitwise_count(more[i] ^ more[j]) <= budget
        label = _united(label, i[near], j[near])
        at = to
    return label


def _forest(radius: int, rows: int, budget: int = 0):
    """Tasks' rows (task key, rotated fingerprint, node, perhaps another word), in order of the key -> edges of nodes."""

    def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key, rot = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
        more = t.column(3).to_numpy().view(np.uint64) if t.num_columns > 3 else None
        order = np.lexsort((rot, key))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (rot[order][1:] != rot[order][:-1])
        # Equal leaves of a subtrie are linked to their first, which alone goes on.
        first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        twins, firsts = order[~fresh], first[~fresh]
        order = order[fresh]
        key, rot = key[order], rot[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        label = trie_forest(rot, cut, np.append(cut[1:], len(key)), radius, None if more is None else more[order], budget)
        if budget:
            # Stars around the smallest node: tries of the same group give many of the same links.
            node = t.column(2).to_numpy()
            least = node[order].copy()
            np.minimum.at(least, label, node[order])
            u = np.concatenate([node[order], node[twins]])
            v = np.concatenate([least[label], least[label][np.cumsum(fresh) - 1][~fresh]])
            return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])
        linked = np.flatnonzero(label != np.arange(len(label)))
        node = t.column(2).combine_chunks()
        node = node.chunk(0) if isinstance(node, pa.ChunkedArray) else node
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate([order[linked], twins]))), node.take(pa.array(np.concatenate([order[label[linked]], firsts])))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                last = b.column(0)[-1].as_py()
                done = int(np.searchsorted(b.column(0).to_numpy(), last))  # in order of the key
                if done or held[0].column(0)[0].as_py() != last:
                    sure = [x if x is not b else b.slice(0, done) for x in held]
                    open_ = [x.slice(int(np.searchsorted(x.column(0).to_numpy(), last))) for x in sure] + [b.slice(done)]
                    sure = [x.slice(0, int(np.searchsorted(x.column(0).to_numpy(), last))) for x in sure]
                    yield edges(sure)
                    held = [x for x in open_ if x.num_rows]
        if held:
            yield edges(held)

    return run


def _turned(word: Column, turn: int) -> Column:
    return F.shiftleft(word, turn).bitwiseOR(F.shiftrightunsigned(word, BITS - turn)) if turn else word


def _tops(word: Column, sizes: list[int], base: int) -> list[Column]:
    """One struct (rot, top) for each block of bits of a word: the word with that block on top, and the block with a number of its own."""
    out, turn = [], 0
    for size in sizes:
        rot = _turned(word, turn)
        out.append(F.struct(rot.alias("rot"), (F.shiftrightunsigned(rot, BITS - size) + F.lit(base)).alias("top")))
        turn, base = turn + size, base + (1 << size)
    return out


def _joined(leaves: DataFrame, radius: int, subtrie_rows: int, budget: int = 0) -> DataFrame:
    """``leaves`` (rot, top, node, perhaps more) -> (u, v): a spanning forest of the links of each subtrie.

    A subtrie above ``subtrie_rows`` leaves is dealt into chunks, and each pair of chunks is a task's unit.
    """
    # A top block with too many leaves is one of a few: there are at most leaves / subtrie_rows.
    hot = leaves.groupBy("top").count().where(F.col("count") > subtrie_rows)
    hot = stage(hot.select("top", F.ceil(F.col("count") / subtrie_rows).cast("long").alias("chunks")))
    if hot.isEmpty():
        tasks = leaves.withColumn("key", F.col("top"))
    else:
        leaves = leaves.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "top", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        mine = F.pmod(F.xxhash64("rot", "node"), F.col("chunks"))
        partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        tasks = leaves.withColumn("mine", mine).withColumn("other", partner)
        pair = F.xxhash64("top", F.least("mine", "other"), F.greatest("mine", "other"))
        tasks = tasks.withColumn("key", F.when(F.col("chunks") == 1, F.col("top")).otherwise(pair))
    tasks = tasks.select("key", "rot", "node", *["more"] * bool(budget)).repartition("key").sortWithinPartitions("key")
    kind = leaves.schema["node"].dataType.simpleString()
    return map_arrow(tasks, _forest(radius, max(subtrie_rows, 1), budget), f"u {kind}, v {kind}")


def fingerprint_links(prints: DataFrame, radius: int = 4, subtrie_rows: int = 200_000) -> DataFrame:
    """``prints`` (fp: distinct longs, node: any name of it) -> (u, v): edges of nodes whose components are those of all links."""
    blocks = radius + 1
    sizes = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    leaves = prints.select("node", F.explode(F.array(*_tops(F.col("fp"), sizes, 0))).alias("x")).select("x.*", "node")
    return _joined(leaves, radius, subtrie_rows)


def sketch_links(sketches: DataFrame, words: int, block: int = 16, radius: int = 20, budget: int = 34, subtrie_rows: int = 200_000) -> DataFrame:
    """``sketches`` (node, words: that many fingerprints by independent hashes) -> (u, v): links of a wider radius.

    Wide radii leave no block equal for sure, so each word is built into tries with each of its whole blocks of ``block`` bits on
    top, and a pair is found if any block agrees; it links if the word differs in ``radius`` bits at
    most and in ``budget`` bits together with the next word.
    """
    sizes = [block] * (BITS // block)
    each = sketches.select("node", "words", F.posexplode("words").alias("i", "word"))
    each = each.select("node", "i", "word", F.element_at("words", (F.col("i") + 1) % words + 1).alias("more"))
    leaves = each.select("node", "i", "more", F.explode(F.array(*_tops(F.col("word"), sizes, 0))).alias("x"))
    leaves = leaves.select("x.rot", (F.col("x.top") + F.col("i") * (len(sizes) << block)).alias("top"), "more", "node")
    return _joined(leaves, radius, subtrie_rows, budget)


def _component_ids(first: DataFrame, links: DataFrame) -> DataFrame:
    """``first`` (fp, first: the smallest id or null, n), ``links`` of its nodes -> (fp, n, component_id).

    Nodes are named by their smallest ids, those without an id last, so a component's root carries
    its id and no rows of a component meet.
    """
    roots = connected_components(links)
    roots = roots.select(F.col("node.fp").alias("fp"), F.col("root.first").alias("_least"), F.lit(True).alias("_linked"))
    return first.join(roots, "fp", "left").select("fp", "n", F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("first")).alias("component_id"))


def _node():
    return F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, subtrie_rows: int = 200_000) -> DataFrame:
    """One row for each row of ``df``: (id, fp, component_id).

    ``fp``: the signed 64-bit fingerprint; ``component_id``: the smallest id of its component. Null and
    wordless texts have fingerprint 0 and link like any other. Null ids are kept and
    never become a component_id unless no id is there. Repeated rows come out as
    often as they went in. Other columns are not read. Empty in, empty out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    prints = stage(map_texts(slim, _fingerprints(shingle, to_arrow_type(kind)), f"id {kind.simpleString()}, fp long"))
    first = stage(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    member = stage(_component_ids(first, fingerprint_links(first.select("fp", _node()), radius, subtrie_rows)))
    return joined_hot(prints, member, "fp", "n", prints.count()).select("id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
