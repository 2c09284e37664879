"""Nearest neighbours by randomly rotated one-bit codes, with blocks that a bound skips.

Vectors are dealt to the nearest of at most ``MOST_CENTROIDS`` centroids, which are fitted on a bounded sample. What is left of a vector
after its centroid is scaled to length 1, rotated by one random orthogonal matrix and kept as the
signs of its components, packed to bits, with two correction scalars: its length and the inner product
of the rotated vector with its own code (Gao and Long's RaBitQ). A query's inner product with a vector
is that with the centroid and an estimate from the bits; the part of the vector across its code enters with an unknown sign of known
scale, which bounds the error. Vectors whose upper bound
reaches the worst of a query's best exact products so far are reranked on the original vectors.

A query first visits the blocks of its ``probes`` most promising centroids. Their best products are a floor; after that it visits only those
other blocks whose bound, the product with the centroid plus the query's length times the block's radius, reaches
the floor. That bound holds for sure, so skipping loses nothing: where vectors lie in clusters most blocks are skipped, where they don't, none can be.
A centroid's vectors are dealt into blocks of about ``block_rows`` and its visits into runs of ``query_rows``; a pair of those is one task's unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read, stage

STEP = 2048
MOST_CENTROIDS = 4096
SAMPLE = 20_000  # vectors that centroids are fitted on


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one, signs made unique)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the rows of ``x`` about a centre: packed signs and two scalars each."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, centre: np.ndarray):
        rest = x - centre
        self.centre, self.length = centre, np.linalg.norm(rest, axis=1)
        unit = (rest / np.maximum(self.length, 1e-300)[:, None]) @ turn.T
        self.bits = np.packbits(unit > 0, axis=1)
        self.aligned = np.maximum(np.abs(unit).sum(1) / np.sqrt(x.shape[1]), 1e-6)  # inner product with its own code

    def bounds(self, q: np.ndarray, turn: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error) of the inner products, one row for each query."""
        dim = q.shape[1]
        signs = np.unpackbits(self.bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        estimate = (q @ turn.T).astype(np.float32) @ (signs * (self.length / self.aligned / np.sqrt(dim)).astype(np.float32)[:, None]).T
        estimate += (q @ self.centre).astype(np.float32)[:, None]
        across = np.sqrt(np.maximum(0, 1 - self.aligned**2)) / self.aligned / np.sqrt(max(1, dim - 1))
        error = np.linalg.norm(q, axis=1).astype(np.float32)[:, None] * (self.length * across * sigmas).astype(np.float32)[None, :]
        return estimate, error


class Best:
    """The ``k`` best exact products of every query so far, ties to the smaller id; none under its floor."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.vectors, self.floor, self.k = rows, vectors, floor, k
        self.score = np.full((len(rows), k), -np.inf)
        self.id = np.full((len(rows), k), np.iinfo(np.int64).max)

    def worst(self, part: slice) -> np.ndarray:
        return np.maximum(self.score[part, -1], self.floor[part])

    def add(self, q: np.ndarray, row: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        """Query rows, candidate rows with their ids and exact products."""
        live = (row != self.rows[q]) & (score >= np.maximum(self.score[q, -1], self.floor[q]))
        q, c, score = q[live], c[live], score[live]
        rows = np.unique(q)
        if not len(rows):
            return
        held = np.repeat(rows, self.k)
        q, c, score = np.concatenate([held, q]), np.concatenate([self.id[rows].ravel(), c]), np.concatenate([self.score[rows].ravel(), score])
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        take = np.searchsorted(q, rows)[:, None] + np.arange(self.k)
        self.id[rows], self.score[rows] = c[take], score[take]


def _search(best: Best, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, centre: np.ndarray, sigmas: float) -> None:
    """Rerank what may enter ``best``, out of one run of candidates."""
    order = np.argsort(ids, kind="stable")
    rows, ids, x = rows[order], ids[order], x[order]
    _, first, back = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    # Of equal vectors only the k + 1 smallest ids can be among a query's best.
    place = np.argsort(back, kind="stable")
    starts = np.searchsorted(back[place], np.arange(len(first)))
    nth = np.arange(len(place)) - starts[back[place]]
    place = place[nth <= best.k]
    cut = np.searchsorted(back[place], np.arange(len(first) + 1))
    distinct = x[first]
    codes = Codes(distinct, turn, centre)
    for at in range(0, len(best.rows), 512):
        part = slice(at, at + 512)
        asked = best.vectors[part]
        estimate, error = codes.bounds(asked, turn, sigmas)
        worst = best.worst(part)
        if np.isneginf(worst).any() and len(first) > best.k:
            # No full list yet: the k-th best lower bound among these is a floor.
            low = np.partition(estimate - error, len(first) - best.k - 1, axis=1)[:, len(first) - best.k - 1]
            worst = np.maximum(worst, low - 1e-6)
        error += estimate
        reached = error >= (worst - 1e-6).astype(np.float32)[:, None]
        share = np.count_nonzero(reached) / max(1, reached.size)
        if share > 0.02:  # many: all products of the run at once, in double precision, and of those the reached
            exact = asked @ distinct.T
            q, c = np.nonzero(reached & (exact >= worst[:, None]))
            score = exact[q, c]
        else:
            q, c = np.nonzero(reached)
            score = np.einsum("ij,ij->i", asked[q], distinct[c])
        n = cut[c + 1] - cut[c]
        into = place[np.repeat(cut[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        best.add(at + np.repeat(q, n), rows[into], ids[into], np.repeat(score, n))


def _vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components in a row, where each vector begins and the last ends)."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])


def _units(k: int, sigmas: float, seed: int, centres: dict[int, np.ndarray]):
    """Rows (key, kind 0 for queries and 1 for candidates, row, id, vector, floor, centroid) in order of the first two -> one row of best lists for each query and key."""

    def out(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is None:
            return
        full = ~np.isneginf(best.score)
        offsets = pa.array(np.concatenate([[0], np.cumsum(full.sum(1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[full])) for v in (best.id, best.score)]
        yield pa.RecordBatch.from_arrays([pa.array(best.rows), *lists], ["row", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, asked, turn = None, None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, kind, row, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat, ends = _vectors(b.column(4))
            floor, centre = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(key)], strict=True):
                x = flat[ends[a] : ends[z]].reshape(z - a, -1)
                if key[a] != now:
                    yield from out(best)
                    best, now, asked, turn = None, key[a], [], rotation(x.shape[1], seed)
                if kind[a] == 0:
                    asked.append((row[a:z], x, floor[a:z]))
                elif asked:
                    best = best or Best(*(np.concatenate(v) for v in zip(*asked, strict=True)), k)
                    for s in range(a, z, STEP):
                        e = min(z, s + STEP)
                        _search(best, row[s:e], ids[s:e], x[s - a : e - a], turn, _centre(centres, x.shape[1], centre[a]), sigmas)
        yield from out(best)

    return run


def _centre(centres: dict[int, np.ndarray], dim: int, number: int) -> np.ndarray:
    return centres[dim][number] if dim in centres else np.zeros(dim)


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` (Lloyd's rounds from distinct rows of it)."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[at : at + STEP] @ c.T - half, axis=1) for at in range(0, len(x), STEP)] or [np.zeros(0, np.int64)])


def _assigned(centres: dict[int, np.ndarray]):
    """(id, asks, v) -> with the centroid's number and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = _vectors(b.column(2))
            size = np.diff(ends)
            number, far = np.zeros(len(size), np.int64), np.zeros(len(size))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                c = centres.get(int(dim), np.zeros((1, dim)))
                number[rows] = _nearest(x, c)
                far[rows] = np.linalg.norm(x - c[number[rows]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int64)), pa.array(number), pa.array(far)], [*b.schema.names, "dim", "c", "far"])

    return run


def _visits(centres: dict[int, np.ndarray], radius: dict[int, dict[int, float]], probes: int, later: bool):
    """(row, v, floor) -> (row, v, floor, dim, c): the blocks a query visits at first, or later on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = _vectors(b.column(1))
            floor = b.column(2).to_numpy(zero_copy_only=False)
            size = np.diff(ends)
            for dim in np.unique(size):
                numbers = np.array(sorted(radius.get(int(dim), {})), np.int64)
                if not len(numbers):
                    continue
                reach = np.array([radius[int(dim)][c] for c in numbers])
                centre = np.stack([_centre(centres, int(dim), c) for c in numbers])
                mine = np.flatnonzero(size == dim)
                for at in range(0, len(mine), 256):
                    rows = mine[at : at + 256]
                    x = flat[ends[rows][:, None] + np.arange(dim)]
                    bound = x @ centre.T + np.linalg.norm(x, axis=1)[:, None] * reach
                    best = np.zeros(bound.shape, bool)
                    np.put_along_axis(best, np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :probes], True, 1)
                    go = ~best & (bound >= floor[rows][:, None] - 1e-9) if later else best
                    r, c = np.nonzero(go)
                    take = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(np.full(len(r), dim, np.int64)), pa.array(numbers[c])], ["row", "v", "floor", "dim", "c"])

    return run


def nearest(
    df: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, block_rows: int = 16_384, query_rows: int = 4096, sigmas: float = 4.0, probes: int = 2, seed: int = 42
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``df`` that ``asks``, the ``k`` other rows of largest inner product.

    Ids are integers. Vectors that are null, empty, zero or hold null, NaN or infinite
    components take no part, nor do null ids; vectors of another length than the query's are not its candidates.
    Every row stands for itself: of rows that repeat an id each is asked and each is a candidate, a row's own being the only one left out.
    Ties go to the smaller id. ``sigmas`` widens the error bound; products are exact in double precision. Empty in, empty out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    dim = max(by_dim, key=lambda d: (len(by_dim[d]), d))
    centres = {dim: centroids(np.array(by_dim[dim]), min(MOST_CENTROIDS, max(1, -(-n // block_rows))), seed)}

    placed = map_arrow(rows, _assigned(centres), "id long, asks boolean, v array<double>, dim long, c long, far double")
    placed = stage(placed.withColumn("row", F.monotonically_increasing_id()))
    cells = placed.groupBy("dim", "c").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each centroid, and for each odd length
    radius: dict[int, dict[int, float]] = {}
    for r in cells:
        radius.setdefault(r["dim"], {})[r["c"]] = r["far"] * (1 + 1e-9)
    blocks = df.sparkSession.createDataFrame([(r["dim"], r["c"], -(-r["n"] // block_rows)) for r in cells], "dim long, c long, blocks long")
    queries = placed.where("asks").select("row", F.col("id").alias("query_id"), "v")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    def found(visits: DataFrame) -> DataFrame:
        visits = stage(visits)
        runs = visits.groupBy("dim", "c").agg(F.ceil(F.count("*") / query_rows).alias("runs"))
        cell = F.broadcast(runs.join(blocks, ["dim", "c"]))  # no more rows than cells
        q = visits.join(cell, ["dim", "c"]).select("dim", "c", "row", F.lit(0).cast("long").alias("id"), "v", "floor", F.pmod(F.xxhash64(F.lit(seed), "row"), "runs").alias("run"), every(F.col("blocks")).alias("block"), F.lit(0).alias("kind"))
        c = placed.join(cell, ["dim", "c"]).select("dim", "c", "row", "id", "v", F.lit(0.0).alias("floor"), every(F.col("runs")).alias("run"), F.pmod(F.xxhash64(F.lit(seed), "row"), "blocks").alias("block"), F.lit(1).alias("kind"))
        both = q.unionByName(c).withColumn("key", F.xxhash64("dim", "c", "run", "block"))
        both = both.select("key", "kind", "row", "id", "v", "floor", "c").repartition("key").sortWithinPartitions("key", "kind")
        lists = map_arrow(both, _units(k, sigmas, seed, centres), "row long, ids array<long>, scores array<double>")
        return lists.select("row", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("row", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def best(each: DataFrame) -> DataFrame:
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    visit = "row long, v array<double>, floor double, dim long, c long"
    open_ = queries.select("row", "v", F.lit(float("-inf")).alias("floor"))
    first = stage(best(found(map_arrow(open_, _visits(centres, radius, probes, False), visit))).drop("rank"))
    full = first.groupBy("row").agg(F.count("*").alias("m"), F.min("score").alias("floor"))
    floored = queries.join(full, "row", "left").select("row", "v", F.when(F.col("m") == k, F.col("floor")).otherwise(float("-inf")).alias("floor"))
    rest = found(map_arrow(floored, _visits(centres, radius, probes, True), visit))
    out = best(first.unionByName(rest)).join(queries.select("row", "query_id"), "row")
    return out.select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 neighbours of every row whose id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS row FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
