"""Pairs of boxes, hashes, entities and tokens, and greedy choices among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import geometry as g
from foliant.functions.arrays import let
from foliant.functions.ids import hash_rank, stable_id
from foliant.functions.text import plain_text_score
from foliant.session import map_arrow, ship_code

# Pairs of labels that can relate, and the relation.
COMPATIBLE = [("KEY", "VALUE", "KEY_VALUE"), ("QUESTION", "ANSWER", "QUESTION_ANSWER"), ("HEADER", "SECTION", "HEADER_SECTION"), ("TABLE_HEADER", "TABLE_CELL", "TABLE_HEADER_CELL")]
# Which label wins a tie.
LABEL_RANK = {"ANSWER": 7, "QUESTION": 6, "VALUE": 5, "KEY": 4, "HEADER": 3, "TABLE_CELL": 2, "OTHER": 1}


def near_hashes(df: DataFrame, id_col: str, hash_col: str, most: int, bits: int = 64, bucket: list[str] | None = None) -> DataFrame:
    """(a, b, distance): pairs with ``most`` or fewer differing bits in one bucket (columns that must be equal).

    Two such hashes agree in one of ``most + 1`` bands of bits, so pairs come from equi-joins on bands.
    """
    bands, bucket = most + 1, bucket or []
    width = -(-bits // bands)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_col, i * width).bitwiseAND((1 << min(width, bits - i * width)) - 1).alias("key")) for i in range(bands) if i * width < bits])
    t = df.where(F.col(hash_col).isNotNull()).select(*bucket, F.col(id_col).alias("id"), F.col(hash_col).alias("h"), F.explode(keys).alias("k")).select(*bucket, "id", "h", "k.*")
    on = [*bucket, "band", "key"]
    pairs = t.withColumnsRenamed({"id": "a", "h": "ha"}).join(t.withColumnsRenamed({"id": "b", "h": "hb"}), on).where("a < b")
    pairs = pairs.withColumn("distance", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))).where(F.col("distance") <= most)
    return pairs.select("a", "b", "distance").distinct()


def overlapping(refs: DataFrame, preds: DataFrame, by: list[str], least: float, band: float) -> DataFrame:
    """(by..., ref, pred, iou): boxes (id, x0, y0, x1, y1) of one page with IoU of ``least`` or more.

    Boxes meet in horizontal bands, so far boxes of a page are never paired; ``band`` is about a line's height.
    """

    def banded(df: DataFrame, name: str) -> DataFrame:
        rows = F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))
        return df.select(*by, F.col("id").alias(name), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(rows).alias("_band"))

    a, b = banded(refs, "ref"), banded(preds, "pred")
    x = a.join(b, [*by, "_band"]).where(F.col("_band") == F.floor(F.greatest("ref_y0", "pred_y0") / band))
    value = g.iou(g.Box.columns("ref_"), g.Box.columns("pred_"))
    return x.select(*by, "ref", "pred", value.alias("iou")).where(F.col("iou") >= least)


def overlapping_polygons(refs: DataFrame, preds: DataFrame, by: list[str], least: float, band: float) -> DataFrame:
    """(by..., ref, pred, iou): polygons (id, polygon) of one page whose convex hulls have an IoU of ``least`` or more.

    Their boxes meet in horizontal bands as in ``overlapping``; only polygons whose boxes overlap are cut.
    """

    def boxed(df: DataFrame) -> DataFrame:
        box = g.polygon_box(F.col("polygon"))
        return df.select(*by, "id", "polygon", *[box[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])

    a, b = boxed(refs), boxed(preds)
    near = overlapping(a, b, by, 0.0, band).where("iou > 0").select(*by, "ref", "pred")
    x = near.join(a.select(*by, F.col("id").alias("ref"), F.col("polygon").alias("_p")), [*by, "ref"]).join(b.select(*by, F.col("id").alias("pred"), F.col("polygon").alias("_q")), [*by, "pred"])
    return x.withColumn("iou", g.convex_iou("_p", "_q")).where(F.col("iou") >= least).select(*by, "ref", "pred", "iou")


def greedy_pairs(candidates: DataFrame, by: list[str], left: str, right: str, score: str, reusable: str | None = None) -> DataFrame:
    """Candidates taken by falling score (ties: larger left, then larger right) while both sides are free.

    With ``reusable`` (a boolean column), rows where it holds may use a taken side again. Each group goes to one
    Arrow batch, so a group should be a page or a document.
    """
    ship_code(candidates.sparkSession)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=False, kind="stable")
        lefts, rights, pairs, keep = set(), set(), set(), []
        for a, b, free in zip(pdf[left], pdf[right], pdf[reusable] if reusable else [False] * len(pdf), strict=True):
            fine = (free or (a not in lefts and b not in rights)) and (a, b) not in pairs
            keep.append(fine)
            if fine:
                lefts.add(a)
                rights.add(b)
                pairs.add((a, b))
        return pdf[keep]

    return candidates.groupBy(*by).applyInPandas(pick, candidates.schema)


def align_tokens(source: DataFrame, ocr: DataFrame, by: list[str], least: float = 0.45) -> DataFrame:
    """(by..., source, ocr, score, kind): greedy matches of tokens (id, text, x0, y0, x1, y1) of a page.

    Texts come normalised; the score is 0.7 of text and 0.3 of place. Only matches in which one text holds the other
    may share a token.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        token = F.struct("id", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
        return df.where("text <> ''").groupBy(*by).agg(F.collect_list(token).alias(name))

    return align_rows(rows(source, "_source").join(rows(ocr, "_ocr"), by), by, "_source", "_ocr", least)


def _most_alike(us: list[str], vs: list[str]) -> np.ndarray:
    """A bound of the text score of each pair: by letters in common or, where one may hold the other, by their lengths."""
    a, b = (np.array([len(x) for x in xs], float) for xs in (us, vs))
    shared = np.zeros((len(us), len(vs)))
    for ch in set("".join(us)) & set("".join(vs)):
        n, m = (np.array([x.count(ch) for x in xs], float) for xs in (us, vs))
        i, j = np.nonzero(n)[0], np.nonzero(m)[0]
        shared[np.ix_(i, j)] += np.minimum(n[i][:, None], m[j])
    least, most = np.minimum(a[:, None], b), np.maximum(a[:, None], b)
    return np.maximum(2 * shared / (a[:, None] + b), np.where(shared == least, np.minimum(1.0, least / most + 0.25), 0.0))


def page_matches(ids: tuple, texts: tuple, boxes: tuple, least: float, room: int = 1 << 20) -> list[tuple[int, int, float, str]]:
    """(source, ocr, score, kind) by place in the lists of one page; ``room`` pairs are looked at together."""
    u_words, u = np.unique(np.array(texts[0], object), return_inverse=True)
    v_words, v = np.unique(np.array(texts[1], object), return_inverse=True)
    known: dict[tuple[int, int], tuple[float, str]] = {}
    x0, y0, x1, y1 = boxes[1]
    area_b, found = np.maximum(0.0, x1 - x0) * np.maximum(0.0, y1 - y0), []
    step = max(1, room // max(1, len(v)))
    for lo in range(0, len(u), step):
        p0, q0, p1, q1 = (c[lo : lo + step, None] for c in boxes[0])
        part, back = np.unique(u[lo : lo + step], return_inverse=True)
        area_a = np.maximum(0.0, p1 - p0) * np.maximum(0.0, q1 - q0)
        shared = np.maximum(0.0, np.minimum(p1, x1) - np.maximum(p0, x0)) * np.maximum(0.0, np.minimum(q1, y1) - np.maximum(q0, y0))
        scale = np.maximum(1.0, (np.sqrt(area_a) + np.sqrt(area_b)) / 2)
        away = np.hypot((p0 + p1) / 2 - (x0 + x1) / 2, (q0 + q1) / 2 - (y0 + y1) / 2)
        place = np.maximum(shared / np.maximum(1e-6, area_a + area_b - shared), np.maximum(0.0, 1 - away / (3 * scale)))
        bound = _most_alike(list(u_words[part]), list(v_words))[back][:, v]
        for i, j in zip(*np.nonzero(0.7 * bound + 0.3 * place >= least - 1e-9), strict=True):
            key = (u[lo + i], v[j])
            if key not in known:
                known[key] = plain_text_score(u_words[key[0]], v_words[key[1]])
            text, kind = known[key]
            score = 0.7 * text + 0.3 * float(place[i, j])
            if score >= least:
                found.append((score, ids[0][lo + i], ids[1][j], kind))
    found.sort(key=lambda f: f[:3], reverse=True)
    lefts, rights, pairs, kept = set(), set(), set(), []
    for score, a, b, kind in found:
        if (kind.endswith(("_annotation", "_ocr")) or (a not in lefts and b not in rights)) and (a, b) not in pairs:
            lefts.add(a)
            rights.add(b)
            pairs.add((a, b))
            kept.append((a, b, score, kind))
    return kept


def align_rows(pages: DataFrame, by: list[str], source: str, ocr: str, least: float = 0.45) -> DataFrame:
    """``align_tokens`` of pages in one row each: two arrays of tokens (id, text, x0, y0, x1, y1) without blank texts.

    Only a page's distinct words are compared, and only those whose letters and places allow a match.
    """

    def tokens(b: pa.RecordBatch, name: str):
        lists = b.column(b.schema.get_field_index(name))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        names, parts = [f.name for f in lists.type.value_type], lists.flatten().flatten()
        at = {c: parts[names.index(c)] for c in names}
        return np.r_[0, np.cumsum(n)], at["id"].to_pylist(), at["text"].to_pylist(), [at[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (s, *left), (o, *right) = tokens(b, source), tokens(b, ocr)
            places, out = [], []
            for k in range(b.num_rows):
                cut = [(slice(at[k], at[k + 1]), side) for at, side in ((s, left), (o, right))]
                got = page_matches(*(tuple(side[n][c] for c, side in cut) for n in (0, 1)), tuple([x[c] for x in side[2]] for c, side in cut), least)
                places += [k] * len(got)
                out += got
            keys = b.select(by).take(pa.array(places, pa.int64()))
            made = zip(*out, strict=True) if out else [[]] * 4
            kinds = [b.schema.field(n).type.value_type.field("id").type for n in (source, ocr)] + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(list(v), t) for v, t in zip(made, kinds, strict=True))], names=[*by, "source", "ocr", "score", "kind"])

    ids = [T.StructField(n, pages.schema[c].dataType.elementType["id"].dataType) for n, c in (("source", source), ("ocr", ocr))]
    schema = T.StructType([*(pages.schema[c] for c in by), *ids, T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType())])
    return map_arrow(pages.select(*by, source, ocr), run, schema)


def resolve_labels(matches: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by..., label): the most frequent label, ties by a fixed rank."""
    rank = F.create_map(*[F.lit(v) for kv in LABEL_RANK.items() for v in kv])
    n = matches.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.max_by("label", F.struct("_n", F.coalesce(F.try_element_at(rank, F.col("label")), F.lit(0)))).alias("label"))


def relation_pairs(entities: DataFrame, by: list[str], furthest: float = 0.6) -> DataFrame:
    """Compatible pairs of entities (id, label, x0, y0, x1, y1) of one page, near enough for its size, with ten features."""
    pairs = entities.sparkSession.createDataFrame(COMPATIBLE, "s_label string, t_label string, type string")  # four rows
    extent = F.max(F.greatest("x1", "y1")).over(Window.partitionBy(*by))
    e = entities.withColumn("_extent", extent.cast("double"))
    names = ["id", "label", "x0", "y0", "x1", "y1"]
    s = e.select(*by, "_extent", *[F.col(c).alias(f"s_{c}") for c in names]).join(F.broadcast(pairs), "s_label")
    t = e.select(*by, *[F.col(c).alias(f"t_{c}") for c in names])
    x = s.join(t, [*by, "t_label"]).where("s_id <> t_id")
    x = x.withColumns(g.relation_features(g.Box.columns("s_"), g.Box.columns("t_")))
    x = x.withColumn("normal_distance", F.col("distance") / F.greatest(F.lit(1.0), F.col("_extent")))
    return x.where(F.col("normal_distance") <= furthest)


def infer_relations(entities: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, type, source, target, confidence): the cheapest target of each source and type."""
    back = (F.col("target_is_right") == 0) & (F.col("target_is_below") == 0)
    cost = F.col("normal_distance") + F.when(back, 0.25).otherwise(0.0) - F.when(F.col("same_line") == 1, 0.15).otherwise(0.0)
    x = relation_pairs(entities, by).withColumn("_cost", cost)
    w = Window.partitionBy(*by, "s_id", "type").orderBy("_cost", "vertical_gap", "horizontal_gap", "t_id")
    best = x.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(*by, stable_id("rel", F.col("s_id"), F.col("t_id"), F.col("type")).alias("id"), "type", F.col("s_id").alias("source"), F.col("t_id").alias("target"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("normal_distance"))).alias("confidence"))


def hard_negatives(entities: DataFrame, positives: DataFrame, page: str, each: int = 3, seed: int = 42) -> DataFrame:
    """(page, source, target, place): pairs that no relation joins, the hardest first, ``each`` a positive.

    Compatible labels come first, then near ones, then hash order. All pairs of one page are made, so a page bounds the work.
    """
    names = ["id", "label", "x0", "y0", "x1", "y1"]
    s = entities.select(page, *[F.col(c).alias(f"s_{c}") for c in names])
    t = entities.select(page, *[F.col(c).alias(f"t_{c}") for c in names])
    fit = F.lit(False)
    for a, b, _ in COMPATIBLE:
        fit = fit | ((F.col("s_label") == a) & (F.col("t_label") == b))
    pos = positives.select(page, F.col("source").alias("s_id"), F.col("target").alias("t_id"))
    x = s.join(t, page).where("s_id <> t_id").join(pos, [page, "s_id", "t_id"], "left_anti")
    distance = g.relation_features(g.Box.columns("s_"), g.Box.columns("t_"))["distance"]
    rank = hash_rank(seed, F.concat_ws("|", F.col(page).cast("string"), F.col("s_id").cast("string"), F.col("t_id").cast("string")))
    w = Window.partitionBy(page).orderBy(F.when(fit, 0).otherwise(1), distance, rank)
    limit = pos.groupBy(page).agg(F.count("*").alias("_n"))
    x = x.withColumn("place", F.row_number().over(w)).join(limit, page, "left")
    return x.where(F.col("place") <= each * F.greatest(F.lit(1), F.coalesce("_n", F.lit(0)))).select(page, F.col("s_id").alias("source"), F.col("t_id").alias("target"), "place")


def contained(texts: DataFrame, id_col: str, text: str, passages: DataFrame, passage: str, shingle: int = 5) -> DataFrame:
    """Pairs of rows where the text holds the passage as it stands: all columns of both sides.

    Both sides meet on a passage's rarest-looking word run (the one of the smallest hash among its runs of ``shingle`` words inside the passage,
    first and last word left out) or, where that is too short, on its longest inner word. Only ids and hashes are
    exploded and joined: a text goes along once for each passage that it meets, not for each of its words. Passages of
    one or two words have no whole word inside; they go to every task if they are few, and are looked for in all texts.
    """

    def runs(words: Column) -> Column:
        def hashed(x: Column) -> Column:
            n = F.size(x)
            return F.when(n >= shingle, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - shingle + 1)), lambda i: F.xxhash64(F.slice(x, i, shingle))))

        return let(words, hashed)

    w = F.split(F.col(passage), r"\s+")
    inner = let(w, lambda x: F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 2)))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    p = passages.select(F.struct(*passages.columns).alias("_p"), F.col(passage).alias("_passage"), F.coalesce(F.array_min(runs(inner)), F.xxhash64(F.lit("word"), longest)).alias("_key"), (F.array_min(runs(inner)).isNull() & longest.isNull()).alias("_short"))
    words = F.split(F.col(text), r"\s+")
    keys = F.array_distinct(F.concat(F.coalesce(runs(words), F.array().cast("array<bigint>")), F.transform(words, lambda x: F.xxhash64(F.lit("word"), x))))
    met = texts.select(F.col(id_col).alias("_id"), F.explode(keys).alias("_key")).join(p.where("not _short").select("_key", "_p", "_passage"), "_key").drop("_key")
    t = texts.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.struct(*texts.columns).alias("_t"))
    # Rows may repeat an id: each is looked at itself.
    hit = t.join(met.distinct(), "_id").where(F.col("_text").contains(F.col("_passage")))
    short = p.where("_short").select("_p", "_passage")
    if short.limit(1).count():
        few = short.count() <= 10_000
        hit = hit.unionByName(t.join(F.broadcast(short) if few else short, F.col("_text").contains(F.col("_passage"))).select(*hit.columns))
    names = [c for c in passages.columns if c not in texts.columns]
    return hit.select(*[F.col("_t")[c].alias(c) for c in texts.columns], *[F.col("_p")[c].alias(c) for c in names])
