"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared out to its documents as expected copies that grow with their length: a document
whose number of words has b binary digits weighs ``tilt`` + b, up to ``most`` copies. Their whole
part is certain. For the fraction p, unequal from length to length, documents are ranked by Pareto's statistic, random odds
divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first are taken until
the source's words are nearest to the target. u comes from a hash of
seed, id and text, so reruns agree.

The rank is never sorted as a whole: words are summed over equal slices of the rank
(``slices`` rows a source at most), and only the slice in which the target falls is sorted.
Each document then meets one row of its source and length, and its text is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, read, stage

WEIGHTS = (5, 2, 1)
TILT = 4
NONE = 1e-9  # a fraction of a copy that is rounding, not a chance


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: the weights' shares of all words.

    Weights repeat over the sources in order of code point, null last. A target stops at
    ``most`` times its source's size and the excess is shared again, until none is
    above: target = min(most * size, weight * level) at the one level that spends all words.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("full", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    by_full = Window.orderBy("full", F.col("source").isNull(), F.col("source"))
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumns({"level": left / open_weight, "at": F.row_number().over(by_full)})
    # Sources before the first that takes its share of the level stop at their caps.
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(all_rows)
    t = t.withColumn("level", first["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def expected_copies(classes: DataFrame, most: int = 3, tilt: int = TILT) -> DataFrame:
    """(source, class, words, source_size, target) -> with base (int), p and rest: certain copies, chance of one more, and the source's words beyond the certain ones.

    A class has min(most, level * (tilt + class)) copies a document, at the one level of its source that spends the target.
    """
    t = classes.withColumn("w", (F.col("class") + tilt).cast("long"))
    heavy = Window.partitionBy("source").orderBy(F.desc("w"))
    before = heavy.rowsBetween(Window.unboundedPreceding, -1)
    from_here = heavy.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum(F.col("w") * F.col("words")).over(from_here))
    # Heavier classes than the first that stays under the cap are at it.
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= most, F.struct("w", "level"))).over(Window.partitionBy("source"))["level"])
    copies = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("w"), F.lit(float(most)))))
    t = t.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(0.0)).withColumn("base", F.floor(F.col("copies") + NONE).cast("int"))
    t = t.withColumn("p", F.col("copies") - F.col("base"))
    rest = F.col("target") - F.sum(F.col("base") * F.col("words")).over(Window.partitionBy("source"))
    return t.select("source", "class", "source_size", "target", "base", "p", rest.alias("rest"))


def size_class(size: Column) -> Column:
    """Binary digits of a number of words."""
    return F.length(F.bin(size)).cast("int")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, tilt: int = TILT, seed: int = 42, slices: int = 4096, broadcast_rows: int = 200_000
) -> DataFrame:
    """``df`` with size, source_size (long), target (double), copies (int) and taken (long).

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix
    takes the document, at most ``most`` times, and ``taken`` = copies * size. Null is a source of its own.
    Documents without words and sources without words are never drawn. Rows
    that repeat id and text are numbered and drawn each by itself; which of them is drawn is open. Empty in, empty out.
    Columns of ``df`` with these five names are replaced.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in df.columns if c.lower() not in own]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    # The rows' columns travel in one struct, so that their names can't clash with those made here.
    known = df.select(F.struct(*keep).alias("_row"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), key.alias("_key"))
    light = stage(known.select("_source", "size", "_key"))
    keys = light.select("_key")

    classes = light.where("size > 0").groupBy(F.col("_source").alias("source"), size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    sizes = light.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, most))
    names = targets.withColumnRenamed("source", "s")
    classes = classes.join(names, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chances = stage(expected_copies(classes, most, tilt))
    few = chances.count() + targets.count() <= broadcast_rows

    def small(rows: DataFrame) -> DataFrame:
        # Sources are few, as a rule: then rows stay where they are, however many a source has.
        return F.broadcast(rows) if few else rows

    def ranked(rows: DataFrame, to: DataFrame) -> DataFrame:
        rows = numbered(rows, keys, "_key", "_j")
        rows = rows.withColumn("_key", F.when(F.col("_j") > 0, F.md5(F.concat_ws("|", "_key", F.col("_j").cast("string")))).otherwise(F.col("_key")))
        rows = rows.join(small(to.withColumnsRenamed({"source": "_to", "class": "_class"})), F.col("_source").eqNullSafe(F.col("_to")) & (size_class(F.col("size")) == F.col("_class")), "left").drop("_to", "_class")
        u = F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") / float(1 << 52)
        rank = F.when((F.col("p") > NONE) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
        rows = rows.withColumn("_rank", rank)
        return rows.withColumn("_slice", F.floor(F.col("_rank") / (1 + F.col("_rank")) * slices).cast("int"))

    drawn = ranked(light, chances).where("_rank is not null")
    up_to = Window.partitionBy("_source").orderBy("_slice")
    sums = drawn.groupBy("_source", "_slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("_before", F.sum("words").over(up_to) - F.col("words"))
    sums = stage(sums.where("_before <= rest and _before + words > rest").select(F.col("_source").alias("s"), F.col("_slice").alias("_cut"), "_before"))
    inside = drawn.join(small(sums), drawn["_source"].eqNullSafe(sums["s"]) & (drawn["_slice"] == sums["_cut"]))
    order = Window.partitionBy("_source").orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("size").over(order))
    inside = inside.withColumn("_in", F.col("_upto") - F.col("size") / 2 <= F.col("rest"))
    cuts = inside.groupBy("_source", "_cut").agg(F.max(F.when(F.col("_in"), F.struct("_rank", "_key"))).alias("_last"))
    cuts = cuts.withColumnRenamed("_source", "s")
    cuts = chances.join(cuts, chances["source"].eqNullSafe(cuts["s"]), "left").drop("s", "source_size", "target")
    cuts = stage(cuts)

    out = ranked(known, cuts)
    out = out.join(small(names), F.col("_source").eqNullSafe(F.col("s")), "left").drop("s")
    within = F.coalesce(F.col("_slice") < F.col("_cut"), F.lit(True)) | ((F.col("_slice") == F.col("_cut")) & F.coalesce(F.struct("_rank", "_key") <= F.col("_last"), F.lit(False)))
    drawn_once = F.when(F.col("_rank").isNotNull() & within, 1).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + drawn_once).otherwise(0).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *own)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    mixed = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM s GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM z),
f AS (SELECT *, 3 * ss AS cap, 3 * ss / CAST(w AS DOUBLE) AS full_at FROM n),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER b, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level, row_number() OVER o AS pos
  FROM f WINDOW o AS (ORDER BY full_at, source IS NULL, source), b AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, ss, coalesce(least(CAST(cap AS DOUBLE), w * (SELECT level FROM l WHERE level <= full_at ORDER BY pos LIMIT 1)), 0.0) AS target FROM l),
b AS (SELECT s.source, length(bin(s.size)) AS k, CAST(sum(s.size) AS BIGINT) AS words, CAST(length(bin(s.size)) + 4 AS BIGINT) AS w FROM s WHERE s.size > 0 GROUP BY ALL),
v AS (SELECT b.*, t.target, (t.target - coalesce(sum(3 * words) OVER e, 0)) / CAST(sum(w * words) OVER a AS DOUBLE) AS level
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
  WINDOW e AS (PARTITION BY b.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY b.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, max(CASE WHEN level * w <= 3 THEN w END) OVER (PARTITION BY source) AS open_at FROM v),
e AS (SELECT *, CASE WHEN target > 0 THEN greatest(0.0, least(3.0, coalesce(max(CASE WHEN w = open_at THEN level END) OVER (PARTITION BY source) * w, 3.0))) ELSE 0.0 END AS copies FROM c),
p AS (SELECT source, k, copies - floor(copies + 1e-9) AS p, CAST(floor(copies + 1e-9) AS BIGINT) AS base, target - sum(CAST(floor(copies + 1e-9) AS BIGINT) * words) OVER (PARTITION BY source) AS rest FROM e),
q AS (SELECT s.doc_id, s.source, s.size, s.k, p.base, p.rest, p.p, CAST('0x' || substr(s.k, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source AND length(bin(s.size)) = p.k WHERE s.size > 0),
drawn AS (SELECT doc_id, rest, size, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), k ROWS UNBOUNDED PRECEDING) AS upto FROM q WHERE p > 1e-9),
once AS (SELECT doc_id FROM drawn WHERE upto - size / 2.0 <= rest)
SELECT s.doc_id, s.size, t.ss AS source_size, t.target, CAST(c.copies * s.size AS BIGINT) AS taken, CAST(c.copies AS INT) AS copies
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (doc_id) LEFT JOIN once USING (doc_id),
  LATERAL (SELECT CASE WHEN s.size = 0 THEN 0 WHEN once.doc_id IS NULL THEN q.base ELSE q.base + 1 END AS copies) c
"""
