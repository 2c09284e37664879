"""Training rows from annotated documents: word labels, remapped evidence, hybrid tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def canonical_ids(tokens: DataFrame, fields: DataFrame, keys: list[str], vocabulary: list[str]) -> DataFrame:
    """(keys..., token, canonical_id): the field of each token, 0 of none, -100 where masked or where fields disagree.

    ``tokens``: keys, token, enabled. ``fields``: keys, field, token, valid. Fields outside the vocabulary and evidence
    that is not valid don't count.
    """
    names = F.array(*map(F.lit, vocabulary))
    f = fields.where(F.coalesce("valid", F.lit(True)) & F.array_contains(names, F.col("field")))
    f = f.groupBy(*keys, "token").agg(F.count_distinct("field").alias("_n"), F.min("field").alias("_f"))
    out = tokens.join(f, [*keys, "token"], "left")
    value = F.when(~F.col("enabled"), IGNORED).when(F.col("_n") > 1, IGNORED).when(F.col("_n") == 1, F.array_position(names, F.col("_f"))).otherwise(0)
    return out.select(*keys, "token", value.cast("int").alias("canonical_id"))


def hybrid_tokens(source: DataFrame, matches: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., token, origin, source, ocr): source tokens in order, then recognised ones that are left.

    A source token takes the first recognised one that no earlier source token took; without one it is a fallback.
    """
    first = matches.groupBy(*keys, "source").agg(F.min("ocr").alias("ocr"))
    taken = first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "ocr").orderBy("source"))).where("_r = 1").drop("_r")
    s = source.join(taken, [*keys, "source"], "left")
    s = s.select(*keys, F.when(F.col("ocr").isNull(), F.concat(F.lit("fallback__"), F.col("source").cast("string"))).otherwise(F.concat(F.lit("ocr__"), F.col("ocr").cast("string"))).alias("token"), F.when(F.col("ocr").isNull(), "fallback").otherwise("matched").alias("origin"), "source", "ocr")
    extra = ocr.join(taken, [*keys, "ocr"], "left_anti")
    extra = extra.select(*keys, F.concat(F.lit("ocr__"), F.col("ocr").cast("string")).alias("token"), F.lit("extra").alias("origin"), F.lit(None).cast(dict(source.dtypes)["source"]).alias("source"), "ocr")
    return s.unionByName(extra)


def remapped(members: DataFrame, positions: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys..., item, places, kept, total): token ids of items (entities, fields) as positions, in order, with how many were found."""
    x = members.join(positions, [*keys, "token"], "left")
    return x.groupBy(*keys, item).agg(F.sort_array(F.collect_list("place")).alias("places"), F.count("place").alias("kept"), F.count("*").alias("total"))


def retention(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., retained, partial, rate): items of which all tokens, or some, were found."""
    return found.groupBy(*keys).agg(F.count_if(F.col("kept") == F.col("total")).alias("retained"), F.count_if((F.col("kept") > 0) & (F.col("kept") < F.col("total"))).alias("partial"), F.avg((F.col("kept") == F.col("total")).cast("double")).alias("rate"))


def assembled(rows: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "tokens") -> DataFrame:
    """(keys..., name): rows as one array of structs, in order, so that parallel lists can't come apart."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
