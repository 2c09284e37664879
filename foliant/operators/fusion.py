"""Fusion of evidence: pages, documents, types, routes, with abstention as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.arrays import let


def plain_value(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x.cast("string")), r"\s+", " "))


def fuse_page(model: DataFrame, rule: DataFrame, keys: list[str], margin: float = 0.15) -> DataFrame:
    """(keys..., value, confidence, origin, note) of two tables (keys..., value, confidence).

    Equal values: the higher confidence, the model's on a tie. Different values: the one ahead
    by ``margin``, else no value.
    """
    m = model.select(*keys, F.col("value").alias("mv"), F.coalesce("confidence", F.lit(0.0)).alias("mc"))
    r = rule.select(*keys, F.col("value").alias("rv"), F.coalesce("confidence", F.lit(0.0)).alias("rc"))
    x = m.join(r, keys, "full")
    same = plain_value(F.col("mv")) == plain_value(F.col("rv"))
    lone_m, lone_r = F.col("rc").isNull(), F.col("mc").isNull()
    clear = F.abs(F.col("mc") - F.col("rc")) >= margin
    origin = F.when(lone_r, "rule").when(lone_m, "model").when(same, F.when(F.col("mc") >= F.col("rc"), "model").otherwise("rule")).when(clear, F.when(F.col("mc") > F.col("rc"), "model").otherwise("rule"))
    note = F.when(lone_r | lone_m | same, F.lit(None).cast("string")).when(clear, "conflict_selected").otherwise("conflict_abstained")
    x = x.withColumns({"origin": origin, "note": note})
    return x.select(*keys, F.when(F.col("origin") == "model", F.col("mv")).when(F.col("origin") == "rule", F.col("rv")).alias("value"), F.when(F.col("origin") == "model", F.col("mc")).when(F.col("origin") == "rule", F.col("rc")).alias("confidence"), "origin", "note")


def fuse_document(df: DataFrame, keys: list[str], value: str, confidence: str, margin: float = 0.10, page: str | None = None) -> DataFrame:
    """(keys..., value, score, values): the best value of a field over pages, null where the next is within ``margin``.

    A value's score is its best confidence, 0.03 more for each further support up to 0.10, at most 1. The value is a normal form for
    comparison; with ``page`` there is a column shown, the value as it is written on its best page (of equal ones the last).
    """
    shown = [] if page is None else [F.max_by(F.col(value), F.struct(F.col(confidence), F.col(page))).alias("shown")]
    by_value = df.groupBy(*keys, plain_value(F.col(value)).alias("value")).agg(F.max(F.coalesce(F.col(confidence), F.lit(0.0))).alias("best"), F.count("*").alias("n"), *shown)
    score = F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.10), 0.03 * (F.col("n") - 1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("value"))
    t = by_value.withColumn("score", score)
    t = t.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w), "values": F.count("*").over(Window.partitionBy(*keys))}).where("_r = 1")
    near = F.col("_next").isNotNull() & (F.col("score") - F.col("_next") < margin)
    return t.select(*keys, F.when(~near, F.col("value")).alias("value"), F.when(~near, F.col("score")).alias("score"), "values", *([] if page is None else [F.when(~near, F.col("shown")).alias("shown")]))


def fused_fields(found: Column, margin: float = 0.10) -> Column:
    """Array of (field, value, confidence), every field once: ``fuse_document`` of a document's (field, value, confidence, page), an array in one row.

    The value is the written one of its best page.
    """

    def scored(same: Column) -> Column:
        n, best = F.size(same), F.array_max(F.transform(same, lambda x: x["confidence"]))
        score = F.least(F.lit(1.0), best + F.least(F.lit(0.10), 0.03 * (n - 1)))
        shown = F.array_max(F.transform(same, lambda x: F.struct(x["confidence"].alias("c"), x["page"].alias("p"), x["value"].alias("v"))))
        return F.struct(score.alias("score"), F.array_max(F.transform(same, lambda x: x["plain"])).alias("plain"), shown["v"].alias("shown"))

    def fused(f: Column, pages: Column) -> Column:
        def ranked(xs: Column) -> Column:
            kinds = F.array_distinct(F.transform(xs, lambda x: x["plain"]))
            return F.sort_array(F.transform(kinds, lambda k: let(F.filter(xs, lambda x: x["plain"] == k), scored)), asc=False)

        def sure(r: Column) -> Column:
            near = (F.size(r) > 1) & (F.get(r, F.lit(0))["score"] - F.get(r, F.lit(1))["score"] < margin)
            return F.struct(f.alias("field"), F.when(~near, F.get(r, F.lit(0))["shown"]).alias("value"), F.when(~near, F.get(r, F.lit(0))["score"]).alias("confidence"))

        return let(let(F.filter(pages, lambda x: x["field"] == f), ranked), sure)

    def all_fields(pages: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(pages, lambda x: x["field"])), lambda f: fused(f, pages))

    plain = F.transform(F.filter(found, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), x["page"].alias("page"), plain_value(x["value"]).alias("plain")))
    return let(plain, all_fields)


def fuse_type(df: DataFrame, keys: list[str], label: str, confidence: str, margin: float = 0.10) -> DataFrame:
    """(keys..., label, confidence): the label of the highest mean; "unknown", with the top mean, where the next is near."""
    use = df.where(F.col(label).isNotNull() & ~F.col(label).isin("", "unknown") & F.col(confidence).isNotNull())
    means = use.groupBy(*keys, F.col(label).alias("label")).agg(F.avg(confidence).alias("confidence"))
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("label"))
    t = means.withColumns({"_r": F.row_number().over(w), "_next": F.lead("confidence").over(w)}).where("_r = 1")
    near = F.col("_next").isNotNull() & (F.col("confidence") - F.col("_next") < margin)
    return t.select(*keys, F.when(near, "unknown").otherwise(F.col("label")).alias("label"), "confidence")


def abstain(confidence: Column, predicted: Column, names: list[str], threshold: float, by_class: dict[str, float]) -> Column:
    """The prediction, or class 0 under its threshold: its class's, else "default", else the common one."""
    limits = F.create_map(*[F.lit(v) for kv in by_class.items() for v in kv]) if by_class else F.create_map().cast("map<string,double>")
    name = F.get(F.array(*map(F.lit, names)), predicted.cast("int"))
    limit = F.coalesce(F.try_element_at(limits, name), F.try_element_at(limits, F.lit("default")), F.lit(threshold)) if by_class else F.lit(threshold)
    return F.when(confidence >= F.when(name.isNull(), threshold).otherwise(limit), predicted).otherwise(0)


def route_reasons(text: Column, hint: Column, mean_confidence: Column, words: Column, valid: Column) -> Column:
    """Why the Thai reader should be tried; empty if it should not."""
    return F.array_compact(
        F.array(
            F.when(F.lower(F.coalesce(hint, F.lit(""))).isin("th", "thai", "th-th"), "hint_is_thai"),
            F.when(text.rlike("[฀-๿]"), "thai_script"),
            F.when(mean_confidence < 0.75, "low_confidence"),
            F.when(words < 2, "empty_or_weak"),
            F.when(valid < 0.8, "low_valid_characters"),
        )
    )


def languages(text: Column) -> Column:
    """Thai by script; Turkish letters stand for Turkish, else Latin letters for English."""
    turkish = text.rlike("[ÇĞİÖŞÜçğıöşü]")
    return F.array_compact(F.array(F.when(text.rlike("[฀-๿]"), "th"), F.when(turkish, "tr").when(text.rlike("[A-Za-z]"), "en")))
