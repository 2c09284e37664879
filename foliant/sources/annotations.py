"""Annotation formats as one table of tokens, entities, relations and fields.

Every adapter takes rows of parsed or raw text and gives tables keyed by page: tokens (page, at, text,
x0, y0, x1, y1, label), with fields and relations where the format has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.ids import stable_id
from foliant.functions.text import plain_annotation_text
from foliant.operators.extraction import question_field
from foliant.operators.sequences import islands

# Source keys and the fields they fill.
RECEIPT_FIELDS = {"company": "organization_name", "address": "address", "date": "date", "total": "total_amount"}
INVOICE_FIELDS = {"SELLER_NAME": "organization_name", "DATE": "date", "NUMBER": "invoice_number", "SUB_TOTAL": "subtotal", "TAX": "tax", "TOTAL": "total_amount", "SELLER_ADDRESS": "address", "SELLER_EMAIL": "email", "TITLE": "document_title"}


def _text(x):
    return plain_annotation_text(F.coalesce(x, F.lit("")))


def polygon_lines(pages: DataFrame, boxes: str, entities: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, skipped, fields) of pages with box lines "x1,y1,..,x4,y4,text" and a JSON object of entities.

    Lines with under nine values, with coordinates that are no numbers, without text or without extent are skipped with the reason.
    A token is a VALUE where its text and an entity's hold one another.
    """
    lines = pages.select("page", entities, F.posexplode(F.split(F.regexp_replace(boxes, "\r", ""), "\n")).alias("at", "raw")).where("raw <> ''")
    v = F.split("raw", ",")
    xs = F.transform(F.filter(F.slice(v, 1, 8), lambda x, i: i % 2 == 0), lambda x: x.try_cast("double"))
    ys = F.transform(F.filter(F.slice(v, 1, 8), lambda x, i: i % 2 == 1), lambda x: x.try_cast("double"))
    words = F.trim(F.array_join(F.slice(v, F.lit(9), F.greatest(F.lit(0), F.size(v) - 8)), ","))
    x = lines.select("page", "at", entities, F.size(v).alias("_n"), xs.alias("_xs"), ys.alias("_ys"), words.alias("text"))
    bad = F.when(F.col("_n") < 9, "fewer_than_9_values").when(F.exists("_xs", lambda c: c.isNull()) | F.exists("_ys", lambda c: c.isNull()), "invalid_coordinate").when(F.col("text") == "", "empty_text").when((F.array_min("_xs") >= F.array_max("_xs")) | (F.array_min("_ys") >= F.array_max("_ys")), "degenerate_geometry")
    x = x.withColumn("reason", bad)
    skipped = x.where("reason is not null").select("page", (F.col("at") + 1).alias("line"), "reason")
    values = F.from_json(entities, "map<string,string>")
    t = x.where("reason is null").withColumn("_e", F.map_values(values)).withColumn("_t", _text(F.col("text")))
    hit = F.exists("_e", lambda e: (_text(e) != "") & (_text(e).contains(F.col("_t")) | F.col("_t").contains(_text(e))))
    w = Window.partitionBy("page").orderBy("at")
    tokens = t.select("page", (F.row_number().over(w) - 1).alias("at"), "text", F.array_min("_xs").alias("x0"), F.array_min("_ys").alias("y0"), F.array_max("_xs").alias("x1"), F.array_max("_ys").alias("y1"), F.when(F.coalesce(hit, F.lit(False)), "VALUE").otherwise("OTHER").alias("label"))
    f = pages.select("page", F.explode(values).alias("source_key", "value")).where("value <> ''")
    name = F.create_map(*[F.lit(s) for kv in RECEIPT_FIELDS.items() for s in kv])
    f = f.withColumn("field", F.try_element_at(name, F.col("source_key"))).where("field is not null")
    inside = f.join(tokens, "page").where(_text(F.col("value")).contains(_text(F.col("text"))))
    ids = inside.groupBy("page", "field").agg(F.sort_array(F.collect_list("at")).alias("token_at"))
    fields = f.join(ids, ["page", "field"], "left").select("page", "field", "value", "source_key", F.coalesce("token_at", F.array().cast("array<int>")).alias("token_at"))
    return tokens, skipped, fields


FORM_SCHEMA = "struct<form:array<struct<id:int,text:string,label:string,box:array<double>,words:array<struct<text:string,box:array<double>>>,linking:array<array<int>>>>>"


def form_json(pages: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, entities, relations) of pages whose JSON lists form items with words and links."""
    form = pages.select("page", F.posexplode(F.from_json(document, FORM_SCHEMA)["form"]).alias("item", "f"))
    source = F.coalesce("f.id", "item")
    label = F.when(F.lower("f.label").isin("header", "question", "answer"), F.upper("f.label")).otherwise("OTHER")
    good = F.filter("f.words", lambda w: (F.trim(w["text"]) != "") & (F.size(w["box"]) == 4) & (w["box"][2] > w["box"][0]) & (w["box"][3] > w["box"][1]))
    whole = F.array(F.struct(F.col("f.text").alias("text"), F.col("f.box").alias("box")))
    words = F.when(F.size(good) > 0, good).when((F.trim("f.text") != "") & (F.size("f.box") == 4), whole)
    t = form.select("page", "item", source.alias("source"), label.alias("label"), F.col("f.text").alias("entity_text"), F.posexplode(words).alias("word", "w"))
    w = Window.partitionBy("page").orderBy("item", "word")
    tokens = t.select("page", (F.row_number().over(w) - 1).alias("at"), "source", "label", F.trim("w.text").alias("text"), *[F.col("w.box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    entities = t.groupBy("page", "source", "label").agg(F.max(F.nullif("entity_text", F.lit(""))).alias("_t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.col("w.text").alias("text")))), lambda x: x["text"]), " ").alias("_w"), *[f(F.col("w.box")[i]).alias(c) for f, i, c in ((F.min, 0, "x0"), (F.min, 1, "y0"), (F.max, 2, "x1"), (F.max, 3, "y1"))])
    entities = entities.select("page", "source", "label", F.coalesce("_t", "_w").alias("text"), "x0", "y0", "x1", "y1")
    links = form.select("page", F.explode("f.linking").alias("l")).where("size(l) = 2").select("page", F.col("l")[0].alias("a"), F.col("l")[1].alias("b")).distinct()
    ends = entities.select("page", "source", "label")
    r = links.join(ends.select("page", F.col("source").alias("a"), F.col("label").alias("la")), ["page", "a"]).join(ends.select("page", F.col("source").alias("b"), F.col("label").alias("lb")), ["page", "b"])
    pair = ((F.col("la") == "QUESTION") & (F.col("lb") == "ANSWER")) | ((F.col("la") == "ANSWER") & (F.col("lb") == "QUESTION"))
    relations = r.select("page", stable_id("rel", F.col("page"), F.col("a"), F.col("b")).alias("id"), F.when(pair, "QUESTION_ANSWER").otherwise("GENERIC").alias("type"), F.col("a").alias("source"), F.col("b").alias("target"))
    return tokens, entities, relations


def parallel_json(pages: DataFrame, document: str, original: str, width: str, height: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, entities, fields) of pages whose JSON has equally long words, bboxes and ner_tags.

    Boxes are cut to the page; tag 10 is a table cell, 13 is nothing, others are values. Runs of one tag are entities.
    """
    d = pages.withColumn("_d", F.from_json(document, "struct<words:array<string>,bboxes:array<array<double>>,ner_tags:array<int>>"))
    same = (F.size("_d.words") == F.size("_d.bboxes")) & (F.size("_d.words") == F.size("_d.ner_tags"))
    d = d.where(F.when(~F.coalesce(same, F.lit(False)), F.raise_error(F.concat(F.lit("lists of different lengths on page "), F.col("page").cast("string"))).cast("boolean")).otherwise(True))
    t = d.select("page", width, height, F.posexplode(F.arrays_zip("_d.words", "_d.bboxes", "_d.ner_tags")).alias("at", "z"))
    box = [F.greatest(F.lit(0.0), F.least(F.col("z.bboxes")[i], F.col(m).cast("double"))).alias(c) for i, (c, m) in enumerate((("x0", width), ("y0", height), ("x1", width), ("y1", height)))]
    tag = F.col("z.ner_tags")
    clipped = (F.col("z.bboxes")[2] > F.col(width)) | (F.col("z.bboxes")[3] > F.col(height)) | (F.col("z.bboxes")[0] < 0) | (F.col("z.bboxes")[1] < 0)
    t = t.where("size(z.bboxes) = 4").select("page", "at", F.trim("z.words").alias("text"), *box, tag.alias("tag"), F.when(tag == 10, "TABLE_CELL").when(tag == 13, "OTHER").otherwise("VALUE").alias("label"), clipped.alias("clipped"))
    tokens = t.where("text <> '' and x1 > x0 and y1 > y0")
    runs = islands(tokens, ["page"], "at", "tag").where("label <> 'OTHER'")
    entities = runs.groupBy("page", "island", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    name = F.create_map(*[F.lit(s) for kv in INVOICE_FIELDS.items() for s in kv])
    f = pages.select("page", F.explode(F.from_json(original, "map<string,struct<text:string>>")).alias("source_key", "v")).select("page", "source_key", F.col("v.text").alias("value"), F.try_element_at(name, F.col("source_key")).alias("field"))
    return tokens, entities, f.where("field is not null and value <> ''")


def question_json(pages: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """(questions, fields) of pages whose JSON lists questions and answers; the first question of a field gives it."""
    q = pages.select("page", F.posexplode(F.from_json(document, "array<struct<question:string,answer:string>>")).alias("at", "q")).select("page", "at", F.trim("q.question").alias("question"), F.trim("q.answer").alias("answer")).where("question <> '' and answer <> ''")
    f = q.withColumn("field", question_field(F.col("question"))).where("field is not null")
    first = f.groupBy("page", "field").agg(F.min(F.struct("at", "answer", "question")).alias("m"))
    return q, first.select("page", "field", F.col("m.answer").alias("value"), F.col("m.question").alias("source_key"))


def violations(tokens: DataFrame, relations: DataFrame | None, entities: DataFrame | None, width: float, height: float) -> DataFrame:
    """(page, rule, detail): repeated token places, boxes outside the page, relations to entities that are not there."""
    out = tokens.groupBy("page", "at").count().where("count > 1").select("page", F.lit("repeated_token").alias("rule"), F.col("at").cast("string").alias("detail"))
    off = tokens.where((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height) | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))
    out = out.unionByName(off.select("page", F.lit("box_off_page").alias("rule"), F.col("at").cast("string").alias("detail")))
    if relations is not None and entities is not None:
        for end in ("source", "target"):
            lost = relations.join(entities.select("page", F.col("source").alias(end)).distinct(), ["page", end], "left_anti")
            out = out.unionByName(lost.select("page", F.lit(f"unknown_{end}").alias("rule"), F.col("id").alias("detail")))
    return out
