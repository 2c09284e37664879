"""Queries of rotated pages, guards, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import extraction, guards, matching, rotation
from foliant.plans.documents import _lines
from foliant.plans.registry import query, table


def r(x, n: int = 6):
    return F.round(x, n)


_ESTIMATES = """e AS (SELECT event_id, user_id % 4 AS split, event_id % 4 AS cluster, CAST(event_id * 15 % 360 AS DOUBLE) AS truth, CASE WHEN event_id % 11 <> 0 THEN CAST((event_id * 15 + user_id % 9) % 360 AS DOUBLE) END AS estimate,
  event_id % 4 + 1 AS zone, user_id % 4 + 1 AS predicted, value / 500 AS zone_confidence, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events)"""


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", (u % 4).alias("split"), (i % 4).alias("cluster"), (i * 15 % 360).cast("double").alias("truth"), F.when(i % 11 != 0, ((i * 15 + u % 9) % 360).cast("double")).alias("estimate"),
        (i % 4 + 1).alias("zone"), (u % 4 + 1).alias("predicted"), (F.col("value") / 500).alias("zone_confidence"), (i % 100 / 100).alias("confidence"),
    )


@query("evaluation_records", f"""WITH {_ESTIMATES} SELECT event_id, round(least(abs(estimate - truth), 360 - abs(estimate - truth)), 6) AS circular_error, round(((truth - estimate) % 360 + 360) % 360, 6) AS residual_angle,
  CAST(zone = predicted AS INT) AS zone_correct, round(least(zone_confidence, confidence), 6) AS combined_confidence, CASE WHEN estimate IS NULL OR event_id % 7 = 0 AND estimate <> 0 THEN 0 ELSE 1 END AS correction_direction_valid,
  CASE WHEN least(abs(estimate - truth), 360 - abs(estimate - truth)) <= 5 THEN 1 ELSE 0 END AS corrected_within_5_degrees FROM e""")
def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates against the truth; every seventh correction turns the wrong way."""
    e = _estimates(spark, sf_dir).withColumn("correction", F.when(F.col("event_id") % 7 == 0, F.col("estimate")).otherwise(-F.col("estimate")))
    x = rotation.evaluation_record(e, "truth", "estimate", "correction", "zone", "predicted", "zone_confidence", "confidence")
    return x.select("event_id", r(F.col("circular_error")).alias("circular_error"), r(F.col("residual_angle")).alias("residual_angle"), "zone_correct", r(F.col("combined_confidence")).alias("combined_confidence"), "correction_direction_valid", "corrected_within_5_degrees")


@query("cluster_summaries", f"""WITH {_ESTIMATES} SELECT split, cluster, count(*) AS n, count(*) FILTER (WHERE zone <> predicted) AS wrong, {", ".join(f"round({f}({m}), 6) AS {m}_{n}" for m in ("zone_confidence", "confidence") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))} FROM e GROUP BY 1, 2""")
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rotation.cluster_summary(_estimates(spark, sf_dir), ["split", "cluster"], ["zone_confidence", "confidence"], "zone", "predicted")
    return x.select("split", "cluster", "n", "wrong", *[r(F.col(c)).alias(c) for c in x.columns[4:]])


@query("misclassified_rows", f"WITH {_ESTIMATES} SELECT event_id, zone, predicted FROM e WHERE zone <> predicted")
def misclassified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.misclassified(_estimates(spark, sf_dir), "zone", "predicted").select("event_id", "zone", "predicted")


@query("split_violations", """WITH d AS (SELECT doc_id, source, doc_id % 10 = 0 AS private, CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 10 = 0 AND doc_id % 50 <> 0 OR doc_id % 89 = 0 THEN 'private_test' WHEN doc_id % 5 = 1 THEN 'test' ELSE 'train' END AS split, 'g' || doc_id // 7 AS grp FROM documents)
SELECT problem, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM (SELECT CASE WHEN split = '' THEN 'without a split' WHEN private AND split <> 'private_test' THEN 'private in a public split' WHEN NOT private AND split = 'private_test' THEN 'public in the private split' END AS problem FROM d) WHERE problem IS NOT NULL GROUP BY problem
UNION ALL SELECT 'group in several splits', grp, count(DISTINCT split) FROM d GROUP BY grp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'source in several splits', source, count(DISTINCT split) FROM d GROUP BY source HAVING count(DISTINCT split) > 1""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    split = F.when(i % 97 == 0, "").when((i % 10 == 0) & (i % 50 != 0) | (i % 89 == 0), "private_test").when(i % 5 == 1, "test").otherwise("train")
    d = table(spark, sf_dir, "documents").select("source", (i % 10 == 0).alias("private"), split.alias("split"), F.concat(F.lit("g"), F.floor(i / 7)).alias("grp"))
    return rotation.split_violations(d, "split", "private", {"group": "grp", "source": "source"})


@query("rotated_boxes", """WITH b AS (SELECT p_partkey, 20.0::DOUBLE + p_size AS w, 30.0::DOUBLE + p_size AS h, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, 5.0::DOUBLE + p_size AS x1, 9.0::DOUBLE + p_size AS y1, p_partkey % 4 * 90 AS a FROM part)
SELECT p_partkey, CAST(CASE WHEN a % 180 = 0 THEN w ELSE h END AS DOUBLE) AS width, round(CASE a WHEN 0 THEN x0 WHEN 90 THEN y0 WHEN 180 THEN w - x1 ELSE h - y1 END, 6) AS left_edge, round(CASE a WHEN 0 THEN y0 WHEN 90 THEN w - x1 WHEN 180 THEN h - y1 ELSE x0 END, 6) AS top_edge, 1 AS steps, x0 AS back_x, y0 AS back_y FROM b""")
def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of each part's page turned by quarters, all items of the page together, and put back."""
    s = F.col("p_size").cast("double")
    corners = [(F.lit(1.0), F.lit(2.0)), (5 + s, F.lit(2.0)), (5 + s, 9 + s), (F.lit(1.0), 9 + s)]
    item = F.struct(F.lit("t").alias("id"), F.array(*[F.array(x, y) for x, y in corners]).alias("polygon"))
    p = table(spark, sf_dir, "part").select("p_partkey", (20 + s).alias("width"), (30 + s).alias("height"), (F.col("p_partkey") % 4 * 90).alias("angle"), F.array(item).alias("tokens"), F.array(item).alias("entities"))
    x = rotation.rotate_annotation(p, ["tokens", "entities"], "width", "height", "angle")
    step = F.col("transformation_history")[0]
    back = rotation.restored_points(F.col("entities")[0]["polygon"], step["width"], step["height"], step["angle"])[0]
    box = F.col("tokens")[0]["bbox"]
    return x.select("p_partkey", "width", r(box[0]).alias("left_edge"), r(box[1]).alias("top_edge"), F.size("transformation_history").alias("steps"), r(back[0]).alias("back_x"), r(back[1]).alias("back_y"))


@query("polygon_iou_pairs", """WITH p AS (SELECT p_partkey, 10.0::DOUBLE + p_size AS a, 20.0::DOUBLE + p_size % 7 AS b, 5.0::DOUBLE + p_size % 3 AS s, 4.0::DOUBLE + p_size % 5 AS t FROM part),
i AS (SELECT *, s / a + t / b - 1 AS over_ FROM p), j AS (SELECT *, s * t - CASE WHEN over_ > 0 THEN over_ * over_ * a * b / 2 ELSE 0 END AS shared FROM i)
SELECT p_partkey, round(shared / (a * b / 2 + s * t - shared), 6) AS iou FROM j WHERE shared / (a * b / 2 + s * t - shared) >= 0.05""")
def polygon_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right triangle and a box in its corner, on a page for each part."""
    s = F.col("p_size")
    a, b, u, v = ((x).cast("double") for x in (10 + s, 20 + s % 7, 5 + s % 3, 4 + s % 5))
    zero = F.lit(0.0)
    p = table(spark, sf_dir, "part")
    left = p.select("p_partkey", F.lit("t").alias("id"), F.array(F.array(zero, zero), F.array(a, zero), F.array(zero, b)).alias("polygon"))
    right = p.select("p_partkey", F.lit("q").alias("id"), F.array(F.array(zero, zero), F.array(zero, v), F.array(u, v), F.array(u, zero)).alias("polygon"))
    return matching.overlapping_polygons(left, right, ["p_partkey"], 0.05, 20.0).select("p_partkey", r(F.col("iou")).alias("iou"))


@query("private_paths", "SELECT doc_id, source = 'src1' AS private FROM documents")
def private_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with detours: those that end up below the private root, siblings with its name as a prefix left out."""
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("source") == "src1", F.concat(F.lit("/data/open/../mail/./"), i)).otherwise(F.concat(F.lit("/data/mail/../mailbox/"), i))
    return table(spark, sf_dir, "documents").select("doc_id", guards.within(path, ["/data//mail/"]).alias("private"))


@query("hash_mismatches", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not audited' WHEN doc_id % 4 = 0 THEN 'without a hash' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0")
def hash_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    old = live.where("doc_id % 3 <> 0").withColumn("digest", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")))
    return guards.hash_mismatches(live, old, "doc_id", "digest")


@query("build_manifest", """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, d.source, d.lang, CAST(coalesce(e.n, 0) AS INT) AS n_lines, CAST(CASE WHEN e.doc_id IS NULL THEN 0 ELSE 1 END AS INT) AS n_fields, CASE WHEN d.doc_id % 9 = 0 THEN 'unreadable' WHEN e.doc_id IS NULL THEN 'no_annotation' WHEN e.n = 0 THEN 'no_lines' END AS exclusion_reason,
  NOT (d.doc_id % 9 = 0 OR e.doc_id IS NULL OR e.n = 0) AS usable FROM documents d LEFT JOIN e USING (doc_id)""")
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    inventory = d.select("doc_id", "source", "lang", (F.col("doc_id") % 9 != 0).alias("readable"))
    lines = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    examples = d.where("doc_id % 4 <> 0").select("doc_id", lines.alias("lines"), F.array(F.lit("title")).alias("fields"))
    return guards.manifest(inventory, examples, "doc_id", ["source", "lang"], ["lines", "fields"])


@query("trial_report", "SELECT p_partkey, round(list_avg(list_filter([CASE WHEN p_size % 2 = 0 THEN p_size / 50.0::DOUBLE END, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 3000 END], lambda x: x IS NOT NULL)), 6) AS mean_composite, p_brand = 'Brand#11' AS selected FROM part")
def trial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(s % 2 == 0, s / 50).alias("clean"), F.when(s % 3 == 0, F.col("p_retailprice") / 3000).alias("rotated"))
    return guards.trial_report(p, "p_brand", ["clean", "rotated"], "Brand#11").select("p_partkey", r(F.col("mean_composite")).alias("mean_composite"), F.col("selected_for_final").alias("selected"))


@query("evidence_gates", "WITH g AS (SELECT doc_id, n_chars > 100 AS a, lang = 'en' AS b FROM documents) SELECT doc_id, 'long' AS gate, a AS passed FROM g UNION ALL SELECT doc_id, 'english', b FROM g UNION ALL SELECT doc_id, 'all', a AND b FROM g")
def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.evidence_gates(table(spark, sf_dir, "documents"), {"long": F.col("n_chars") > 100, "english": F.col("lang") == "en"}, "doc_id")


@query("rule_evidence", """WITH c AS (SELECT c_custkey, c_custkey % 3 = 0 AS bad FROM customer)
SELECT c_custkey, 'organization_name' AS field, 'ACME TRADING' AS value, 0.6::DOUBLE AS confidence, 'unvalidated' AS status, 'rule:top_header_organization' AS method, 0.0::DOUBLE AS y0 FROM c
UNION ALL SELECT c_custkey, 'subtotal', '100.00', 0.86, 'validated', 'rule:subtotal', 12.0 FROM c UNION ALL SELECT c_custkey, 'tax', '8.00', 0.86, 'validated', 'rule:tax', 24.0 FROM c
UNION ALL SELECT c_custkey, 'total_amount', CASE WHEN bad THEN '150.00' ELSE '108.00' END, 0.86, CASE WHEN bad THEN 'conflict' ELSE 'validated' END, 'rule:total_amount', 36.0 FROM c
UNION ALL SELECT c_custkey, 'email', 'a' || c_custkey || '@mail.example', 0.8, CASE WHEN c_custkey % 4 = 0 THEN 'conflict' ELSE 'validated' END, 'rule:email', 48.0 FROM c""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each customer; a third of the totals don't agree with their parts, a quarter names two addresses."""
    k = F.col("c_custkey")
    total = F.when(k % 3 == 0, "Grand total: 150.00").otherwise("Grand total: 108.00")
    mail = F.concat(F.lit("a"), k.cast("string"), F.lit("@mail.example"))
    texts = F.array(F.lit("ACME TRADING"), F.lit("Subtotal: 100.00"), F.lit("Tax: 8.00"), total, mail, F.when(k % 4 == 0, F.concat(F.lit("b"), mail)).otherwise("."))
    lines = F.transform(texts, lambda t, i: F.struct(i.alias("line"), t.alias("text"), F.lit(0.8).alias("confidence"), F.array(F.lit(1.0), i * 12.0, F.lit(90.0), i * 12.0 + 10).alias("box")))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.explode_outer(F.array(lines)).alias("lines"))
    f = pages.select("c_custkey", F.explode_outer(extraction.page_evidence(F.col("lines"))).alias("x")).where("x is not null").select("c_custkey", "x.*")
    return f.select("c_custkey", "field", "value", r(F.col("confidence")).alias("confidence"), "status", "method", F.col("box")[1].alias("y0"))


_LETTERS = r"regexp_replace(text, '[^\p{L}]', '', 'g')"


@query("organization_lines", rf"""WITH l AS (SELECT doc_id, g.i - 1 AS line, string_split(text, chr(10))[g.i] AS text FROM documents, range(1, 1 + len(string_split(text, chr(10)))) g(i)),
x AS (SELECT *, max(line * 12 + 10) OVER (PARTITION BY doc_id) AS top FROM l WHERE trim(text) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM x WHERE line * 12 <= top * 0.25 AND length(text) >= 3 AND length({_LETTERS}) > 0 AND NOT regexp_matches(text, '(?i)invoice|receipt|date|total|tax|fatura|ใบเสร็จ') AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / greatest(1, length({_LETTERS})) >= 0.5)
SELECT doc_id, trim(text) AS value, 0.6::DOUBLE AS confidence FROM k WHERE r = 1""")
def organization_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line in capitals at the top of each document."""
    y = F.col("line") * 12.0
    lines = _lines(spark, sf_dir).where("trim(text) <> ''").select("doc_id", "text", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(9.0).alias("x1"), (y + 10).alias("y1"), F.lit(0.8).alias("c"))
    return extraction.organization(lines, ["doc_id"], "text", ["x0", "y0", "x1", "y1"], "c")

