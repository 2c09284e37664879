"""Queries of ordered analytics, metrics, calibration and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import angles, arrays
from foliant.operators import fusion, metrics, sampling, sequences
from foliant.plans.registry import query, table


def r(x, n: int = 6):
    return F.round(x, n)


# --- ordered analytics

@query("field_islands", "SELECT user_id, island, event_type, count(*) AS size, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, island, event_type")
def field_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sequences.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return t.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("size"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


_BIO = """tokens AS (SELECT user_id, event_id, CASE WHEN value < 60 THEN 'OTHER' WHEN value < 200 THEN 'KEY' ELSE 'VALUE' END AS label, event_id // 40 AS entity FROM events),
bio AS (SELECT *, CASE WHEN label = 'OTHER' THEN 'O' WHEN lag(label) OVER w = label AND lag(entity) OVER w = entity THEN 'I-' || label ELSE 'B-' || label END AS bio FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("value") < 60, "OTHER").when(F.col("value") < 200, "KEY").otherwise("VALUE")
    return table(spark, sf_dir, "events").select("user_id", "event_id", label.alias("label"), F.floor(F.col("event_id") / 40).alias("entity"))


@query("bio_encode", f"WITH {_BIO} SELECT user_id, event_id, bio FROM bio")
def bio_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.bio_encode(_tokens(spark, sf_dir), ["user_id"], "event_id", "label", "entity").select("user_id", "event_id", "bio")


@query("bio_spans", f"WITH {_BIO}, l AS (SELECT *, CASE WHEN bio <> 'O' THEN substr(bio, 3) END AS lab FROM bio), s AS (SELECT *, CASE WHEN lab IS NOT NULL AND (bio LIKE 'B-%' OR lag(lab) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM lab) THEN 1 ELSE 0 END AS st FROM l), g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS span FROM s) SELECT user_id, span, lab AS label, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM g WHERE lab IS NOT NULL GROUP BY user_id, span, lab")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sequences.bio_encode(_tokens(spark, sf_dir), ["user_id"], "event_id", "label", "entity")
    return sequences.bio_spans(t.select("user_id", "event_id", "bio"), ["user_id"], "event_id", "bio")


@query("weighted_median", "WITH d AS (SELECT l_returnflag, l_discount, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_discount ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM d) SELECT l_returnflag, min(l_discount) AS weighted_median FROM c WHERE u >= t / 2 GROUP BY 1")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("group_medians", "SELECT event_type, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(F.percentile("value", 0.5)).alias("median_value"), r(F.percentile("value", 0.9)).alias("p90"))


@query("token_windows", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT *, greatest(0, CAST(ceil((len(w) - 512) / 448.0) AS INT)) AS k FROM t) SELECT doc_id, i AS win, i * 448 AS start, len(list_slice(w, i * 448 + 1, i * 448 + 512)) AS size, w[i * 448 + 1] AS first_word FROM n, range(0, 100) g(i) WHERE i <= k")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 words that overlap by 64."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    t = t.select("doc_id", F.explode(sequences.sliding_windows(F.col("w"), 512, 64)).alias("x"))
    return t.select("doc_id", F.col("x.window").alias("win"), "x.start", F.size("x.items").alias("size"), F.get("x.items", F.lit(0)).alias("first_word"))


@query("window_average", """WITH s AS (SELECT vec_id, i AS word, j AS win, embedding[i * 4 + j + 1] AS a, embedding[i * 4 + j + 2] AS b FROM embeddings, range(0, 15) g(i), range(0, 3) h(j)) SELECT vec_id, word, 0 AS class, round(avg(CAST(a AS DOUBLE)), 6) AS value FROM s GROUP BY 1, 2 UNION ALL SELECT vec_id, word, 1, round(avg(CAST(b AS DOUBLE)), 6) FROM s GROUP BY 1, 2""")
def window_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping windows score each of 15 words of a vector for two classes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("word")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("win"))
    at = F.col("word") * 4 + F.col("win")
    e = e.select("vec_id", "word", "win", F.lit(0).alias("place"), F.array(F.get("embedding", at).cast("double"), F.get("embedding", at + 1).cast("double")).alias("p"))
    return sequences.average_over_windows(e, ["vec_id"], "win", "word", "place", "p").withColumn("value", r(F.col("value")))


@query("transcript_concat", "SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def transcript_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("transcript"))


# --- decoding and calibration

@query("argmax_decode", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS predicted, list_max(embedding) >= 0.1 AS kept FROM embeddings")
def argmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.argmax(x).alias("predicted"), (F.array_max(x) >= F.lit(0.1).cast("double")).alias("kept"))


@query("softmax_temperature", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) / 0.7)) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, round(e[4] / list_sum(e), 6) AS p3 FROM s")
def softmax_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", arrays.softmax(F.col("embedding"), 0.7).alias("p"))
    return t.select("vec_id", *[r(F.col("p")[i]).alias(f"p{i}") for i in range(4)])


@query("temperature_fit", "WITH g AS (SELECT 0.25 * pow(16.0, i / 20.0) AS temperature FROM range(0, 21) t(i)), x AS (SELECT temperature, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / temperature) AS s, label FROM embeddings, g) SELECT round(temperature, 6) AS temperature, round(avg(ln(list_sum(list_transform(s, lambda v: exp(v)))) - s[label + 1]), 6) AS nll FROM x GROUP BY temperature")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("x"), "label")
    return metrics.temperature_grid(t, "x", "label").select(r(F.col("temperature")).alias("temperature"), r(F.col("nll")).alias("nll"))


_SCORED = "s AS (SELECT l.doc_id, toxic AS truth, (d.n_chars * 7919 % 1000) / 999.0 AS confidence, CAST(d.n_chars % 3 > 0 AS INT) AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return t.select("doc_id", F.col("toxic").cast("int").alias("truth"), (F.col("n_chars") * 7919 % 1000 / F.lit(999.0)).alias("confidence"), (F.col("n_chars") % 3 > 0).cast("int").alias("predicted"))


@query("f1_threshold", f"WITH {_SCORED}, g AS (SELECT confidence AS t, count(*) FILTER (WHERE truth > 0 AND predicted = truth) AS hit, count(*) AS n FROM s WHERE predicted > 0 GROUP BY 1), c AS (SELECT t, sum(hit) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)) SELECT round(t, 6) AS threshold, round(2 * tp / (al + (SELECT count(*) FROM s WHERE truth > 0)), 6) AS f1 FROM c ORDER BY 2 * tp / (al + (SELECT count(*) FROM s WHERE truth > 0)) DESC, t DESC LIMIT 1")
def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1_threshold(_scored(spark, sf_dir), "confidence", "predicted", "truth").select(r(F.col("threshold")).alias("threshold"), r(F.col("f1")).alias("f1"))


@query("f1_at_threshold", f"WITH {_SCORED}, k AS (SELECT truth, CASE WHEN confidence >= 0.4 THEN predicted ELSE 0 END AS p FROM s), c AS (SELECT count(*) FILTER (WHERE truth > 0 AND p = truth) AS tp, count(*) FILTER (WHERE p > 0 AND NOT (truth > 0 AND p = truth)) AS fp, count(*) FILTER (WHERE truth > 0 AND p <> truth) AS fn FROM k) SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def f1_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("p", F.when(F.col("confidence") >= 0.4, F.col("predicted")).otherwise(0))
    c = s.agg(*[v.alias(k) for k, v in metrics.positive_counts(F.col("truth"), F.col("p")).items()])
    return c.withColumn("f1", r(metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))))


@query("coverage_threshold", f"WITH {_SCORED}, g AS (SELECT confidence AS t, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS hit FROM s GROUP BY 1), c AS (SELECT t, sum(n) OVER w AS kept, sum(hit) OVER w AS hits, sum(n) OVER () AS al FROM g WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)) SELECT round(t, 6) AS threshold, round(hits / kept, 6) AS accuracy, round(kept / al, 6) AS coverage FROM c WHERE kept / al + 1e-12 >= 0.9 ORDER BY hits / kept DESC, t DESC LIMIT 1")
def coverage_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("ok", F.col("truth") == F.col("predicted"))
    return metrics.best_coverage_threshold(s, "confidence", "ok").select(*[r(F.col(c)).alias(c) for c in ("threshold", "accuracy", "coverage")])


@query("calibration_error", f"WITH {_SCORED}, b AS (SELECT least(14, floor(confidence * 15)) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(truth = predicted AS DOUBLE)) AS y FROM s GROUP BY 1) SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("ok", F.col("truth") == F.col("predicted"))
    return metrics.calibration_error(s, "confidence", "ok").select(r(F.col("ece")).alias("ece"))


@query("abstention", "SELECT vec_id, CASE WHEN c >= CASE p WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.15 END THEN p ELSE 0 END AS kept FROM (SELECT vec_id, CAST(label % 4 AS INT) AS p, abs(CAST(embedding[1] AS DOUBLE)) AS c FROM embeddings)")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).cast("int").alias("p"), F.abs(F.col("embedding")[0].cast("double")).alias("c"))
    return t.select("vec_id", fusion.abstain(F.col("c"), F.col("p"), ["none", "key", "value", "other"], 0.5, {"key": 0.2, "value": 0.3, "default": 0.15}).alias("kept"))


# --- metrics

@query("confusion_metrics", "WITH p AS (SELECT label AS t, CAST(vec_id * 7 % 10 AS INT) AS p FROM embeddings), k AS (SELECT DISTINCT t AS class FROM p UNION SELECT DISTINCT p FROM p), c AS (SELECT class, (SELECT count(*) FROM p WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM p WHERE t <> class AND p = class) AS fp, (SELECT count(*) FROM p WHERE t = class AND p <> class) AS fn, (SELECT count(*) FROM p) AS n FROM k) SELECT class, tp, fp, fn, tp + fn AS support, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") * 7 % 10).cast("int").alias("p"))
    m = metrics.class_metrics(t, "label", "p")
    return m.select("class", "tp", "fp", "fn", "support", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("positive_class_counts", "WITH p AS (SELECT CASE WHEN label = 9 THEN -100 ELSE label % 4 END AS t, CAST(vec_id % 4 AS INT) AS p FROM embeddings) SELECT count(*) FILTER (WHERE t <> -100 AND t > 0 AND t = p) AS tp, count(*) FILTER (WHERE t <> -100 AND p > 0 AND NOT (t > 0 AND t = p)) AS fp, count(*) FILTER (WHERE t > 0 AND t <> p) AS fn FROM p")
def positive_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") == 9, -100).otherwise(F.col("label") % 4).alias("t"), (F.col("vec_id") % 4).cast("int").alias("p"))
    return t.agg(*[v.alias(k) for k, v in metrics.positive_counts(F.col("t"), F.col("p")).items()])


@query("clustering_indices", "WITH c AS (SELECT label AS a, CAST(vec_id % 5 + label // 3 AS INT) AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n, max(n) AS m FROM c GROUP BY b), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * ln(n)) FROM c) AS lij, (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * ln(n)) FROM ra) AS la, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, (SELECT sum(n * ln(n)) FROM rb) AS lb, (SELECT sum(m) FROM rb) AS m), h AS (SELECT *, sa * sb / (n * (n - 1) / 2) AS ex, ln(n) - la / n AS ha, ln(n) - lb / n AS hb, ln(n) + (lij - la - lb) / n AS mi FROM s) SELECT round((ij - ex) / ((sa + sb) / 2 - ex), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(m / n, 6) AS purity FROM h")
def clustering_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5 + F.floor(F.col("label") / 3)).cast("int").alias("c"))
    m = metrics.clustering_indices(t, "label", "c")
    return m.select(*[r(F.col(c)).alias(c) for c in m.columns])


@query("optimal_assignment", "WITH c AS (SELECT CAST(vec_id % 4 AS INT) AS c, CAST(label AS INT) AS t, count(*) AS n FROM embeddings WHERE label < 4 GROUP BY 1, 2), v AS (SELECT i FROM range(0, 4) t(i)), p AS (SELECT a.i AS p0, b.i AS p1, d.i AS p2, e.i AS p3 FROM v a, v b, v d, v e WHERE a.i <> b.i AND a.i <> d.i AND a.i <> e.i AND b.i <> d.i AND b.i <> e.i AND d.i <> e.i), s AS (SELECT *, (SELECT coalesce(sum(n), 0) FROM c WHERE (c = 0 AND t = p0) OR (c = 1 AND t = p1) OR (c = 2 AND t = p2) OR (c = 3 AND t = p3)) AS total FROM p), best AS (SELECT * FROM s ORDER BY total DESC, p0, p1, p2, p3 LIMIT 1), l AS (SELECT 0 AS cluster, p0 AS truth, total FROM best UNION ALL SELECT 1, p1, total FROM best UNION ALL SELECT 2, p2, total FROM best UNION ALL SELECT 3, p3, total FROM best) SELECT cluster, truth, coalesce(n, 0) AS n, total FROM l LEFT JOIN c ON c.c = cluster AND c.t = truth")
def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").where("label < 4").select("label", (F.col("vec_id") % 4).alias("c"))
    return metrics.best_assignment(t, "label", "c")


@query("multiset_prf", "WITH e AS (SELECT lang AS grp, lower(w) AS w, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2), p AS (SELECT lang AS grp, lower(w) AS w, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id % 2 = 1) GROUP BY 1, 2), j AS (SELECT coalesce(e.grp, p.grp) AS grp, coalesce(e.n, 0) AS e, coalesce(p.n, 0) AS p FROM e FULL JOIN p ON e.grp = p.grp AND e.w = p.w), s AS (SELECT grp, sum(least(e, p)) AS tp, sum(e) AS e, sum(p) AS p FROM j GROUP BY grp) SELECT grp, CAST(tp AS BIGINT) AS tp, CAST(e AS BIGINT) AS expected, CAST(p AS BIGINT) AS found, round(tp / p, 6) AS precision, round(tp / e, 6) AS recall, round(2 * tp / (e + p), 6) AS f1 FROM s")
def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.explode(F.split(F.lower("text"), " ")).alias("w"), (F.col("doc_id") % 2).alias("half"))
    m = metrics.multiset_prf(w.where("half = 0"), w.where("half = 1"), ["grp"], ["w"])
    return m.select("grp", "tp", "expected", "found", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("micro_macro_rates", "WITH g AS (SELECT user_id, event_type, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS num, count(*) FILTER (WHERE value > 20) AS den FROM events GROUP BY 1, 2) SELECT event_type, round(sum(num) / nullif(sum(den), 0), 6) AS micro, round(avg(num / nullif(den, 0)), 6) AS macro FROM g GROUP BY event_type")
def micro_macro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 100).alias("num"), F.count_if(F.col("value") > 20).alias("den"))
    return g.groupBy("event_type").agg(r(F.try_divide(F.sum("num"), F.sum("den"))).alias("micro"), r(F.avg(F.try_divide("num", "den"))).alias("macro"))


@query("circular_error_summary", "WITH a AS (SELECT event_type, ((value % 360) + 360) % 360 AS e, ((user_id * 37 + event_id) % 360) * 1.0::DOUBLE AS t FROM events), d AS (SELECT event_type, least(abs(e - t), 360 - abs(e - t)) AS e FROM a) SELECT event_type, count(*) AS n, round(avg(e), 6) AS mae, round(median(e), 6) AS median, round(stddev_pop(e), 6) AS std, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS largest, round(avg(CAST(e <= 1 AS DOUBLE)), 6) AS within_1, round(avg(CAST(e <= 2 AS DOUBLE)), 6) AS within_2, round(avg(CAST(e <= 3 AS DOUBLE)), 6) AS within_3, round(avg(CAST(e <= 5 AS DOUBLE)), 6) AS within_5, round(avg(CAST(e <= 10 AS DOUBLE)), 6) AS within_10 FROM d GROUP BY event_type")
def circular_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type", "value", ((F.col("user_id") * 37 + F.col("event_id")) % 360).cast("double").alias("truth"))
    m = metrics.circular_summary(t, ["event_type"], "value", "truth")
    return m.select("event_type", "n", *[r(F.col(c)).alias(c) for c in m.columns[2:]])


@query("angle_expansion", "SELECT p_partkey, a.angle, CAST(floor(a.angle / 90) + 1 AS INT) AS zone, CAST(p_partkey AS VARCHAR) || '_angle_' || lpad(CAST(CAST(a.angle AS INT) AS VARCHAR), 3, '0') || '_zone_' || CAST(CAST(floor(a.angle / 90) + 1 AS INT) AS VARCHAR) || '.png' AS name, CASE WHEN a.angle = 0 THEN 0 ELSE -a.angle END AS correction FROM part JOIN (VALUES (0, 0.0::DOUBLE), (0, 90.0), (0, 359.0), (1, 45.0), (1, 180.0), (2, 270.0)) a(kind, angle) ON p_partkey % 3 = a.kind")
def angle_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(0, 0.0), (0, 90.0), (0, -1.0), (1, 405.0), (1, 180.0), (2, -90.0)], "kind int, raw double")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("kind")).join(F.broadcast(listed), "kind")
    name = angles.rotation_name(F.col("p_partkey").cast("string"), F.col("raw"))
    return p.select("p_partkey", angles.normal_angle(F.col("raw")).alias("angle"), angles.zone(F.col("raw")).alias("zone"), name.alias("name"), angles.signed_correction(F.col("raw")).alias("correction"))


@query("class_weights", "WITH n AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1), w AS (SELECT label, n, least(4.0, greatest(0.25, sqrt(sum(n) OVER () / (count(*) OVER () * n)))) AS w FROM n) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "events"), "event_type").withColumn("weight", r(F.col("weight")))


@query("baseline_retention", "WITH g AS (SELECT p_size % 4 AS angle, avg(p_retailprice) AS score FROM part GROUP BY 1) SELECT angle, round(score, 6) AS score, round(score / nullif((SELECT score FROM g WHERE angle = 0), 0), 6) AS retention FROM g")
def baseline_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).alias("angle")).agg(F.avg("p_retailprice").alias("score"))
    base = F.max(F.when(F.col("angle") == 0, F.col("score"))).over(Window.partitionBy())
    return g.select("angle", r(F.col("score")).alias("score"), r(F.try_divide("score", base)).alias("retention"))


@query("setting_selection", "SELECT l_shipmode_like AS setting, round(coverage, 6) AS coverage, round(error, 6) AS error FROM (SELECT l_linenumber AS l_shipmode_like, avg(l_discount) AS coverage, avg(l_tax) AS error FROM lineitem GROUP BY 1) ORDER BY coverage DESC, error, setting LIMIT 1")
def setting_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("setting")).agg(F.avg("l_discount").alias("coverage"), F.avg("l_tax").alias("error"))
    return sampling.best_one(g.withColumn("_all", F.lit(1)), ["_all"], F.desc("coverage"), F.col("error"), F.col("setting")).select("setting", r(F.col("coverage")).alias("coverage"), r(F.col("error")).alias("error"))


@query("boundary_errors", "WITH p AS (SELECT vec_id % 3 AS split, label % 4 + 1 AS t, CAST(vec_id % 4 AS INT) + 1 AS p FROM embeddings) SELECT split, count(*) AS n, round(avg(CAST(t = p AS DOUBLE)), 6) AS accuracy, count(*) FILTER (WHERE t <> p AND abs(t - p) IN (1, 3)) AS neighbour_errors FROM p GROUP BY split")
def boundary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("split"), (F.col("label") % 4 + 1).alias("t"), (F.col("vec_id") % 4 + 1).alias("p"))
    return t.groupBy("split").agg(F.count("*").alias("n"), r(F.avg((F.col("t") == F.col("p")).cast("double"))).alias("accuracy"), F.count_if((F.col("t") != F.col("p")) & F.abs(F.col("t") - F.col("p")).isin(1, 3)).alias("neighbour_errors"))


@query("private_aggregate", "SELECT count(*) AS documents, count(DISTINCT lang) AS languages, round(avg(n_chars), 6) AS mean_chars, round(stddev_pop(n_chars), 6) AS std_chars, count(*) FILTER (WHERE n_chars > 5000) AS long_documents FROM documents")
def private_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), r(F.avg("n_chars")).alias("mean_chars"), r(F.stddev_pop("n_chars")).alias("std_chars"), F.count_if(F.col("n_chars") > 5000).alias("long_documents"))


# --- fusion

_SIDE = "SELECT user_id, event_type AS field, arg_max(CAST(round(value) AS BIGINT) % 3, struct_pack(v := value, e := event_id)) AS value, max(value) / 500 AS confidence FROM events WHERE event_id % 2 = {} GROUP BY 1, 2"


def _side(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == half)
    value = F.max_by((F.round("value").cast("long") % 3), F.struct("value", "event_id"))
    return e.groupBy("user_id", F.col("event_type").alias("field")).agg(value.cast("string").alias("value"), (F.max("value") / 500).alias("confidence"))


@query("fusion_page", f"WITH m AS ({_SIDE.format(0)}), r AS ({_SIDE.format(1)}), j AS (SELECT coalesce(m.user_id, r.user_id) AS user_id, coalesce(m.field, r.field) AS field, m.value AS mv, m.confidence AS mc, r.value AS rv, r.confidence AS rc FROM m FULL JOIN r ON m.user_id = r.user_id AND m.field = r.field), o AS (SELECT *, CASE WHEN mc IS NULL THEN 'rule' WHEN rc IS NULL THEN 'model' WHEN mv = rv THEN CASE WHEN mc >= rc THEN 'model' ELSE 'rule' END WHEN abs(mc - rc) >= 0.15 THEN CASE WHEN mc > rc THEN 'model' ELSE 'rule' END END AS origin, CASE WHEN mc IS NULL OR rc IS NULL OR mv = rv THEN NULL WHEN abs(mc - rc) >= 0.15 THEN 'conflict_selected' ELSE 'conflict_abstained' END AS note FROM j) SELECT user_id, field, CAST(CASE origin WHEN 'model' THEN mv WHEN 'rule' THEN rv END AS VARCHAR) AS value, round(CASE origin WHEN 'model' THEN mc WHEN 'rule' THEN rc END, 6) AS confidence, origin, note FROM o")
def fusion_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse_page(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1), ["user_id", "field"]).withColumn("confidence", r(F.col("confidence")))


@query("fusion_document", "WITH v AS (SELECT user_id, event_type AS field, CAST(CAST(round(value) AS BIGINT) % 5 AS VARCHAR) AS value, max(value / 500) AS best, count(*) AS n FROM events GROUP BY 1, 2, 3), s AS (SELECT *, least(1.0, best + least(0.10, 0.03 * (n - 1))) AS score FROM v), r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt, count(*) OVER (PARTITION BY user_id, field) AS vals FROM s WINDOW w AS (PARTITION BY user_id, field ORDER BY score DESC, value DESC)) SELECT user_id, field, CASE WHEN nxt IS NULL OR score - nxt >= 0.10 THEN value END AS value, CASE WHEN nxt IS NULL OR score - nxt >= 0.10 THEN round(score, 6) END AS score, vals AS \"values\" FROM r WHERE r = 1")
def fusion_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), (F.round("value").cast("long") % 5).cast("string").alias("value"), (F.col("value") / 500).alias("c"))
    return fusion.fuse_document(e, ["user_id", "field"], "value", "c").withColumn("score", r(F.col("score")))


@query("fusion_type", "WITH m AS (SELECT user_id, event_type AS label, avg(value / 500) AS c FROM events WHERE event_type <> 'unknown' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS r, lead(c) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY user_id ORDER BY c DESC, label DESC)) SELECT user_id, CASE WHEN nxt IS NOT NULL AND c - nxt < 0.10 THEN 'unknown' ELSE label END AS label, round(c, 6) AS confidence FROM r WHERE r = 1")
def fusion_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") / 500).alias("c"))
    return fusion.fuse_type(e, ["user_id"], "event_type", "c").withColumn("confidence", r(F.col("confidence")))


@query("route_decision", "SELECT doc_id, concat_ws(',', CASE WHEN lang = 'th' THEN 'hint_is_thai' END, CASE WHEN n_chars % 100 / 100.0 < 0.75 THEN 'low_confidence' END, CASE WHEN len(string_split(text, ' ')) < 2 THEN 'empty_or_weak' END) AS reasons, CASE WHEN regexp_matches(text, '[ÇĞİÖŞÜçğıöşü]') THEN 'tr' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE '' END AS languages FROM documents")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    reasons = fusion.route_reasons(t, F.col("lang"), F.col("n_chars") % 100 / 100, F.size(F.split(t, " ")), F.lit(1.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(reasons, ",").alias("reasons"), F.array_join(fusion.languages(t), ",").alias("languages"))


@query("route_selection", "WITH s AS (SELECT user_id, sum(value) FILTER (WHERE event_id % 2 = 0) / 5000 AS g, sum(value) FILTER (WHERE event_id % 2 = 1) / 5000 AS t FROM events GROUP BY 1) SELECT user_id, CASE WHEN t IS NULL OR coalesce(g, -1) >= t + 0.08 THEN 'general' ELSE 'thai' END AS route FROM s")
def route_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of the higher total, 0.08 more for the preferred one; general on ties."""
    half = F.when(F.col("event_id") % 2 == 0, "general").otherwise("thai")
    s = table(spark, sf_dir, "events").groupBy("user_id", half.alias("route")).agg((F.sum("value") / 5000).alias("total"))
    score = F.col("total") + F.when(F.col("route") == "thai", 0.08).otherwise(0.0)
    return s.groupBy("user_id").agg(F.max_by("route", F.struct(score.alias("s"), (F.col("route") == "general").alias("g"))).alias("route"))
