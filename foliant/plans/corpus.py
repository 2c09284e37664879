"""Queries over documents, pages and tables as files: pairing, duplicates, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.operators import graph, relational, sampling, splits
from foliant.plans.registry import query, table

RANK = "sha256('42|' || CAST(doc_id AS VARCHAR))"


@query("unpaired_orders", "SELECT o_orderkey AS orderkey, 'order_without_lines' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'lines_without_order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def unpaired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return relational.unmatched(orders, lines, ["orderkey"], ("order_without_lines", "lines_without_order"))


@query("split_lookup_join", "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority, 'none') AS group_key, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def split_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority", F.lit("none")).alias("group_key"), "c_nationkey")


@query("required_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def required_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return relational.required_join(n, table(spark, sf_dir, "region"), ["r_regionkey"], "region").select("n_name", "r_name")


@query("selected_members", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09)")
def selected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(hits, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


_URL_SQL = """
WITH p AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '.', '_'), '/', '_') AS stem FROM pages),
keys AS (SELECT DISTINCT array_to_string(list_slice(string_split(stem, '_'), 1, 1 + CAST(page_id % 4 AS INT)), '_') AS k FROM p WHERE page_id % 3 = 0),
cuts AS (SELECT page_id, g.n AS n, array_to_string(list_slice(string_split(stem, '_'), 1, CAST(g.n AS INT)), '_') AS cut FROM p, range(1, 1 + len(string_split(stem, '_'))) g(n)),
best AS (SELECT page_id, max(n) AS n FROM cuts WHERE cut IN (SELECT k FROM keys) GROUP BY page_id)
SELECT p.page_id, p.stem, c.cut AS matched_prefix FROM p LEFT JOIN best b USING (page_id) LEFT JOIN cuts c ON c.page_id = b.page_id AND c.n = b.n
"""


@query("url_longest_prefix", _URL_SQL)
def url_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes to find come from every third page's address, cut at varying depth."""
    stem = F.translate(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), "./", "__")
    p = table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"))
    keys = p.where("page_id % 3 = 0").select(F.array_join(F.slice(F.split("stem", "_"), F.lit(1), (F.col("page_id") % 4 + 1).cast("int")), "_").alias("k"))
    stems = p.select("stem").distinct()
    found = relational.longest_prefix_join(stems, "stem", keys, "k")
    return p.join(found, "stem").select("page_id", "stem", "matched_prefix")


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^(?:[a-z]+://)?([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^(?:[a-z]+://)?[^/?#]+/([^/?#]*)', 1), '') AS component, lower(nullif(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1), '')) AS stem, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'fragment' ELSE 'plain' END AS kind FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")

    def part(pattern: str):
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))

    kind = F.when(url.contains("?"), "query").when(url.contains("#"), "fragment").otherwise("plain")
    return table(spark, sf_dir, "pages").select("page_id", part(r"^(?:[a-z]+://)?([^/?#]+)").alias("host"), part(r"^(?:[a-z]+://)?[^/?#]+/([^/?#]*)").alias("component"), F.lower(part(r"/([^/?#]*)(?:[?#].*)?$")).alias("stem"), kind.alias("kind"))


@query("exact_duplicate_report", "SELECT 'dup_' || substr(sha256(text), 1, 16) AS group_id, sha256(text) AS content_hash, count(*) AS members, min(doc_id) AS canonical, count(DISTINCT source) > 1 AS crosses FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY text HAVING count(*) > 1")
def exact_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = relational.exact_duplicates(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "source")
    return groups.select(F.concat(F.lit("dup_"), F.substring("content_hash", 1, 16)).alias("group_id"), "content_hash", "members", "canonical", "crosses")


@query("document_rollup", "SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, min_by(text, struct_pack(a := CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, b := turn)) AS primary_text, min(CASE WHEN role = 'assistant' THEN turn END) AS first_answer, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.min_by("text", F.struct(rank.alias("a"), F.col("turn").alias("b"))).alias("primary_text"),
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_answer"), F.count_distinct("role").alias("roles"),
    )


@query("audit_grouping_sets", "SELECT d.lang, d.source, count(*) AS docs, sum(n_chars) AS chars, count(DISTINCT d.text) AS texts, count(*) FILTER (WHERE quality = 1) AS good, round(avg(n_chars), 6) AS mean_chars, grouping(d.lang) * 2 + grouping(d.source) AS level FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((d.lang), (d.source), (d.lang, d.source), ())")
def audit_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h")).join(l, "doc_id", "left")
    sets = d.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source")
    return sets.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("h").alias("texts"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.grouping_id().cast("int").alias("level"))


@query("audit_summary", "SELECT source, count(*) AS files, count(*) FILTER (WHERE n_chars = 0) AS empty_files, sum(n_chars) AS bytes, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang <> 'en') AS other, max(n_chars) AS largest FROM documents GROUP BY source")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") == 0).alias("empty_files"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.max("n_chars").alias("largest"))


@query("human_sizes", "SELECT doc_id, CASE WHEN n_chars * 40 < 1024 THEN printf('%.2f B', n_chars * 40.0) WHEN n_chars * 40 < 1048576 THEN printf('%.2f KiB', n_chars * 40 / 1024.0) ELSE printf('%.2f MiB', n_chars * 40 / 1048576.0) END AS size FROM documents")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.human_bytes(F.col("n_chars") * 40).alias("size"))


@query("usability_first_reason", "SELECT doc_id, coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 8000 THEN 'too_long' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END) AS reason, coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN false END, n_chars BETWEEN 200 AND 8000 AND lang IN ('en', 'de', 'fr')) AS usable FROM documents")
def usability_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(F.when(ids.blank_to_null(F.col("text")).isNull(), "empty"), F.when(F.col("n_chars") < 200, "too_short"), F.when(F.col("n_chars") > 8000, "too_long"), F.when(~F.col("lang").isin("en", "de", "fr"), "language"))
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).withColumn("usable", F.col("reason").isNull())


@query("error_types", "SELECT event_id, CASE WHEN note LIKE '%empty%' THEN 'empty_file' WHEN note LIKE '%unread%' THEN 'unreadable' WHEN note LIKE '%encod%' THEN 'encoding' ELSE 'other' END AS error_type FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'file is empty' WHEN 1 THEN 'unreadable image' WHEN 2 THEN 'bad encoding' ELSE event_type END AS note FROM events)")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 4
    note = F.when(at == 0, "file is empty").when(at == 1, "unreadable image").when(at == 2, "bad encoding").otherwise(F.col("event_type"))
    kind = F.when(F.col("note").contains("empty"), "empty_file").when(F.col("note").contains("unread"), "unreadable").when(F.col("note").contains("encod"), "encoding").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", note.alias("note")).select("event_id", kind.alias("error_type"))


@query("path_redaction", r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS shown_url, 'ds_' || substr(sha256('web|' || regexp_replace(url, '^[./]+', '')), 1, 12) AS file_id, CASE WHEN page_id % 5 = 0 THEN 'private_' || lpad(CAST(page_id AS VARCHAR), 6, '0') ELSE regexp_replace(url, '//[^/]+', '//***') END AS safe_path FROM pages")
def path_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    private, url = F.col("page_id") % 5 == 0, F.col("url")
    safe = F.when(private, F.concat(F.lit("private_"), F.lpad(F.col("page_id").cast("string"), 6, "0"))).otherwise(F.regexp_replace(url, "//[^/]+", "//***"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(private, "").otherwise(url).alias("shown_url"), ids.file_id(F.lit("web"), url).alias("file_id"), safe.alias("safe_path"))


@query("stable_ids", "SELECT doc_id, 'doc_' || substr(sha256(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)), 1, 16) AS stable_id, substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 20) AS opaque_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    opaque = F.substring(F.sha2(F.concat("source", F.decode(F.unhex(F.lit("00")), "UTF-8"), d.cast("string")), 256), 1, 20)
    return table(spark, sf_dir, "documents").select("doc_id", ids.stable_id("doc", F.col("source"), F.col("lang"), d).alias("stable_id"), opaque.alias("opaque_id"))


@query("stable_document_ids", "SELECT source, text_hash, 'ds_' || lpad(CAST(dense_rank() OVER (PARTITION BY source ORDER BY text_hash) - 1 AS VARCHAR), 6, '0') AS document_id FROM (SELECT source, sha256(text) AS text_hash FROM documents)")
def stable_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("text_hash")
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("text_hash"))
    return d.withColumn("document_id", F.concat(F.lit("ds_"), F.lpad((F.dense_rank().over(w) - 1).cast("string"), 6, "0")))


@query("id_collisions", "SELECT short_id, count(DISTINCT doc_id) AS owners FROM (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS short_id, doc_id FROM documents) GROUP BY short_id HAVING count(DISTINCT doc_id) > 1")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 3).alias("short_id"), "doc_id")
    return d.groupBy("short_id").agg(F.count_distinct("doc_id").alias("owners")).where("owners > 1")


@query("hash_rank_sample", f"SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK}) AS place FROM documents) WHERE place <= 25")
def hash_rank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_n(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 25)


_QUOTA = """floors AS (SELECT *, least(size, floor(exact)) AS f FROM exact),
marked AS (SELECT *, cap - sum(f) OVER (PARTITION BY part) AS left_over, CASE WHEN f < size THEN 1 ELSE 0 END AS open FROM floors),
nth AS (SELECT *, sum(open) OVER (PARTITION BY part ORDER BY exact - f DESC, s ROWS UNBOUNDED PRECEDING) AS n FROM marked),
quotas AS (SELECT part, s, f + CASE WHEN open = 1 AND n <= left_over THEN 1 ELSE 0 END AS quota FROM nth)"""


@query("proportional_sample", f"""WITH sizes AS (SELECT 0 AS part, source AS s, count(*) AS size, 120 AS cap FROM documents GROUP BY source),
exact AS (SELECT *, cap * size / CAST(sum(size) OVER () AS DOUBLE) AS exact FROM sizes), {_QUOTA},
ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {RANK}) AS place FROM documents)
SELECT source, doc_id, place FROM ranked JOIN quotas ON source = s WHERE place <= quota""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.proportional(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 120)


@query("round_robin_sample", f"SELECT source, doc_id, depth, row_number() OVER (ORDER BY depth, source) AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {RANK}) - 1 AS depth FROM documents) ORDER BY depth, source LIMIT 130")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 130).select("source", "doc_id", "depth", "turn")


@query("two_level_quota", f"""WITH parts AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
caps AS (SELECT lang, 150 // n + CASE WHEN i < 150 % n THEN 1 ELSE 0 END AS cap FROM parts),
sizes AS (SELECT d.lang AS part, source AS s, count(*) AS size, max(cap) AS cap FROM documents d JOIN caps c ON d.lang = c.lang GROUP BY d.lang, source),
exact AS (SELECT *, cap * size / CAST(sum(size) OVER (PARTITION BY part) AS DOUBLE) AS exact FROM sizes), {_QUOTA},
ranked AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {RANK}) AS place FROM documents)
SELECT lang, source, doc_id, place, CAST(quota AS BIGINT) AS quota FROM ranked JOIN quotas ON lang = part AND source = s WHERE place <= quota""")
def two_level_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.two_level(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 150)


@query("preference_pick", "SELECT lang, doc_id FROM (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY CASE WHEN l.toxic = 1 THEN 0 WHEN l.toxic = 0 THEN 1 ELSE 2 END, n_chars DESC, d.doc_id) AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE r = 1")
def preference_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, 1).otherwise(2)
    return sampling.best_one(d, ["lang"], first, F.desc("n_chars"), F.col("doc_id")).select("lang", "doc_id")


@query("split_targets", "WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source), e AS (SELECT source, total, s.pos, s.split, total * s.ratio AS exact, floor(total * s.ratio) AS f FROM t, (VALUES (0, 'train', 0.70::DOUBLE), (1, 'dev_select', 0.10::DOUBLE), (2, 'dev_calibration', 0.05::DOUBLE), (3, 'test_in_domain', 0.15::DOUBLE)) s(pos, split, ratio)) SELECT source, split, CAST(f + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY exact - f DESC, pos) <= total - sum(f) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS BIGINT) AS target FROM e")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return splits.target_counts(totals, ["source"])


_FRACTION = "CAST('0x' || substr(sha256('42|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE"


@query("hash_split_assignment", f"SELECT doc_id, CASE WHEN {_FRACTION} < 0.15 THEN 'validation' ELSE 'train' END AS project_split FROM documents")
def hash_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("leakage_check", f"WITH s AS (SELECT CASE WHEN {_FRACTION} < 0.15 THEN 'validation' ELSE 'train' END AS split, sha256(text) AS content, CAST(doc_id AS VARCHAR) AS document, source FROM documents), long AS (SELECT split, 'content' AS kind, content AS value FROM s UNION ALL SELECT split, 'document', document FROM s UNION ALL SELECT split, 'source', source FROM s) SELECT kind, value, count(DISTINCT split) AS splits FROM long GROUP BY kind, value HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = splits.hash_split(table(spark, sf_dir, "documents"), "doc_id")
    d = d.select("project_split", F.sha2("text", 256).alias("content"), F.col("doc_id").alias("document"), "source")
    return splits.leaks(d, "project_split", ["content", "document", "source"])


@query("duplicate_components", """WITH RECURSIVE k AS (SELECT doc_id, sha256(text) AS a, sha256(substr(text, 1, 60)) AS b FROM documents),
e AS (SELECT k.doc_id AS u, m.v FROM k JOIN (SELECT a, min(doc_id) AS v FROM k GROUP BY a) m USING (a) UNION SELECT k.doc_id, m.v FROM k JOIN (SELECT b, min(doc_id) AS v FROM k GROUP BY b) m USING (b)),
sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b.v, r.root FROM reach r JOIN sym b ON r.id = b.u WHERE r.root < b.v)
SELECT id, min(root) AS root FROM reach GROUP BY id""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by equal texts or equal openings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.sha2(F.substring("text", 1, 60), 256).alias("b"))
    return graph.components_by_keys(d, "doc_id", ["a", "b"])


@query("leakage_safe_split")
def leakage_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("a"), F.sha2(F.substring("text", 1, 60), 256).alias("b"))
    return splits.leakage_safe_split(d, "doc_id", "source", ["a", "b"], held_out=["src19"])


@query("ordered_union_distinct", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation, name ORDER BY origin, key) AS r FROM (SELECT c_nationkey AS nation, substr(c_name, -1) AS name, c_custkey AS key, 0 AS origin FROM customer UNION ALL SELECT s_nationkey, substr(s_name, -1), s_suppkey, 1 FROM supplier)) WHERE r = 1".replace("SELECT * FROM (SELECT *", "SELECT nation, name, key, origin FROM (SELECT *"))
def ordered_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.substring("c_name", -1, 1).alias("name"), F.col("c_custkey").alias("key"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.substring("s_name", -1, 1).alias("name"), F.col("s_suppkey").alias("key"))
    return relational.ordered_union(c, s, ["nation", "name"])


@query("manifest_diff", "SELECT *, 'missing' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber > 1) UNION ALL SELECT *, 'unexpected' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber > 1 EXCEPT ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR true)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("k")).distinct()
    return relational.difference_both_ways(a, b)


@query("latest_events", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_by_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id", "value")


@query("annotation_lookup", "SELECT c.c_custkey, o.orders, o.first_order FROM customer c LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey".replace("o.orders,", "array_to_string(o.orders, ',') AS orders,"))
def annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("x"))
    out = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return out.select("c_custkey", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("orders"), F.try_element_at("x", F.lit(1)).alias("first_order"))


@query("privacy_join", "SELECT d.doc_id, a.anon, CASE WHEN a.anon IS NULL THEN 'missing_anonymous_row' END AS error FROM documents d LEFT JOIN (SELECT doc_id, 'private_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') AS anon FROM labels WHERE quality = 1) a ON d.doc_id = a.doc_id")
def privacy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    a = a.withColumn("anon", F.concat(F.lit("private_"), F.lpad(F.row_number().over(Window.orderBy("doc_id")).cast("string"), 6, "0")))
    return table(spark, sf_dir, "documents").select("doc_id").join(a, "doc_id", "left").withColumn("error", F.when(F.col("anon").isNull(), "missing_anonymous_row"))


@query("extension_histogram", r"SELECT coalesce(nullif(regexp_extract(url, '\.([a-z]+)/', 1), ''), '(none)') AS ext, count(*) AS n FROM pages GROUP BY 1")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.coalesce(F.nullif(F.regexp_extract("url", r"\.([a-z]+)/", 1), F.lit("")), F.lit("(none)"))
    return table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@query("duplicate_templates", "SELECT sha256(regexp_replace(html, '>[^<]+<', '><', 'g')) AS template, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def duplicate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.sha2(F.regexp_replace("html", ">[^<]+<", "><"), 256).alias("template")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
