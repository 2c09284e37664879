"""Line dedup: windows of three consecutive lines that occur before are removed.

Lines are the pieces of a text between line feeds, compared exactly. Every
window of ``window`` lines is hashed inside its row (128 bits, no shuffle), the first
occurrence of each repeated hash is found by a grouped minimum, and in all later
occurrences the covered lines go; overlapping windows cover lines once. Only
DataFrame functions run. The minimum combines before the shuffle and the way back is
an equi-join, which Spark splits where one window holds very many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, read


def line_windows(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(_noid, _id, _th, pos, w1, w2): one row for each window that has a word."""
    slim = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).isNull().alias("_noid"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_th"),
        F.split(text_col, "\n", -1).alias("lines"),
    )
    slim = slim.where(F.size("lines") >= window)
    # Null for a line without a word; the two hashes have independent seeds.
    spoken = F.transform("lines", lambda x: F.when(x.rlike(rf"[^{WS_CLASS}]"), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))))
    slim = slim.withColumn("h", spoken).drop("lines")
    made = F.expr(
        f"transform(sequence(0, size(h) - {window}), i -> named_struct('pos', i,"
        f" 'w1', xxhash64({', '.join(f'coalesce(h[i + {k}].a, 0L)' for k in range(window))}),"
        f" 'w2', xxhash64({', '.join(f'coalesce(h[i + {k}].b, 0L)' for k in range(window))}),"
        f" 'word', {' or '.join(f'h[i + {k}] is not null' for k in range(window))}))"
    )
    return slim.select("_noid", "_id", "_th", F.explode(made).alias("w")).select("_noid", "_id", "_th", "w.*").where("word").drop("word")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``df`` with ``text_col`` cleaned, and (n_lines, n_removed) longs added.

    The first occurrence of a window is the one of the smallest id (null ids last),
    then hash of the text, then position. Rows that repeat id and text count as one
    document and are cleaned alike. Texts with fewer lines than ``window``, and
    windows without a word, stay. Null text stays null (0 lines); a text may become
    empty, its row stays. Clashing extra columns ``n_lines``, ``n_removed`` are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    windows = line_windows(df, id_col, text_col, window)
    place = F.struct("_noid", "_id", "_th", "pos")
    first = windows.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    first = first.where("times > 1").select("w1", "w2", "first")
    later = windows.join(first, ["w1", "w2"]).where(place > F.col("first"))
    cover = later.groupBy("_id", "_th").agg(F.collect_set("pos").alias("starts"))
    # Other columns travel in one struct, so that their names can't clash with those made here.
    docs = df.select(F.struct(*[c for c in keep if c != text_col]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    out = docs.join(cover, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").withColumn("lines", F.split("text", "\n", -1))
    gone = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(window)])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    out = out.withColumn("stay", F.when(F.col("starts").isNotNull(), stay))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    cleaned = F.when(F.col("stay").isNotNull(), F.concat_ws("\n", F.transform("stay", lambda i: F.col("lines")[i]))).otherwise(F.col("text"))
    columns = [cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep]
    return out.select(*columns, count.alias("n_lines"), F.coalesce(count - F.size("stay"), F.lit(0)).cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_removed of every document."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


OP8_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, g.i - 1 AS pos, string_split(d.text, chr(10))[g.i] AS line, len(string_split(d.text, chr(10))) AS n
  FROM documents d, range(1, 1 + len(string_split(d.text, chr(10)))) g(i) WHERE d.text IS NOT NULL),
wins AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c, n FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
spoken AS (SELECT * FROM wins WHERE pos + 2 < n AND regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r FROM spoken),
gone AS (SELECT DISTINCT doc_id, pos + k.k AS pos FROM ranked, range(0, 3) k(k) WHERE r > 1),
kept AS (
  SELECT l.doc_id, max(l.n) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
  CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
