"""Quality rules: lines that too many documents of a host share.

Lines are normalised and hashed, the distinct documents of each host that hold a line are
counted, lines above the host's limit leave their documents, and documents that keep too few of
their words are rejected. Rules about one text (length, repetition) are checked beside this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, map_texts, read, slices, stage

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = text.split("\n")
    seen = set(lines)
    again = 0
    if len(seen) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                again += bool(line.strip(_SPACE))
            seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        pair = ids[:-1] * size + ids[1:]
        if size < 2_000_000:  # size ** 3 fits in 63 bits
            code = pair[:-1] * size + ids[2:]
        else:
            code = np.unique(pair, return_inverse=True)[1][:-1] * size + ids[2:]
        _, back, times = np.unique(code, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[back] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(b.num_columns - 1)
        rows = [measures(t) for at, n in slices(text) for t in text.slice(at, n).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], *_MEASURES])


def shared_lines(df: DataFrame, host_col: str, text_col: str, key: list[str], most: int, share: float, broadcast_rows: int = 500_000) -> DataFrame:
    """(key..., _shared_words), key being an id and a hash of its text: words in lines that more documents of the host hold than its limit.

    The limit is ``most`` documents or ``share`` of the host's documents, if that is more.
    A document is one id; rows without an id are one document for each text. Lines are compared in lower case with
    runs of ASCII marks and white space as one space; lines of marks alone don't count. A document's copies of a
    line count once; its words count as often as the line stands there.
    Rows are counted first, with hashes combined before the shuffle: only a line that more than ``most`` rows hold
    can be above a limit, and the distinct documents of those few lines are counted after. Such lines go to every task if
    they are at most ``broadcast_rows``; beyond that, they are joined by a shuffle.
    """

    def hashed(x: Column) -> Column:
        return F.xxhash64(F.trim(F.regexp_replace(F.lower(x), r"[\p{Punct}\s]+", " ")))

    # A host is its hash here; null is a host.
    host = F.coalesce(F.xxhash64(host_col), F.lit(0)).alias("_host")
    lines = F.filter(F.split(text_col, "\n", -1), lambda x: x.rlike(r"[^\p{Punct}\s]"))
    rows = df.where(F.col(text_col).isNotNull())
    once = rows.select(host, F.explode(F.array_distinct(F.transform(lines, hashed))).alias("_line"))
    often = stage(once.groupBy("_host", "_line").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select("_host", "_line"))
    every = rows.select(*key, host, F.posexplode(lines).alias("_at", "_text_line"))
    every = every.select(*key, "_host", "_at", hashed(F.col("_text_line")).alias("_line"), F.regexp_count("_text_line", F.lit(WORD)).alias("_w"))
    hit = every.join(F.broadcast(often) if often.count() <= broadcast_rows else often, ["_host", "_line"], "left_semi")
    hit = stage(hit.groupBy(*key, "_host", "_line", "_at").agg(F.first("_w").alias("_w")))  # rows may repeat
    document = [F.col(key[0]), F.when(F.col(key[0]).isNull(), F.col(key[1])).alias("_unnamed")]
    counts = hit.select("_host", "_line", *document).distinct().groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hosts = df.select(host, *document).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    hot = counts.join(hosts, "_host").where(F.col("_n") > F.greatest(F.lit(float(most)), share * F.col("_docs")))
    hot = stage(hot.select("_host", "_line"))
    hit = hit.join(F.broadcast(hot) if hot.count() <= broadcast_rows else hot, ["_host", "_line"], "left_semi")
    return hit.groupBy(*key).agg(F.sum("_w").alias("_shared_words"))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = 50, share: float = 0.002, left: float = 0.5) -> DataFrame:
    """(id, host, five measures, shared_words, base_failed, kept) for each row of ``df``.

    base_failed: under 50 words, or over half of the words in repeated windows of three. A
    document is rejected too if less than ``left`` of its words stay when the lines go that over ``most``
    documents and over ``share`` of the host's documents hold. Null is a host like any other. Null and
    empty texts have zeros and fail. Rows that repeat id and text get equal results and count as one document.
    Other columns are not read. Empty in, empty out.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    longs = [F.lit(0).cast("long").alias(m) for m in _MEASURES]
    measured = map_texts(slim, _measured, slim.select("id", "host", "_th", *longs).schema)
    shared = shared_lines(slim, "host", "_text", ["id", "_th"], most, share)
    shared = shared.select(F.col("id").alias("_id"), F.col("_th").alias("_th2"), "_shared_words")
    out = measured.join(shared, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_th2")), "left")
    out = out.withColumn("shared_words", F.coalesce("_shared_words", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("shared_words") >= left * F.col("n_words")))
    return out.select("id", "host", *_MEASURES, "shared_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five measures, shared_words, base_failed and kept of every document."""
    found = apply_rules(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", *_MEASURES, "shared_words", "base_failed", "kept")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
triples AS (
  SELECT doc_id, g.i AS i, words[g.i] AS a, words[g.i + 1] AS b, words[g.i + 2] AS c FROM w, range(1, greatest(1, len(words) - 1)) g(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM triples) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM twice, range(0, 3) k(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, g.i AS i, string_split(text, chr(10))[g.i] AS line FROM w, range(1, 1 + len(string_split(text, chr(10)))) g(i)),
spoken AS (SELECT doc_id, source, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(lower(line), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\s\x0B]+', ' ', 'g')) AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM spoken) WHERE r > 1 GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
freq AS (SELECT source, norm, count(DISTINCT doc_id) AS n FROM spoken WHERE norm <> '' GROUP BY source, norm),
hot AS (SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > greatest(50, 0.002 * h.docs)),
shared AS (SELECT s.doc_id, sum(s.n) AS n FROM spoken s JOIN hot h ON s.source IS NOT DISTINCT FROM h.source AND s.norm = h.norm GROUP BY s.doc_id),
out AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(shared.n, 0) AS shared_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN shared USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(shared_words AS BIGINT) AS shared_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - shared_words >= 0.5 * n_words AS kept
FROM out
"""
