"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again as the next one's documents. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import read, shared_folder
from foliant.llm.line_dedup import dedup_lines
from foliant.llm.mixing import mix_sources
from foliant.llm.near_copies import drop_near_copies
from foliant.llm.packing import pack_sequences
from foliant.llm.toxicity import score_toxicity

TOXIC = 0.5
USED = ("doc_id", "text", "source")


def _slim(docs: DataFrame) -> DataFrame:
    """The columns that operators use, and all others in one struct, so that no name of theirs can clash with an operator's."""
    rest = [c for c in docs.columns if c not in USED]
    return docs.select(*[c for c in docs.columns if c in USED], (F.struct(*rest) if rest else F.lit(None)).alias("others"))


def _back(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some with new values."""
    return out.select(*[(new[c] if c in new else F.col(c) if c in USED else F.col("others")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is under ``TOXIC``; null and empty texts stay, and all do where nothing can be learnt."""
    return _back(score_toxicity(_slim(docs), read(spark, sf_dir, "labels")).where(F.col("toxicity") < TOXIC), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text. No row goes."""
    out = dedup_lines(_slim(docs))
    if "n_chars" not in docs.columns:
        return _back(out, docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("others")["n_chars"])
    return _back(out, docs, n_chars=length.cast(docs.schema["n_chars"].dataType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows that repeat id and text leave one; null, empty and wordless texts are copies of each other.
    """
    return _back(drop_near_copies(_slim(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words go."""
    mixed = mix_sources(_slim(docs)).where(F.col("copies") > 0)
    return _back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: where it stands in which sequence."""
    return pack_sequences(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix),
    ("packing", pack),
]

#: Models, fingerprints and tokenizers are beyond SQL: tests compare the pipeline with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared checkpoint folder, and from there once it is used.

    The last stage's rows, which the result reads, stay in that folder.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        before = name
    return docs
