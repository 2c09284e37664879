"""Writers: fixed columns, one folder a document, cache tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, missing ones null, nested ones as JSON, NaN as null, booleans as true and false."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns:
        if c not in kinds:
            out.append(F.lit(None).cast("string").alias(c))
        elif isinstance(kinds[c], ArrayType | MapType | StructType):
            out.append(F.to_json(c).alias(c))
        elif kinds[c].typeName() in ("double", "float"):
            out.append(F.when(~F.isnan(c), F.col(c)).cast("string").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def write_manifest(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """CSV files with a header; Spark's commit makes the write atomic."""
    flat(df, columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").option("escape", '"').csv(path)


def write_results(df: DataFrame, path: str, document: str = "document_id", force: bool = False) -> None:
    """JSON, one folder for each document; a result that is there is kept unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(document).json(path)


def append_cache(rows: DataFrame, cache: DataFrame, path: str, key: str = "cache_key") -> None:
    """Add rows whose key the cache lacks."""
    rows.dropDuplicates([key]).join(cache, key, "left_anti").write.mode("append").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small aggregate, as Markdown; at most ``most`` rows are fetched and the cut is stated."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines += ["", f"Only the first {most} rows are shown."]
    return "\n".join(lines) + "\n"
