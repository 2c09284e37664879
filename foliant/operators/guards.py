"""Guards of builds and reports: private inputs, hashes, manifests, trials and evidence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.quality import require_none


def canonical_path(path: Column) -> Column:
    """A path with forward slashes, without ``.`` parts, with ``..`` taken back and no slash at its end. Files are not opened."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def within(path: Column, roots: Iterable[str]) -> Column:
    """The path is one of the roots or lies below one."""
    p, out = canonical_path(path), F.lit(False)
    for root in roots:
        r = canonical_path(F.lit(root))
        out = out | (p == r) | p.startswith(F.concat(r, F.lit("/")))
    return out


def require_private_mode(df: DataFrame, path: str, roots: list[str], private_output: bool) -> DataFrame:
    """``df``; without private output, a row whose path lies in a private root fails the job. The message has no names."""
    return df if private_output else require_none(df, F.coalesce(within(F.col(path), roots), F.lit(True)), "a private input needs a private output")


def hash_mismatches(live: DataFrame, audited: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): files whose live hash is not the audited one, or that were never audited or have no hash."""
    a = audited.select(key, F.col(digest).alias("_audited"), F.lit(True).alias("_known"))
    x = live.select(key, F.col(digest).alias("_live")).join(a, key, "left")
    problem = F.when(F.col("_known").isNull(), "not audited").when(F.col("_audited").isNull() | F.col("_live").isNull(), "without a hash").when(F.col("_live") != F.col("_audited"), "changed")
    return x.select(key, problem.alias("problem")).where("problem is not null")


def manifest(inventory: DataFrame, examples: DataFrame, key: str, columns: list[str], counts: list[str]) -> DataFrame:
    """(key, columns..., n_<count>..., usable, exclusion_reason): one row for each file of the inventory.

    A file joins its example by ``key``. Excluded are, in this order: unreadable files, files without an example, and
    examples whose first ``counts`` column, an array, is empty; their counts are 0.
    """
    e = examples.select(key, *counts, F.lit(True).alias("_made"))
    x = inventory.select(key, "readable", *columns).join(e, key, "left")
    sizes = [F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).alias(f"n_{c}") for c in counts]
    empty = F.greatest(F.lit(0), F.coalesce(F.size(counts[0]), F.lit(0))) == 0
    reason = F.when(~F.coalesce(F.col("readable"), F.lit(False)), "unreadable").when(F.col("_made").isNull(), "no_annotation").when(empty, f"no_{counts[0]}")
    return x.select(key, *columns, *sizes, reason.isNull().alias("usable"), reason.alias("exclusion_reason"))


def trial_report(df: DataFrame, trial: str, composites: list[str], selected: str) -> DataFrame:
    """``df`` with mean_composite, the mean of the composites that are there (else null), and selected_for_final, by name."""
    there = F.filter(F.array(*[F.col(c).cast("double") for c in composites]), lambda x: x.isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return df.withColumns({"mean_composite": mean, "selected_for_final": F.col(trial) == selected})


def evidence_gates(df: DataFrame, gates: dict[str, Column], key: str) -> DataFrame:
    """(key, gate, passed) for each gate and, as gate ``all``, their conjunction; a null answer is a failure."""
    answers = {name: F.coalesce(c, F.lit(False)) for name, c in gates.items()}
    whole = F.lit(True)
    for c in answers.values():
        whole = whole & c
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in {**answers, "all": whole}.items()])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def content_hash(df: DataFrame, columns: list[str]) -> str:
    """A digest of a table's rows in any order: their number and the sums of two seeded hashes."""
    row = df.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(s), *columns).cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)]).first()
    return f"{row['n']}:{row['h1'] or 0}:{row['h2'] or 0}"


def load_split(df: DataFrame, split: str, name: str, columns: list[str], expected: str) -> DataFrame:
    """The rows of one split; a ``content_hash`` other than ``expected`` is an error."""
    part = df.where(F.col(split) == name)
    found = content_hash(part, columns)
    if found != expected:
        raise ValueError(f"features of split {name} are stale")
    return part
