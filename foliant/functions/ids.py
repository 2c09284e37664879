"""Content-addressed ids, deterministic ranks and small string helpers. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(x: Column) -> Column:
    """A part of an id as text; null is the word None, so that no part is skipped."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def digest(*parts: Column) -> Column:
    """SHA-256 (hex) of the parts joined by a bar, backslashes as slashes."""
    return F.sha2(F.regexp_replace(F.concat_ws("|", *map(text_of, parts)), r"\\", "/"), 256)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest(*parts), 1, length))


def hash_rank(seed: int, key: Column) -> Column:
    """The text that orders rows in a reproducible random order."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), text_of(key)), 256)


def hash_fraction(seed: int, key: Column) -> Column:
    """The first 32 bits of the rank's hash as a number from 0 to 1."""
    return F.conv(F.substring(hash_rank(seed, key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def normal_path(path: Column) -> Column:
    """Slashes forward, leading dots and slashes gone."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")


def file_id(dataset: Column, path: Column) -> Column:
    return F.concat(F.lit("ds_"), F.substring(F.sha2(F.concat_ws("|", text_of(dataset), normal_path(path)), 256), 1, 12))


def opaque_id(path: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(text_of(path), F.lit("\0"), text_of(key)), 256), 1, 20)


def human_bytes(n: Column) -> Column:
    """1536 -> 1.50 KiB."""
    size, units = n.cast("double"), ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.format_string("%.2f PiB", F.bround(size / float(1024**5), 2))
    for k in reversed(range(len(units))):
        out = F.when(F.abs(size) < float(1024 ** (k + 1)), F.format_string(f"%.2f {units[k]}", F.bround(size / float(1024**k), 2))).otherwise(out)
    return out


def as_bool(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))).isin("true", "1", "yes", "y")


def blank_to_null(x: Column) -> Column:
    """Empty and missing text are the same."""
    return F.nullif(F.trim(x), F.lit(""))


def safe_stem(x: Column, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), 1, length)
