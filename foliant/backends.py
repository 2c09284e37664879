"""Readers of page images: a protocol, a deterministic stand-in, a cache by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import ship_code

WORD_SCHEMA = "page_id string, ok boolean, error string, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"


class Reader(Protocol):
    """Reads one page. It is sent to the executors and should load models at its first use there."""

    name: str
    version: str

    def read(self, content: bytes) -> list[dict]: ...


class FixedReader:
    """Stands in for a model: words and confidences follow from the content's hash; empty content fails."""

    name, version = "fixed", "1"

    def read(self, content: bytes) -> list[dict]:
        if not content:
            raise ValueError("empty page")
        digest = hashlib.sha256(content).digest()
        return [{"text": f"w{b:02x}", "x0": 10.0 * i, "y0": float(b), "x1": 10.0 * i + 8, "y1": float(b) + 9, "confidence": b / 255} for i, b in enumerate(digest[:8])]


def read_pages(pages: DataFrame, reader: Reader) -> DataFrame:
    """(page_id, ok, error, words) of pages (page_id, content). A failing page never stops the others."""
    ship_code(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, content in zip(b["page_id"], b["content"], strict=True):
                try:
                    rows.append((page, True, None, reader.read(None if content is None else bytes(content))))
                except Exception as e:  # noqa: BLE001  any failure of a reader is the page's result
                    rows.append((page, False, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["page_id", "ok", "error", "words"])

    return pages.select("page_id", "content").mapInPandas(run, WORD_SCHEMA)


def with_cache(pages: DataFrame, cache: DataFrame, reader: Reader) -> tuple[DataFrame, DataFrame]:
    """(results, new cache rows): only pages whose content, reader and version the cache lacks are read.

    ``pages``: page_id, content, private. Private pages neither use nor fill the cache.
    """
    key = F.sha2(F.concat_ws("|", F.sha2("content", 256), F.lit(reader.name), F.lit(reader.version)), 256)
    p = pages.withColumn("cache_key", key)
    open_, private = p.where("not private"), p.where("private")
    known = open_.join(cache, "cache_key").select("page_id", "ok", "error", "words")
    missing = open_.join(cache, "cache_key", "left_anti")
    read = read_pages(missing, reader)
    fresh = read.where("ok").join(missing.select("page_id", "cache_key"), "page_id").select("cache_key", "ok", "error", "words").dropDuplicates(["cache_key"])
    return known.unionByName(read).unionByName(read_pages(private, reader)), fresh
