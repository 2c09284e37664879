"""Files as tables: listing, inventory, probes, discovery, manifests and pages."""

from __future__ import annotations

import csv
import io
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliant.functions.ids import file_id, normal_path
from foliant.session import ship_code

# Kinds of files by extension.
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]
TEXTS = ["txt", "json", "csv", "xml"]
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "pdf": "application/pdf", "json": "application/json", "csv": "text/csv", "txt": "text/plain", "xml": "application/xml"}


def walk(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, modified, size, ext(, content)) of all files below a folder; bytes are read only if asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(?://)?(?=/)", "")
    rel = F.when(plain.startswith(base), F.substr(plain, F.length(base) + 1)).otherwise(plain)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return f.select(F.col("path").alias("uri"), rel.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), ext.alias("ext"), *(["content"] if content else []))


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """The files without bytes below a folder, in the form of ``walk`` with content; Spark's sources leave them out.

    The driver lists the folder and keeps only these.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    rows = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            uri = f.getPath().toString()
            path = uri.split(root.rstrip("/") + "/", 1)[-1]
            rows.append((uri, path, f.getModificationTime() / 1000, path.rsplit(".", 1)[-1].lower() if "." in path else ""))
    d = spark.createDataFrame(rows, "uri string, path string, t double, ext string")
    return d.select("uri", "path", F.timestamp_seconds("t").alias("modified"), F.lit(0).cast("long").alias("size"), "ext", F.lit(b"").alias("content"))


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height out of a PNG, GIF, BMP or JPEG header."""
    if not data or len(data) < 24:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def decoded(data: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8 with or without a mark, else Windows-1252."""
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), "windows-1252"


def _problem(ext: str, data: bytes) -> str | None:
    if not data:
        return "empty_file"
    if ext == "json":
        try:
            json.loads(decoded(data)[0])
        except ValueError:
            return "invalid_json"
    if ext == "csv" and not any(c.strip() for c in next(csv.reader(io.StringIO(decoded(data)[0])), [])):
        return "no_csv_header"
    if ext in ("png", "jpg", "jpeg", "gif", "bmp") and image_size(data) is None:
        return "unreadable_image"
    if ext == "pdf" and not data.startswith(b"%PDF-"):
        return "unreadable_pdf"
    return None


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, ext, data in zip(b["path"], b["ext"], b["content"], strict=True):
            data = b"" if data is None else bytes(data)
            try:
                wh = image_size(data) or (None, None)
                pages = data.count(b"/Type /Page") - data.count(b"/Type /Pages") + data.count(b"/Type/Page") - data.count(b"/Type/Pages") if ext == "pdf" else None
                rows.append((path, wh[0], wh[1], pages or None, decoded(data)[1] if ext in TEXTS else None, _problem(ext, data)))
            except Exception as e:  # noqa: BLE001  one bad file never stops an inventory
                rows.append((path, None, None, None, None, f"{type(e).__name__}"))
        yield pd.DataFrame(rows, columns=["path", "width", "height", "pages", "encoding", "problem"]).astype({"width": "Int32", "height": "Int32", "pages": "Int32"})


def probe(files: DataFrame) -> DataFrame:
    """(path, width, height, pages, encoding, problem) of files with content; a PDF's pages are counted in its plain objects."""
    ship_code(files.sparkSession)
    return files.select("path", "ext", "content").mapInPandas(_probe, "path string, width int, height int, pages int, encoding string, problem string")


def category(path: Column, ext: Column) -> Column:
    return F.when(ext.isin(*IMAGES), "image").when(ext == "pdf", "document").when(ext.isin("json", "xml", "csv") | ((ext == "txt") & F.lower(path).rlike("annot|label|box|entit")), "annotation").otherwise("other")


def mime(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in MIME.items() for v in kv]), ext), F.lit("application/octet-stream"))


def inventory(files: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of listed files with content: ids, hashes, sizes, kinds, and what could not be read."""
    f = files.withColumn("sha256", F.sha2("content", 256))
    rows = f.drop("content").join(probe(files), "path")
    rows = rows.select(file_id(F.lit(dataset), F.col("path")).alias("file_id"), F.lit(dataset).alias("dataset"), normal_path(F.col("path")).alias("path"), "ext", mime(F.col("ext")).alias("mime"), category(F.col("path"), F.col("ext")).alias("category"), "size", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), "sha256", "width", "height", "pages", "encoding", F.col("problem").isNull().alias("readable"), "problem")
    errors = rows.where("problem is not null").select("file_id", "dataset", "path", F.col("problem").alias("error_type"))
    return rows, errors


def discover(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """(root, dataset, confidence, markers, files) of the folders that look like known datasets.

    ``signatures``: dataset, name_hint, markers (array of path parts), extensions (array). A marker below
    the folder means high confidence, a telling name with a known extension medium, else low.
    """
    parts = F.split("path", "/")
    f = files.where(F.size(parts) > 1).select(parts[0].alias("root"), "path", "ext")
    x = f.join(F.broadcast(signatures))  # a handful of signatures against the listing
    per_file = x.select("root", "dataset", F.lower("root").contains(F.lower("name_hint")).alias("named"), F.array_contains("extensions", F.col("ext")).alias("known"), F.filter("markers", lambda m: F.col("path").contains(m)).alias("hit"))
    g = per_file.groupBy("root", "dataset").agg(F.max("named").alias("named"), F.count_if("known").alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("markers"))
    level = F.when(F.size("markers") > 0, "high").when(F.col("named") & (F.col("files") > 0), "medium").otherwise("low")
    return g.select("root", "dataset", level.alias("confidence"), "markers", "files")


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column text; columns it lacks are null, others are left out."""
    found = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return found.select(*[(F.col(f"`{c}`") if c in found.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def json_documents(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt): one JSON document a file, by an explicit schema."""
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    x = spark.read.schema(wide).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.input_file_name())
    return x.where("_corrupt_record is null").drop("_corrupt_record"), x.where("_corrupt_record is not null").select("path", "_corrupt_record")


def native_splits(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows with the split that a listing (key, split) gives them, null where it gives none."""
    one = lookup.groupBy(key).agg(F.min("split").alias("native_split"))
    return rows.join(one, key, "left")


def examples(rows: DataFrame, split: str, stream: str, build_id: str) -> DataFrame:
    """Usable rows of a split and stream; a private row, or one of another build, fails the job."""
    use = rows.where((F.col("split") == split) & (F.col("stream") == stream) & F.col("usable"))
    bad = F.coalesce(F.col("private"), F.lit(True)) | ~F.col("build_id").eqNullSafe(F.lit(build_id))
    return use.where(F.when(bad, F.raise_error(F.concat(F.lit("private or stale example "), F.col("example_id"))).cast("boolean")).otherwise(True))


def pages(files: DataFrame, most_pages: int = 100, most_pixels: int = 60_000_000, render=None) -> DataFrame:
    """(path, page, kind, width, height, error): a page for an image, pages for a PDF.

    ``render`` (bytes -> list of (width, height)) opens PDFs; without it they are reported as unsupported. Empty, unknown,
    too large and too long files get one row with the error.
    """
    ship_code(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, data in zip(b["path"], b["ext"], b["content"], strict=True):
                data = b"" if data is None else bytes(data)
                kind, error, found = ("pdf" if ext == "pdf" else "image"), None, []
                try:
                    if not data:
                        error = "empty_file"
                    elif ext == "pdf":
                        found = render(data) if render else []
                        error = None if render else "no_pdf_reader"
                    elif ext in IMAGES:
                        wh = image_size(data)
                        found, error = ([wh], None) if wh else ([], "unreadable_image")
                    else:
                        error = "unsupported_type"
                except Exception as e:  # noqa: BLE001
                    error = type(e).__name__
                if len(found) > most_pages:
                    found, error = [], "too_many_pages"
                if any(w * h > most_pixels for w, h in found):
                    found, error = [], "too_many_pixels"
                rows += [(path, i + 1, kind, w, h, None) for i, (w, h) in enumerate(found)] or [(path, None, kind, None, None, error or "no_pages")]
            yield pd.DataFrame(rows, columns=["path", "page", "kind", "width", "height", "error"]).astype({"page": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("path", "ext", "content").mapInPandas(run, "path string, page int, kind string, width int, height int, error string")
