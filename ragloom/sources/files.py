"""Files -> extracted text -> chunk rows.

Files are read with the ``binaryFile`` source (one row per file, content
as bytes).  Decoding, extension routing, placeholders and packing are
native expressions; only the structured formats whose exact text rendering
comes from a Python library (JSON pretty print, XML element walk) and any
registered extractor run in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (EMPTY_DOC_TEXT, EMPTY_TXT_TEXT, col_of, fill_template, is_blank,
                              normalize_newlines, py_strip)
from ..operators.chunking import CHUNK_SIZE, PARAGRAPH_SEP, explode_chunks, file_key

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])

# Extension -> function(bytes) -> str for formats without a built-in route
# (the generic element extractor of the reference is such a hook).
_EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def register_extractor(ext: str, fn: Callable[[bytes], str]) -> None:
    """Route files with extension ``ext`` (e.g. ``'.pdf'``) through ``fn``."""
    _EXTRACTORS[ext.lower() if ext.startswith(".") else "." + ext.lower()] = fn


def register_element_extractor(ext: str, fn: Callable[[bytes], list], sep: str = "\n") -> None:
    """An extractor that yields document elements; their strings are
    joined with ``sep`` (a newline on ingest, a blank line in the utility
    path)."""
    register_extractor(ext, lambda b: sep.join(str(el) for el in fn(b)))


def clear_extractors() -> None:
    _EXTRACTORS.clear()


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True,
               expected: DataFrame | None = None) -> DataFrame:
    """Files under ``path``.  Spark does not list zero-length files; with ``expected`` (path), a listing of
    what was delivered, those that are not found come as empty files and get their placeholder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path)
    if expected is None:
        return files
    empty = expected.select("path").distinct().join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"),
        F.lit(b"").alias("content")))


def base_name(path) -> Column:
    return F.element_at(F.split(col_of(path), "/"), -1)


def extension(path) -> Column:
    """``os.path.splitext(path)[1].lower()``: last dot part of the base name,
    leading dots of the name do not start an extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def decode_text(content) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1; then the
    text-mode newline translation."""
    c = col_of(content)
    as_utf8 = F.decode(c, "UTF-8")
    valid = F.is_valid_utf8(c.cast("string"))
    return normalize_newlines(F.when(valid, as_utf8).otherwise(F.decode(c, "ISO-8859-1")))


def _json_pretty(b: bytes) -> str:
    return json.dumps(json.loads(b.decode("utf-8")), indent=2)


def _xml_text(b: bytes) -> str:
    """Each element renders as its own stripped text and its children's
    renderings joined by single spaces, then stripped; tail text is not
    used.  Computed bottom-up with an explicit stack (no recursion limit)."""
    root = ET.fromstring(b)
    rendered: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        el, children_done = stack.pop()
        if children_done:
            pieces = [(el.text or "").strip()] + [rendered.pop(id(c)) for c in el]
            rendered[id(el)] = " ".join(pieces).strip()
        else:
            stack.append((el, True))
            stack.extend((c, False) for c in el)
    return rendered[id(root)]


_EXTRACTED = T.StructType([T.StructField("text", T.StringType()),
                           T.StructField("error", T.StringType())])


def _structured_udf(registry: dict[str, Callable[[bytes], str]]):
    routes = {".json": _json_pretty, ".xml": _xml_text, **registry}

    def extract(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for b, e in zip(content, ext):
            fn = routes.get(e)
            if fn is None or b is None:
                texts.append(None)
                errors.append(None)
                continue
            try:
                texts.append(fn(bytes(b)))
                errors.append(None)
            except Exception as exc:  # noqa: BLE001 - error isolation per file
                texts.append(None)
                errors.append(f"{type(exc).__name__}: {exc}")
        return pd.DataFrame({"text": texts, "error": errors})

    # nondeterministic: evaluated once, never copied into pushed-down filters
    return F.pandas_udf(extract, _EXTRACTED).asNondeterministic()


def xml_text_native(text) -> Column:
    """S4 on the JVM: each element's own leading text (``xpath`` text nodes
    without a preceding sibling element, so tail text is left out), stripped,
    joined by single spaces.  Differs from the Python walk only where an
    element has no leading text: the walk leaves an extra space there."""
    nodes = F.xpath(col_of(text), F.lit("//*/text()[not(preceding-sibling::*)]"))
    kept = F.filter(F.transform(nodes, lambda t: py_strip(t)), lambda t: t != F.lit(""))
    return F.array_join(kept, " ")


def extract_files(files: DataFrame, strict: bool = False, xml_mode: str = "python") -> DataFrame:
    """S5 + S2-S4 + X1: (path, name, ext, text, extract_status) per file.

    ``.txt`` decodes with fallback and replaces blank content with the
    text-file placeholder; ``.md`` is UTF-8 pass-through; ``.json`` and
    ``.xml`` are rendered in Python (``xml_mode="native"`` renders XML with
    Spark's ``xpath`` instead); registered extensions use their extractor;
    anything else decodes like text (or fails when ``strict``).  Empty
    results get the document placeholder.  Rows with a ``status`` other than ``ok`` (the corpus source's files
    that could not be read) keep it as their error."""
    registry = dict(_EXTRACTORS)
    ext = extension(F.col("path"))
    unread = F.when(F.col("status") != "ok", F.col("status")) if "status" in files.columns else F.lit(None).cast("string")
    f = files.select("path", "content", unread.alias("_unread"), base_name(F.col("path")).alias("name"), ext.alias("ext"))
    structured = {".json", *registry} | ({".xml"} if xml_mode == "python" else set())
    f = f.withColumn("_s", F.when(F.col("ext").isin(*structured),
                                  _structured_udf(registry)(F.col("content"), F.col("ext"))))
    valid_utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    decoded = decode_text(F.col("content"))
    known = F.col("ext").isin(".txt", ".md", *structured)
    text = (F.when(F.col("ext").isin(*structured), F.col("_s.text"))
            .when(F.col("ext") == ".xml", xml_text_native(decode_text(F.col("content"))))
            .when(F.col("ext") == ".md", F.when(valid_utf8, decoded))
            .when(F.col("ext") == ".txt", F.when(is_blank(decoded), F.lit(EMPTY_TXT_TEXT)).otherwise(decoded))
            .otherwise(F.lit(None) if strict else decoded))
    error = (F.when(F.col("_unread").isNotNull(), F.col("_unread"))
             .when(F.col("ext").isin(*structured), F.col("_s.error"))
             .when((F.col("ext") == ".md") & ~valid_utf8, F.lit("UnicodeDecodeError: not UTF-8"))
             .when(~known & F.lit(strict), F.concat(F.lit("Unsupported file format: "), F.col("ext"))))
    f = f.withColumn("_text", text).withColumn("error", error)
    placeholder = fill_template(EMPTY_DOC_TEXT, F.col("name"))
    final = F.when(F.col("error").isNull() & ((F.col("_text").isNull()) | (F.col("_text") == "")),
                   placeholder).otherwise(F.col("_text"))
    return f.select("path", "name", "ext",
                    F.when(F.col("error").isNull(), final).alias("text"),
                    F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.col("error"))
                    .alias("extract_status"))


def chunk_files(extracted: DataFrame, collection: str = "default", metadata: dict | None = None,
                chunk_size: int = CHUNK_SIZE, sep: str = PARAGRAPH_SEP) -> DataFrame:
    """C3 + C2 + X14: chunk rows in the store schema.  ``document_name`` is
    the caller's value if given, else the base name; ``folder_name`` comes
    from the caller's metadata.  Files that failed extraction are skipped
    (their status stays in ``extracted``)."""
    meta = dict(metadata or {})
    ok = extracted.where(F.col("extract_status") == "ok").withColumn("doc_key", file_key(F.col("path")))
    ch = explode_chunks(ok, "doc_key", "text", chunk_size, sep, keep=["name", "path", "ext"])
    doc_name = F.lit(meta["document_name"]) if "document_name" in meta else F.col("name")
    folder = F.lit(meta.get("folder_name")).cast("string")
    return ch.select(
        F.lit(collection).alias("collection"), "chunk_id", "doc_key", "chunk_index", "text",
        doc_name.alias("document_name"), folder.alias("folder_name"),
        F.col("path").alias("source"), F.lit("file").alias("source_type"),
        F.regexp_replace(F.col("ext"), r"^\.", "").alias("content_type"),
        _metadata_map(meta).alias("metadata"))


def _metadata_map(meta: dict) -> Column:
    pairs = [F.lit(str(x)) for kv in sorted(meta.items()) for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def ingest_receipts(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """K3 for files: per path, status and chunk count or the error."""
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    return (extracted.join(counts, extracted.path == counts.source, "left")
            .select("path", F.when(F.col("extract_status") == "ok", F.lit("success"))
                    .otherwise(F.lit("error")).alias("status"),
                    F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
                    F.when(F.col("extract_status") != "ok", F.col("extract_status")).alias("error")))


# Names used by SURVEY §2 for the same jobs.
def read_corpus(spark: SparkSession, path: str, strict: bool = False, xml_mode: str = "python") -> DataFrame:
    """Every file under ``path`` read, decoded and routed by extension."""
    return extract_files(read_files(spark, path), strict=strict, xml_mode=xml_mode)


route_by_extension = extract_files


def chunk_file(spark: SparkSession, path: str, chunk_size: int = CHUNK_SIZE, collection: str = "default",
               metadata: dict | None = None) -> DataFrame:
    """Extract + chunk the files under ``path``."""
    return chunk_files(read_corpus(spark, path), collection, metadata, chunk_size)
