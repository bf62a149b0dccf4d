"""Readers of documents and of JSON lines."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.staging import path_exists

from stratasift.functions import access

#: Suffixes that have a parser.
PARSED = (".txt", ".html", ".htm", ".docx", ".xlsx", ".pdf", ".png", ".jpg", ".jpeg")

TEXT_LIMIT = 131_072
PAGE_TEXT_LEAST = 20
SHEET_ROWS = 50

BLOCKS = "doc_id string, block_order int, block_id string, block_type string, text string, needs_ocr boolean"


def supported_suffixes(wanted: list[str]) -> tuple[str, ...]:
    """Normalised allow-list; a suffix without a parser is an error, not skipped."""
    out = tuple(sorted({w.lower() if w.startswith(".") else "." + w.lower() for w in wanted}))
    unknown = [s for s in out if s not in PARSED]
    if unknown or not out:
        raise ValueError(f"no parser for {unknown}")
    return out


def discover_sources(
    spark: SparkSession, root: str, suffixes: list[str], permissions: list[tuple[str, int]], default_mask: int
) -> DataFrame:
    """(path, relative_path, length, modified, role_mask) of all files below ``root`` with an allowed suffix."""
    allowed = supported_suffixes(suffixes)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    prefix = root.split("://", 1)[-1].rstrip("/") + "/"
    relative = F.regexp_extract("path", f"{_quoted(prefix)}(.*)$", 1)
    found = files.where(suffix.isin(*allowed)).withColumn("relative_path", relative)
    return found.withColumn("role_mask", access.first_glob(F.col("relative_path"), permissions, default_mask))


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def normalized_text(raw: Column) -> Column:
    """Decoded text without byte-order mark and carriage returns, trimmed."""
    decoded = F.regexp_replace(F.decode(raw, "UTF-8"), "^﻿", "")
    return F.regexp_replace(F.regexp_replace(decoded, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def read_txt(spark: SparkSession, path: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """(path, text, content_hash, too_long) of text files; those above the limit are marked, and read in full like the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return (
        files.select("path", (F.col("length") > limit).alias("too_long"), normalized_text(F.col("content")).alias("text"))
        .withColumn("content_hash", F.sha2("text", 256))
        .select("path", "text", "content_hash", "too_long")
    )


def _docx_blocks(data: bytes) -> list[tuple[str, str]]:
    """(type, text) of paragraphs, headings and tables in order, from the package's own XML."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{ns}t")).strip()

    out = []
    for node in body if body is not None else []:
        if node.tag == f"{ns}p":
            style = node.find(f"{ns}pPr/{ns}pStyle")
            name = (style.get(f"{ns}val") or "") if style is not None else ""
            level = "".join(c for c in name if c.isdigit())
            is_heading = name.lower().startswith(("heading", "标题"))
            if text := words(node):
                out.append((f"heading:{level or 1}" if is_heading else "paragraph", text))
        elif node.tag == f"{ns}tbl":
            rows = [" | ".join(words(c) for c in r.iter(f"{ns}tc")) for r in node.iter(f"{ns}tr")]
            out.append(("table", "\n".join(rows)))
    return out


def _xlsx_blocks(data: bytes, window: int = SHEET_ROWS) -> list[tuple[str, str]]:
    """(id, text) of windows of rows of each sheet."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in root.iter(f"{ns}si")]
        for number, name in enumerate(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{ns}row"):
                cells = []
                for c in row.iter(f"{ns}c"):
                    v = c.find(f"{ns}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                    value = (v.text or "") if v is not None else inline
                    cells.append(strings[int(value)] if c.get("t") == "s" and value else value)
                rows.append(" | ".join(cells))
            for at in range(0, len(rows), window):
                part = rows[at : at + window]
                out.append((f"sheet:{number}:rows:{at + 1}-{at + len(part)}", "\n".join(part)))
    return out


def _pdf_blocks(data: bytes) -> list[tuple[str, str, bool]]:
    """(id, text, needs OCR) of each page; the parser is an optional dependency."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return [(f"page:{i}", t, len(t) < PAGE_TEXT_LEAST) for i, t in enumerate(pages)]


def read_blocks(spark: SparkSession, path: str, kind: str, files: str | None = None) -> DataFrame:
    """Ordered blocks of DOCX, XLSX or PDF files, in Arrow batches of few files.

    ``files`` is a pattern of names, unless the suffix says what they are.
    """
    if kind not in ("docx", "xlsx", "pdf"):
        raise ValueError(f"no blocks for {kind}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files or f"*.{kind}").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                if kind == "docx":
                    blocks = [(f"block:{i}", t, x, False) for i, (t, x) in enumerate(_docx_blocks(data))]
                elif kind == "xlsx":
                    blocks = [(i, "rows", x, False) for i, x in _xlsx_blocks(data)]
                else:
                    blocks = [(i, "page", x, o) for i, x, o in _pdf_blocks(data)]
                rows += [(p, n, *b) for n, b in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["doc_id", "block_order", "block_id", "block_type", "text", "needs_ocr"])

    return found.select("path", "content").mapInPandas(run, BLOCKS)


def weighted_ocr_text(core: Column, rest: Column, times: int = 3) -> Column:
    """Text near the centre of an image counts several times."""
    return F.array_join(F.concat(F.flatten(F.array_repeat(core, times)), rest), "\n")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under an explicit schema; blank lines are skipped.

    Strict reading fails on any malformed line, otherwise such lines are dropped.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def recent_log(spark: SparkSession, path: str, schema: T.StructType | str, as_of: float, days: int = 7) -> DataFrame:
    """Rows of a log (``ts`` in epoch seconds) of the last days before ``as_of``; malformed lines are ignored."""
    return read_json_lines(spark, path, schema, strict=False).where(F.col("ts") >= as_of - days * 86_400)


def catalogue_rows(df: DataFrame, name: str, wanted: list[str], fields: dict[str, str], missing: str = "未提供") -> DataFrame:
    """Selected rows as ``label：value`` lines; what is missing says so."""
    parts = [F.concat(F.lit(f"{label}："), F.coalesce(F.col(c).cast("string"), F.lit(missing))) for c, label in fields.items()]
    return df.where(F.col(name).isin(*wanted)).select(name, F.concat_ws("\n", *parts).alias("text"))


def read_annotations(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Annotations as JSON lines: an empty file has none, a missing one is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return read_json_lines(spark, path, schema)
