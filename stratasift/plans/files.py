"""Queries that go through files: each writes rows of a test table in some format and reads them back."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from stratasift.operators import extension
from stratasift.sources import images, readers, sinks
from stratasift.staging import new_folder
from stratasift.streaming import events

from .catalog import register
from .fixtures import table


def _zip(**parts: str) -> bytes:
    """A package without its last byte, which is a zero that the writer adds."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()[:-1]


def _packages(rows, columns: list[str], build) -> None:
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([build(*x) for x in zip(*series, strict=True)])

    run.__annotations__ = dict.fromkeys(["series", "return"], pd.Series)
    return rows.select(F.pandas_udf(run, "binary")(*columns).cast("string"))


@register(
    "source_discovery",
    "SELECT '.txt' AS suffix, count(*) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(2 AS BIGINT) AS role_mask FROM benchmark",
)
def source_discovery(spark, sf):
    """Files below a folder that have an allowed suffix, with the permissions of the first pattern that fits."""
    folder = new_folder(spark, "sources")
    sinks.write_each(table(spark, sf, "benchmark").select("text"), f"{folder}/open")
    table(spark, sf, "labels").limit(0).write.json(f"{folder}/other")
    found = readers.discover_sources(spark, folder, ["txt", ".DOCX"], [("open/**", 2)], 1)
    suffix = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    return found.groupBy(suffix.alias("suffix"), "role_mask").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@register(
    "txt_reader",
    r"""SELECT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash, strlen(text) + 1 > 131072 AS too_long, count(*) AS n FROM benchmark GROUP BY ALL""",
)
def txt_reader(spark, sf):
    folder = new_folder(spark, "texts")
    sinks.write_each(table(spark, sf, "benchmark").select("text"), folder)
    return readers.read_txt(spark, folder).groupBy("content_hash", "too_long").agg(F.count(F.lit(1)).alias("n"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(item, words) -> bytes:
    def p(x, style=""):
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(x)}</w:t></w:r></w:p>'

    row = "".join(f"<w:tc>{p(x)}</w:tc>" for x in ("id", str(item)))
    body = p(f"Item {item}", "Heading2") + p("") + p(words) + f"<w:tbl><w:tr>{row}</w:tr></w:tbl>"
    return _zip(**{"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


@register(
    "docx_reader",
    """SELECT block_order, block_type, sha256(text) AS hash, count(*) AS n FROM (
      SELECT 0 AS block_order, 'heading:2' AS block_type, 'Item ' || item_id AS text FROM benchmark UNION ALL SELECT 1, 'paragraph', trim(text) FROM benchmark UNION ALL SELECT 2, 'table', 'id | ' || item_id FROM benchmark) GROUP BY ALL""",
)
def docx_reader(spark, sf):
    """Headings, paragraphs and tables of word-processor files, in order; empty paragraphs are no blocks."""
    folder = new_folder(spark, "docx")
    sinks.write_each(_packages(table(spark, sf, "benchmark"), ["item_id", "text"], _docx), folder, "\0")
    blocks = readers.read_blocks(spark, folder, "docx", "part-*")
    return blocks.groupBy("block_order", "block_type", F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def _xlsx(item) -> bytes:
    strings = f"<sst><si><t>row</t></si><si><t>item {item}</t></si></sst>"
    rows = "".join(f'<row><c t="s"><v>0</v></c><c><v>{i}</v></c><c t="s"><v>1</v></c></row>' for i in range(60))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return _zip(
        **{
            "xl/sharedStrings.xml": strings.replace("<sst>", f"<sst {space}>"),
            "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>",
        }
    )


@register(
    "xlsx_reader",
    """SELECT block_id, sha256(string_agg('row | ' || i || ' | item ' || item_id, chr(10) ORDER BY i)) AS hash FROM
      (SELECT item_id, i, CASE WHEN i < 50 THEN 'sheet:0:rows:1-50' ELSE 'sheet:0:rows:51-60' END AS block_id FROM benchmark, range(0, 60) t(i)) GROUP BY item_id, block_id""",
)
def xlsx_reader(spark, sf):
    """Windows of fifty rows of each sheet."""
    folder = new_folder(spark, "xlsx")
    sinks.write_each(_packages(table(spark, sf, "benchmark"), ["item_id"], _xlsx), folder, "\0")
    return readers.read_blocks(spark, folder, "xlsx", "part-*").select("block_id", F.sha2("text", 256).alias("hash"))


@register(
    "golden_jsonl",
    "SELECT item_id, text AS question, item_id % 2 = 0 AS visual_required, CAST(item_id % 3 AS INTEGER) AS relevance FROM benchmark",
)
def golden_jsonl(spark, sf):
    """Golden rows through JSON lines under an explicit schema; a malformed line is an error."""
    folder = new_folder(spark, "golden")
    i = F.col("item_id")
    note = F.struct(F.lit("d").alias("doc_id"), (i % 3).cast("int").alias("relevance"))
    rows = table(spark, sf, "benchmark").select(i, F.col("text").alias("question"), (i % 2 == 0).alias("visual_required"), F.array(note).alias("annotations"))
    sinks.export_json_lines(rows, folder)
    read = readers.read_json_lines(spark, folder, "item_id long, question string, visual_required boolean, annotations array<struct<doc_id string, relevance int>>")
    return read.select("item_id", "question", "visual_required", F.col("annotations")[0]["relevance"].alias("relevance"))


@register(
    "rewrite_log",
    "SELECT event_id, event_type AS intent, value AS confidence FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-20 00:00:00') - 7 * 86400 AND event_id % 50 <> 0",
)
def rewrite_log(spark, sf):
    """The last seven days of a log in which some lines are broken; these are passed over."""
    folder = new_folder(spark, "log")
    rows = table(spark, sf, "events").select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"), "event_id", F.col("event_type").alias("intent"), F.col("value").alias("confidence")
    )
    line = F.to_json(F.struct("ts", "event_id", "intent", "confidence"))
    rows.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    as_of = 1_705_708_800.0  # 2024-01-20
    return readers.recent_log(spark, folder, "ts double, event_id long, intent string, confidence double", as_of).select("event_id", "intent", "confidence")


@register(
    "audit_sink",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1",
)
def audit_sink(spark, sf):
    """Audit rows by day, without those that are older than the retention."""
    folder = new_folder(spark, "audit")
    events.audit_sink(table(spark, sf, "events").select("event_id", "ts"), folder, keep_days=10)
    kept = spark.read.parquet(folder)
    return kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "catalogue_rows",
    "SELECT p_name, 'brand：' || p_brand || chr(10) || 'size：' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '未提供' END AS text FROM part WHERE p_name IN (SELECT p_name FROM part ORDER BY p_partkey LIMIT 3)",
)
def catalogue_rows(spark, sf):
    """Wanted rows of a catalogue as labelled lines."""
    part = table(spark, sf, "part")
    wanted = [r[0] for r in part.orderBy("p_partkey").select("p_name").limit(3).collect()]
    rows = part.withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return readers.catalogue_rows(rows, "p_name", wanted, {"p_brand": "brand", "p_size": "size"})


@register(
    "image_descriptions",
    """SELECT page_id, CAST(strlen(html) % 97 AS DOUBLE) AS x, 'c' || page_id || chr(10) || 'c' || page_id || chr(10) || 'c' || page_id || chr(10) || 'edge' AS ocr FROM pages""",
)
def image_descriptions(spark, sf):
    """Vectors and OCR text of images (here: pages' bytes) from a model that the caller brings; what stands in the centre counts three times."""

    def load():
        return lambda images: [([float(len(x) % 97)], ["c" + x.split(b"|")[0].decode()], ["edge"]) for x in images]

    content = F.concat(F.col("page_id").cast("string").cast("binary"), F.lit(b"|"), F.col("html").cast("binary"))
    rows = table(spark, sf, "pages").select("page_id", content.alias("content"))
    found = extension.describe_images(rows, "content", load)
    size = F.octet_length("content") - F.octet_length(F.col("page_id").cast("string")) - 1
    return found.select("page_id", (size % 97).cast("double").alias("x"), readers.weighted_ocr_text(F.col("core"), F.col("rest")).alias("ocr"))


def _png(width, height, words) -> bytes:
    """The beginning of an image and a comment; the text writer adds the last byte."""
    header = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + int(width).to_bytes(4, "big") + int(height).to_bytes(4, "big")
    return header + bytes([8, 2, 0, 0, 0, 0, 0, 0, 0]) + str(words).encode()


@register(
    "image_ocr_text",
    """WITH p AS (SELECT page_id, 100 + page_id % 50 AS w, 200 + page_id % 70 AS h FROM pages)
    SELECT w AS width, h AS height, CASE WHEN h % 3 = 0 THEN 'side t' || w || ' t' || w || ' t' || w || ' faint low' ELSE 'side t' || w || ' faint low' END AS main_text, count(*) AS n
    FROM p GROUP BY ALL""",
)
def image_ocr_text(spark, sf):
    """Images read back with their sizes, blocks with boxes from a stand-in model, and what is large and central three times over."""
    folder = new_folder(spark, "images")
    rows = table(spark, sf, "pages").select((100 + F.col("page_id") % 50).alias("w"), (200 + F.col("page_id") % 70).alias("h"), F.col("page_id").alias("i"))
    sinks.write_each(_packages(rows, ["w", "h", "i"], _png), folder, "\0")

    def load():
        def model(content, width, height):
            tall = 30.0 if height % 3 == 0 else 10.0
            middle = (0.4 * width, 0.5 * height, 0.6 * width)
            return [
                ("side", 0.99, 0.0, 0.5 * height, 10.0, 0.5 * height + 30),
                (f"t{width}", 0.9, *middle, 0.5 * height + tall),
                ("faint", 0.5, *middle, 0.5 * height + 30),
                ("", 0.9, *middle, 0.5 * height + 30),
                ("low", 0.9, 0.4 * width, 0.9 * height, 0.6 * width, 0.9 * height + 30),
            ]

        return model

    found = images.ocr_blocks(images.read_images(spark, folder, "*.txt", together=32), load)
    words = images.weighted_text(F.col("blocks"), F.col("width"), F.col("height"))
    return found.groupBy("width", "height", words.alias("main_text")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "annotation_files",
    """SELECT 'written' AS file, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels UNION ALL SELECT 'empty', 0, NULL UNION ALL SELECT 'missing', NULL, NULL""",
)
def annotation_files(spark, sf):
    """Annotations of a file, of an empty one, and of one that isn't there."""
    folder, ddl = new_folder(spark, "annotations"), "doc_id long, quality int"
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sinks.export_json_lines(rows, f"{folder}/written")
    sinks.export_json_lines(rows.limit(0), f"{folder}/empty")
    parts = []
    for name in ("written", "empty", "missing"):
        try:
            found = readers.read_annotations(spark, f"{folder}/{name}", ddl).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
        except FileNotFoundError:
            found = rows.limit(0).agg(F.sum("doc_id").alias("n"), F.sum("quality").alias("good"))
        parts.append(found.select(F.lit(name).alias("file"), "n", "good"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
