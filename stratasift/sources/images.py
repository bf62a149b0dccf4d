"""Images: their sizes from their own headers, OCR blocks from a model that the caller brings, and the text that counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a block has to be to count several times.
CENTRE = (0.2, 0.8)
LARGE_FONT = 20.0
MIN_CONFIDENCE = 0.7
CORE_TIMES = 3

#: One block of text that OCR has found: its box in pixels and how sure the model is.
BLOCK = "struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>"


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes at a place from 1."""
    digits = F.hex(F.substring(content, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(digits, 16, 10).cast("long")


def image_shape(content: Column) -> Column:
    """(format, width, height) of PNG, GIF and BMP images by their headers; null for anything else."""

    def shape(name, width, height):
        return F.struct(F.lit(name).alias("format"), width.alias("width"), height.alias("height"))

    start = F.hex(F.substring(content, 1, 8))
    return (
        F.when(start == "89504E470D0A1A0A", shape("png", _number(content, 17, 4), _number(content, 21, 4)))
        .when(F.substring(start, 1, 8) == "47494638", shape("gif", _number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(F.substring(start, 1, 4) == "424D", shape("bmp", _number(content, 19, 4, True), _number(content, 23, 4, True)))
    )


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,gif,bmp}", together: int = 1) -> DataFrame:
    """(path, content, format, width, height, image_id) of the images below a folder; what isn't one is left out.

    Spark counts 4 MB for opening a file, so a task gets 32 images at most, however small they are. For small ones a task takes
    ``together`` such parts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select("path", "content", image_shape(F.col("content")).alias("shape")).where("shape is not null")
    rows = rows.select("path", "content", "shape.*", F.sha2("content", 256).alias("image_id"))
    return rows.coalesce(-(-rows.rdd.getNumPartitions() // together) or 1) if together > 1 else rows


def ocr_blocks(images: DataFrame, load: Callable[[], Callable[[bytes, int, int], list[tuple]]]) -> DataFrame:
    """Adds ``blocks`` from a model that each worker loads once; it takes an image with its size and gives the fields of ``BLOCK``."""
    block = T.StructType.fromDDL("text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    schema = T.StructType([*images.schema, T.StructField("blocks", T.ArrayType(block))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        names = block.names
        for batch in batches:
            found = [[dict(zip(names, b, strict=True)) for b in model(bytes(c), int(w), int(h))] for c, w, h in zip(batch["content"], batch["width"], batch["height"], strict=True)]
            yield batch.assign(blocks=pd.Series(found, index=batch.index, dtype=object))

    return images.mapInPandas(run, schema)


def is_centre(block: Column, width: Column, height: Column) -> Column:
    """Whether the middle of a block's box lies within the middle three fifths of the image, both ways."""
    low, high = CENTRE
    x, y = (block["x0"] + block["x1"]) / 2, (block["y0"] + block["y1"]) / 2
    return (x > low * width) & (x < high * width) & (y > low * height) & (y < high * height)


def is_core(block: Column, width: Column, height: Column, large: float = LARGE_FONT, sure: float = MIN_CONFIDENCE) -> Column:
    """Central, tall and certain enough to count several times."""
    return is_centre(block, width, height) & (block["y1"] - block["y0"] > large) & (block["confidence"] >= sure)


def weighted_text(blocks: Column, width: Column, height: Column, times: int = CORE_TIMES) -> Column:
    """The blocks' texts in their order, core ones ``times`` over; blocks without text are dropped."""
    if times < 1:
        raise ValueError("a block counts once at least")
    several = F.transform(blocks, lambda b: F.array_repeat(b["text"], F.when(F.coalesce(is_core(b, width, height), F.lit(False)), times).otherwise(1)))
    return F.array_join(F.filter(F.flatten(several), lambda t: F.coalesce(t != "", F.lit(False))), " ")
