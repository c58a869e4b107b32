"""Folders of PNG files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..kernels import png
from ..session import ship

# Which files of a folder are read by default.
INCLUDE, EXCLUDE = ("**/*.png",), ("**/output/**",)

IMAGE = "source string, status string, stage string, code string, message string, has_alpha boolean, width int, height int, byte_size long, data binary"


def scan(spark: SparkSession, root: str, recursive: bool = True, include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    """source (path below root), byte_size, content of PNG files whose path matches the globs.

    Other files are not read, and files that vanish meanwhile are left out. Rows have no order: sort by
    source, which is an image's place in a batch.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[pP][nN][gG]").option("ignoreMissingFiles", "true").load(root)
    prefix = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    source = F.substring_index(F.col("path"), prefix + "/", -1)
    rows = files.select(source.alias("source"), F.col("length").alias("byte_size"), "content")
    return rows.where(S.matches_globs(F.col("source"), list(include), list(exclude)))


def in_memory(spark: SparkSession, items: Iterable[tuple[str, bytes]]) -> DataFrame:
    """The rows of `scan` for (name, content) pairs at hand, such as dropped files; `decode` tells which are ready.

    A name that is no PNG's stays in, with no content, so that it becomes a failed row.
    """
    rows = [(name, len(content), bytearray(content) if name.lower().endswith(".png") else None) for name, content in items]
    return spark.createDataFrame(rows, "source string, byte_size long, content binary")


def headers(files: DataFrame) -> DataFrame:
    """Header columns by SQL functions, without decoding; valid is false for other files."""
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    valid = (F.length("content") >= 33) & (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring("content", 13, 4)) == "49484452")
    return files.select("source", valid.alias("valid"), number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).alias("bit_depth"), number(26, 1).alias("color_type"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.string()), ("status", pa.string()), ("stage", pa.string()), ("code", pa.string()), ("message", pa.string()), ("has_alpha", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("byte_size", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):  # one image at a time: rows are large
            source, size, content = (batch.column(k)[i].as_py() for k in range(3))
            row = {"source": source, "status": "ok", "byte_size": size}
            try:
                if content is None:
                    raise png.PngError("only PNG files are read")
                rgba, alpha = png.decode(content)
                row |= {"has_alpha": alpha, "width": rgba.shape[1], "height": rgba.shape[0], "data": rgba.tobytes()}
            except png.PngError as e:
                row |= {"status": "failed", "stage": "decode", "code": "IMAGE_INVALID", "message": str(e)}
            yield pa.RecordBatch.from_pylist([row], schema)


def decode(files: DataFrame) -> DataFrame:
    """Images as rows; a file that can't be decoded is a row that says why, never a failed job."""
    ship(files.sparkSession)
    return files.select("source", "byte_size", "content").mapInArrow(_decode, IMAGE)


def pixels(images: DataFrame) -> DataFrame:
    """Exploded form: source, y, x, r, g, b, a. For tests and relational operators on small images."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                source, width, height, data = (batch.column(k)[i].as_py() for k in range(4))
                px = np.frombuffer(data, np.uint8).reshape(-1, 4)
                at = np.arange(len(px))
                columns = [pa.array([source] * len(px)), pa.array((at // width).astype(np.int64)), pa.array((at % width).astype(np.int64)), *[pa.array(px[:, c].astype(np.int16)) for c in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "y", "x", "r", "g", "b", "a"])

    ship(images.sparkSession)
    return images.where("status = 'ok'").select("source", "width", "height", "data").mapInArrow(run, "source string, y long, x long, r short, g short, b short, a short")
