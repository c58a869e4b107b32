"""The image pipeline: images to sprites, atlas pages, manifests and features.

Each image is one row and is worked on by one kernel call from decoded pixels to placed cells, so pixels
cross between JVM and Python once each way and are never shuffled. Failures are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import atlas, png, raster
from ..kernels.raster import Box, StageError
from ..plans.config import Config
from ..session import ship

_BOX = pa.struct([(n, pa.int32()) for n in ("x", "y", "width", "height")])
_PIVOT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SPRITE = pa.struct([("ordinal", pa.int32()), ("id", pa.string()), ("source_rect", _BOX), ("trimmed_rect", _BOX), ("pivot", _PIVOT), ("page", pa.int32()), ("page_rect", _BOX)])
_SKIPPED = pa.struct([("id", pa.string()), ("source_rect", _BOX), ("reason", pa.string())])
_PAGE = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary())])
_RESULT = pa.schema([("source", pa.string()), ("status", pa.string()), ("stage", pa.string()), ("code", pa.string()), ("message", pa.string()), ("sprites", pa.list_(_SPRITE)), ("skipped", pa.list_(_SKIPPED)), ("pages", pa.list_(_PAGE))])
_B = "struct<x:int,y:int,width:int,height:int>"
_DDL = f"source string, status string, stage string, code string, message string, sprites array<struct<ordinal:int,id:string,source_rect:{_B},trimmed_rect:{_B},pivot:struct<x:double,y:double>,page:int,page_rect:{_B}>>, skipped array<struct<id:string,source_rect:{_B},reason:string>>, pages array<struct<page:int,width:int,height:int,png:binary>>"


def detect(rgba: np.ndarray, has_alpha: bool, cfg: Config) -> list[tuple[Box, str | None]]:
    d = cfg.detect
    if d["mode"] == "manual":
        return raster.manual(rgba, d["rects"])
    if d["mode"] == "grid":
        boxes = raster.grid(rgba, has_alpha, d["alphaThreshold"], d.get("rows"), d.get("columns"), d.get("cellWidth"), d.get("cellHeight"))
    else:
        boxes = raster.components(rgba, has_alpha, d["alphaThreshold"], d["minPixels"], d["connectivity"])
    return [(b, None) for b in boxes]


def pivot(cfg: Config) -> dict:
    mode = cfg.pivot["mode"]
    return {"x": cfg.pivot["x"], "y": cfg.pivot["y"]} if mode == "manual" else {"x": 0.5, "y": 0.5 if mode == "center" else 1.0}


def assemble(source: str, rgba: np.ndarray, has_alpha: bool, cfg: Config) -> tuple[list[dict], list[dict]]:
    """(sprites with their cells, skipped); numbering counts skipped ones."""
    sprites, skipped = [], []
    at, scale = pivot(cfg), cfg.resize["scale"] if cfg.resize["enabled"] else 1
    for n, (box, given) in enumerate(detect(rgba, has_alpha, cfg)):
        name = f"{source}#{given or f'sprite-{n:04d}'}"
        pixels = raster.crop(rgba, box)
        trimmed = box
        if cfg.trim["enabled"]:
            inner = raster.content_box(pixels, cfg.trim["alphaThreshold"])
            if inner is None:
                skipped.append({"id": name, "source_rect": vars(box), "reason": "fully-transparent"})
                continue
            pixels = raster.crop(pixels, inner)
            trimmed = Box(box.x + inner.x, box.y + inner.y, inner.width, inner.height)
        cell = raster.cell(pixels, scale, cfg.resize["filter"] == "bilinear", cfg.bleed["pixels"], cfg.padding["pixels"])
        sprites.append({"ordinal": len(sprites), "id": name, "source_rect": vars(box), "trimmed_rect": vars(trimmed), "pivot": at, "cell": cell})
    return sprites, skipped


def process_one(source: str, rgba: np.ndarray, has_alpha: bool, cfg: Config, with_pixels: bool = True) -> dict:
    sprites, skipped = assemble(source, rgba, has_alpha, cfg)
    a = cfg.atlas
    pages = atlas.pack([s["cell"].shape[1::-1] for s in sprites], a["maxWidth"], a["maxHeight"], a["spacing"])
    out = []
    for n, page in enumerate(pages):
        width, height = atlas.used_size(page)
        body = png.encode(atlas.blit(page, {i: sprites[i]["cell"] for i, _ in page.placed})) if with_pixels else None
        out.append({"page": n, "width": width, "height": height, "png": body})
        for i, box in page.placed:
            sprites[i] |= {"page": n, "page_rect": vars(box)}
    for s in sprites:
        del s["cell"]
    return {"sprites": sprites, "skipped": skipped, "pages": out}


def from_cells(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Images (the columns of `sources.images.decode`) from opaque cells (source, y, x, r, g, b), each cell once."""
    from ..sources.images import IMAGE

    schema = pa.schema([("source", pa.string()), ("status", pa.string()), ("stage", pa.string()), ("code", pa.string()), ("message", pa.string()), ("has_alpha", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("byte_size", pa.int64()), ("data", pa.binary())])

    def draw(table):
        rgba = np.zeros((height, width, 4), np.uint8)
        y, x, r, g, b = (table.column(c).to_numpy() for c in ("y", "x", "r", "g", "b"))
        rgba[y, x] = np.stack([r, g, b, np.full(len(r), 255)], 1)
        return pa.Table.from_pylist([{"source": table.column("source")[0].as_py(), "status": "ok", "has_alpha": True, "width": width, "height": height, "byte_size": rgba.nbytes, "data": rgba.tobytes()}], schema)

    ship(cells.sparkSession)
    rows = cells.selectExpr("source", *[f"cast({c} as int) {c}" for c in ("y", "x", "r", "g", "b")])
    return rows.groupBy("source").applyInArrow(draw, IMAGE)


def process(images: DataFrame, cfg: Config, with_pixels: bool = True) -> DataFrame:
    """One row an image: sprites, skipped and pages, or the stage, code and message of its failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {k: row[k] for k in ("source", "status", "stage", "code", "message")}
                if row["status"] == "ok":
                    rgba = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                    try:
                        out |= process_one(row["source"], rgba, row["has_alpha"], cfg, with_pixels)
                    except StageError as e:
                        out |= {"status": "failed", "stage": e.stage, "code": e.code, "message": str(e)}
                yield pa.RecordBatch.from_pylist([out], _RESULT)

    ship(images.sparkSession)
    return images.select("source", "status", "stage", "code", "message", "has_alpha", "width", "height", "data").mapInArrow(run, _DDL)


def features(images: DataFrame) -> DataFrame:
    """The analyser's input rows: pixels stay where they were decoded."""
    schema = pa.schema([("name", pa.string()), ("byte_size", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("transparent_ratio", pa.float64()), ("hash", pa.string()), ("bits", pa.int64()), ("r", pa.float64()), ("g", pa.float64()), ("b", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rgba = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                yield pa.RecordBatch.from_pylist([{"name": row["source"], "byte_size": row["byte_size"]} | raster.features(rgba)], schema)

    ship(images.sparkSession)
    rows = images.where("status = 'ok'").select("source", "byte_size", "has_alpha", "width", "height", "data")
    out = rows.mapInArrow(run, "name string, byte_size long, width int, height int, transparent_ratio double, hash string, bits long, r double, g double, b double")
    return out.withColumns({"ord": F.col("name"), "pivot_x": F.lit(None).cast("double"), "pivot_y": F.lit(None).cast("double")})


def manifest(processed: DataFrame, generator: str, version: str) -> DataFrame:
    """source, manifest: a JSON document for each image that went through; fixed key order."""
    rect = lambda r: F.struct(*[r[k].alias(k) for k in ("x", "y", "width", "height")])
    pages = F.transform("pages", lambda p: F.struct(F.format_string("atlas-%d.png", p["page"]).alias("file"), p["width"].alias("width"), p["height"].alias("height")))
    sprites = F.transform("sprites", lambda s: F.struct(s["id"].alias("id"), s["page"].alias("page"), rect(s["page_rect"]).alias("rect"), rect(s["source_rect"]).alias("sourceRect"), rect(s["trimmed_rect"]).alias("trimmedRect"), s["pivot"].alias("pivot")))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.lit(generator).alias("name"), F.lit(version).alias("version")).alias("generator"), F.col("source").alias("source"), pages.alias("pages"), sprites.alias("sprites"))
    return processed.where("status = 'ok'").select("source", F.to_json(body).alias("manifest"))


def batch_errors(processed: DataFrame) -> DataFrame:
    return processed.where("status <> 'ok'").select("source", "stage", "code", "message")
