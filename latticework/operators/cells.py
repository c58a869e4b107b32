"""Operators on cells of integer grids and on regular series: bins, bounds, margins, masks, lookups.

Cells are rows (keys, y, x, ...). Set algebra and neighbour tests are equi-joins on shifted cells, never
inequality joins; looking around costs (2r + 1)^2 rows a cell before an aggregate combines them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut

def bin_cells(df: DataFrame, x: str, y: str, cell_width: float, cell_height: float, keys: list[str] = ()) -> DataFrame:
    """Non-empty cells of a uniform grid with their counts: keys, row, col, n."""
    row, col = F.floor(F.col(y) / cell_height).cast("long"), F.floor(F.col(x) / cell_width).cast("long")
    return df.groupBy(*keys, row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"))


def content_bounds(df: DataFrame, x: str, y: str, keys: list[str], foreground: Column) -> DataFrame:
    """Bounding box of the rows that are foreground; keys without any are absent."""
    box = df.where(foreground).groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return box


def in_regions(df: DataFrame, x: str, y: str, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Rows with every region (id, x, y, width, height) they lie in, and the region's place in the list.

    The list is part of the plan (a query's literal), so membership is a filter and an explode.
    """
    inside = lambda r: (F.col(x) >= r[1]) & (F.col(x) < r[1] + r[3]) & (F.col(y) >= r[2]) & (F.col(y) < r[2] + r[4])
    hits = F.array(*[F.when(inside(r), F.struct(F.lit(i).alias("ordinal"), F.lit(r[0]).alias("region"))) for i, r in enumerate(regions)])
    return df.withColumn("_r", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select(*df.columns, "_r.*")


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- resampling of series (keys, i, value) with i = 0 .. n-1


def _targets(series: DataFrame, keys: list[str], scale: float) -> DataFrame:
    sizes = series.groupBy(*keys).agg((F.max("i") + 1).cast("long").alias("n"))
    out = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * scale + 0.5).cast("long"))
    return sizes.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), out - 1)))


def resample_nearest(series: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """keys, t, value: each target takes the source cell under its middle."""
    at = F.least(F.col("n") - 1, F.floor((F.col("t") + 0.5) / scale).cast("long"))
    return _targets(series, keys, scale).withColumn("i", at).join(series, [*keys, "i"]).select(*keys, "t", "value")


def resample_linear(series: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """keys, t, value: weighted mean of the two source cells around, ends held."""
    place = (F.col("t") + 0.5) / scale - 0.5
    low = F.floor(place).cast("long")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col("n") - 1, c))
    taps = _targets(series, keys, scale).withColumn("f", place - low)
    both = F.array(F.struct(clamp(low).alias("i"), (1 - F.col("f")).alias("w")), F.struct(clamp(low + 1).alias("i"), F.col("f").alias("w")))
    taps = taps.withColumn("tap", F.explode(both)).select(*keys, "t", "tap.*")
    return taps.join(series, [*keys, "i"]).groupBy(*keys, "t").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def pad(series: DataFrame, keys: list[str], margin: int, default) -> DataFrame:
    """Dense i from -margin to n - 1 + margin; cells without a row get the default."""
    span = series.groupBy(*keys).agg(F.min("i").alias("_a"), F.max("i").alias("_b"))
    grid = span.withColumn("i", F.explode(F.sequence(F.col("_a") - margin, F.col("_b") + margin))).drop("_a", "_b")
    return grid.join(series, [*keys, "i"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def extend_edges(series: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """Dense series with `margin` cells on either side that repeat the end values."""
    span = series.groupBy(*keys).agg(F.min("i").alias("_a"), F.max("i").alias("_b"))
    grid = span.withColumn("t", F.explode(F.sequence(F.col("_a") - margin, F.col("_b") + margin)))
    grid = grid.withColumn("i", F.greatest("_a", F.least("_b", "t")))
    return grid.join(series, [*keys, "i"]).select(*keys, F.col("t").alias("i"), "value")


# ---- masks: sets of cells (keys, y, x)


def _around(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def shifted(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every cell at every offset; the explode stays in the scan's stage."""
    steps = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in offsets])
    rest = [c for c in cells.columns if c not in ("y", "x")]
    moved = cells.withColumn("_s", F.explode(steps))
    return moved.select(*rest, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))


def _clip(cells: DataFrame, height: int | None, width: int | None) -> DataFrame:
    inside = F.lit(True)
    if height is not None:
        inside = inside & (F.col("y") >= 0) & (F.col("y") < height)
    if width is not None:
        inside = inside & (F.col("x") >= 0) & (F.col("x") < width)
    return cells.where(inside)


def dilate(cells: DataFrame, r: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """All cells within Chebyshev distance r, clipped to the image."""
    return _clip(shifted(cells, _around(r)), height, width).distinct()


def erode(cells: DataFrame, r: int, height: int, width: int) -> DataFrame:
    """Cells whose whole neighbourhood is set; outside the image counts as set."""
    keys = cells.columns
    marks = _clip(shifted(cells.distinct(), _around(r)), height, width).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    clipped = lambda c, size: F.least(c + r, F.lit(size - 1)) - F.greatest(c - r, F.lit(0)) + 1
    full = clipped(F.col("y"), height) * clipped(F.col("x"), width)
    return marks.where(F.col("n") == full).select(*keys)


def full_grid(frame: DataFrame, height: int, width: int) -> DataFrame:
    """All cells for each row of `frame` (keys)."""
    ys, xs = F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")), F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    return frame.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs))


def invert(cells: DataFrame, frame: DataFrame, height: int, width: int) -> DataFrame:
    return full_grid(frame, height, width).join(cells, cells.columns, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi").distinct()


def stamp(cells: DataFrame, cy: int, cx: int, r: int, erase: bool = False) -> DataFrame:
    """A disc added to, or taken from, a mask without keys."""
    spark = cells.sparkSession
    disc = spark.createDataFrame([(cy + dy, cx + dx) for dy, dx in _around(r) if dy * dy + dx * dx <= r * r], "y long, x long")
    return cells.join(disc, ["y", "x"], "left_anti") if erase else union(cells.select("y", "x"), disc)


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Directed unit edges (keys, y1, x1, y2, x2) of cells beside clear cells, inside to the right."""
    keys = [c for c in cells.columns if c not in ("y", "x")]
    sides = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))
    step = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip((*d, *a, *b), ("dy", "dx", "ay", "ax", "by", "bx"))]) for d, a, b in sides])
    probe = cells.withColumn("s", F.explode(step)).withColumns({"ny": F.col("y") + F.col("s.dy"), "nx": F.col("x") + F.col("s.dx")})
    other = cells.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    free = probe.join(other, [*keys, "ny", "nx"], "left_anti")
    at = lambda c, o: F.col(c) + F.col(f"s.{o}")
    return free.select(*keys, at("y", "ay").alias("y1"), at("x", "ax").alias("x1"), at("y", "by").alias("y2"), at("x", "bx").alias("x2"))


def nearest_cells(targets: DataFrame, cells: DataFrame, radius: int, value: str) -> DataFrame:
    """For each target cell (keys, y, x) the value of the nearest cell with its keys: least (ring, dy, dx) within radius."""
    keys = [c for c in targets.columns if c not in ("y", "x")]
    offsets = [(max(abs(dy), abs(dx)), dy, dx) for dy, dx in _around(radius)]
    step = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(o, ("ring", "dy", "dx"))]) for o in offsets])
    look = targets.withColumn("o", F.explode(step)).withColumns({"sy": F.col("y") + F.col("o.dy"), "sx": F.col("x") + F.col("o.dx")})
    source = cells.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value))
    return look.join(source, [*keys, "sy", "sx"]).groupBy(*keys, "y", "x").agg(F.min_by(value, "o").alias(value), F.min("o.ring").alias("ring"))


def grid_mesh(cells: DataFrame, step: int) -> DataFrame:
    """Squares of `step` cells that lie wholly in the mask: keys, gy, gx; two triangles each."""
    keys = [c for c in cells.columns if c not in ("y", "x")]
    square = cells.distinct().groupBy(*keys, F.floor(F.col("y") / step).cast("long").alias("gy"), F.floor(F.col("x") / step).cast("long").alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    return square.where(F.col("n") == step * step).select(*keys, "gy", "gx")


def mesh_vertices(squares: DataFrame, step: int) -> DataFrame:
    """Corner points of squares, numbered in the order of the text `y:x`."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    keys = [c for c in squares.columns if c not in ("gy", "gx")]
    points = squares.withColumn("c", F.explode(corners)).select(*keys, ((F.col("gy") + F.col("c.a")) * step).alias("y"), ((F.col("gx") + F.col("c.b")) * step).alias("x")).distinct()
    text = F.concat_ws(":", F.col("y").cast("string"), F.col("x").cast("string"))
    return points.withColumn("vertex", F.row_number().over(W.partitionBy(*keys or [F.lit(0)]).orderBy(text)) - 1) if keys else points.withColumn("_k", F.lit("")).withColumn("vertex", F.row_number().over(W.partitionBy("_k").orderBy(text)) - 1).drop("_k")


# ---- layers


def compose(rows: DataFrame, keys: list[str], value: str, z: list[str], visible: Column) -> DataFrame:
    """The topmost visible value of each cell: greatest z, no blending."""
    return rows.where(visible).groupBy(*keys).agg(F.max_by(value, F.struct(*z)).alias(value))


def compare(a: DataFrame, b: DataFrame, keys: list[str], channels: list[str], delta: float) -> DataFrame:
    """One row: covered cells, violations (some channel off by more than delta), and cells of a alone."""
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in channels], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in channels], F.lit(1).alias("_in_b"))
    both = left.join(right, keys, "full")
    covered = F.col("_in_b").isNotNull()
    off = reduce(lambda x, y: x | y, [F.abs(F.coalesce(F.col(f"_a_{c}"), F.lit(0)) - F.col(f"_b_{c}")) > delta for c in channels])
    return both.agg(F.count_if(covered).alias("covered"), F.count_if(covered & off).alias("violations"), F.count_if(~covered).alias("uncovered"))


#: Anchors that go to all executors as one array; more are found through grid cells.
RIG = 256


def _nearest_by_cells(points: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """x, y, near for every place of points: its k nearest anchors, by joins on the 3 x 3 cells around.

    All anchors nearer than a cell's side are in these cells; places with fewer than k of them look
    again in cells twice as wide, at last in one that holds everything. Of anchors at one place only
    the k least ids can be among the nearest.
    """
    same = W.partitionBy("ax", "ay").orderBy("anchor")
    rig = cut(anchors.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n"))
    left = cut(points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct())
    bounds = lambda df, x, y: df.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    n, *of_rig = bounds(rig, "ax", "ay")
    m, *of_left = bounds(left, "x", "y")
    if not m:
        of_left = of_rig
    x0, x1, y0, y1 = [f(float(a), float(b)) for f, a, b in zip((min, max, min, max), of_rig, of_left)]
    span = max(x1 - x0, y1 - y0)
    side = max(float(of_rig[1] - of_rig[0]), float(of_rig[3] - of_rig[2])) * (k / n) ** 0.5 or span / 64 or 1.0
    steps = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in _around(1)])
    order = W.partitionBy("x", "y").orderBy("d", "anchor")
    found = None
    while True:
        cell = lambda c, low: F.floor((F.col(c) - low) / side).cast("long")  # noqa: B023, E731
        look = left.withColumn("_s", F.explode(steps)).select("x", "y", (cell("y", y0) + F.col("_s.dy")).alias("row"), (cell("x", x0) + F.col("_s.dx")).alias("col"))
        pairs = look.join(rig.withColumns({"row": cell("ay", y0), "col": cell("ax", x0)}), ["row", "col"])
        pairs = pairs.select("x", "y", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")).alias("d"), "anchor")
        best = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        near = best.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("d", "anchor"))).alias("near"))
        whole = side > span
        if not whole:  # a little less than the side, as cells are found by division
            near = near.where((F.size("near") == k) & (F.element_at("near", -1)["d"] < side * 0.999999))
        near = cut(near)
        found = near if found is None else found.unionByName(near)
        if whole:
            return found
        left = cut(left.join(near.select("x", "y"), ["x", "y"], "left_anti"))
        if not left.limit(1).count():
            return found
        side *= 2


def nearest_weights(points: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """point, anchor, weight: the k nearest anchors of each point (ties by anchor id), inverse distance.

    points (point, x, y); anchors (anchor, ax, ay), coordinates not null. Up to `RIG` anchors are sent
    whole to where points are, as one array, and the k best are picked there without a shuffle of pairs.
    """
    if anchors.limit(RIG + 1).count() <= RIG:
        rig = anchors.agg(F.sort_array(F.collect_list(F.struct("anchor", "ax", "ay"))).alias("rig"))
        near = F.slice(F.array_sort(F.transform("rig", lambda a: F.struct(F.hypot(F.col("x") - a["ax"], F.col("y") - a["ay"]).alias("d"), a["anchor"].alias("anchor")))), 1, k)
        found = points.join(F.broadcast(rig)).select("point", near.alias("near"))
    else:
        found = points.join(_nearest_by_cells(points, anchors, k), ["x", "y"]).select("point", "near")
    inverse = lambda n: F.when(n["d"] == 0, F.lit(1e6)).otherwise(1 / n["d"])
    rows = found.withColumn("total", F.aggregate("near", F.lit(0.0), lambda s, n: s + inverse(n)))
    return rows.select("point", "total", F.explode("near").alias("n")).select("point", F.col("n.anchor").alias("anchor"), (inverse(F.col("n")) / F.col("total")).alias("weight"))
