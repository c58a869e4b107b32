"""Connected components by large-star and small-star rounds, as joins and min-aggregates.

Edges stay distributed; each round is cut by a reliable checkpoint, so a lost executor costs one
round at most. Hubs are ordinary skewed join keys, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge list (a long, b long): component is its least node.

    Null ends and loops are left out. Nodes without an edge don't appear.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = sign(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = cut(_small_star(_large_star(now)))
        if (then := sign(now)) == was:
            break
        was = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def hierarchy_problems(nodes: DataFrame) -> DataFrame:
    """(id, problem) of a forest (id, parent): `missing-parent`, or `cycle` for nodes whose ancestors run into one.

    Ancestors are found by pointer doubling: a node that has one more steps above it than there are
    nodes with a parent meets some node twice. So log2(nodes) joins do, each of a row a node.
    """
    nodes = nodes.select("id", "parent")
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    missing = nodes.where("parent IS NOT NULL").join(ids, nodes["parent"] == ids["_id"], "left_anti").select("id", F.lit("missing-parent").alias("problem"))
    above = cut(nodes.where("id IS NOT NULL AND parent IS NOT NULL").select("id", F.col("parent").alias("up")).distinct())
    n = above.select("id").distinct().count()
    steps = 1
    while steps <= n and above.limit(1).count():
        right = above.select(F.col("id").alias("_mid"), F.col("up").alias("_far"))
        above = cut(above.join(right, above["up"] == right["_mid"]).select("id", F.col("_far").alias("up")).distinct())
        steps *= 2
    return missing.union(above.select("id", F.lit("cycle").alias("problem")).distinct())


def runs(df: DataFrame, keys: list[str], position: str, min_size: int = 1) -> DataFrame:
    """Runs of consecutive integer positions per key: keys, start, stop, size. One sort, no iteration."""
    from pyspark.sql import Window as W

    rows = df.select(*keys, F.col(position).cast("long").alias("p")).distinct()
    island = F.col("p") - F.row_number().over(W.partitionBy(*keys).orderBy("p"))
    out = rows.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("p").alias("start"), F.max("p").alias("stop"), F.count(F.lit(1)).alias("size"))
    return out.where(F.col("size") >= min_size).drop("_i")


#: Columns of a bin in which runs of neighbouring rows meet.
RUN_BIN = 64


def cell_components(cells: DataFrame, keys: list[str], eight: bool = True, min_cells: int = 1) -> DataFrame:
    """Connected components of cells (keys, y, x): keys, ordinal, bounds and size, in reading order.

    Rows are first reduced to runs; runs that touch in neighbouring rows are edges of a graph, whose
    components are found by label rounds. Runs meet by bins of columns, each in the bins that it covers,
    so a long row of many runs is no pair of all its runs.
    """
    from pyspark.sql import Window as W

    flat = runs(cells, [*keys, "y"], "x").select(*keys, F.col("y").cast("long").alias("y"), F.col("start").alias("x0"), F.col("stop").alias("x1"), "size")
    flat = cut(flat.withColumn("node", F.xxhash64(*keys, "y", "x0")))
    reach = 1 if eight else 0
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / RUN_BIN).cast("long"), F.floor(b / RUN_BIN).cast("long"))).alias("bin")
    low = flat.select(*keys, "y", "x0", "x1", "node", bins(F.col("x0"), F.col("x1")))
    up = flat.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("node").alias("b"), bins(F.col("x0") - reach, F.col("x1") + reach))
    touch = low.join(up, [*keys, "y", "bin"]).where((F.col("a0") <= F.col("x1") + reach) & (F.col("a1") >= F.col("x0") - reach))
    labels = components(touch.select(F.col("node").alias("a"), "b"))
    named = flat.join(labels.withColumnRenamed("node", "_n"), flat["node"] == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node"))
    boxes = named.groupBy(*keys, "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.sum("size").alias("cells"))
    boxes = boxes.where(F.col("cells") >= min_cells).drop("component")
    order = W.partitionBy(*keys).orderBy("y", "x", "width", "height", "cells")
    return boxes.withColumn("ordinal", F.row_number().over(order)) if keys else boxes
