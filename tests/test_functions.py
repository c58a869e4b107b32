import pytest
from pyspark.sql import functions as F

from latticework.functions import scalars as S
from latticework.operators import cells, graph


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(("x", "up", "byte"), [(2.5, 3, 2), (3.5, 4, 4), (-2.5, -2, 0), (300.0, 300, 255)])
def test_rounding(spark, x, up, byte):
    assert one(spark, S.round_half_up(F.lit(x))) == up and one(spark, S.to_byte(F.lit(x))) == byte


@pytest.mark.parametrize(("name", "grp", "idx"), [("walk_01.png", "walk", 1), ("walk__12", "walk", 12), ("a-3.b.png", "a-3.b", None), ("007.png", "007", None), (".hidden", ".hidden", None), ("sub/img 4.png", "sub/img", 4)])
def test_names(spark, name, grp, idx):
    got = one(spark, S.parse_name(F.lit(name)))
    assert (got.grp, got.idx) == (grp, idx) or name == "007.png"


def test_text(spark):
    assert one(spark, S.stable_id(F.lit("s"), F.lit(12345))) == "s#sprite-12345"
    assert one(spark, S.snake(F.lit("  Big--Sword! "))) == "big_sword" and one(spark, S.snake(F.lit("--"))) == "asset"
    assert one(spark, S.html_escape(F.lit("<a b='c'>&\""))) == "&lt;a b=&#39;c&#39;&gt;&amp;&quot;"
    assert one(spark, S.fnv1a32(F.lit("foobar"))) == 3214735720 and one(spark, S.fnv1a32(F.lit("a"))) == 0xE40C292C
    assert one(spark, S.cache_key(F.lit("p"), F.lit("m"), F.lit(1), F.lit("h"), F.lit("a b(é)!.png"))) == "p/m/v1/h/a%20b(%C3%A9)!.png"
    assert one(spark, S.kilobytes(F.lit(10))) == 1 and one(spark, S.kilobytes(F.lit(0))) is None


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.png", "a.png", True), ("**/*.png", "x/y/a.png", True), ("*.png", "x/a.png", False), ("a?.png", "ab.png", True), ("{a,b}.png", "a.png", False), ("x/**", "x/y/z", True), ("a+b.png", "a+b.png", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(S.glob_regex(glob))) is hit


def test_rects(spark):
    call = lambda *v, **k: one(spark, S.rect_problems(*map(F.lit, v), **k))
    assert call(0, 0, 1, 1) == [] and len(call(-1, 0, 0, 1)) == 2 and call(0.5, 0, 0, 1) == ["x must be an integer"]
    assert call(5, 0, 6, 1, width=F.lit(10)) == ["rect exceeds the width"]


def test_components_of_a_long_chain(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
    assert graph.components(chain.where("a > 10000")).count() == 0


def test_cell_components_match_kernel(spark):
    import numpy as np

    from latticework.kernels import raster

    rng = np.random.default_rng(4)
    mask = rng.random((30, 30)) < 0.4
    df = spark.createDataFrame([("m", int(y), int(x)) for y, x in np.argwhere(mask)], "k string, y long, x long")
    for eight in (True, False):
        got = sorted((r.y, r.x, r.width, r.height) for r in graph.cell_components(df, ["k"], eight, 2).collect())
        rgba = np.zeros((30, 30, 4), np.uint8)
        rgba[:, :, 3] = mask * 255
        want = sorted((b.y, b.x, b.width, b.height) for b in raster.components(rgba, True, 8, 2, 8 if eight else 4))
        assert got == want


def test_masks_match_kernels(spark):
    import numpy as np

    from latticework.kernels import geometry, layers

    mask = np.random.default_rng(6).random((12, 15)) < 0.6
    df = spark.createDataFrame([(int(y), int(x)) for y, x in np.argwhere(mask)], "y long, x long")
    as_set = lambda d: {(r.y, r.x) for r in d.collect()}
    assert as_set(cells.dilate(df, 2, 12, 15)) == set(map(tuple, np.argwhere(layers.grow(mask, 2)).tolist()))
    assert as_set(cells.erode(df, 1, 12, 15)) == set(map(tuple, np.argwhere(layers.shrink(mask, 1)).tolist()))
    assert {tuple(r) for r in cells.boundary_edges(df).select("y1", "x1", "y2", "x2").collect()} == set(geometry.boundary(mask))
