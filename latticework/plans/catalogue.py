"""The tabular query catalogue: each operator applied to an ordinary table, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cells as C
from ..operators import enrich as E
from ..operators import graph as G
from ..operators import images as I
from ..operators import packing as P
from ..operators import rules as R
from ..operators.series import ordinals
from .config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("size_majority_deviants", """
    WITH c AS (SELECT p_brand, p_size, count(*) n FROM part GROUP BY 1, 2),
         m AS (SELECT p_brand, p_size AS majority_size FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1)
    SELECT p.p_partkey, p.p_brand, p.p_size, m.majority_size, 'high' AS severity
    FROM part p JOIN m USING (p_brand) WHERE p.p_size <> m.majority_size""")
def size_majority_deviants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ranked = parts.groupBy("p_brand", "p_size").count().withColumn("rn", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("count"), "p_size")))
    majority = ranked.where("rn = 1").select("p_brand", F.col("p_size").alias("majority_size"))
    return parts.join(majority, "p_brand").where(F.col("p_size") != F.col("majority_size")).withColumn("severity", F.lit("high"))


# ---- names, hashes, text


@query("name_parse", r"""
    SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^.+?[_\-\s]?\d+$') AND rtrim(regexp_extract(c_name, '^(.+?)[_\-\s]?(\d+)$', 1), '_- ') <> '' THEN rtrim(regexp_extract(c_name, '^(.+?)[_\-\s]?(\d+)$', 1), '_- ') ELSE c_name END AS grp,
           CASE WHEN regexp_matches(c_name, '^.+?[_\-\s]?\d+$') THEN regexp_extract(c_name, '^(.+?)[_\-\s]?(\d+)$', 2)::BIGINT END AS idx FROM customer""")
def name_parse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.parse_name(F.col("c_name")).alias("n")).select("c_custkey", "n.grp", "n.idx")


@query("text_fnv", """
    SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fnv FROM part""")
def text_fnv(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.fnv1a32(F.col("p_name")).alias("fnv"))


@query("naming_rule", r"""
    WITH s AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '')) AS stem FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(stem, '^\d+$') THEN '^\d+$' WHEN regexp_matches(stem, 'page=') THEN 'page=' ELSE 'utm_' END AS pattern
    FROM s WHERE regexp_matches(stem, '^\d+$') OR regexp_matches(stem, 'page=') OR regexp_matches(stem, 'utm_')""")
def naming_rule(spark, sf_dir):
    stem = F.lower(F.regexp_replace(F.regexp_extract("url", "[^/]*$", 0), r"\.[^.]*$", ""))
    hit = R.first_match(stem, [r"^\d+$", "page=", "(", "utm_"])
    return table(spark, sf_dir, "pages").select("page_id", hit.alias("pattern")).where("pattern IS NOT NULL")


@query("stable_ids", """
    SELECT o_orderkey, o_custkey::VARCHAR || '#sprite-' || format('{:04d}', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS id FROM orders""")
def stable_ids(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", S.stable_id(F.col("o_custkey").cast("string"), n).alias("id"))


@query("glob_filter", r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://(?:.*/)?en/[^/]*$') AND NOT regexp_matches(url, '^.*\.html$')""")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(S.matches_globs(F.col("url"), ["https://**/en/*"], ["**.html"]))


@query("html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(S.html_escape(F.col("html"))).alias("escaped"))


@query("exact_duplicates", """
    WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) SELECT doc_id, first FROM k WHERE doc_id <> first""")
def exact_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    return rows.join(first, "h").where("doc_id <> first").select("doc_id", "first")


_BITS = "list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN 1 ELSE 0 END)"


def _embedding_bits() -> Column:
    """One bit a dimension: whether it is above the next one, the last against the first."""
    at = lambda i: F.get("embedding", F.lit(i))
    out = F.lit(0).cast("long")
    for i in range(64):
        one = F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
        out = out.bitwiseOR(F.when(at(i) > at((i + 1) % 64), one).otherwise(F.lit(0).cast("long")))
    return out


@query("near_duplicates", f"""
    WITH v AS (SELECT vec_id, {_BITS} AS b FROM embeddings),
         p AS (SELECT x.vec_id AS i, y.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: CASE WHEN x.b[k] <> y.b[k] THEN 1 ELSE 0 END))::INTEGER AS distance FROM v x JOIN v y ON x.vec_id < y.vec_id)
    SELECT j AS vec_id, min(i) AS first, arg_min(distance, i) AS distance FROM p WHERE distance <= 16 GROUP BY j""")
def near_duplicates(spark, sf_dir):
    bits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), _embedding_bits().alias("bits"))
    assets = bits.withColumns({"hash": F.col("bits"), "r": F.lit(0), "g": F.lit(0), "b": F.lit(0)})
    return R.first_duplicates(assets, threshold=16).select(F.col("ord").alias("vec_id"), "first", "distance")


@query("hamming_histogram", f"""
    WITH v AS (SELECT vec_id, {_BITS} AS b FROM embeddings),
         p AS (SELECT list_sum(list_transform(range(1, 65), lambda k: CASE WHEN x.b[k] <> y.b[k] THEN 1 ELSE 0 END))::INTEGER AS distance FROM v x JOIN v y ON y.vec_id = x.vec_id + 1)
    SELECT distance, floor((1 - distance / 64) * 100 + 0.5)::BIGINT AS similarity, count(*) AS n FROM p GROUP BY 1, 2""")
def hamming_histogram(spark, sf_dir):
    bits = table(spark, sf_dir, "embeddings").select("vec_id", _embedding_bits().alias("a"))
    after = bits.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    d = S.hamming(F.col("a"), F.col("b")).alias("distance")
    return bits.join(after, "vec_id").select(d).groupBy("distance").agg(F.count(F.lit(1)).alias("n")).withColumn("similarity", S.similarity_percent(F.col("distance")))


# ---- bins, bounds, runs, regions


@query("grid_cells", "SELECT l_returnflag, floor(l_extendedprice / 10000)::BIGINT AS row, floor(l_quantity / 10)::BIGINT AS col, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def grid_cells(spark, sf_dir):
    return C.bin_cells(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 10, 10000, ["l_returnflag"])


@query("content_bounds", "SELECT l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1")
def content_bounds(spark, sf_dir):
    return C.content_bounds(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], F.col("l_discount") >= 0.08)


@query("transparent_ratio", """
    SELECT l_suppkey, round(count(*) FILTER (l_discount = 0) / count(*), 6) AS ratio FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_discount = 0) / count(*) > 0.05""")
def transparent_ratio(spark, sf_dir):
    share = F.avg((F.col("l_discount") == 0).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(share.alias("r")).where("r > 0.05").select("l_suppkey", F.round("r", 6).alias("ratio"))


@query("run_components", """
    WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::BIGINT AS p FROM events),
         g AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS i FROM h)
    SELECT user_id, min(p) AS start, max(p) AS stop, count(*) AS size FROM g GROUP BY user_id, i HAVING count(*) >= 1""")
def run_components(spark, sf_dir):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return G.runs(table(spark, sf_dir, "events").select("user_id", hour.alias("p0")), ["user_id"], "p0")


_LABELS_SQL = """
         l(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION
             SELECT u.b, min(l.component) FROM l JOIN u ON u.a = l.node JOIN recurring.l AS k ON k.node = u.b WHERE l.component < k.component GROUP BY u.b)"""


@query("graph_components", f"""
    WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {_LABELS_SQL}
    SELECT node, component FROM l""")
def graph_components(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return G.components(rows.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


@query("graph_components_sparse", f"""
    WITH RECURSIVE p AS (SELECT p_partkey * 3 AS a, substr(p_brand, 7)::BIGINT AS brand, p_size, floor(p_retailprice)::BIGINT AS price FROM part),
         e AS (SELECT a, (brand * 1000 + p_size) * 3 + 1 AS b FROM p UNION SELECT a, (brand * 1000000 + price) * 3 + 2 FROM p), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {_LABELS_SQL}
    SELECT node, component FROM l""")
def graph_components_sparse(spark, sf_dir):
    """Parts that share a brand and size, or a brand and price: many components of all sizes."""
    brand, node = F.substring("p_brand", 7, 9).cast("long"), (F.col("p_partkey") * 3).alias("a")
    parts = table(spark, sf_dir, "part")
    sizes = parts.select(node, ((brand * 1000 + F.col("p_size")) * 3 + 1).alias("b"))
    prices = parts.select(node, ((brand * 1000000 + F.floor("p_retailprice").cast("long")) * 3 + 2).alias("b"))
    return G.components(sizes.unionByName(prices))


_REGIONS = [("hero", 0, 0, 10, 20000), ("middle", 20, 10000, 15, 20000), ("wide", 5, 15000, 30, 40000)]


@query("manual_regions", """
    SELECT l_orderkey, l_linenumber, ordinal, region FROM lineitem JOIN (VALUES (0, 'hero', 0, 0, 10, 20000), (1, 'middle', 20, 10000, 15, 20000), (2, 'wide', 5, 15000, 30, 40000)) r(ordinal, region, x, y, w, h)
    ON l_quantity >= x AND l_quantity < x + w AND l_extendedprice >= y AND l_extendedprice < y + h""")
def manual_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return C.in_regions(rows, "l_quantity", "l_extendedprice", _REGIONS).drop("l_quantity", "l_extendedprice")


@query("skipped_regions", """
    WITH c AS (SELECT DISTINCT l_returnflag AS f, floor(l_quantity)::BIGINT AS col, floor(l_extendedprice / 1000)::BIGINT AS row FROM lineitem)
    SELECT f, row, col, 'fully-transparent' AS reason FROM (SELECT DISTINCT f FROM c), range(105) a(row), range(51) b(col) WHERE (f, row, col) NOT IN (SELECT f, row, col FROM c)""")
def skipped_regions(spark, sf_dir):
    cells = C.bin_cells(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1, 1000, ["l_returnflag"]).select(F.col("l_returnflag").alias("f"), F.col("row").alias("y"), F.col("col").alias("x"))
    empty = C.invert(cells, cells.select("f").distinct(), 105, 51)
    return empty.select("f", F.col("y").alias("row"), F.col("x").alias("col"), F.lit("fully-transparent").alias("reason"))


# ---- series


_SERIES_SQL = """
    WITH h AS (SELECT event_type AS k, floor(epoch(ts) / 3600)::BIGINT AS p, sum(value) AS value FROM events GROUP BY 1, 2),
         s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS i, value FROM h),
         n AS (SELECT k, max(i) + 1 AS n FROM s GROUP BY k)"""


def _hourly(spark, sf_dir) -> DataFrame:
    """Hourly sums for each event type, numbered from 0."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), hour.alias("p")).agg(F.sum("value").alias("value"))
    return ordinals(sums, ["k"], "p", "n").select("k", (F.col("n") - 1).cast("long").alias("i"), "value")


@query("resample_nearest", _SERIES_SQL + """,
         t AS (SELECT k, n, unnest(range(greatest(1, floor(n * 0.4 + 0.5)::BIGINT))) AS t FROM n)
    SELECT t.k, t, round(value, 6) AS value FROM t JOIN s ON s.k = t.k AND s.i = least(n - 1, floor((t + 0.5) / 0.4)::BIGINT)""")
def resample_nearest(spark, sf_dir):
    return C.resample_nearest(_hourly(spark, sf_dir), ["k"], 0.4).select("k", "t", F.round("value", 6).alias("value"))


@query("resample_linear", _SERIES_SQL + """,
         t AS (SELECT k, n, unnest(range(greatest(1, floor(n * 1.5 + 0.5)::BIGINT))) AS t FROM n),
         u AS (SELECT *, (t + 0.5) / 1.5 - 0.5 AS place FROM t), w AS (SELECT *, floor(place)::BIGINT AS lo, place - floor(place) AS f FROM u)
    SELECT w.k, t, round((1 - f) * a.value + f * b.value, 4) AS value FROM w JOIN s a ON a.k = w.k AND a.i = greatest(0, least(n - 1, lo)) JOIN s b ON b.k = w.k AND b.i = greatest(0, least(n - 1, lo + 1))""")
def resample_linear(spark, sf_dir):
    return C.resample_linear(_hourly(spark, sf_dir), ["k"], 1.5).select("k", "t", F.round("value", 4).alias("value"))


@query("to_bytes", "SELECT event_id, least(255, greatest(0, round_even(value * 2.5, 0)))::INTEGER AS byte, floor(value * 2.5 + 0.5)::BIGINT AS half_up FROM events")
def to_bytes(spark, sf_dir):
    x = F.col("value") * 2.5
    return table(spark, sf_dir, "events").select("event_id", S.to_byte(x).alias("byte"), S.round_half_up(x).alias("half_up"))


@query("pad_grid", """
    WITH d AS (SELECT event_type AS k, floor(epoch(ts) / 86400)::BIGINT AS i, count(*) AS value FROM events GROUP BY 1, 2),
         r AS (SELECT k, unnest(range(min(i) - 2, max(i) + 3)) AS i FROM d GROUP BY k)
    SELECT k, i, coalesce(value, 0) AS value FROM r LEFT JOIN d USING (k, i)""")
def pad_grid(spark, sf_dir):
    return C.pad(_daily(spark, sf_dir), ["k"], 2, 0)


def _daily(spark, sf_dir) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), day.alias("i")).agg(F.count(F.lit(1)).alias("value"))


@query("edge_extend", """
    WITH d AS (SELECT event_type AS k, floor(epoch(ts) / 86400)::BIGINT AS i, count(*) AS value FROM events GROUP BY 1, 2),
         b AS (SELECT k, min(i) AS lo, max(i) AS hi FROM d GROUP BY k), r AS (SELECT k, lo, hi, unnest(range(lo - 3, hi + 4)) AS i FROM b)
    SELECT r.k, r.i, d.value FROM r JOIN d ON d.k = r.k AND d.i = greatest(lo, least(hi, r.i))""")
def edge_extend(spark, sf_dir):
    return C.extend_edges(_daily(spark, sf_dir), ["k"], 3)


# ---- masks and layers


# every discount and tax is a layer, of cells of quantity and price
_MASK_SQL = "SELECT DISTINCT (round(l_discount * 100) * 100 + round(l_tax * 100))::BIGINT AS layer, floor(l_extendedprice / 4000)::BIGINT AS y, floor(l_quantity / 2)::BIGINT AS x FROM lineitem"


def _mask(spark, sf_dir, wide: int = 2, high: int = 4000) -> DataFrame:
    layer = (F.round(F.col("l_discount") * 100) * 100 + F.round(F.col("l_tax") * 100)).cast("long")
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    return table(spark, sf_dir, "lineitem").select(layer.alias("layer"), cell("l_extendedprice", high).alias("y"), cell("l_quantity", wide).alias("x")).distinct()


_FRAME_SQL = "SELECT layer, y, x FROM (SELECT DISTINCT layer FROM m), range(30) a(y), range(30) b(x)"


@query("mask_dilate", f"""
    WITH m AS ({_MASK_SQL}) SELECT DISTINCT layer, y + dy AS y, x + dx AS x FROM m, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 29""")
def mask_dilate(spark, sf_dir):
    return C.dilate(_mask(spark, sf_dir), 1, 30, 30)


@query("mask_erode", f"""
    WITH m AS ({_MASK_SQL}), o AS ({_FRAME_SQL} EXCEPT SELECT layer, y, x FROM m),
         d AS (SELECT DISTINCT layer, y + dy AS y, x + dx AS x FROM o, range(-1, 2) a(dy), range(-1, 2) b(dx)) SELECT layer, y, x FROM m WHERE y BETWEEN 0 AND 29 AND x BETWEEN 0 AND 29 EXCEPT SELECT layer, y, x FROM d""")
def mask_erode(spark, sf_dir):
    return C.erode(_mask(spark, sf_dir).where("y BETWEEN 0 AND 29 AND x BETWEEN 0 AND 29"), 1, 30, 30)


@query("mask_algebra", f"""
    WITH m AS ({_MASK_SQL}), b AS (SELECT layer + 100 AS layer, y, x FROM m)
    SELECT 'union' AS op, layer, count(*) AS n FROM (SELECT * FROM m UNION SELECT * FROM b) GROUP BY layer UNION ALL SELECT 'overlap', layer, count(*) FROM (SELECT * FROM m INTERSECT SELECT * FROM b) GROUP BY layer
    UNION ALL SELECT 'invert', layer, count(*) FROM ({_FRAME_SQL} EXCEPT SELECT layer, y, x FROM m) GROUP BY layer""")
def mask_algebra(spark, sf_dir):
    """Each layer with the one of the next lower discount, and against the whole image."""
    a = _mask(spark, sf_dir)
    b = a.withColumn("layer", F.col("layer") + 100)
    size = lambda d, op: d.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "layer", "n")
    return size(C.union(a, b), "union").unionByName(size(C.overlaps(a, b), "overlap")).unionByName(size(C.invert(a, a.select("layer").distinct(), 30, 30), "invert"))


@query("nearest_cell", f"""
    WITH m AS ({_MASK_SQL}), t AS ({_FRAME_SQL} EXCEPT SELECT layer, y, x FROM m),
         c AS (SELECT t.layer, t.y, t.x, greatest(abs(dy), abs(dx)) AS ring, dy, dx, m.y * 100 + m.x AS v FROM t, range(-2, 3) a(dy), range(-2, 3) b(dx), m WHERE m.layer = t.layer AND m.y = t.y + dy AND m.x = t.x + dx)
    SELECT layer, y, x, arg_min(v, row(ring, dy, dx)) AS v, min(ring) AS ring FROM c GROUP BY 1, 2, 3""")
def nearest_cell(spark, sf_dir):
    mask = _mask(spark, sf_dir)
    targets = C.invert(mask, mask.select("layer").distinct(), 30, 30)
    return C.nearest_cells(targets, mask.withColumn("v", F.col("y") * 100 + F.col("x")), 2, "v")


@query("boundary_edges", f"""
    WITH m AS ({_MASK_SQL}), s(dy, dx, ay, ax, by_, bx) AS (VALUES (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))
    SELECT m.layer, m.y + ay AS y1, m.x + ax AS x1, m.y + by_ AS y2, m.x + bx AS x2 FROM m CROSS JOIN s LEFT JOIN m AS o ON o.layer = m.layer AND o.y = m.y + dy AND o.x = m.x + dx WHERE o.layer IS NULL""")
def boundary_edges(spark, sf_dir):
    return C.boundary_edges(_mask(spark, sf_dir))


@query("grid_mesh", """
    WITH m AS (SELECT DISTINCT l_returnflag AS f, floor(l_extendedprice / 4000)::BIGINT AS y, floor(l_quantity / 2)::BIGINT AS x FROM lineitem)
    SELECT f, y // 2 AS gy, x // 2 AS gx FROM m GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def grid_mesh(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.floor(F.col("l_extendedprice") / 4000).cast("long").alias("y"), F.floor(F.col("l_quantity") / 2).cast("long").alias("x"))
    return C.grid_mesh(rows, 2)


@query("cell_components", f"""
    WITH RECURSIVE m AS ({_MASK_SQL.replace("4000", "1000").replace("l_quantity / 2", "l_quantity")}), n AS (SELECT *, layer * 1000000 + y * 1000 + x AS a FROM m),
         u AS (SELECT n.a, o.a AS b FROM n, range(-1, 2) p(dy), range(-1, 2) q(dx), n AS o WHERE o.layer = n.layer AND o.y = n.y + dy AND o.x = n.x + dx), {_LABELS_SQL}
    SELECT component // 1000000 AS layer, min(node % 1000) AS x, min(node // 1000 % 1000) AS y, max(node % 1000) - min(node % 1000) + 1 AS width, max(node // 1000 % 1000) - min(node // 1000 % 1000) + 1 AS height, count(*) AS cells FROM l GROUP BY component HAVING count(*) >= 2""")
def cell_components(spark, sf_dir):
    found = G.cell_components(_mask(spark, sf_dir, 1, 1000), ["layer"], eight=True, min_cells=2)
    return found.select("layer", "x", "y", "width", "height", "cells")


@query("compose_latest", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events WHERE value > 10 GROUP BY 1")
def compose_latest(spark, sf_dir):
    return C.compose(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], F.col("value") > 10)


@query("reconstruction_check", """
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 ELSE o_totalprice + 0.5 END AS p FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT count(*) FILTER (b.k IS NOT NULL) AS covered, count(*) FILTER (b.k IS NOT NULL AND abs(coalesce(a.p, 0) - b.p) > 1) AS violations, count(*) FILTER (b.k IS NULL) AS uncovered FROM a FULL JOIN b USING (k)""")
def reconstruction_check(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    b = a.where("k % 5 <> 0").withColumn("p", F.when(F.col("k") % 7 == 0, F.col("p") + 2).otherwise(F.col("p") + 0.5))
    return C.compare(a, b, ["k"], ["p"], 1.0)


@query("occupancy", "SELECT DISTINCT o_custkey % 100 AS x, month(o_orderdate)::BIGINT AS y FROM orders WHERE o_totalprice > 100000")
def occupancy(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 100000").select((F.col("o_custkey") % 100).alias("x"), F.month("o_orderdate").cast("long").alias("y")).distinct()


@query("manifest_join", """
    SELECT l_orderkey, l_linenumber, o_custkey AS page, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'ok' END AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 <> 0) ON l_orderkey = o_orderkey""")
def manifest_join(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select("o_orderkey", F.col("o_custkey").alias("page"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    out = rows.join(placed, rows["l_orderkey"] == placed["o_orderkey"], "left")
    return out.select("l_orderkey", "l_linenumber", "page", F.when(F.col("o_orderkey").isNull(), "missing").otherwise("ok").alias("status"))


@query("knn_weights", """
    WITH a AS (SELECT s_suppkey, s_acctbal AS ax, s_nationkey * 400.0 AS ay FROM supplier),
         p AS (SELECT c_custkey, s_suppkey, sqrt((c_acctbal - ax) ** 2 + (c_nationkey * 400.0 - ay) ** 2) AS d FROM customer, a),
         k AS (SELECT *, CASE WHEN d = 0 THEN 1e6 ELSE 1 / d END AS w FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) <= 2)
    SELECT c_custkey AS point, s_suppkey AS anchor, round(w / sum(w) OVER (PARTITION BY c_custkey), 6) AS weight FROM k""")
def knn_weights(spark, sf_dir):
    return _knn(spark, sf_dir, table(spark, sf_dir, "supplier"))


def _knn(spark, sf_dir, suppliers: DataFrame) -> DataFrame:
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 400.0).alias("y"))
    anchors = suppliers.select(F.col("s_suppkey").alias("anchor"), F.col("s_acctbal").alias("ax"), (F.col("s_nationkey") * 400.0).alias("ay"))
    return C.nearest_weights(points, anchors, 2).select("point", "anchor", F.round("weight", 6).alias("weight"))


_TREE = [("root", None), ("body", "root"), ("head", "body"), ("arm", "ghost"), ("a", "b"), ("b", "c"), ("c", "a"), ("tail", "tip"), ("tip", "a")]


@query("hierarchy_check", """
    WITH RECURSIVE t(id, parent) AS (VALUES ('root', NULL), ('body', 'root'), ('head', 'body'), ('arm', 'ghost'), ('a', 'b'), ('b', 'c'), ('c', 'a'), ('tail', 'tip'), ('tip', 'a')),
         n AS (SELECT * FROM t UNION ALL SELECT n_name, CASE WHEN n_nationkey % 9 = 0 THEN 'NOWHERE' ELSE r_name END FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region),
         r(id, up) AS (SELECT id, parent FROM n WHERE parent IS NOT NULL UNION SELECT r.id, n.parent FROM r JOIN n ON r.up = n.id WHERE n.parent IS NOT NULL)
    SELECT id, 'missing-parent' AS problem FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n) UNION ALL SELECT DISTINCT id, 'cycle' FROM r WHERE up IN (SELECT id FROM r WHERE id = up)""")
def hierarchy_check(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 9 == 0, "NOWHERE").otherwise(F.col("r_name")).alias("parent"))
    top = region.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent"))
    return G.hierarchy_problems(spark.createDataFrame(_TREE, "id string, parent string").unionByName(own).unionByName(top))


# ---- the analyser


_ASSETS_SQL = """
    a AS (SELECT CASE WHEN p_partkey % 10 = 3 THEN 'IMG' ELSE p_brand END AS grp, grp || '_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '' END AS name, p_size AS width, p_size % 3 AS height, (p_partkey % 100) / 100 AS ratio,
                 xor(('0x' || substr(md5(p_brand || p_size), 1, 16))::UBIGINT, (p_partkey % 4)::UBIGINT) AS bits, p_size AS r, p_partkey % 7 * 5 AS g, CASE WHEN p_partkey % 5 = 0 THEN 0.5 WHEN p_partkey % 5 = 1 THEN 0.2 END AS px FROM part)"""


def _assets(spark, sf_dir) -> DataFrame:
    """Parts read as assets: names, sizes, ratios, 64-bit words, colours and pivots."""
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 10 == 3, "IMG").otherwise(F.col("p_brand")), F.lit("_"), p.cast("string"), F.when(p % 2 == 0, ".png").otherwise(""))
    word = F.conv(F.substring(F.md5(F.concat("p_brand", F.col("p_size").cast("string"))), 1, 16), 16, -10).cast("long").bitwiseXOR(p % 4)
    rows = table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_size").alias("width"), (F.col("p_size") % 3).alias("height"), ((p % 100) / 100).alias("transparent_ratio"), word.alias("bits"), F.col("p_size").alias("r"), (p % 7 * 5).cast("int").alias("g"), F.lit(0).alias("b"), F.when(p % 5 == 0, 0.5).when(p % 5 == 1, 0.2).alias("pivot_x"), F.when((p % 5).isin(0, 1), 1.0).alias("pivot_y"), F.lit(None).cast("long").alias("byte_size"))
    return rows.withColumns({"hash": F.concat_ws("/", "bits", "r", "g"), "ord": F.col("name")})


_ISSUES_SQL = f"""
    WITH {_ASSETS_SQL},
    m AS (SELECT grp, width AS mw, height AS mh FROM (SELECT grp, width, height, count(*) AS n FROM a GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, width, height) = 1),
    dup AS (SELECT y.name, min(x.name) AS first, arg_min(CASE WHEN x.bits = y.bits AND x.r = y.r AND x.g = y.g THEN -1 ELSE bit_count(xor(x.bits, y.bits)) END, x.name) AS d
            FROM a x JOIN a y ON x.name < y.name AND bit_count(xor(x.bits, y.bits)) <= 5 AND greatest(abs(x.r - y.r), abs(x.g - y.g)) <= 24 GROUP BY y.name),
    i AS (SELECT name AS asset, 0 AS rule_ord, 'low' AS severity FROM a WHERE grp = 'IMG' UNION ALL SELECT name, 1, 'medium' FROM a WHERE ratio > 0.9
          UNION ALL SELECT name, 2, 'high' FROM a JOIN m USING (grp) WHERE width <> mw OR height <> mh
          UNION ALL SELECT name, 3, CASE WHEN d = -1 THEN 'high' ELSE 'medium' END FROM dup
          UNION ALL SELECT name, 4, CASE WHEN px IS NULL THEN 'info' WHEN grp = 'Brand#11' THEN 'medium' ELSE 'info' END FROM a WHERE px = 0.2 OR (px IS NULL AND grp = 'Brand#11'))"""


@query("quality_report", _ISSUES_SQL + " SELECT * FROM i")
def quality_report(spark, sf_dir):
    found = R.analyze(_assets(spark, sf_dir), characters=["^brand#11"], max_ratio=0.9)
    return found.select("asset", "rule_ord", "severity")


@query("severity_summary", _ISSUES_SQL + " SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info FROM i")
def severity_summary(spark, sf_dir):
    return R.severity_summary(R.analyze(_assets(spark, sf_dir), characters=["^brand#11"], max_ratio=0.9))


@query("report_nested", _ISSUES_SQL + " SELECT a.name AS asset, coalesce(string_agg(rule_ord || ':' || severity, ',' ORDER BY rule_ord), '') AS warnings FROM a LEFT JOIN i ON i.asset = a.name GROUP BY a.name")
def report_nested(spark, sf_dir):
    assets = _assets(spark, sf_dir)
    nested = R.report(assets, R.analyze(assets, characters=["^brand#11"], max_ratio=0.9))
    return nested.select("asset", F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["rule_ord"].cast("string"), w["severity"])), ",").alias("warnings"))


@query("pivot_deviation", """
    WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), p AS (SELECT s_suppkey, (s_acctbal - lo) / (hi - lo) AS x, s_nationkey / 24 AS y FROM supplier, b)
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'medium' ELSE 'info' END AS severity FROM p WHERE sqrt((x - 0.5) ** 2 + (y - 1) ** 2) > 0.05""")
def pivot_deviation(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    ends = rows.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    x, y = (F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.col("s_nationkey") / 24
    return rows.join(F.broadcast(ends)).where(S.pivot_deviates(x, y)).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "medium").otherwise("info").alias("severity"))


@query("rect_check", """
    SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity - 5 < 0 THEN 1 ELSE 0 END) + (CASE WHEN l_linenumber - 1 <= 0 THEN 1 ELSE 0 END) + (CASE WHEN l_quantity - 5 >= 0 AND l_linenumber - 1 > 0 AND l_quantity - 5 + l_linenumber - 1 > 40 THEN 1 ELSE 0 END) AS problems FROM lineitem""")
def rect_check(spark, sf_dir):
    x, w = F.col("l_quantity") - 5, F.col("l_linenumber") - 1
    found = S.rect_problems(x, F.lit(0), w, F.lit(1), width=F.lit(40))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(found).alias("problems"))


# ---- enrichment


@query("json_validate", """
    SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE WHEN NOT json_valid(props) OR (json_extract_string(props, '$.k'))::BIGINT > 50 THEN 1 ELSE 0 END AS problems FROM events""")
def json_validate(spark, sf_dir):
    v = F.try_parse_json(F.col("props"))
    k = F.try_variant_get(v, "$.k", "long")
    bad = F.filter(F.array(F.when(v.isNull(), "not JSON"), F.when(k > 50, "k is above 50")), lambda p: p.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.size(bad).alias("problems"))


@query("batch_summary", "SELECT count(*) AS total, count(*) FILTER (json_extract_string(props, '$.k')::BIGINT <= 50) AS succeeded, count(*) FILTER (json_extract_string(props, '$.k')::BIGINT > 50) AS failed FROM events")
def batch_summary(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json(F.col("props")), "$.k", "long")
    return R.batch_summary(table(spark, sf_dir, "events").select(F.when(k > 50, "failed").otherwise("ok").alias("status")))


_RESULTS_SQL = """
    r AS (SELECT p_partkey AS ord, p_name AS source, CASE p_size % 5 WHEN 0 THEN 'character' WHEN 1 THEN 'monster' WHEN 2 THEN 'item' WHEN 3 THEN 'ui' ELSE 'unknown' END AS asset_type, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Slime' ELSE 'unknown' END AS category FROM part)"""


def _results(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("character", "monster", "item", "ui", "unknown")]), size % 5 + 1)
    category = F.when(size % 3 == 0, F.col("p_brand")).when(size % 3 == 1, "Slime").otherwise("unknown")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("source"), kind.alias("asset_type"), category.alias("category"))


@query("suggest_names", f"""
    WITH {_RESULTS_SQL}, s AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'asset') AS c FROM r WHERE asset_type <> 'unknown'),
         b AS (SELECT *, CASE WHEN category IN ('unknown', '') THEN asset_type ELSE asset_type || '_' || c END AS base FROM s)
    SELECT source, base || '_' || format('{{:02d}}', row_number() OVER (PARTITION BY base ORDER BY ord)) || '.png' AS suggested FROM b""")
def suggest_names(spark, sf_dir):
    return E.name_suggestions(_results(spark, sf_dir))


@query("animation_lookup", f"""
    WITH {_RESULTS_SQL} SELECT source, CASE WHEN lower(category) = 'slime' THEN 'idle,run,bite' WHEN asset_type IN ('character', 'monster') THEN 'idle,move' WHEN asset_type = 'item' THEN 'rotate,float' END AS moves FROM r WHERE (lower(category) = 'slime' AND asset_type <> 'unknown') OR asset_type IN ('character', 'monster', 'item')""")
def animation_lookup(spark, sf_dir):
    return E.animation_suggestions(_results(spark, sf_dir)).select("source", F.array_join("moves", ",").alias("moves"))


@query("cache_misses", """
    WITH k AS (SELECT doc_id, md5(text) AS key FROM documents), c AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, key IN (SELECT key FROM c) AS hit FROM k""")
def cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    cache = docs.where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").cast("string").alias("value"))
    answers, _ = E.cache_pass(docs, cache, F.col("doc_id").cast("string"))
    return answers.select("doc_id", "hit")


@query("understanding", """
    SELECT c_custkey, CASE WHEN fnv % 3 = 0 THEN 'character' WHEN fnv % 3 = 1 THEN 'item' ELSE 'environment' END AS asset_type, CASE WHEN fnv % 3 = 0 THEN 'humanoid' WHEN fnv % 3 = 1 THEN 'item' ELSE 'environment' END AS category, 0 AS problems
    FROM (SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fnv FROM customer)""")
def understanding(spark, sf_dir):
    u = E.validate(E.mock_response(F.col("c_name")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", u.alias("u"))
    return rows.select("c_custkey", "u.asset_type", "u.category", F.size("u.problems").alias("problems"))


_PAYLOADS = (
    '{"assetType": "monster", "category": "slime", "description": "d", "confidence": 0.5}', '```json\n{"assetType": "item"}\n```', '{"assetType": "thing", "confidence": 2}', "no JSON", '["item"]',
    '{"assetType": "ui", "category": " ", "description": 4}', '{"assetType": "weapon", "confidence": "0.5"}', "```\n{}\n```",
)


@query("understanding_payloads", f"""
    WITH t AS (SELECT p_partkey, [{", ".join("'" + x + "'" for x in _PAYLOADS)}][p_partkey % {len(_PAYLOADS)} + 1] AS raw FROM part),
         f AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(raw, '^```(json)?', ''), '```$', ''), ' ' || chr(10)) AS j FROM t),
         j AS (SELECT p_partkey, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM f),
         v AS (SELECT p_partkey, ok, json_type(j) = 'OBJECT' AS is_object, j->>'$.assetType' AS kind, json_type(j, '$.category') AS ct, j->>'$.category' AS category, json_type(j, '$.description') AS dt, j->>'$.description' AS description, json_type(j, '$.confidence') AS pt, j->>'$.confidence' AS confidence FROM j)
    SELECT p_partkey, CASE WHEN NOT ok OR NOT is_object THEN 1 ELSE
             (CASE WHEN kind IN ('character', 'monster', 'item', 'weapon', 'environment', 'ui', 'unknown') THEN 0 ELSE 1 END) + (CASE WHEN ct IS NOT NULL AND (ct <> 'VARCHAR' OR trim(category) = '') THEN 1 ELSE 0 END)
             + (CASE WHEN dt IS NOT NULL AND dt <> 'VARCHAR' THEN 1 ELSE 0 END) + (CASE WHEN pt IS NOT NULL AND (pt = 'VARCHAR' OR try_cast(confidence AS DOUBLE) NOT BETWEEN 0 AND 1) THEN 1 ELSE 0 END) END AS problems,
           CASE WHEN is_object THEN kind END AS asset_type FROM v""")
def understanding_payloads(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in _PAYLOADS]), (F.col("p_partkey") % len(_PAYLOADS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", E.validate(raw).alias("u"))
    return rows.select("p_partkey", F.size("u.problems").alias("problems"), "u.asset_type")


@query("pivot_suggestions", f"WITH {_RESULTS_SQL} SELECT source, 0.5::DOUBLE AS x, 1.0::DOUBLE AS y FROM r WHERE asset_type IN ('character', 'monster')")
def pivot_suggestions(spark, sf_dir):
    return E.pivot_suggestions(_results(spark, sf_dir))


@query("metadata_join", f"""
    WITH {_RESULTS_SQL}, s AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'asset') AS c FROM r),
         n AS (SELECT ord, base || '_' || format('{{:02d}}', row_number() OVER (PARTITION BY base ORDER BY ord)) || '.png' AS name FROM (SELECT *, CASE WHEN category = 'unknown' THEN asset_type ELSE asset_type || '_' || c END AS base FROM s WHERE asset_type <> 'unknown'))
    SELECT source, asset_type || 's' AS folder, name, CASE WHEN asset_type = 'unknown' THEN '' WHEN lower(category) = 'slime' THEN 'idle,run,bite' WHEN asset_type IN ('character', 'monster') THEN 'idle,move' WHEN asset_type = 'item' THEN 'rotate,float' ELSE '' END AS moves
    FROM r LEFT JOIN n USING (ord)""")
def metadata_join(spark, sf_dir):
    """Folder, name and moves of every result, by its number as source (part names repeat)."""
    results = _results(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    named = results.withColumn("part", F.col("source")).withColumn("source", F.col("ord").cast("string"))
    rows = E.metadata(named).join(E.classification(named).select("source", "suggested_folder"), "source")
    return rows.select(F.col("part").alias("source"), F.col("suggested_folder").alias("folder"), F.col("suggested_name").alias("name"), F.array_join("moves", ",").alias("moves"))


@query("file_names", r"""
    WITH p AS (SELECT p_partkey, ' ' || p_type || '//' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '/' ELSE '' END AS path FROM part),
         b AS (SELECT *, list_last(string_split(regexp_replace(path, '/+$', ''), '/')) AS base FROM p)
    SELECT p_partkey, base, 'out/' || ltrim(path, '/') AS joined, coalesce(nullif(lower(regexp_replace(regexp_replace(base, '^(.+)[.][^.]*$', '\1'), '[^A-Za-z0-9_-]+', '_', 'g')), ''), 'asset') AS stem,
           'mock/m-1/v2/' || md5(path) || '/' || replace(replace(replace(replace(replace(url_encode(base), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS key FROM b""")
def file_names(spark, sf_dir):
    p = F.col("p_partkey") % 4
    tail = F.when(p == 0, ".PNG").when(p == 1, ".tar.gz").when(p == 2, "/").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit("//"), "p_name", tail).alias("path"))
    base = S.basename(F.col("path"))
    key = S.cache_key(F.lit("mock"), F.lit("m-1"), F.lit(2), F.md5("path"), base)
    return rows.select("p_partkey", base.alias("base"), S.join_path(F.lit("out//"), F.col("path")).alias("joined"), S.file_base(base).alias("stem"), key.alias("key"))


@query("size_labels", "SELECT doc_id, CASE WHEN n_chars - 100 > 0 THEN greatest(1, floor((n_chars - 100) / 1024 + 0.5)::BIGINT) END AS kb FROM documents")
def size_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.kilobytes(F.col("n_chars") - 100).alias("kb"))


@query("random_numbers", """
    WITH s AS (SELECT event_id, (event_id * 2654435761 + 1831565813) % 4294967296 AS a FROM events),
         t AS (SELECT event_id, a, (xor(a, a >> 15)::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t FROM s),
         u AS (SELECT event_id, xor(t, (t + (xor(t, t >> 7)::HUGEINT * (t | 61) % 4294967296)::BIGINT) % 4294967296) AS u FROM t)
    SELECT event_id, xor(u, u >> 14) / 4294967296 AS value FROM u""")
def random_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.mulberry32(F.col("event_id") * 2654435761 % 4294967296).alias("value"))


@query("pivot_modes", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 0.5 ELSE s_nationkey / 24 END AS x, CASE s_suppkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1 - s_nationkey / 24 END AS y FROM supplier""")
def pivot_modes(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("center"), F.lit("bottom-center"), F.lit("manual")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    at = S.pivot_of(mode, F.col("s_nationkey") / 24, 1 - F.col("s_nationkey") / 24)
    return table(spark, sf_dir, "supplier").select("s_suppkey", at["x"].alias("x"), at["y"].alias("y"))


@query("brush_stamps", """
    WITH m AS (SELECT DISTINCT floor(l_extendedprice / 4000)::BIGINT AS y, floor(l_quantity / 2)::BIGINT AS x FROM lineitem), c AS (SELECT y, x FROM range(-9, 40) a(y), range(-9, 40) b(x)),
         added AS (SELECT y, x FROM m UNION SELECT y, x FROM c WHERE (y - 3) ** 2 + (x - 24) ** 2 <= 49)
    SELECT y, x FROM added EXCEPT SELECT y, x FROM c WHERE (y - 8) ** 2 + (x - 12) ** 2 <= 16""")
def brush_stamps(spark, sf_dir):
    cells = _mask(spark, sf_dir).select("y", "x").distinct()
    return C.stamp(C.stamp(cells, 3, 24, 7), 8, 12, 4, erase=True)


@query("mesh_vertices", """
    WITH m AS (SELECT DISTINCT l_returnflag AS f, floor(l_extendedprice / 4000)::BIGINT AS y, floor(l_quantity / 2)::BIGINT AS x FROM lineitem),
         g AS (SELECT f, y // 2 AS gy, x // 2 AS gx FROM m GROUP BY 1, 2, 3 HAVING count(*) = 4), v AS (SELECT DISTINCT f, (gy + a) * 2 AS y, (gx + b) * 2 AS x FROM g, range(2) p(a), range(2) q(b))
    SELECT f, y, x, row_number() OVER (PARTITION BY f ORDER BY y || ':' || x) - 1 AS vertex FROM v""")
def mesh_vertices(spark, sf_dir):
    return C.mesh_vertices(grid_mesh(spark, sf_dir), 2)


@query("png_headers", """
    SELECT p_partkey::VARCHAR AS source, p_partkey % 5 <> 4 AS valid, CASE WHEN p_partkey % 5 <> 4 THEN p_size * 70000 END AS width, CASE WHEN p_partkey % 5 <> 4 THEN p_partkey END AS height,
           CASE WHEN p_partkey % 5 <> 4 THEN 8 END AS bit_depth, CASE WHEN p_partkey % 5 <> 4 THEN p_size % 7 END AS color_type FROM part""")
def png_headers(spark, sf_dir):
    from ..sources import images as source

    word = lambda c, n: F.lpad(F.hex(c), n, "0")
    head = F.when(F.col("p_partkey") % 5 == 4, "89504E470D0A1A0B").otherwise("89504E470D0A1A0A")
    hexed = F.concat(head, F.lit("0000000D49484452"), word((F.col("p_size") * 70000).cast("long"), 8), word(F.col("p_partkey"), 8), F.lit("08"), word((F.col("p_size") % 7).cast("long"), 2), F.lit("00" * 20))
    rows = source.headers(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), F.unhex(hexed).alias("content")))
    known = lambda c: F.when(F.col("valid"), F.col(c)).alias(c)
    return rows.select("source", "valid", *[known(c) for c in ("width", "height", "bit_depth", "color_type")])


# ---- images drawn from tables, with SQL: customers as pixels of their nation's 16 x 16 image

_PIXELS_SQL = """
    px AS (SELECT n_name AS source, (c_custkey // 25 % 256) // 16 AS y, (c_custkey // 25 % 256) % 16 AS x, max(c_custkey % 251) AS r, max(c_custkey % 17 * 15) AS g, max(c_custkey % 7 * 36) AS b
           FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL)"""


def _pixels(spark, sf_dir) -> DataFrame:
    """Customers in credit are the opaque pixels."""
    key = F.col("c_custkey")
    place = F.floor(key / 25) % 256
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("source"), F.floor(place / 16).alias("y"), (place % 16).alias("x"), (key % 251).alias("r"), (key % 17 * 15).alias("g"), (key % 7 * 36).alias("b"))
    return rows.groupBy("source", "y", "x").agg(*[F.max(c).alias(c) for c in "rgb"])


@query("image_features", f"""
    WITH {_PIXELS_SQL}, grid AS (SELECT source, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a
             FROM (SELECT DISTINCT source FROM px) CROSS JOIN range(16) p(y) CROSS JOIN range(16) q(x) LEFT JOIN px USING (source, y, x)),
         bytes AS (SELECT source, [0, 0, 0, 16, 0, 0, 0, 16] || flatten(list([r, g, b, a] ORDER BY y, x)) AS d FROM grid GROUP BY source),
         h AS (SELECT source, list_reduce(list_prepend(2166136261::BIGINT, d::BIGINT[]), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS h1, list_reduce(list_prepend(2538058380::BIGINT, d::BIGINT[]), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS h2 FROM bytes),
         light AS (SELECT source, j, i, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM grid, range(8) p(j), range(9) q(i) WHERE y = j * 16 // 8 AND x = i * 16 // 9),
         bits AS (SELECT source, string_agg(CASE WHEN v > nxt THEN '1' ELSE '0' END, '' ORDER BY j, i) AS bits FROM (SELECT *, lead(v) OVER (PARTITION BY source, j ORDER BY i) AS nxt FROM light) WHERE nxt IS NOT NULL GROUP BY source)
    SELECT source, format('{{:08x}}{{:08x}}', h1, h2) AS hash, bits, round(avg(CASE WHEN a = 0 THEN 1 ELSE 0 END), 9) AS ratio, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM grid JOIN h USING (source) JOIN bits USING (source) GROUP BY ALL""")
def image_features(spark, sf_dir):
    f = I.features(I.from_cells(_pixels(spark, sf_dir), 16, 16))
    return f.select(F.col("name").alias("source"), "hash", F.lpad(F.bin("bits"), 64, "0").alias("bits"), F.round("transparent_ratio", 9).alias("ratio"), *[F.round(c, 9).alias(c) for c in "rgb"])


_TRIM = {"enabled": True, "alphaThreshold": 1}
_CUTS = {
    "manual": {"mode": "manual", "rects": [{"x": n % 4 * 4, "y": n // 4 * 4, "width": 4, "height": 4} | ({"id": "first"} if n == 0 else {}) for n in range(16)]},
    "grid": {"mode": "grid", "rows": 4, "columns": 4, "alphaThreshold": 1},
}


@query("image_sprites", f"""
    WITH {_PIXELS_SQL}, cell AS (SELECT source, row * 4 + col AS n, row * 4 AS y0, col * 4 AS x0 FROM (SELECT DISTINCT source FROM px), range(4) p(row), range(4) q(col)),
         box AS (SELECT cell.source, n, y0, x0, min(y) AS t, max(y) AS b, min(x) AS l, max(x) AS r FROM cell LEFT JOIN px ON px.source = cell.source AND y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY ALL),
         all_ AS (SELECT 'manual' AS mode, *, n AS k FROM box UNION ALL SELECT 'grid', *, row_number() OVER (PARTITION BY source ORDER BY n) - 1 FROM box WHERE t IS NOT NULL)
    SELECT mode, source || CASE WHEN mode = 'manual' AND k = 0 THEN '#first' ELSE '#sprite-' || format('{{:04d}}', k) END AS id, x0::BIGINT AS source_x, y0::BIGINT AS source_y, l AS x, t AS y, r - l + 1 AS width, b - t + 1 AS height, CASE WHEN t IS NULL THEN 'fully-transparent' END AS skipped FROM all_""")
def image_sprites(spark, sf_dir):
    """Cells of the images, given as rects (empty ones are skipped) or as a grid (empty ones don't count), trimmed."""
    images = I.from_cells(_pixels(spark, sf_dir), 16, 16)
    long = lambda r, c: F.col(f"s.{r}.{c}").cast("long")
    none = [F.lit(None).cast("long").alias(c) for c in ("x", "y", "width", "height")]
    out = None
    for mode, detect in _CUTS.items():
        done = I.process(images, Config.parse({"schemaVersion": 2, "detect": detect, "trim": _TRIM}), with_pixels=False)
        first = (F.lit(mode).alias("mode"), F.col("s.id"), long("source_rect", "x").alias("source_x"), long("source_rect", "y").alias("source_y"))
        found = done.select(F.explode("sprites").alias("s")).select(*first, *[long("trimmed_rect", c).alias(c) for c in ("x", "y", "width", "height")], F.lit(None).cast("string").alias("skipped"))
        found = found.unionByName(done.select(F.explode("skipped").alias("s")).select(*first, *none, F.col("s.reason").alias("skipped")))
        out = found if out is None else out.unionByName(found)
    return out


# ---- kernels on images drawn from tables (no SQL form; tests compare them with brute force)


#: Part keys whose blocks are drawn together, blocks on one image, and places along its side, 4 pixels each.
_RANGE, _BLOCKS, _SIDE = 3200, 128, 16


def _drawn(spark, sf_dir) -> DataFrame:
    """A 3 x 3 block for every part, on 64 x 64 images of `_BLOCKS` parts of one brand and range of keys.

    Blocks lie by (size, number), or in the next free place, with a clear pixel between them; so every
    part is a sprite of its own, and tasks and images stay bounded however many parts a brand has.
    """
    import numpy as np
    import pyarrow as pa

    from ..session import ship

    def draw(table):
        schema = pa.schema([("source", pa.string()), ("status", pa.string()), ("stage", pa.string()), ("code", pa.string()), ("message", pa.string()), ("has_alpha", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("byte_size", pa.int64()), ("data", pa.binary())])
        table = table.sort_by([("p_partkey", "ascending"), ("p_size", "ascending")])
        brand, part, parts = table.column("p_brand")[0].as_py(), table.column("part")[0].as_py(), list(zip(table.column("p_size").to_pylist(), table.column("p_partkey").to_pylist()))
        out = []
        for k in range(0, len(parts), _BLOCKS):
            rgba, used = np.zeros((4 * _SIDE, 4 * _SIDE, 4), np.uint8), set()
            for size, key in parts[k : k + _BLOCKS]:
                place = (size % _SIDE) * _SIDE + key % _SIDE
                while place in used:
                    place = (place + 1) % _SIDE**2
                used.add(place)
                y, x = (4 * p for p in divmod(place, _SIDE))
                rgba[y : y + 3, x : x + 3] = (size * 5 % 256, key % 256, 90, 255)
            out.append({"source": f"{brand}-{part}-{k // _BLOCKS}", "status": "ok", "has_alpha": True, "width": 4 * _SIDE, "height": 4 * _SIDE, "byte_size": rgba.nbytes, "data": rgba.tobytes()})
        return pa.Table.from_pylist(out, schema)

    from ..sources.images import IMAGE

    ship(spark)
    part = F.floor(F.col("p_partkey") / _RANGE).cast("long")
    rows = table(spark, sf_dir, "part").select("p_brand", part.alias("part"), "p_size", "p_partkey")
    return rows.groupBy("p_brand", "part").applyInArrow(draw, IMAGE)


@query("pack_pages")
def pack_pages(spark, sf_dir):
    blocks = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") + 4).alias("width"), (F.col("p_partkey") % 37 + 4).alias("height"))
    return P.pack_groups(blocks, 256, 256, 2)


@query("sprite_pipeline")
def sprite_pipeline(spark, sf_dir):
    done = I.process(_drawn(spark, sf_dir), Config.default(), with_pixels=False)
    rows = done.select("source", "status", F.explode_outer("sprites").alias("s"))
    return rows.select("source", "status", "s.id", "s.page", "s.page_rect.x", "s.page_rect.y", "s.page_rect.width", "s.page_rect.height")


@query("image_report")
def image_report(spark, sf_dir):
    assets = I.features(_drawn(spark, sf_dir))
    return R.analyze(assets, max_ratio=0.5).select("asset", "rule", "severity", "message")


@query("manifest_json")
def manifest_json(spark, sf_dir):
    done = I.process(_drawn(spark, sf_dir), Config.default(), with_pixels=False)
    return I.manifest(done, "latticework", "0.1.0")
