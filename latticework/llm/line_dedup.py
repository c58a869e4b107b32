"""Cross-site boilerplate lines, in DataFrame functions only.

A line's spread is the number of distinct sites (sources) it stands on. One aggregation per line hash
merges HyperLogLog sketches of the sites; lines whose estimate is near the threshold, within what the
sketch can be wrong by, get exact distinct counts. Lines on `min_sites` sites or more are boilerplate:
all their occurrences go but the first (least doc_id, then position), so no text is lost outright.

Texts are split once, into hashes and positions that are written; all shuffles carry these and sketches,
and frequent lines are combined before each. What documents lose goes to where they lie, if it is small by
count; else texts move once.

Edge cases. A line is compared trimmed of spaces; blank lines are never removed. Null text: no lines,
text stays null. Null source: one site of its own. Rows are judged one by one, also those that share a
doc_id; repeated rows all keep a line of which theirs is the first. Null doc_id: comes before all
others. Empty table: empty result. Extra columns are kept by `line_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_written, hash128, written

MIN_SITES = 10
#: 2^10 registers: relative standard error 1.04 / 32 = 3.3 %.
LG_K = 10
#: The band around the threshold that gets exact counts: eight standard errors.
BAND = 0.26
#: Boilerplate lines (16 bytes of hash and a position each), or documents that lose lines, that may go to all executors.
BROADCAST_LINES = 200_000
#: Positions of lines to remove (4 bytes each) that may go to all executors, with up to as many documents.
BROADCAST_PLACES = 2_000_000
_DROP = "__latticework_drop"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, site, position and hash of every line with something in it."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), site.alias("site"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select("doc_id", "body", "site", "pos", *hash128(F.col("line")))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first_doc, first_pos of every line on `min_sites` sites or more, from occurrences."""
    # a line on n sites stands n times at least: rarer ones need no sketch after this
    spread = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    known = spread.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    known = cut(known.where(F.col("sites") >= min_sites * (1 - BAND)))
    sure = known.where(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2", "first")
    near = known.where(F.col("sites") <= min_sites * (1 + BAND)).select("h1", "h2", "first")
    exact = rows.join(_small(near.select("h1", "h2")), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    out = sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))
    return cut(out.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is small enough, by count; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """docs with `_DROP`, the positions of the lines to remove (null: none)."""
    rows = written(_occurrences(docs), "lines")  # texts are split once; later passes read hashes
    hits = rows.join(_small(boilerplate(rows, min_sites)), ["h1", "h2"])
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    gone = cut(hits.where(~first).groupBy(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")).agg(F.collect_set("pos").alias(_DROP)))
    drop_written(rows)
    n, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(_DROP)), F.lit(0))).first()
    if n <= BROADCAST_LINES and places <= BROADCAST_PLACES:
        gone = F.broadcast(gone)
    own = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_body"])
    return docs.join(gone, own, "left").select(*[docs[c] for c in docs.columns], gone[_DROP])


def _kept() -> Column:
    keep = F.filter(lines_of(F.col("text")), lambda _, i: ~F.array_contains(_DROP, i))
    return F.when(F.col(_DROP).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for each row."""
    docs = docs.select("doc_id", "text", "source")
    marked = _marked(docs, min_sites)
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col("text"))))
    return marked.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(_DROP), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.encode(F.coalesce(_kept(), F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows, with boilerplate lines taken out of `text`; columns and their order stay."""
    marked = _marked(docs, min_sites)
    return marked.withColumn("text", _kept()).select(*docs.columns)
