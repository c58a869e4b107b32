"""Quality rules: base rules and robust multivariate outliers, in DataFrame functions only.

Every text gets a vector of statistics. Per language and source the minimum covariance determinant
(MCD) estimates where the bulk of these vectors lies: from three deterministic robust starts, C-steps
refit mean and covariance on the share `COVERAGE` of the rows that is nearest to the last fit, which
never raises the determinant; after two steps the start with the least determinant goes on. Rows whose
Mahalanobis distance from that fit is beyond a chi-square quantile are rejected.

The statistics are transformed and kept as integers (thousandths), so that all sums are exact and
the result does not depend on partitioning. The share nearest to a fit is found from a histogram of
distances in geometric bins: bounded state per group, no sort, and no group in one task.

Edge cases. Null text: no words, base rules fail. Null language or source: a group of their own.
Groups below `MIN_GROUP` base-passing rows, where a covariance of their own says nothing, are judged
by the estimate of their language, and if that has too few rows as well, by that of all rows.
Repeated rows are judged alike. Empty table: empty result. Extra columns are ignored by
`text_statistics` (it returns only its own) and kept by `quality_filter`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, drop_written, row_key, without, words_of, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Groups below this many base-passing rows have no estimate of their own.
MIN_GROUP = 60
#: Share of a group that the estimate must cover.
COVERAGE = 0.75
C_STEPS, TRIAL_STEPS = 4, 2
#: Groups whose estimates (about 200 bytes each) may go to all executors; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Factor that makes the covariance of the nearest `COVERAGE` right for normal rows in four dimensions:
#: COVERAGE / P(chi-square with 6 degrees of freedom <= 5.385), 5.385 being the quantile of COVERAGE with 4.
CONSISTENCY = 1.4864
#: Chi-square quantile 1 - 1e-6 with 4 degrees of freedom. On labelled clean rows distances follow that law
#: (99 % lie below 13.5, the quantile is 13.3); junk lies far beyond (half of it above 4,000).
CUTOFF = 33.4
#: A statistic's standard deviation counts as this much at least (thousandths); constant ones divide by it.
FLOOR = (100, 60, 40, 200)
DIMS = ("z_len", "z_word", "z_sym", "z_dup")


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of all 5-word windows; null where a text has no two of them."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    return F.when(n > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))


def text_statistics(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; one narrow pass over the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = words_of(F.col(text))
    base = docs.select(*keys, body.alias("_text"), words.alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]"))
    base = base.withColumns({"_h": _window_hashes(F.col("_words")), "_lines": lines})
    # Most texts repeat no window, which a hash set over the long array tells; only for the others
    # are windows sorted with their positions, to find those that occur twice or more, in order.
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    same = lambda a, b: F.coalesce(a.getField("h") == b.getField("h"), F.lit(False))
    hit = F.filter("_p", lambda x, j: same(x, F.get(F.col("_p"), j - 1)) | same(x, F.get(F.col("_p"), j + 1)))
    base = base.withColumn("_q", F.array_sort(F.transform(hit, lambda x: x.getField("i"))))
    covered = F.aggregate(
        F.transform("_q", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q"), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return base.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _vector(stats: DataFrame) -> DataFrame:
    """Transformed statistics in thousandths: log length, mean word length, symbols and repeats a word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    milli = lambda x: F.rint(x * 1000).cast("long")
    return stats.withColumns(
        {
            "z_len": milli(F.log1p(F.col("n_words").cast("double"))),
            "z_word": milli(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
            "z_sym": milli(F.log1p(10.0 * F.col("n_symbols") / n)),
            "z_dup": milli(F.log1p(F.sqrt(10.0 * F.col("n_repeat_words") / n) + F.col("n_dup_lines") / n)),
        }
    )


def _moments() -> list[Column]:
    """Exact sums for mean and covariance: additive, so they are combined before the shuffle. Products are
    below 3e8, so a sum of 3e10 rows fits a long; beyond that Spark raises."""
    one = [F.count(F.lit(1)).alias("m")]
    one += [F.sum(z).alias(f"s_{z}") for z in DIMS]
    return one + [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c_*, and the Cholesky factor l_* of the covariance v_*, with a floor on each variance."""
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            rest = reduce(lambda x, k: x + F.col(f"l_{a}_{DIMS[k]}") * F.col(f"l_{b}_{DIMS[k]}"), range(j), F.lit(0.0))
            if i == j:
                value = F.sqrt(F.greatest(F.col(f"v_{a}_{a}") + float(FLOOR[i] ** 2) - rest, F.lit(float(FLOOR[i] ** 2))))
            else:
                value = (F.col(f"v_{a}_{b}") - rest) / F.col(f"l_{b}_{b}")
            df = df.withColumn(f"l_{a}_{b}", value)
    return df.select(*keys, *centre_names(), *factor_names())


def _fit(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance, from moments."""
    m = F.col("m").cast("double")
    mean = {z: F.col(f"s_{z}") / m for z in DIMS}
    covariance = [(F.col(f"s_{a}_{b}").cast("double") / m - mean[a] * mean[b]).alias(f"v_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return _cholesky(sums.select(*keys, *[mean[z].alias(f"c_{z}") for z in DIMS], *covariance), keys)


def _distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i, a in enumerate(DIMS):
        rest = reduce(lambda x, k: x + F.col(f"l_{a}_{DIMS[k]}") * F.col(f"y_{DIMS[k]}"), range(i), F.lit(0.0))
        df = df.withColumn(f"y_{a}", (F.col(a) - F.col(f"c_{a}") - rest) / F.col(f"l_{a}_{a}"))
    return df.withColumn("d2", reduce(lambda x, z: x + F.col(f"y_{z}") * F.col(f"y_{z}"), DIMS, F.lit(0.0)))


def _bin() -> Column:
    """Geometric bins of the distance, 32 a doubling."""
    return F.greatest(F.lit(-320), F.least(F.lit(1280), F.floor(F.log2(F.col("d2") + 1e-9) * 32))).cast("int")


def _starts(vectors: DataFrame, size: DataFrame) -> DataFrame:
    """Three starts a group, as (_group, start, share, centre, factor): medians with mean deviations about
    them; the same, but only the nearest half counts in the first step; medians with the covariance of
    spatial signs, which tells correlations whatever the tails are."""
    at = vectors.join(size, "_group")
    length = F.sqrt(reduce(lambda x, z: x + F.pow((F.col(z) - F.col(f"m_{z}")) / F.col(f"r_{z}"), 2), DIMS, F.lit(0.0)))
    at = at.withColumn("_length", F.when(length > 0, length))
    sign = {z: F.coalesce(F.rint(1000 * (F.col(z) - F.col(f"m_{z}")) / F.col(f"r_{z}") / F.col("_length")), F.lit(0.0)).cast("long") for z in DIMS}
    signs = [F.sum(sign[a] * sign[b]).alias(f"g_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    spread = at.groupBy("_group").agg(*[F.sum(F.abs(F.col(z) - F.col(f"m_{z}"))).alias(f"a_{z}") for z in DIMS], *signs)
    known = cut(size.join(spread, "_group"))
    centre = [F.col(f"m_{z}").cast("double").alias(f"c_{z}") for z in DIMS]
    flat = [F.greatest(F.col(f"a_{z}") / F.col("n"), F.lit(float(f))).alias(f"l_{z}_{z}") for z, f in zip(DIMS, FLOOR)]
    flat += [F.lit(0.0).alias(f"l_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[:i]]
    columns = ["_group", "start", "share", *centre_names(), *factor_names()]
    both = F.explode(F.array(F.struct(F.lit(0).alias("start"), F.lit(COVERAGE).alias("share")), F.struct(F.lit(1).alias("start"), F.lit(0.5).alias("share"))))
    plain = known.select("_group", both.alias("x"), *centre, *flat).select("_group", "x.*", *centre_names(), *factor_names())
    scaled = [(F.col(f"g_{a}_{b}") / F.col("n") * len(DIMS) / 1e6 * F.col(f"r_{a}") * F.col(f"r_{b}")).alias(f"v_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    signed = _cholesky(known.select("_group", *centre, *scaled), ["_group"]).withColumns({"start": F.lit(2), "share": F.lit(COVERAGE)})
    return plain.select(*columns).unionByName(signed.select(*columns))


def centre_names() -> list[str]:
    return [f"c_{z}" for z in DIMS]


def factor_names() -> list[str]:
    return [f"l_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]


def _c_step(vectors: DataFrame, fit: DataFrame, size: DataFrame) -> DataFrame:
    """Means and covariances of the share of rows nearest to each fit (_group, start, share, ...).

    Sums by bin of distance are additive: one pass gives the histogram and, for any cut of it, the moments.
    """
    own = ["_group", "start", "share"]
    by_bin = _distance(vectors.join(fit, "_group")).select(*own, *DIMS, _bin().alias("bin")).groupBy(*own, "bin").agg(*_moments())
    before = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = by_bin.withColumn("_before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(size.select("_group", "n"), "_group").where(F.col("_before") < F.ceil(F.col("n") * F.col("share")))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = near.groupBy(*own).agg(F.sum("m").alias("m"), *[wide(f"s_{z}") for z in DIMS], *[wide(f"s_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]])
    return _fit(sums, own).withColumn("share", F.lit(COVERAGE))


def mcd_fit(vectors: DataFrame, steps: int = C_STEPS) -> DataFrame:
    """_group, centre and Cholesky factor of the minimum-covariance-determinant estimate, for vectors (_group, z_*).

    All starts take `TRIAL_STEPS`, the one with the least determinant the rest.
    """
    quartiles = [F.percentile_approx(z, [0.25, 0.5, 0.75], 1000).alias(f"q_{z}") for z in DIMS]
    middle = [F.col(f"q_{z}")[1].alias(f"m_{z}") for z in DIMS]
    spread = [F.greatest((F.col(f"q_{z}")[2] - F.col(f"q_{z}")[0]) / 1.349, F.lit(float(f))).alias(f"r_{z}") for z, f in zip(DIMS, FLOOR)]
    size = cut(vectors.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *quartiles).select("_group", "n", *middle, *spread))
    sent = F.broadcast if size.count() <= BROADCAST_GROUPS else lambda df: df
    size = sent(size)
    fit = _starts(vectors, size)
    for step in range(steps):
        if step == TRIAL_STEPS:
            order = F.struct(F.round(reduce(lambda x, z: x + F.log(F.col(f"l_{z}_{z}")), DIMS, F.lit(0.0)), 9), "start")
            rest = ("start", "share", *centre_names(), *factor_names())
            fit = fit.groupBy("_group").agg(F.min_by(F.struct(*rest), order).alias("x")).select("_group", "x.*")
        fit = _c_step(vectors, sent(cut(fit)), size)
    # the nearest rows spread less than all; this makes the estimate right for normal ones
    return cut(fit.select("_group", *centre_names(), *[(F.col(f) * CONSISTENCY**0.5).alias(f) for f in factor_names()]))


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """_lang, _source, `_group` that judges their rows, `_feeds` the groups that they belong to, `_wide`.

    A language and source with `min_group` rows is a group of its own; else its language is, if it has as
    many, else all rows together. Wide groups hold all rows of the language or of the table.
    """
    key = lambda *cols: F.xxhash64(F.lit(len(cols)), *cols)
    few = F.col("n") < min_group
    counts = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.groupBy("_lang").agg(F.sum("n").alias("n_lang"), F.max(few).alias("lang_needed")).withColumn("lang_needed", F.col("lang_needed") & (F.col("n_lang") >= min_group))
    counts = cut(counts.join(langs, "_lang"))
    alone = few & (F.col("n_lang") < min_group)
    needed = bool(counts.where(alone).limit(1).count())
    feeds = [F.when(~few, key("_lang", "_source")), F.when(F.col("lang_needed"), key("_lang"))] + ([key()] if needed else [])
    group = F.when(~few, key("_lang", "_source")).when(~alone, key("_lang")).otherwise(key())
    return counts.select("_lang", "_source", group.alias("_group"), F.filter(F.array(*feeds), lambda x: x.isNotNull()).alias("_feeds"), few.alias("_wide"))


def judge(stats: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds base_failed, d2, d2_wide and kept to statistics rows.

    d2 is the distance from the estimate of the row's own group; where that is too small for one, d2 is
    null and d2_wide is the distance from the wider estimate that judges the row.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = _vector(stats).withColumns({"base_failed": failed, "_lang": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})
    good = rows.where(~F.col("base_failed"))
    groups = cut(_groups(good, min_group))
    sent = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda df: df
    groups = sent(groups)
    vectors = written(good.join(groups, ["_lang", "_source"]).select(F.explode("_feeds").alias("_group"), *DIMS), "vectors")
    fit = sent(mcd_fit(vectors))
    drop_written(vectors)
    out = _distance(rows.join(groups, ["_lang", "_source"], "left").join(fit, "_group", "left"))
    own, wide = F.when(~F.col("_wide"), F.round("d2", 6)), F.when(F.col("_wide"), F.round("d2", 6))
    return out.select(*stats.columns, "base_failed", own.alias("d2"), wide.alias("d2_wide"), (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"))


def quality_scores(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: statistics, base_failed, distance and verdict."""
    stats = written(text_statistics(docs), "quality")
    return judge(stats, cutoff, min_group)


def quality_filter(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are kept, with all their columns.

    Rows are judged by their text, language and source, whatever their doc_id; the rejected ones are
    looked up by a hash of these.
    """
    content = [F.col(c) for c in ("text", "lang", "source")]
    rows = docs.select("text", "lang", "source", *row_key(*content))
    stats = written(text_statistics(rows, keys=("lang", "source", "_r1", "_r2")), "quality")
    out = without(docs, judge(stats, cutoff).where("NOT kept"), *[docs[c] for c in ("text", "lang", "source")])
    drop_written(stats)
    return out
