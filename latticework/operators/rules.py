"""The quality analyser: rules over rows of features, and the report made of them."""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import cut

# Default patterns of names that describe nothing, and default limits.
NON_DESCRIPTIVE = (r"^img[ _-]?\d+$", r"^(final|new|copy|test|untitled)\d*$", r"^aaa\d*$", r"^bad[_ -]?name")
MAX_TRANSPARENT_RATIO = 0.6
HAMMING_THRESHOLD = 5
MAX_COLOR_DISTANCE = 24
#: Severities and the order of rules in a report.
SEVERITIES = ("high", "medium", "low", "info")
RULES = ("naming_convention", "transparent_area", "size_mismatch", "duplicate_frames", "pivot_check")


def usable(patterns) -> list[str]:
    """Patterns that compile; a bad one would fail the whole job."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            pass
    return good


def first_match(text: Column, patterns) -> Column:
    """The first pattern, in list order, that matches anywhere, ignoring case; null if none."""
    out = F.lit(None).cast("string")
    for p in reversed(usable(patterns)):
        out = F.when(text.rlike(f"(?i){p}"), F.lit(p)).otherwise(out)
    return out


def majority_sizes(df: DataFrame, group: str, w: str, h: str) -> DataFrame:
    """group, majority_w, majority_h, members: the most frequent size, then the least width and height."""
    sizes = df.groupBy(group, w, h).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(group).agg(F.min_by(F.struct(w, h), F.struct(-F.col("n"), F.col(w), F.col(h))).alias("m"), F.sum("n").alias("members"))
    return best.select(group, F.col(f"m.{w}").alias("majority_w"), F.col(f"m.{h}").alias("majority_h"), "members")


def band_widths(bits: int, bands: int) -> list[tuple[int, int]]:
    """Bands (first bit, width) of a word."""
    edges = [bits * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


#: Bit patterns that are tried for each band, at most.
PROBES = 400


def band_plan(words: int, threshold: int, bits: int = 64) -> tuple[int, int]:
    """(bands, radius) that cost least for so many words: two words within the threshold are within the
    radius in one band, so one side looks up every pattern that near, and the other its own.

    Many narrow bands need few lookups but have few, large buckets; few wide ones the reverse.
    """
    best = None
    for bands in range(1, min(threshold + 1, bits) + 1):
        radius, width = threshold // bands, bits // bands
        probes = sum(math.comb(-(-bits // bands), i) for i in range(radius + 1))
        if probes <= PROBES or bands == threshold + 1:
            cost = words * bands * probes * (1 + words / 2**width)
            best = min(best or (cost, bands, radius), (cost, bands, radius))
    return best[1:]


def band_keys(word: Column, bands: int, radius: int = 0, bits: int = 64) -> Column:
    """Array of longs, one for each band and pattern of up to `radius` other bits, that differ between bands."""
    parts = []
    for n, (first, width) in enumerate(band_widths(bits, bands)):
        part = word if width >= 64 else F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1))
        flips = [sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(width), k)]
        flips = F.array(*[F.lit(f if f < 1 << 63 else f - (1 << 64)).cast("long") for f in flips])
        parts.append(F.transform(flips, lambda f: F.xxhash64(F.lit(n), part.bitwiseXOR(f))))  # noqa: B023  called at once
    return F.flatten(F.array(*parts))


def near_pairs(df: DataFrame, key: str, word: str, threshold: int) -> DataFrame:
    """(i, j, distance), i < j, for all pairs of 64-bit words within a Hamming threshold.

    Equal words are one node first, so a group of copies is no bucket of pairs; then an equi-join on
    bands and a check of the distance. Copies are linked to the least key of their word.
    """
    words = cut(df.groupBy(F.col(word).alias("w")).agg(F.min(key).alias("k")))
    bands, radius = band_plan(words.count(), threshold)
    a = words.select(F.explode(band_keys(F.col("w"), bands, radius)).alias("band"), F.col("w").alias("wa"), F.col("k").alias("ka"))
    b = words.select(F.explode(band_keys(F.col("w"), bands)).alias("band"), F.col("w").alias("wb"), F.col("k").alias("kb"))
    close = a.join(b, "band").where(S.hamming(F.col("wa"), F.col("wb")) <= threshold)
    return close.select("wa", "wb", "ka", "kb", S.hamming(F.col("wa"), F.col("wb")).alias("distance")).distinct()


def first_duplicates(assets: DataFrame, threshold: int = HAMMING_THRESHOLD, color: float = MAX_COLOR_DISTANCE) -> DataFrame:
    """For each asset the first earlier one (by `ord`) that is exact or near: ord, first, exact, distance.

    assets: ord, hash (exact), bits (64-bit difference hash), r, g, b (mean colours). Assets with equal
    features are one node: the first of a node is the match of all others of it. Between nodes, each
    candidate is matched with the least `ord` among near nodes that is earlier, exact or near alike.
    """
    feature = ["hash", "bits", "r", "g", "b"]
    nodes = cut(assets.groupBy(*feature).agg(F.min("ord").alias("least")))
    bands, radius = band_plan(nodes.count(), threshold)
    banded = nodes.withColumn("band", F.explode(band_keys(F.col("bits"), bands)))
    left = nodes.select(F.explode(band_keys(F.col("bits"), bands, radius)).alias("band"), *[F.col(c).alias(f"x_{c}") for c in [*feature, "least"]])
    apart = F.greatest(*[F.abs(F.col(f"x_{c}") - F.col(c)) for c in ("r", "g", "b")])
    exact = F.col("x_hash") == F.col("hash")
    distance = S.hamming(F.col("x_bits"), F.col("bits"))
    close = banded.join(left, "band").where(exact | ((distance <= threshold) & (apart <= color)))
    # the least earlier node of each node; its own first member serves its later members
    found = close.groupBy(*feature).agg(F.min_by(F.struct(F.col("x_least").alias("first"), exact.alias("exact"), distance.alias("distance")), "x_least").alias("m"))
    rows = assets.join(found, feature).where(F.col("m.first") < F.col("ord"))
    return rows.select("ord", F.col("m.first").alias("first"), F.col("m.exact").alias("exact"), F.when(F.col("m.exact"), 0).otherwise(F.col("m.distance")).alias("distance"))


# ---- issues: asset, rule, severity, message, suggestion


def _issue(rule: str, severity, message: Column, suggestion: Column) -> list[Column]:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return [F.lit(RULES.index(rule)).alias("rule_ord"), F.lit(rule).alias("rule"), severity.alias("severity"), message.alias("message"), suggestion.alias("suggestion")]


def naming_issues(assets: DataFrame, patterns=NON_DESCRIPTIVE) -> DataFrame:
    stem = F.lower(S.extension_less(F.col("name")))
    hit = assets.withColumn("_p", first_match(stem, patterns)).where("_p IS NOT NULL")
    return hit.select(F.col("name").alias("asset"), *_issue("naming_convention", "low", F.concat(F.lit("Non-descriptive filename: "), "name"), F.concat(F.lit("Rename to describe the content, e.g. '<asset>_<state>_<index>.png' (matched pattern: "), "_p", F.lit(")"))))


def transparency_issues(assets: DataFrame, limit: float = MAX_TRANSPARENT_RATIO) -> DataFrame:
    percent = S.round_half_up(F.col("transparent_ratio") * 100)
    hit = assets.where(F.col("transparent_ratio") > limit)
    return hit.select(F.col("name").alias("asset"), *_issue("transparent_area", "medium", F.concat(F.lit("Unused canvas: "), percent.cast("string"), F.lit("% of the pixels are fully transparent")), F.lit("Consider trimming or reducing canvas size")))


def size_issues(assets: DataFrame) -> DataFrame:
    rows = assets.withColumn("grp", S.parse_name(F.col("name"))["grp"])
    most = majority_sizes(rows, "grp", "width", "height").where("members >= 2")
    off = rows.join(most, "grp").where("width <> majority_w OR height <> majority_h")
    size = lambda w, h: F.concat(F.col(w).cast("string"), F.lit("x"), F.col(h).cast("string"))
    want = size("majority_w", "majority_h")
    return off.select(F.col("name").alias("asset"), *_issue("size_mismatch", "high", F.concat(F.lit("Frame size mismatch in group '"), "grp", F.lit("': "), "name", F.lit(" is "), size("width", "height"), F.lit(" (expected "), want, F.lit(")")), F.concat(F.lit("Resize or re-export to "), want, F.lit(" so the group animates consistently"))))


def duplicate_issues(assets: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """`ord` is the place of the asset in name order."""
    found = first_duplicates(assets, threshold)
    names = assets.select("ord", "name", "byte_size")
    rows = found.join(names, "ord").join(names.select(F.col("ord").alias("first"), F.col("name").alias("other")), "first")
    how = F.when(F.col("exact"), F.lit("byte-identical")).otherwise(F.concat(F.lit("dHash distance "), F.col("distance").cast("string")))
    saving = F.coalesce(F.concat(F.lit(", potential saving: ~"), S.kilobytes(F.col("byte_size")).cast("string"), F.lit(" KB")), F.lit(""))
    message = F.concat(F.lit("Duplicate of "), "other", F.lit(" (similarity: "), F.when(F.col("exact"), F.lit(100)).otherwise(S.similarity_percent(F.col("distance"))).cast("string"), F.lit("%, "), how, F.lit(")"), saving)
    return rows.select(F.col("name").alias("asset"), *_issue("duplicate_frames", F.when(F.col("exact"), F.lit("high")).otherwise(F.lit("medium")), message, F.concat(F.lit("Remove '"), "name", F.lit("' or replace it with a distinct frame"))))


def _number(x: Column) -> Column:
    """A number without a trailing `.0`, as in messages."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def pivot_issues(assets: DataFrame, characters=()) -> DataFrame:
    """pivot_x and pivot_y are null where a pivot is unknown."""
    stem = F.lower(S.extension_less(F.col("name")))
    character = first_match(stem, characters).isNotNull()
    off = F.coalesce(S.pivot_deviates(F.col("pivot_x"), F.col("pivot_y")), F.lit(False))
    missing = F.col("pivot_x").isNull()
    rows = assets.withColumns({"_c": character, "_off": off, "_missing": missing}).where("_off OR (_c AND _missing)")
    severity = F.when(F.col("_c") & F.col("_off"), F.lit("medium")).otherwise(F.lit("info"))
    message = (
        F.when(~F.col("_c"), F.concat(F.lit("Pivot ("), _number(F.col("pivot_x")), F.lit(", "), _number(F.col("pivot_y")), F.lit(") deviates from bottom-center (0.5, 1.0)")))
        .when(F.col("_missing"), F.concat(F.lit("Character sprite '"), "name", F.lit("' has no pivot metadata")))
        .otherwise(F.lit("Character sprite pivot is not near feet"))
    )
    tail = F.when(~F.col("_c"), F.lit(" if this sprite anchors at its feet")).when(F.col("_missing"), F.lit(" so the sprite anchors at its feet")).otherwise(F.lit(""))
    return rows.select(F.col("name").alias("asset"), *_issue("pivot_check", severity, message, F.concat(F.lit("Set the normalized pivot to (0.5, 1.0)"), tail)))


def analyze(assets: DataFrame, characters=(), patterns=NON_DESCRIPTIVE, max_ratio: float = MAX_TRANSPARENT_RATIO, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """Flat issues (asset, rule_ord, rule, severity, message, suggestion) of all rules."""
    ranked = assets
    if "ord" not in assets.columns:
        # names are ranked by a range-partitioned sort; the rank is the name itself, which orders alike
        ranked = assets.withColumn("ord", F.col("name"))
    parts = [naming_issues(ranked, patterns), transparency_issues(ranked, max_ratio), size_issues(ranked), duplicate_issues(ranked, threshold), pivot_issues(ranked, characters)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(assets: DataFrame, issues: DataFrame) -> DataFrame:
    """asset, warnings (nested, in rule order); clean assets have an empty array."""
    one = F.struct("rule_ord", "rule", "severity", "message", "suggestion")
    nested = issues.groupBy("asset").agg(F.array_sort(F.collect_list(one)).alias("warnings"))
    named = assets.select(F.col("name").alias("asset"))
    return named.join(nested, "asset", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast(nested.schema["warnings"].dataType)))


def severity_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def batch_summary(results: DataFrame) -> DataFrame:
    """total, succeeded, failed of rows with a status."""
    ok = F.col("status") == "ok"
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def occurrence(group: str, order: str) -> Column:
    return F.row_number().over(W.partitionBy(group).orderBy(order))
