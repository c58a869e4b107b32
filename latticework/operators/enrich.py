"""Schema-validated enrichment: responses, an incremental cache, and suggestions made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import ordinals

# Asset types, types that stand on their feet, moves by category (first match), else by type, mock types.
ASSET_TYPES = ("character", "monster", "item", "weapon", "environment", "ui", "unknown")
FOOTED = ("character", "monster")
MOVES = (
    (("humanoid",), ("idle", "walk", "attack")),
    (("monster", "animal", "slime"), ("idle", "run", "bite")),
    (("item", "weapon", "sword"), ("rotate", "float")),
)
MOVES_BY_TYPE = ((("character", "monster"), ("idle", "move")), (("item", "weapon"), ("rotate", "float")), (("environment", "ui"), ()))
OTHER_MOVES = ("idle",)
MOCK_TYPES = ("character", "item", "environment")


def validate(payload: Column) -> Column:
    """struct<problems, asset_type, category, description, confidence> of a JSON text, fences allowed."""
    v = F.try_parse_json(S.strip_fence(payload))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    present = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    asset_type, category, description = text("$.assetType"), text("$.category"), text("$.description")
    numeric = kind("$.confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    confidence = F.when(numeric, F.try_variant_get(v, "$.confidence", "double"))
    bad = [
        F.when(~F.coalesce(asset_type.isin(*ASSET_TYPES), F.lit(False)), F.lit(f"assetType must be one of {' | '.join(ASSET_TYPES)}")),
        F.when(present("$.category") & F.coalesce(F.trim(category) == "", F.lit(True)), F.lit("category must be a non-empty string when present")),
        F.when(present("$.description") & description.isNull(), F.lit("description must be a string when present")),
        F.when(present("$.confidence") & ~F.coalesce(confidence.between(0, 1), F.lit(False)), F.lit("confidence must be a number in [0, 1]")),
    ]
    problems = F.when(v.isNull(), F.array(F.lit("response is not JSON"))).when(~is_object, F.array(F.lit("response must be a JSON object"))).otherwise(F.filter(F.array(*bad), lambda p: p.isNotNull()))
    return F.struct(problems.alias("problems"), asset_type.alias("asset_type"), F.coalesce(category, F.lit("unknown")).alias("category"), F.coalesce(description, F.lit("")).alias("description"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def mock_response(name: Column) -> Column:
    """The JSON that the mock provider gives for a name: its type by the name's 32-bit FNV-1a."""
    kind = F.element_at(F.array(*[F.lit(t) for t in MOCK_TYPES]), (S.fnv1a32(name) % len(MOCK_TYPES) + 1).cast("int"))
    category = F.when(kind == "character", F.lit("humanoid")).otherwise(kind)
    return F.to_json(F.struct(kind.alias("assetType"), category.alias("category"), F.concat(F.lit("mock understanding of "), name).alias("description"), F.lit(0.5).alias("confidence")))


def cache_pass(requests: DataFrame, cache: DataFrame, answer: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache): hits come from the cache (key, value), misses are answered and added.

    requests (key, ...); `answer` is an expression over a request. Each missing key is answered once.
    """
    hits = requests.join(cache, "key").withColumn("hit", F.lit(True))
    fresh = requests.join(cache.select("key"), "key", "left_anti").withColumn("value", answer).withColumn("hit", F.lit(False))
    added = fresh.groupBy("key").agg(F.min("value").alias("value"))
    return hits.unionByName(fresh), cache.select("key", "value").unionByName(added)


def name_suggestions(results: DataFrame) -> DataFrame:
    """source, suggested: <type>[_<category>]_<NN>.png, numbered for each base in input order (`ord`);
    unknown types are skipped, and names that are right already. An empty or unknown category is left out."""
    kind, category = S.snake(F.col("asset_type")), S.snake(F.col("category"))
    named = F.coalesce(~F.col("category").isin("", "unknown"), F.lit(False))
    rows = results.where("asset_type <> 'unknown'").withColumn("base", F.when(named, F.concat_ws("_", kind, category)).otherwise(kind))
    out = ordinals(rows, ["base"], "ord", "number").withColumn("suggested", F.format_string("%s_%02d.png", "base", "number"))
    return out.where(F.col("suggested") != S.basename(F.col("source"))).select("source", "suggested")


def pivot_suggestions(results: DataFrame) -> DataFrame:
    return results.where(F.col("asset_type").isin(*FOOTED)).select("source", F.lit(0.5).alias("x"), F.lit(1.0).alias("y"))


def moves_of(asset_type: Column, category: Column) -> Column:
    """Recommended moves: by category, else by type; may be empty."""
    array = lambda moves: F.array(*[F.lit(m) for m in moves]).cast("array<string>")
    out = array(OTHER_MOVES)
    for key, rules in ((asset_type, MOVES_BY_TYPE), (F.lower(category), MOVES)):
        for match, moves in reversed(rules):
            out = F.when(key.isin(*match), array(moves)).otherwise(out)
    return out


def animation_suggestions(results: DataFrame) -> DataFrame:
    """source, moves for known types that have any."""
    known = results.where("asset_type <> 'unknown'")
    return known.withColumn("moves", moves_of(F.col("asset_type"), F.col("category"))).where(F.size("moves") > 0).select("source", "moves")


def classification(results: DataFrame) -> DataFrame:
    return results.select("source", "asset_type", "category", "confidence", F.concat("asset_type", F.lit("s")).alias("suggested_folder"))


def metadata(results: DataFrame) -> DataFrame:
    """Results with their suggestions; null name and empty moves where there are none."""
    names = name_suggestions(results).withColumnRenamed("suggested", "suggested_name")
    return results.join(names, "source", "left").join(animation_suggestions(results), "source", "left").withColumn("moves", F.coalesce("moves", F.array().cast("array<string>")))
