import json

import numpy as np
import pytest

from latticework.kernels import raster
from latticework.operators import enrich, rules
from latticework.plans import exports
from latticework.plans.config import Config, ConfigError, problems_of

ASSET = "name string, byte_size long, width int, height int, transparent_ratio double, hash string, bits long, r double, g double, b double, ord string, pivot_x double, pivot_y double"


def solid(w, h, color, box=None):
    out = np.zeros((h, w, 4), np.uint8)
    x, y, bw, bh = box or (0, 0, w, h)
    out[y : y + bh, x : x + bw] = (*color, 255)
    return out


def asset(name, rgba, size=None, pivot=(None, None)):
    f = raster.features(rgba)
    return (name, size, f["width"], f["height"], f["transparent_ratio"], f["hash"], f["bits"], f["r"], f["g"], f["b"], name, *pivot)


RED, GREEN, BLUE, GREY = (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)


def test_quality_golden(spark):
    rows = [
        asset("IMG_003.png", solid(8, 8, RED), 300),
        asset("faint.png", solid(10, 10, GREEN, (0, 0, 4, 4))),
        asset("hero.png", solid(16, 16, GREEN), None, (0.5, 0.5)),
        asset("hero_idle_01.png", solid(8, 8, BLUE)),
        asset("hero_idle_01_copy.png", solid(8, 8, BLUE), 512),
        asset("walk_01.png", solid(32, 32, GREY)),
        asset("walk_02.png", solid(32, 32, GREY)),
        asset("walk_03.png", solid(64, 64, GREY)),
    ]
    assets = spark.createDataFrame(rows, ASSET)
    issues = rules.analyze(assets, characters=["^hero"])
    nested = [r.asDict(True) for r in rules.report(assets, issues).collect()]
    found = {r["asset"]: [(w["rule"], w["severity"]) for w in r["warnings"]] for r in nested}
    assert found == {
        "IMG_003.png": [("naming_convention", "low")],
        "faint.png": [("transparent_area", "medium")],
        "hero.png": [("pivot_check", "medium")],
        "hero_idle_01.png": [("pivot_check", "info")],
        "hero_idle_01_copy.png": [("duplicate_frames", "high"), ("pivot_check", "info")],
        "walk_01.png": [],
        "walk_02.png": [("duplicate_frames", "high")],
        "walk_03.png": [("size_mismatch", "high"), ("duplicate_frames", "medium")],
    }
    text = {(r["asset"], w["rule"]): w["message"] for r in nested for w in r["warnings"]}
    assert text["faint.png", "transparent_area"] == "Unused canvas: 84% of the pixels are fully transparent"
    assert "saving: ~1 KB" in text["hero_idle_01_copy.png", "duplicate_frames"] and "expected 32x32" in text["walk_03.png", "size_mismatch"]
    nested = sorted(nested, key=lambda r: r["asset"])
    text = "".join(exports.quality_json(nested, [{"source": "x", "message": "<é>"}]))
    doc = json.loads(text)
    assert text == exports.pretty(doc) and doc["errors"] == [{"source": "x", "message": "<é>"}]
    empty = "".join(exports.quality_json([]))
    assert empty == exports.pretty(json.loads(empty)) and json.loads(empty)["issues"] == []
    assert doc["version"] == 2 and doc["summary"]["assets"] == 8 and doc["summary"]["warnings"] == 9
    page = "".join(exports.quality_html(nested, [{"source": "x", "message": "<b>"}, {"source": "y", "message": ""}]))
    assert 'class="good">Good' in page and page.endswith("<h2>Errors</h2><ul><li>x: &lt;b&gt;</li><li>y: </li></ul></body></html>\n")


def test_bands_miss_nothing(spark):
    rng = np.random.default_rng(1)
    words = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    words += [w ^ (1 << int(rng.integers(0, 62))) for w in words[:20]] + [w ^ 0b11 ^ (1 << 40) for w in words[20:]]
    df = spark.createDataFrame(list(enumerate(words)), "k long, w long")
    for t in (0, 2, 5):
        got = {frozenset((r.wa, r.wb)) for r in rules.near_pairs(df, "k", "w", t).collect() if r.wa != r.wb}
        want = {frozenset((a, b)) for a in words for b in words if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= t}
        assert got == want


def test_hash_includes_size():
    assert raster.raster_hash(solid(2, 8, RED)) != raster.raster_hash(solid(4, 4, RED))


def test_validation(spark):
    cases = {
        '{"assetType":"item","category":"sword","description":"d","confidence":0.5}': 0,
        '```json\n{"assetType":"ui"}\n```': 0,
        "not json": 1,
        "[1]": 1,
        '{"assetType":"dragon"}': 1,
        '{"assetType":"item","confidence":1.5}': 1,
        '{"assetType":"item","category":" ","confidence":"x","description":3}': 3,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: len(r.u.problems) for r in df.select("p", enrich.validate(df["p"]).alias("u")).collect()}
    assert got == cases


def test_cache(spark):
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, n int")
    cache = spark.createDataFrame([("a", "old")], "key string, value string")
    from pyspark.sql import functions as F

    answers, new = enrich.cache_pass(requests, cache, F.concat(F.lit("new "), "key"))
    assert {(r.key, r.value, r.hit) for r in answers.collect()} == {("a", "old", True), ("b", "new b", False)}
    assert {(r.key, r.value) for r in new.collect()} == {("a", "old"), ("b", "new b")}


def test_config():
    cfg = Config.default()
    assert cfg.trim == {"enabled": True, "alphaThreshold": 8} and Config.parse(cfg.to_json()).detect == cfg.detect
    assert Config.parse({"schemaVersion": 1, "detect": {"mode": "grid", "rows": 2, "alphaThreshold": 3}}).trim["alphaThreshold"] == 3
    bad = {"schemaVersion": 2, "extra": 1, "detect": {"mode": "grid", "rows": 2, "cellWidth": 4}, "padding": {"pixels": 65, "x": 1}, "pivot": {}, "resize": {"scale": 0}, "output": {"format": ["png", "png"]}}
    assert [p.path for p in problems_of(bad)] == ["$.extra", "detect", "resize.scale", "padding.x", "padding.pixels", "pivot.mode", "output.format"]
    with pytest.raises(ConfigError) as e:
        Config.parse({"schemaVersion": 9})
    assert e.value.problems[0].code == "PRESET_SCHEMA_VERSION_UNSUPPORTED"
    with pytest.raises(ConfigError):
        Config.parse("{")
