"""Suggestions, engine files and number formats against hand-written expectations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import scalars
from latticework.kernels import geometry, png
from latticework.operators import enrich, series
from latticework.plans import exports, project
from latticework.plans.config import Config
from latticework.sources import images as source


def results(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, source string, asset_type string, category string")


def test_names(spark):
    rows = [
        ("IMG_001.png", "character", "humanoid"), ("IMG_002.png", "character", "humanoid"), ("tree.png", "environment", "forest"), ("mystery.png", "unknown", "unknown"),
        ("a/b.png", "item", "item"), ("c.png", "item", ""), ("d.png", "item", "unknown"), ("e.png", "item", None), ("f.png", "ui", "Big Button!"), ("character_humanoid_03.png", "character", "humanoid"),
    ]
    got = {r.source: r.suggested for r in enrich.name_suggestions(results(spark, rows)).collect()}
    assert got == {
        "IMG_001.png": "character_humanoid_01.png", "IMG_002.png": "character_humanoid_02.png", "tree.png": "environment_forest_01.png",
        "a/b.png": "item_item_01.png", "c.png": "item_01.png", "d.png": "item_02.png", "e.png": "item_03.png", "f.png": "ui_big_button_01.png",
    }


def test_moves(spark):
    rows = [
        ("knight", "character", "humanoid"), ("coin", "item", "coin"), ("sky", "environment", "sky"), ("hero", "character", "unknown"), ("orc", "monster", "brute"),
        ("gel", "monster", "Slime"), ("bow", "weapon", None), ("button", "ui", "x"), ("what", "unknown", "slime"), ("vase", "environment", "item"),
    ]
    got = {r.source: ",".join(r.moves) for r in enrich.animation_suggestions(results(spark, rows)).collect()}
    assert got == {"knight": "idle,walk,attack", "coin": "rotate,float", "hero": "idle,move", "orc": "idle,move", "gel": "idle,run,bite", "bow": "rotate,float", "vase": "rotate,float"}


def test_ordinals_over_many_partitions(spark):
    rows = [("big", i) for i in range(2000, 0, -1)] + [("small", 7), (None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "k string, p int").repartition(7)
    got = {(r.k, r.p): r.n for r in series.ordinals(df, ["k"], "p", "n").collect()}
    assert got == {("big", i): i for i in range(1, 2001)} | {("small", 7): 1, (None, 1): 1, (None, 3): 2}


@pytest.mark.parametrize("x, text", [(1234.56789, "1234.56789"), (100000.5, "100000.5"), (0.1 + 0.2, "0.3"), (2, "2"), (-0.000001, "0"), (0.00001, "0.00001"), (1e7, "10000000"), (-1.5, "-1.5"), (0.139626340159546, "0.13963"), (1e15 + 0.5, "1000000000000000.5")])
def test_numbers(x, text):
    assert exports.number(x) == text


def test_name_hash_is_over_utf16_units(spark):
    def plain(text):
        h, raw = scalars.FNV_BASIS, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * scalars.FNV_PRIME) % 2**32
        return h

    names = ["", "a.png", "Été.png", "漢字", "😀.png"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.fnv1a32(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in got} == {n: plain(n) for n in names}


LAYERS = [{"name": "b", "file": "layers/b.png", "z": 1, "cell": {"x": 0, "y": 0, "width": 10, "height": 11}}, {"name": "a", "file": "layers/a.png", "z": 0, "cell": {"x": 20, "y": 20, "width": 4, "height": 4}}]
BONES = [{"name": "root", "parent": None, "x": 4, "y": 4}, {"name": "tip", "parent": "root", "x": 20.5, "y": 22}]


def test_cutout_scene():
    text = exports.cutout_scene(LAYERS, BONES)
    assert text.startswith('[gd_scene load_steps=7 format=3]\n\n[ext_resource type="Texture2D" path="res://layers/b.png" id="Tex_1"]\n[ext_resource type="Texture2D" path="res://layers/a.png" id="Tex_2"]\n[ext_resource type="Script" path="res://cutout_preview.gd" id="Script_1"]\n')
    assert 'tracks/1/path = NodePath("Skeleton2D/Bone_2")' in text and 'tracks/0/path = NodePath("Skeleton2D")' in text
    assert '"times": PackedFloat32Array(0, 0.5, 1, 1.5, 2),' in text and '"values": [0, 0.13963, 0, -0.13963, 0]' in text
    assert '"times": PackedFloat32Array(0, 1, 2, 3, 4),' in text and '"values": [0, 0.03491, 0, -0.03491, 0]' in text
    assert '_data = {\n"breathing": SubResource("Animation_breathing"),\n"idle": SubResource("Animation_idle")\n}' in text
    assert '[node name="Bone_2" type="Bone2D" parent="Skeleton2D/Bone_1"]\nposition = Vector2(20.5, 22)\nrest = Transform2D(1, 0, 0, 1, 20.5, 22)' in text
    # by rising z; on the nearest bone, offsets rounded half up
    assert text.index('name="Layer_a"') < text.index('name="Layer_b"')
    assert '[node name="Layer_a" type="Sprite2D" parent="Skeleton2D/Bone_2"]\ntexture = ExtResource("Tex_2")\noffset = Vector2(2, 0)' in text
    assert 'parent="Skeleton2D/Bone_1"]\ntexture = ExtResource("Tex_1")\noffset = Vector2(1, 2)' in text
    assert text.endswith('"": SubResource("AnimationLibrary_1")\n}\nautoplay = "idle"\n\n')
    still = exports.cutout_scene(LAYERS, BONES, animated=False)
    assert still.startswith("[gd_scene load_steps=4 format=3]") and "Animation" not in still
    files = exports.cutout_files("hero", LAYERS, BONES)
    assert sorted(files) == ["cutout.tscn", "cutout_preview.gd", "project.godot"] and 'config/name="hero"' in files["project.godot"]


def test_importer_script():
    text = exports.importer_script("9.9")
    assert "latticework 9.9" in text and "1f - s.pivot.y" in text and "height - s.rect.y - s.rect.height" in text and text.count("{") == text.count("}")


def test_output_names():
    output = Config.default().output
    assert exports.output_names("x", 2, output) == ["atlas-0.png", "atlas-1.png", "atlas.json"]
    engines = {"format": ["json"], "godot": {"enabled": True}, "unity": {"enabled": True}}
    assert exports.output_names("x", 2, engines) == ["atlas.json", "x_spriteframes.tres", "AtlasImporter.cs"]


def test_listing_is_capped():
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    row = {"source": "s.png", "sprites": [{"id": f"s#{i}", "source_rect": box, "trimmed_rect": box} for i in range(53)], "skipped": [], "pages": [{"page": 0, "width": 8, "height": 9}]}
    lines = exports.listing(row, {"mode": "grid", "cellWidth": 3, "cellHeight": 4}).split("\n")
    assert lines[1] == "detect:     grid (cells 3x4)" and lines[2] == "sprites:    53 detected, 0 skipped" and lines[3] == "  s#0 rect=(1,2 3x4) content=3x4"
    assert len(lines) == 3 + 50 + 2 and lines[-2:] == ["  ... 3 more", "estimated:  1 page(s) [atlas-0.png 8x9]"]
    empty = exports.listing(row | {"sprites": [], "pages": []}, {"mode": "alpha-connected-components", "alphaThreshold": 8, "minPixels": 4, "connectivity": 8})
    assert empty.endswith("estimated:  0 pages (nothing to pack)") and "(threshold 8, minPixels 4, connectivity 8)" in empty
    assert "manual (1 rect(s))" in exports.listing(row, {"mode": "manual", "rects": [box]})


def test_in_memory_sources(spark):
    good = png.encode(np.full((2, 3, 4), 200, np.uint8))
    rows = source.decode(source.in_memory(spark, [("a.PNG", good), ("b.png", b"junk"), ("c.gif", good)])).collect()
    assert {r.source: (r.status, r.width) for r in rows} == {"a.PNG": ("ok", 3), "b.png": ("failed", None), "c.gif": ("failed", None)}
    assert {r.message for r in rows if r.source == "c.gif"} == {"only PNG files are read"}


def test_boundary_repair_points_lie_inside():
    mask = np.zeros((12, 12), bool)
    mask[2:10, 2:10] = True
    for outline in geometry.loops(mask):
        for a, b in zip(outline, [*outline[1:], outline[0]]):
            x, y = geometry.inset_middle(a, b)
            assert mask[int(np.floor(y)), int(np.floor(x))]
            assert abs(np.hypot(x - (a[0] + b[0]) / 2, y - (a[1] + b[1]) / 2) - 0.5) < 1e-12
    assert geometry.inset_middle((0, 0), (4, 0)) == (2, 0.5) and geometry.mesh_stats(geometry.grid_mesh(mask, 2)) == {"vertices": 25, "triangles": 32}


def test_project_migration():
    doc = {"projectVersion": 1, "asset": {"source": "a.png", "width": 4, "height": 4}}
    assert project.load(json.dumps(doc)) == doc
    with pytest.raises(ValueError, match="cannot migrate a project from version 0"):
        project.load(json.dumps(doc | {"projectVersion": 0}))
    with pytest.raises(ValueError, match="projectVersion"):
        project.load(json.dumps(doc | {"projectVersion": 2}))
