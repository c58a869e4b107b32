import json

import numpy as np

from latticework.__main__ import main
from latticework.kernels import png


def test_commands(spark, tmp_path, capsys):
    preset = tmp_path / "p.json"
    assert main(["init", str(preset)]) == 0 and main(["init", str(preset)]) == 2 and main(["validate", str(preset)]) == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"schemaVersion": 2, "trim": {"enabled": 1}}')
    assert main(["validate", str(bad)]) == 2 and main(["inspect", str(tmp_path / "none")]) == 2
    root = tmp_path / "in"
    root.mkdir()
    image = np.zeros((16, 16, 4), np.uint8)
    image[2:9, 2:9] = 255
    (root / "a_1.png").write_bytes(png.encode(image))
    (root / "a_2.png").write_bytes(png.encode(image))
    assert main(["inspect", str(root)]) == 0
    assert main(["process", str(root), "--out", str(tmp_path / "out")]) == 0
    first = (tmp_path / "out/a_1/atlas.json").read_bytes()
    assert main(["process", str(root), "--out", str(tmp_path / "out")]) == 0 and (tmp_path / "out/a_1/atlas.json").read_bytes() == first
    assert json.loads((tmp_path / "out/summary.json").read_text())["succeeded"] == 2
    assert main(["analyze", str(root), "--out", str(tmp_path / "q")]) == 0
    assert json.loads((tmp_path / "q/quality-report.json").read_text())["summary"]["high"] == 1
    assert main(["suggest", str(root), "--out", str(tmp_path / "s")]) == 0
    assert json.loads((tmp_path / "s/ai_report.json").read_text())["summary"] == {"assets": 2, "errors": 0, "cacheHits": 0, "cacheMisses": 2}
    assert main(["suggest", str(root), "--out", str(tmp_path / "s")]) == 0
    assert json.loads((tmp_path / "s/ai_report.json").read_text())["summary"]["cacheHits"] == 2
    assert main(["transform", str(root), "--out", str(tmp_path / "t")]) == 0
    assert json.loads((tmp_path / "t/a_1/project.json").read_text())["layers"][0]["id"] == "layer_01" and (tmp_path / "t/a_1/layers/layer_01.png").exists()
    assert "[gd_scene load_steps=6 format=3]" in (tmp_path / "t/a_1/godot-export/cutout.tscn").read_text() and (tmp_path / "t/a_1/godot-export/layers/layer_01.png").exists()
    assert main(["transform", str(root), "--out", str(tmp_path / "t2"), "--template", "animal", "--dilation", "0", "--include", "a_1.png"]) == 0
    doc = json.loads((tmp_path / "t2/a_1/project.json").read_text())
    assert doc["layers"][0]["dilation"] == 0 and doc["bones"][1]["id"] == "spine" and not (tmp_path / "t2/a_2").exists()
    assert main(["transform", str(root), "--out", str(tmp_path / "t3"), "--dilation", "257"]) == 2 and main(["transform", str(root), "--out", "x", "--template", "fish"]) == 2
    # overrides and formats
    engines = tmp_path / "engines.json"
    engines.write_text('{"schemaVersion": 2, "input": {"exclude": ["a_2.png"]}, "output": {"format": ["json"], "godot": {"enabled": true}, "unity": {"enabled": true}}}')
    assert main(["process", str(root), "--out", str(tmp_path / "e"), "--preset", str(engines)]) == 0
    assert sorted(f.name for f in (tmp_path / "e/a_1").iterdir()) == ["AtlasImporter.cs", "a_1_spriteframes.tres", "atlas.json"] and not (tmp_path / "e/a_2").exists()
    totals = json.loads((tmp_path / "e/summary.json").read_text())
    assert totals["total"] == 1 and totals["durationMs"] >= 0 and [o.rsplit("/", 1)[-1] for o in totals["outputs"]] == ["atlas.json", "a_1_spriteframes.tres", "AtlasImporter.cs", "summary.json"]
    (root / "sub").mkdir()
    (root / "sub/deep.png").write_bytes(png.encode(image))
    capsys.readouterr()
    assert main(["inspect", str(root), "--no-recursive", "--exclude", "a_2.png"]) == 0
    said = capsys.readouterr().out
    assert "source:     a_1.png" in said and "a_2" not in said and "deep" not in said and "estimated:  1 page(s) [atlas-0.png" in said
    (root / "sub/deep.png").unlink()
    settings = tmp_path / "ai.json"
    settings.write_text('{"provider": "nobody"}')
    assert main(["suggest", str(root), "--out", str(tmp_path / "s2"), "--config", str(settings)]) == 2
    assert main(["suggest", str(root), "--out", str(tmp_path / "s3"), "--no-cache"]) == 0 and not (tmp_path / "s3/answers").exists()
    (root / "broken.png").write_bytes(b"x")
    assert main(["inspect", str(root)]) == 1
