"""Report and resource texts, and writers of small result files on the driver's side."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterable, Iterator
from decimal import Decimal
from pathlib import Path
from textwrap import indent

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pretty(doc) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"


def number(x: float) -> str:
    """A number rounded half up to five decimals, without trailing zeros or an exponent."""
    text = format(Decimal(repr(math.floor(x * 1e5 + 0.5) / 1e5)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def sprite_frames(manifest: dict, speed: float = 5.0) -> str:
    """A SpriteFrames resource: pages as textures, sprites as regions, one looping animation."""
    pages, sprites = manifest["pages"], manifest["sprites"]
    out = [f'[gd_resource type="SpriteFrames" load_steps={len(pages) + len(sprites) + 1} format=3]', ""]
    out += [f'[ext_resource type="Texture2D" path="{p["file"]}" id="{n}"]' for n, p in enumerate(pages, 1)]
    out.append("")
    for n, s in enumerate(sprites, 1):
        r = s["rect"]
        out += [f'[sub_resource type="AtlasTexture" id="AtlasTexture_{n}"]', f'atlas = ExtResource("{s["page"] + 1}")', f"region = Rect2({r['x']}, {r['y']}, {r['width']}, {r['height']})", ""]
    frames = ",\n".join(f'{{\n"duration": 1.0,\n"texture": SubResource("AtlasTexture_{n}")\n}}' for n in range(1, len(sprites) + 1))
    out += ["[resource]", "animations = [{", '"frames": [', *([frames] if frames else []), "],", '"loop": true,', '"name": &"default",', f'"speed": {speed}', "}]"]
    return "\n".join(out) + "\n"


def importer_rects(manifest: dict) -> list[dict]:
    """Sprites with a bottom-left origin: y and pivot are flipped."""
    heights = [p["height"] for p in manifest["pages"]]
    out = []
    for s in manifest["sprites"]:
        r = s["rect"]
        out.append({"name": s["id"], "page": s["page"], "x": r["x"], "y": heights[s["page"]] - r["y"] - r["height"], "width": r["width"], "height": r["height"], "pivotX": s["pivot"]["x"], "pivotY": 1 - s["pivot"]["y"]})
    return out


# Fixed values of the importer script: the file that it reads and the names of its fields.
_IMPORTER = """// Made by latticework %s. Put it into an Editor folder beside atlas-N.png and atlas.json.
using System.Collections.Generic;
using System.IO;
using System.Text.RegularExpressions;
using UnityEditor;
using UnityEngine;

public class AtlasImporter : AssetPostprocessor
{
    [System.Serializable] private class Box { public float x, y, width, height; }
    [System.Serializable] private class Point { public float x, y; }
    [System.Serializable] private class Sprite { public string id; public int page; public Box rect; public Point pivot; }
    [System.Serializable] private class Page { public string file; public int width, height; }
    [System.Serializable] private class Atlas { public List<Sprite> sprites; public List<Page> pages; }

    private void OnPreprocessTexture()
    {
        Match name = Regex.Match(assetPath, "(^|/)atlas-([0-9]+)[.]png$", RegexOptions.IgnoreCase);
        string beside = Path.Combine(Path.GetDirectoryName(assetPath) ?? "", "atlas.json");
        if (!name.Success || !File.Exists(beside)) return;
        Atlas atlas = JsonUtility.FromJson<Atlas>(File.ReadAllText(beside));
        int number = int.Parse(name.Groups[2].Value);
        if (atlas?.sprites == null || atlas.pages == null || number >= atlas.pages.Count) return;
        List<SpriteMetaData> slices = new List<SpriteMetaData>();
        foreach (Sprite s in atlas.sprites.FindAll(x => x.page == number))
        {
            // rects and pivots have a top-left origin in the atlas and a bottom-left one here
            float bottom = atlas.pages[number].height - s.rect.y - s.rect.height;
            slices.Add(new SpriteMetaData
            {
                name = s.id.Replace('#', '/'),
                rect = new Rect(s.rect.x, bottom, s.rect.width, s.rect.height),
                alignment = (int)SpriteAlignment.Custom,
                pivot = new Vector2(s.pivot.x, 1f - s.pivot.y),
            });
        }
        TextureImporter importer = (TextureImporter)assetImporter;
        importer.textureType = TextureImporterType.Sprite;
        importer.spriteImportMode = SpriteImportMode.Multiple;
        importer.mipmapEnabled = false;
        importer.filterMode = FilterMode.Point;
        importer.spritePixelsPerUnit = 100f;
        importer.spritesheet = slices.ToArray();
    }
}
"""


def importer_script(version: str) -> str:
    """An editor script that slices the pages by `atlas.json` when they are imported."""
    return _IMPORTER % version


# Fixed values of the cut-out scene: clips as (name, seconds, degrees), node names, and the fallback script.
CLIPS = (("idle", 2, 8), ("breathing", 4, 2))
_SWAY = """extends Node2D
# Sways all bones by 8 degrees; for scenes without an AnimationPlayer.

var seconds := 0.0

func _process(delta: float) -> void:
\tseconds += delta
\tvar bones := $Skeleton2D.get_children().filter(func(n): return n is Bone2D)
\tfor i in bones.size():
\t\tbones[i].rotation = sin(seconds * 2.0 + i) * deg_to_rad(8.0)
"""


def _floats(values: Iterable[float]) -> str:
    return ", ".join(number(v) for v in values)


def _clip(name: str, seconds: int, degrees: float, paths: list[str]) -> list[str]:
    """An Animation resource in which every bone swings once to each side."""
    turn = math.radians(degrees)
    track = {
        "type": '"value"', "imported": "false", "enabled": "true", "path": "", "interp": "1", "loop_wrap": "true",
        "keys": "\n".join(("{", f'"times": PackedFloat32Array({_floats(seconds * k / 4 for k in range(5))}),', '"transitions": PackedFloat32Array(1, 1, 1, 1, 1),', '"update": 0,', f'"values": [{_floats((0, turn, 0, -turn, 0))}]', "}")),
    }
    out = [f'[sub_resource type="Animation" id="Animation_{name}"]', f'resource_name = "{name}"', f"length = {seconds}", "loop_mode = 1"]
    return out + [f"tracks/{n}/{k} = {v}" for n, path in enumerate(paths) for k, v in (track | {"path": f'NodePath("{path}")'}).items()] + [""]


def cutout_scene(layers: list[dict], bones: list[dict], animated: bool = True) -> str:
    """A scene text of bones (name, parent, x, y) and layers (name, file, z, cell: x, y, width, height).

    Layers, by rising z, hang on the bone nearest to their cell's centre (the first of equals).
    """
    label = {b["name"]: f"Bone_{n}" for n, b in enumerate(bones, 1)}
    hangs = lambda b: f"Skeleton2D/{label[b['parent']]}" if b["parent"] is not None else "Skeleton2D"
    texture = {v["name"]: n for n, v in enumerate(layers, 1)}
    clips = CLIPS if animated else ()
    out = [f"[gd_scene load_steps={len(layers) + 2 + len(clips) + bool(clips)} format=3]", ""]
    out += [f'[ext_resource type="Texture2D" path="res://{v["file"]}" id="Tex_{texture[v["name"]]}"]' for v in layers]
    out += ['[ext_resource type="Script" path="res://cutout_preview.gd" id="Script_1"]', ""]
    paths = [f"Skeleton2D/{label[b['name']]}" if b["parent"] is not None else "Skeleton2D" for b in bones]
    for clip in clips:
        out += _clip(*clip, paths)
    if clips:
        names = sorted(c[0] for c in clips)
        out += ['[sub_resource type="AnimationLibrary" id="AnimationLibrary_1"]', "_data = {", ",\n".join(f'"{n}": SubResource("Animation_{n}")' for n in names), "}", ""]
    out += ['[node name="CutoutRoot" type="Node2D"]', 'script = ExtResource("Script_1")', "", '[node name="Skeleton2D" type="Skeleton2D" parent="."]', ""]
    for b in bones:
        x, y = number(b["x"]), number(b["y"])
        out += [f'[node name="{label[b["name"]]}" type="Bone2D" parent="{hangs(b)}"]', f"position = Vector2({x}, {y})", f"rest = Transform2D(1, 0, 0, 1, {x}, {y})", ""]
    for v in sorted(layers, key=lambda v: v["z"]):
        x, y = v["cell"]["x"] + v["cell"]["width"] / 2, v["cell"]["y"] + v["cell"]["height"] / 2
        near = min(bones, key=lambda b: math.hypot(b["x"] - x, b["y"] - y))
        offset = ", ".join(str(math.floor(d + 0.5)) for d in (x - near["x"], y - near["y"]))
        out += [f'[node name="Layer_{v["name"]}" type="Sprite2D" parent="Skeleton2D/{label[near["name"]]}"]', f'texture = ExtResource("Tex_{texture[v["name"]]}")', f"offset = Vector2({offset})", ""]
    if clips:
        out += ['[node name="AnimationPlayer" type="AnimationPlayer" parent="."]', "libraries = {", '"": SubResource("AnimationLibrary_1")', "}", 'autoplay = "idle"', ""]
    return "\n".join(out) + "\n"


def cutout_files(name: str, layers: list[dict], bones: list[dict]) -> dict[str, str]:
    """The text files of a cut-out scene, by name."""
    settings = f'config_version=5\n\n[application]\n\nconfig/name="{name}"\nconfig/features=PackedStringArray("4.2")\n'
    return {"cutout.tscn": cutout_scene(layers, bones), "cutout_preview.gd": _SWAY, "project.godot": settings}


def opened(doc: dict) -> str:
    """A JSON object as `pretty` writes it, open for more members."""
    return json.dumps(doc, indent=2, ensure_ascii=False)[:-2] + ",\n"


def listed(name: str, items: Iterable[dict], depth: int = 1) -> Iterator[str]:
    """A JSON member with a list, as `pretty` would write it, item by item."""
    sep, tab = "", "  " * depth
    yield f'{tab}"{name}": ['
    for item in items:
        yield sep + "\n" + indent(json.dumps(item, indent=2, ensure_ascii=False), tab + "  ")
        sep = ","
    yield f"\n{tab}]" if sep else "]"


def quality_json(nested: Iterable[dict], errors: Iterable[dict] = (), totals: dict | None = None) -> Iterator[str]:
    """Version 2 report in parts: severity totals, warnings by asset, errors.

    nested (asset, warnings) must be in the order of asset; with `totals` it is read once, row by row.
    """
    if totals is None:
        nested = list(nested)
        counts = {s: sum(w["severity"] == s for r in nested for w in r["warnings"]) for s in ("high", "medium", "low", "info")}
        totals = {"assets": len(nested), "warnings": sum(counts.values()), **counts}
    yield opened({"version": 2, "summary": totals})
    yield from listed("issues", ({"asset": r["asset"], "warnings": [{k: w[k] for k in ("rule", "severity", "message", "suggestion")} for w in r["warnings"]]} for r in nested))
    yield ",\n"
    yield from listed("errors", errors)
    yield "\n}\n"


def quality_html(nested: Iterable[dict], errors: Iterable[dict] = ()) -> Iterator[str]:
    """A page without outside references, in parts; clean assets are shown as good."""
    e = lambda s: html.escape(str(s), quote=True).replace("&#x27;", "&#39;")
    yield "<!doctype html><html><head><meta charset=\"utf-8\"><title>Quality report</title></head><body><h1>Quality report</h1><table><tr><th>Asset</th><th>Severity</th><th>Issue</th><th>Suggestion</th></tr>"
    for r in nested:
        if not r["warnings"]:
            yield f'<tr><td>{e(r["asset"])}</td><td colspan="3" class="good">Good</td></tr>'
        for w in r["warnings"]:
            yield f'<tr><td>{e(r["asset"])}</td><td class="{e(w["severity"])}">{e(w["severity"])}</td><td>{e(w["message"])}</td><td>{e(w["suggestion"])}</td></tr>'
    yield "</table>"
    close = ""
    for x in errors:
        yield ("" if close else "<h2>Errors</h2><ul>") + f"<li>{e(x['source'])}: {e(x['message'])}</li>"
        close = "</ul>"
    yield close + "</body></html>\n"


def write_quality(report: DataFrame, failed: DataFrame, folder: Path) -> int:
    """Both reports of (asset, warnings) and failed sources, written row by row; returns the number of failures.

    Only totals are gathered: the rows come partition by partition, in the order of asset.
    """
    levels = ("high", "medium", "low", "info")
    one = lambda s: F.sum(F.size(F.filter("warnings", lambda w: w["severity"] == s)))
    r = report.agg(F.count(F.lit(1)).alias("assets"), F.sum(F.size("warnings")).alias("warnings"), *[one(s).alias(s) for s in levels]).first()
    rows = lambda: (x.asDict(True) for x in report.orderBy("asset").toLocalIterator())
    errors = lambda: (x.asDict() for x in failed.orderBy("source").toLocalIterator())
    with (folder / "quality-report.json").open("w", encoding="utf-8") as f:
        f.writelines(quality_json(rows(), errors(), {k: v or 0 for k, v in r.asDict().items()}))
    with (folder / "quality-report.html").open("w", encoding="utf-8") as f:
        f.writelines(quality_html(rows(), errors()))
    return failed.count()


def summary(processed: DataFrame) -> dict:
    """Totals of a batch and its errors, in source order."""
    ok = F.col("status") == "ok"
    total = processed.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")).first().asDict()
    errors = [r.asDict() for r in processed.where(~ok).select("source", "stage", "code", "message").orderBy("source").collect()]
    return total | {"errors": errors}


def output_names(base: str, pages: int, output: dict) -> list[str]:
    """Files of one image below its folder, by the settings' `output`: pages, manifest, engine files."""
    names = [f"atlas-{n}.png" for n in range(pages)] if "png" in output["format"] else []
    names += ["atlas.json"] if "json" in output["format"] else []
    names += [f"{base}_spriteframes.tres"] if output["godot"]["enabled"] else []
    return names + (["AtlasImporter.cs"] if output["unity"]["enabled"] else [])


def write_files(processed: DataFrame, folder: str, generator: str, version: str, output: dict | None = None) -> None:
    """The files that the settings' `output` names, written by the executors that hold the pages to a folder
    all of them share."""
    from ..operators.images import manifest
    from .config import Config

    docs = manifest(processed, generator, version)
    rows = processed.where("status = 'ok'").select("source", "pages").join(docs, "source")
    base, wanted = folder.rstrip("/"), output or Config.default().output

    def save(part):
        for r in part:
            stem = r["source"].rsplit(".", 1)[0]
            out, doc = Path(base) / stem, json.loads(r["manifest"])
            out.mkdir(parents=True, exist_ok=True)
            pages = {f"atlas-{p['page']}.png": p["png"] for p in r["pages"]}
            for name in output_names(stem.rsplit("/", 1)[-1], len(pages), wanted):
                if name in pages:
                    (out / name).write_bytes(pages[name])
                else:
                    text = {"json": pretty, "tres": sprite_frames, "cs": lambda _: importer_script(version)}[name.rsplit(".", 1)[-1]](doc)
                    (out / name).write_text(text)

    rows.foreachPartition(save)


def listing(row, detect: dict, most: int = 50) -> str:
    """What inspect says of an image: how it is cut up, its first sprites, and the estimated pages."""
    if detect["mode"] == "grid":
        how = f"rows {detect['rows']} x columns {detect['columns']}" if detect.get("rows") and detect.get("columns") else f"cells {detect['cellWidth']}x{detect['cellHeight']}"
    elif detect["mode"] == "manual":
        how = f"{len(detect['rects'])} rect(s)"
    else:
        how = f"threshold {detect['alphaThreshold']}, minPixels {detect['minPixels']}, connectivity {detect['connectivity']}"
    out = [f"source:     {row['source']}", f"detect:     {detect['mode']} ({how})", f"sprites:    {len(row['sprites'])} detected, {len(row['skipped'])} skipped"]
    for s in row["sprites"][:most]:
        a, b = s["source_rect"], s["trimmed_rect"]
        out.append(f"  {s['id']} rect=({a['x']},{a['y']} {a['width']}x{a['height']}) content={b['width']}x{b['height']}")
    if len(row["sprites"]) > most:
        out.append(f"  ... {len(row['sprites']) - most} more")
    pages = [f"atlas-{p['page']}.png {p['width']}x{p['height']}" for p in row["pages"]]
    out.append("estimated:  " + (f"{len(pages)} page(s) [{', '.join(pages)}]" if pages else "0 pages (nothing to pack)"))
    return "\n".join(out)
