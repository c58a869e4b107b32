"""Golden sheets rebuilt from their descriptions, and the image pipeline over a folder."""

import json

import numpy as np
import pytest

from latticework.kernels import atlas, geometry, layers, png, raster
from latticework.operators import images as I
from latticework.plans import exports
from latticework.plans.config import Config
from latticework.sources import images as S


def sheet(width, height, *blobs, alpha=255):
    out = np.zeros((height, width, 4), np.uint8)
    for x, y, w, h in blobs:
        out[y : y + h, x : x + w] = (200, 60, 20, alpha)
    return out


def config(**sections):
    return Config.parse({"schemaVersion": 2, **sections})


def margins(padding, bleed):
    return {"padding": {"pixels": padding}, "bleed": {"pixels": bleed}}


GOLDEN = [
    (sheet(64, 64, (2, 2, 28, 28), (34, 2, 28, 28), (2, 34, 28, 28), (34, 34, 28, 28)), margins(1, 1), [(0, 0, 0, 32, 32), (0, 34, 0, 32, 32), (0, 68, 0, 32, 32), (0, 102, 0, 32, 32)], [(134, 32)]),
    (sheet(100, 80, (2, 2, 20, 30), (40, 3, 40, 10), (60, 50, 12, 12)), margins(0, 0), [(0, 0, 0, 20, 30), (0, 22, 0, 40, 10), (0, 64, 0, 12, 12)], [(76, 30)]),
    (sheet(80, 20, (2, 2, 16, 16), (22, 2, 16, 16), (42, 2, 16, 16), (62, 2, 16, 16)), margins(0, 0) | {"atlas": {"maxWidth": 32, "maxHeight": 16, "spacing": 0}}, [(0, 0, 0, 16, 16), (0, 16, 0, 16, 16), (1, 0, 0, 16, 16), (1, 16, 0, 16, 16)], [(32, 16), (32, 16)]),
    (sheet(16, 16, (2, 2, 8, 8)), margins(0, 0) | {"resize": {"enabled": True, "scale": 2}}, [(0, 0, 0, 16, 16)], [(16, 16)]),
    (sheet(40, 24, (1, 1, 10, 10), (20, 8, 12, 12)), margins(1, 2), [(0, 0, 0, 16, 16), (0, 18, 0, 18, 18)], [(36, 18)]),
    (sheet(80, 60, (3, 3, 15, 15), (40, 20, 22, 25)), margins(2, 2), [(0, 0, 0, 23, 23), (0, 0, 25, 30, 33)], [(30, 58)]),
]


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_golden(n):
    rgba, sections, placed, pages = GOLDEN[n]
    out = I.process_one("f.png", rgba, True, config(**sections))
    assert [(s["page"], *s["page_rect"].values()) for s in out["sprites"]] == placed
    assert [(p["width"], p["height"]) for p in out["pages"]] == pages
    assert [s["id"] for s in out["sprites"]] == [f"f.png#sprite-{i:04d}" for i in range(len(placed))]
    assert all(s["pivot"] == {"x": 0.5, "y": 1.0} for s in out["sprites"])


def test_manual_rects_and_skipped():
    rgba = sheet(48, 16, (1, 1, 8, 8), (30, 4, 10, 10))
    rects = [{"id": "hero", "x": 0, "y": 0, "width": 10, "height": 10}, {"id": "gap", "x": 14, "y": 0, "width": 8, "height": 8}, {"id": "emblem", "x": 28, "y": 0, "width": 16, "height": 16}]
    out = I.process_one("f.png", rgba, True, config(detect={"mode": "manual", "rects": rects}, **margins(1, 1)))
    assert [(s["id"], *s["page_rect"].values()) for s in out["sprites"]] == [("f.png#hero", 0, 0, 12, 12), ("f.png#emblem", 14, 0, 14, 14)]
    assert out["skipped"] == [{"id": "f.png#gap", "source_rect": {"x": 14, "y": 0, "width": 8, "height": 8}, "reason": "fully-transparent"}]
    with pytest.raises(raster.StageError):
        raster.manual(rgba, [rects[0], rects[0]])


def test_detection_rules():
    diagonal = sheet(4, 4, (0, 0, 1, 1), (1, 1, 1, 1))
    assert len(raster.components(diagonal, True, 8, 1, 8)) == 1 and len(raster.components(diagonal, True, 8, 1, 4)) == 2
    with pytest.raises(raster.StageError, match="alpha"):
        raster.components(diagonal, False, 8, 1, 8)
    assert len(raster.grid(diagonal, False, 8, rows=2, columns=2)) == 4 and len(raster.grid(diagonal, True, 8, rows=2, columns=2)) == 1
    for bad in ({"rows": 2}, {"cell_width": 9, "cell_height": 9}):
        with pytest.raises(raster.StageError) as e:
            raster.grid(diagonal, True, 8, **bad)
        assert e.value.code == "GRID_INVALID"


def test_components_against_flood_fill():
    rng = np.random.default_rng(5)
    for eight in (True, False):
        mask = rng.random((40, 50)) < 0.45
        runs, label = raster.label_runs(mask, eight)
        grid = np.full(mask.shape, -1)
        for (y, a, b), k in zip(runs.tolist(), label.tolist()):
            grid[y, a : b + 1] = k
        seen = {}
        todo = set(map(tuple, np.argwhere(mask).tolist()))
        count = 0
        while todo:
            stack, count = [todo.pop()], count + 1
            while stack:
                y, x = stack.pop()
                seen[y, x] = count
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (eight or not (dy and dx)) and (y + dy, x + dx) in todo:
                            todo.remove((y + dy, x + dx))
                            stack.append((y + dy, x + dx))
        pairs = {(grid[p], c) for p, c in seen.items()}
        assert len(pairs) == count == len({a for a, _ in pairs})


def test_resampling():
    line = np.zeros((1, 3, 4), np.uint8)
    line[0, :, 0] = (0, 100, 201)
    assert raster.resize(line, 1.5).shape == (2, 5, 4)
    assert raster.resize(line, 2)[0, :, 0].tolist() == [0, 0, 100, 100, 201, 201]
    assert raster.resize(line, 2, smooth=True)[0, :, 0].tolist() == [0, 25, 75, 125, 176, 201]
    assert raster.resize(line, 1) is line
    with pytest.raises(raster.StageError):
        raster.resize(line, 65)


def test_packing_never_overlaps():
    rng = np.random.default_rng(2)
    sizes = [tuple(map(int, rng.integers(3, 60, 2))) for _ in range(150)]
    for page in atlas.pack(sizes, 200, 200, 2):
        used = np.zeros((202, 202), int)
        for _, b in page.placed:
            used[b.y : b.y + b.height + 2, b.x : b.x + b.width + 2] += 1
        assert used.max() == 1
    with pytest.raises(raster.StageError, match="exceeds"):
        atlas.pack([(199, 10)], 200, 200, 2)


def test_layers_and_fills():
    rng = np.random.default_rng(7)
    image = rng.integers(1, 256, (20, 24, 4)).astype(np.uint8)
    image[:, :, 3] = 255
    mask = np.zeros((20, 24), bool)
    mask[5:12, 6:15] = True
    for fill in ("nearest", "diffuse", "patch"):
        layer = layers.extract(image, mask, 4, fill)
        rebuilt = layers.compose([layer], 24, 20)
        assert layers.check(image, rebuilt, mask)["violations"] == 0
        assert layers.extract(image, mask, 4, fill)["pixels"].tobytes() == layer["pixels"].tobytes()
    hole = image.copy()
    hole[8:10, 8:10] = 0
    assert (layers.patch_match(hole)[:, :, 3] != 0).all() and (layers.patch_match(hole)[mask == 0] == hole[mask == 0]).all()
    one = np.zeros((1, 3, 4), np.uint8)
    one[0, 0] = (10, 10, 10, 255)
    assert layers.diffuse(one, 1)[0, :, 0].tolist() == [10, 10, 10]  # values of a sweep are used in it
    grown = layers.grow(mask, 2)
    assert grown.sum() == 11 * 13 and (layers.shrink(grown, 2) == mask).all()
    edge = np.ones((4, 4), bool)
    assert layers.shrink(edge, 1).all()


def test_meshes():
    mask = np.zeros((48, 64), bool)
    mask[4:44, 6:60] = True
    mask[18:26, 28:40] = False
    points, triangles = geometry.grid_mesh(mask, 8)
    assert len(triangles) % 2 == 0 and points and max(max(t) for t in triangles) == len(points) - 1
    points, triangles = geometry.contour_mesh(mask)
    area = sum(abs((points[b][0] - points[a][0]) * (points[c][1] - points[a][1]) - (points[c][0] - points[a][0]) * (points[b][1] - points[a][1])) / 2 for a, b, c in triangles)
    assert abs(area - mask.sum()) < 0.1 * mask.sum()
    for a, b, c in triangles:
        x, y = (sum(points[i][k] for i in (a, b, c)) / 3 for k in (0, 1))
        assert mask[int(y), int(x)]
    assert len(geometry.loops(mask)) == 2
    rig = [(b, x * 64, y * 48) for b, _, x, y in geometry.RIGS["human"]]
    for row in geometry.weights(points, rig):
        assert len(row) == 2 and abs(sum(w for _, w in row) - 1) < 1e-9


def test_folder_pipeline(spark, tmp_path):
    root = tmp_path / "in"
    (root / "output").mkdir(parents=True)
    for i in range(3):
        (root / f"walk_{i}.png").write_bytes(png.encode(sheet(40, 24, (1, 1, 10, 10), (20, 8, 12, 12 + i % 2))))
    (root / "bad.png").write_bytes(b"broken")
    (root / "output" / "no.png").write_bytes(b"not read")
    (root / "note.txt").write_text("no")
    (root / "upper.PNG").write_bytes((root / "walk_0.png").read_bytes())
    assert S.scan(spark, str(root), include=("**/*.PNG",)).count() == 1
    (root / "upper.PNG").unlink()
    files = S.scan(spark, str(root))
    assert sorted(r.source for r in files.collect()) == ["bad.png", "walk_0.png", "walk_1.png", "walk_2.png"]
    heads = {r.source: r for r in S.headers(files).collect()}
    assert not heads["bad.png"].valid
    h = heads["walk_0.png"]
    assert (h.valid, h.width, h.height, h.bit_depth, h.color_type) == (True, 40, 24, 8, 6)
    decoded = S.decode(files)
    done = I.process(decoded, Config.default())
    assert exports.summary(done) == {"total": 4, "succeeded": 3, "failed": 1, "errors": [{"source": "bad.png", "stage": "decode", "code": "IMAGE_INVALID", "message": "no PNG header"}]}
    doc = json.loads(I.manifest(done, "latticework", "x").where("source = 'walk_1.png'").first().manifest)
    assert list(doc) == ["schemaVersion", "generator", "source", "pages", "sprites"] and len(doc["sprites"]) == 2
    assert exports.sprite_frames(doc).startswith('[gd_resource type="SpriteFrames" load_steps=4 format=3]')
    assert exports.importer_rects(doc)[0]["pivotY"] == 0.0
    exports.write_files(done, str(tmp_path / "out"), "latticework", "x")
    assert png.decode((tmp_path / "out/walk_1/atlas-0.png").read_bytes())[0].shape[2] == 4
    assert S.pixels(decoded).count() == 3 * 40 * 24
    names = {(r.name, r.width) for r in I.features(decoded).collect()}
    assert names == {(f"walk_{i}.png", 40) for i in range(3)}
