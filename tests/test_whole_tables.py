"""Operators over whole tables, against brute force."""

import json
import math
import random

import pytest

from latticework.operators import cells as C
from latticework.operators import graph as G
from latticework.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rig", [0, 1000])
def test_nearest_weights_on_either_path(spark, monkeypatch, rig):
    monkeypatch.setattr(C, "RIG", rig)
    rng = random.Random(5)
    points = [(i, rng.uniform(-50, 150), 10.0 * rng.randrange(8)) for i in range(120)] + [(200, 4000.0, -9000.0), (201, 5.0, 5.0), (202, 5.0, 5.0)]
    anchors = [(i, float(rng.randrange(100)), 10.0 * rng.randrange(8)) for i in range(60)] + [(90 + i, 5.0, 5.0) for i in range(5)]  # many ties
    for k in (1, 3, 100):
        want = {}
        for p, x, y in points:
            near = sorted((math.hypot(x - ax, y - ay), a) for a, ax, ay in anchors)[:k]
            weights = [1e6 if d == 0 else 1 / d for d, _ in near]
            want |= {(p, a): w / sum(weights) for (_, a), w in zip(near, weights)}
        got = C.nearest_weights(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(anchors, "anchor long, ax double, ay double"), k).collect()
        assert len(got) == len(want) and {(r.point, r.anchor) for r in got} == set(want)
        assert all(math.isclose(r.weight, want[r.point, r.anchor], rel_tol=1e-9) for r in got)


def test_every_part_is_a_sprite(spark):
    brands = {}
    for r in catalogue.table(spark, SF, "part").collect():
        brands[r.p_brand] = brands.get(r.p_brand, 0) + 1
    sprites, listed, sources = {}, {}, set()
    for r in catalogue.QUERIES["sprite_pipeline"](spark, SF).collect():
        sources.add(r.source)
        sprites[r.source.rsplit("-", 2)[0]] = sprites.get(r.source.rsplit("-", 2)[0], 0) + (r.status == "ok" and r.id is not None)
    for r in catalogue.QUERIES["manifest_json"](spark, SF).collect():
        listed[r.source.rsplit("-", 2)[0]] = listed.get(r.source.rsplit("-", 2)[0], 0) + len(json.loads(r.manifest)["sprites"])
    assert sprites == listed == brands
    assert {r.asset for r in catalogue.QUERIES["image_report"](spark, SF).collect()} <= sources


def union_find(edges):
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            up[a] = a = up[up[a]]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {a: root(a) for a in list(up)}


def test_components_of_all_edges_against_union_find(spark):
    edges = [(r.l_partkey * 2, r.l_suppkey * 2 + 1) for r in catalogue.table(spark, SF, "lineitem").collect()]
    got = catalogue.QUERIES["graph_components"](spark, SF).collect()
    assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len({n for e in edges for n in e})


def test_components_with_hubs_and_chains(spark):
    rng = random.Random(9)
    edges = [(5000, i) for i in range(300)] + [(7000 + i, 7001 + i) for i in range(150)] + [(7150, 17)]
    edges += [(rng.randrange(8000, 9000), rng.randrange(8000, 9000)) for _ in range(450)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    got = G.components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len({n for e in edges for n in e})


def test_hierarchy_tails_and_long_cycles(spark):
    parent = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "self": "self", "root": None, "lost": "ghost", "kid": "lost"}
    parent |= {f"r{i}": f"r{(i + 1) % 100}" for i in range(100)} | {f"t{i}": f"t{i + 1}" if i < 69 else "r5" for i in range(70)}
    parent |= {f"x{i}": f"x{i + 1}" if i < 89 else None for i in range(90)}

    def runs_into_cycle(at):
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            at = parent.get(at)
        return at is not None

    want = {(i, "cycle") for i in parent if runs_into_cycle(i)} | {("lost", "missing-parent")}
    got = [tuple(r) for r in G.hierarchy_problems(spark.createDataFrame(list(parent.items()), "id string, parent string")).collect()]
    assert len(got) == len(want) == 177 and set(got) == want
    assert G.hierarchy_problems(spark.createDataFrame([("a", None), ("b", "a")], "id string, parent string")).count() == 0


@pytest.mark.parametrize("threshold", [0, 3, 5, 16])
def test_band_plans_find_all_pairs(spark, monkeypatch, threshold):
    from latticework.operators import rules

    rng = random.Random(threshold)
    words = [rng.getrandbits(64) for _ in range(60)]
    for w in words[:40]:
        for _ in range(3):
            flips = sum(1 << i for i in rng.sample(range(64), rng.choice([threshold, threshold + 1, threshold // 2])))
            words.append(w ^ flips)
    rows = [(i, w - (1 << 64) if w >= 1 << 63 else w) for i, w in enumerate(words)]
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if words[i] < words[j] and (words[i] ^ words[j]).bit_count() <= threshold}
    for size in (10, 10**6):
        plan = rules.band_plan(size, threshold)
        assert plan[1] == threshold // plan[0]
        monkeypatch.setattr(rules, "band_plan", lambda *_, plan=plan: plan)
        got = rules.near_pairs(spark.createDataFrame(rows, "k long, w long"), "k", "w", threshold).select("ka", "kb").collect()
        assert {tuple(sorted(r)) for r in got if r.ka != r.kb} == {tuple(sorted(p)) for p in want if words[p[0]] != words[p[1]]}
        monkeypatch.undo()


def test_cell_components_against_a_flood(spark):
    rng = random.Random(2)
    cells = {(k, y, x) for k in "ab" for y in range(12) for x in range(-70, 200) if rng.random() < (0.5 if k == "a" else 0.2)}
    cells |= {("c", 0, x) for x in range(300)} | {("c", 1, x) for x in range(0, 300, 2)} | {("c", 2, 7)}
    for eight in (True, False):
        left, want = set(cells), []
        while left:
            todo, found = [left.pop()], []
            while todo:
                k, y, x = todo.pop()
                found.append((k, y, x))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        n = (k, y + dy, x + dx)
                        if n in left and (eight or not dy or not dx):
                            left.remove(n)
                            todo.append(n)
            ys, xs = [c[1] for c in found], [c[2] for c in found]
            want.append((found[0][0], min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(found)))
        got = G.cell_components(spark.createDataFrame(sorted(cells), "k string, y long, x long"), ["k"], eight).collect()
        assert sorted((r.k, r.x, r.y, r.width, r.height, r.cells) for r in got) == sorted(want)
