"""Page packing against the rule itself, worked out by brute force."""

import random

from latticework.kernels import atlas
from latticework.plans import catalogue

SF = "/root/testdata/sf0.001"


def empty_rects(blocks, width, height):
    """All maximal empty rectangles (x0, y0, x1, y1) of a page that holds blocks."""
    xs = sorted({0, width, *(v for a, _, c, _ in blocks for v in (a, c))})
    ys = sorted({0, height, *(v for _, b, _, d in blocks for v in (b, d))})
    free = []
    for i, x0 in enumerate(xs):
        for x1 in xs[i + 1 :]:
            inside = [b for b in blocks if b[0] < x1 and b[2] > x0]
            for j, y0 in enumerate(ys):
                stop = min([b[1] for b in inside if b[3] > y0], default=height)
                if stop > y0 and (y0 == 0 or any(b[3] == y0 for b in inside)):
                    free.append((x0, y0, x1, stop))
    return [r for r in free if not any(r != o and o[0] <= r[0] and o[1] <= r[1] and o[2] >= r[2] and o[3] >= r[3] for o in free)]


def check(placed, width, height, spacing):
    """placed: (page, x, y, w, h) in input order. Each block stands on the first page with room, at the corner
    of an empty rectangle that leaves least on its shorter and then its longer side."""
    pages = {}
    for page, x, y, w, h in placed:
        bw, bh = w + spacing, h + spacing
        for earlier in range(page + 1):
            rooms = [(c - a - bw, d - b - bh, a, b) for a, b, c, d in empty_rects(pages.get(earlier, []), width, height)]
            rooms = [(min(p, q), max(p, q), a, b) for p, q, a, b in rooms if p >= 0 and q >= 0]
            if earlier < page:
                assert not rooms
        assert (x, y) in {(a, b) for s, n, a, b in rooms if (s, n) == min(rooms)[:2]}
        pages.setdefault(page, []).append((x, y, x + bw, y + bh))


def test_random_pages_follow_the_rule():
    rng = random.Random(1)
    for _ in range(25):
        width, height, spacing = rng.randrange(14, 40), rng.randrange(14, 40), rng.randrange(3)
        sizes = [(rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(22)]
        at = {i: (n, b.x, b.y, b.width, b.height) for n, p in enumerate(atlas.pack(sizes, width, height, spacing)) for i, b in p.placed}
        assert [at[i][3:] for i in range(len(sizes))] == sizes
        check([at[i] for i in range(len(sizes))], width, height, spacing)


def test_pack_pages_query(spark):
    want = {}
    for r in catalogue.table(spark, SF, "part").collect():
        want.setdefault(r.p_brand, {})[r.p_partkey] = (r.p_size + 4, r.p_partkey % 37 + 4)
    got = {}
    for r in catalogue.QUERIES["pack_pages"](spark, SF).collect():
        got.setdefault(r.grp, {})[r.ordinal] = (r.page, r.x, r.y, r.width, r.height)
    assert {g: {o: v[3:] for o, v in rows.items()} for g, rows in got.items()} == want
    for rows in got.values():
        check([rows[o] for o in sorted(rows)], 256, 256, 2)


def test_sprites_of_the_pipeline_query(spark):
    """Every block is one sprite, packed by the rule in reading order."""
    images = {}
    for r in catalogue.QUERIES["sprite_pipeline"](spark, SF).collect():
        images.setdefault(r.source, []).append((r.id, r.page, r.x, r.y, r.width, r.height))
    for rows in list(images.values())[:12]:
        rows.sort()
        assert [r[0].rsplit("-", 1)[-1] for r in rows] == [f"{n:04d}" for n in range(len(rows))]
        check([r[1:] for r in rows], 2048, 2048, 2)
