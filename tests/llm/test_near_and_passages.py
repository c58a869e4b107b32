import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from samples import DOCS, awkward_docs, prose
from latticework.llm import minhash, substring, textkernel


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """doc_id: (set size, least reachable doc_id); rows of one doc_id are one document."""
    sets, parent = [(d, shingles(t)) for d, t in rows if d is not None], {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            both = len(s & u)
            if both and 100 * both >= 75 * (len(s) + len(u) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in parent}


def near_rows():
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in awkward_docs()]
    base = prose(50, 90).split()
    for i in range(60):  # a family of near copies at similarities around the threshold
        w = base[:]
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    passage = prose(51, 60)
    rows += [(300 + i, passage + " " + prose(600 + i, 40)) for i in range(80)]  # one passage in many
    rows += [(500 + i, "The Same Text, five words" if i % 2 else "the same text, five\twords") for i in range(30)]
    rows += [(600, "a b"), (601, "A  B"), (602, "b a")]
    return rows


def with_all_columns(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)


@pytest.mark.parametrize("cap", [32, 3])
def test_classes_against_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(minhash, "CAP", cap)
    if cap == 3:
        monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
        monkeypatch.setattr(minhash, "SALT", 5)
    rows = near_rows()
    got = minhash.near_classes(with_all_columns(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(shingles(t))) for d, t in rows)


def test_near_dedup_edges(spark, clashing, no_docs):
    out = minhash.near_dedup(clashing)
    assert out.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 8, 9]))
    assert minhash.near_classes(no_docs).count() == 0


def test_signature_is_minwise():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(x[:300]), np.unique(x[100:])]
    ptr = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    a, b = minhash.signatures(np.concatenate(sets), ptr, 160)
    assert abs((a == b).mean() - 0.5) < 0.12
    one, two = minhash.signatures(np.concatenate([sets[0], sets[0][::-1].copy()]), np.array([0, 300, 600]), 160)
    assert (one == two).all()


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["", None, "a b", "  A  b\n", "\x0b\x0c", "x" * 3_000_000, "\u00a0 \u00e9", "a b"]
    seen = []
    for a, b, buf, offsets in textkernel.chunks(pa.array(texts)):
        words = textkernel.Words(buf, offsets)
        low = words.hashes(lower=True)
        for i in range(b - a):
            found = [bytes(buf[s:e]) for s, e in zip(words.starts[words.ptr[i] : words.ptr[i + 1]], words.ends[words.ptr[i] : words.ptr[i + 1]])]
            assert found == (texts[a + i] or "").encode().split()
            seen.append(low[words.ptr[i] : words.ptr[i + 1]].tolist())
    assert seen[2] == seen[3] == seen[7] and len(set(seen[2])) == 2


def brute_passages(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        text = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(text).hexdigest()))
    return out


def passage_rows():
    rows = [(r[0], r[1]) for r in awkward_docs()]
    common, edge = prose(70, 75), prose(71, 50)
    rows += [(100 + i, prose(800 + i, i % 60) + " " + common + "  \n" + prose(900 + i, 20)) for i in range(40)]
    rows += [(300, edge), (301, "q " + edge + " z"), (302, edge[:-1]), (303, prose(71, 49)), (304, "w " * 120), (305, "w " * 200)]
    rows += [(120, "another text of id 120 " + common), (9, prose(9, 120) + " tail")]
    return rows


@pytest.mark.parametrize("group", [500, 4])
def test_passages_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    if group == 4:
        monkeypatch.setattr(substring, "BROADCAST_IDS", -1)
        monkeypatch.setattr(substring, "BROADCAST_ANCHORS", 60)
    rows = passage_rows()
    got = substring.passage_report(with_all_columns(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_passages(rows))


def test_passage_dedup_edges(spark, clashing, no_docs):
    out = substring.passage_dedup(clashing)
    assert out.columns == clashing.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[6] == "" and text[5] == prose(99, 4000) and text[2] is None and text[10] == "x y"
    assert substring.passage_report(no_docs).count() == 0


def test_passage_dedup_of_repeated_ids(spark):
    common = prose(70, 75)
    rows = [(1, common), (2, "x " + common), (2, "a text of its own"), (2, "  x " + common), (None, common)]
    out = substring.passage_dedup(with_all_columns(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, common), (2, "x"), (2, "a text of its own"), (2, "x"), (None, common)])


def test_subtree():
    rows = [(5, b"a b c d e"), (3, b"z a b c d"), (4, b"b c d"), (9, b"a b c x"), (5, b"q q q q")]
    leaves, nodes = substring.subtree(rows, 2)
    word = lambda leaf, n: b" ".join(rows[leaf[1]][1].split()[leaf[2] : leaf[2] + n])
    # the node of a maximal repeat, and the documents below it
    assert sorted((word(leaves[a], n), n, sorted(x[0] for x in leaves[a:b])) for n, a, b in nodes) == [
        (b"a b c", 3, [3, 5, 9]), (b"a b c d", 4, [3, 5]), (b"b c", 2, [3, 4, 5, 9]), (b"b c d", 3, [3, 4, 5]), (b"c d", 2, [3, 4, 5]), (b"q q", 2, [5, 5, 5]), (b"q q q", 3, [5, 5]),
    ]
    assert sorted(substring.repeats_of(rows, 2)) == [(0, 0, 4), (0, 1, 3), (0, 2, 2), (2, 0, 3), (2, 1, 2), (3, 0, 3), (3, 1, 2)]


def test_subtree_against_all_pairs():
    rng = random.Random(12)
    for _ in range(60):
        rows = [(rng.randrange(6), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))).encode()) for _ in range(rng.randrange(1, 7))]
        want = {}
        words = [t.split() for _, t in rows]
        for r, (doc, _) in enumerate(rows):
            for i in range(len(words[r])):
                for q, (other, _) in enumerate(rows):
                    for j in range(len(words[q])) if other < doc else ():
                        n = 0
                        while i + n < len(words[r]) and j + n < len(words[q]) and words[r][i + n] == words[q][j + n]:
                            n += 1
                        if n >= 3:
                            want[r, i] = max(want.get((r, i), 0), n)
        assert {(r, j): n for r, j, n in substring.repeats_of(rows, 3)} == want


def test_pair_whose_only_common_bucket_is_large(spark, monkeypatch):
    from pyspark.sql import functions as F

    sign = minhash.sign
    # one bucket holds all documents, two more the odd and the even ones; all are larger than CAP
    keys = F.array(F.lit(7).cast("long"), F.when(F.col("doc_id") % 2 == 0, F.lit(8)).otherwise(F.lit(9)).cast("long"))
    monkeypatch.setattr(minhash, "sign", lambda docs: sign(docs).withColumn("bands", keys))
    monkeypatch.setattr(minhash, "CAP", 4)
    text = prose(1, 100)
    rows = [(i, prose(300 + i, 100), "en", "a", 1) for i in range(1, 21)] + [(30, text, "en", "a", 1), (31, text + " x", "en", "a", 1)]
    got = {r.doc_id: r.component_id for r in minhash.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i for i in range(1, 21)} | {30: 30, 31: 30}


@pytest.mark.parametrize("bounded", [10**6, 100, 3])
def test_components_on_every_path(spark, monkeypatch, bounded):
    from latticework.llm import components

    monkeypatch.setattr(components, "BOUNDED", bounded)
    rng = random.Random(4)
    edges = [(9000, i) for i in range(60)] + [(100 + i, 101 + i) for i in range(80)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(7, 7), (None, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    rng.shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
