import re
from collections import Counter

import numpy as np

from samples import CLASHING, DOCS, awkward_docs, prose  # noqa: F401
from latticework.llm import line_dedup, quality


def brute_lines(rows, min_sites):
    """kept text of each row by exact distinct counts."""
    sites, first = {}, {}
    order = lambda d, p: (d is not None, d or 0, p)
    for d, t, _, s, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            k = line.strip(" ")
            if t is not None and k:
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (d, p)), (d, p), key=lambda x: order(*x))
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, None))
            continue
        keep = [line for p, line in enumerate(t.split("\n")) if not (k := line.strip(" ")) or len(sites[k]) < min_sites or first[k] == (d, p)]
        out.append((d, "\n".join(keep) if len(keep) < len(t.split("\n")) else t))
    return out


def spread_rows():
    rows = awkward_docs()
    for i in range(60):
        lines = [prose(1000 + i, 6)] + ["seen on all sites"] * (i % 3 + 1) + ([" on eleven sites "] if i % 20 < 11 else []) + (["on nine sites"] if i % 20 < 9 else []) + (["often on one site"] if i % 20 == 0 else [])
        rows.append((100 + i, "\n".join(lines), "en", f"s{i % 20}", 1))
    rows.append((100, "seen on all sites\nother text of the same id", "en", "s1", 1))
    return rows


def test_line_dedup_against_brute_force(spark):
    rows = spread_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect()]
    assert Counter(got) == Counter(brute_lines(rows, 10))
    report = line_dedup.line_report(docs)
    assert report.columns == ["doc_id", "n_lines", "n_removed", "kept_sha256"] and report.count() == len(rows)


def test_line_dedup_shuffle_path_and_edges(spark, clashing, no_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    docs = spark.createDataFrame(spread_rows(), DOCS)
    assert Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect()) == Counter(brute_lines(spread_rows(), 10))
    out = line_dedup.line_dedup(clashing, 2)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert line_dedup.line_dedup(no_docs).count() == 0


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark):
    rows = [*awkward_docs(), (20, "a b c d e f a b c d e g", "en", "a", 1), (21, "x " * 30, "en", "a", 1), (22, "a\n\na\n \nb\na", "en", "a", 1), (23, "a b c d e a b c d e", "en", "a", 1), (24, "\x0b\x0c#*$%&|<> a\x0bb", "en", "a", 1)]
    got = quality.text_statistics(spark.createDataFrame(rows, DOCS)).collect()
    want = Counter((r[0], *base(r[1])) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want


def brute_mcd(x):
    """Three starts, C-steps and the least determinant as documented, with geometric distance bins, in numpy."""
    floor, n = np.array(quality.FLOOR, float), len(x)
    low, center, high = (np.sort(x, axis=0)[int(np.ceil(p * n)) - 1] for p in (0.25, 0.5, 0.75))
    scale = np.maximum((high - low) / 1.349, floor)

    def factor(cov):
        return np.linalg.cholesky(cov + np.diag(floor**2))

    def d2(center, chol):
        return (np.linalg.solve(chol, (x - center).T) ** 2).sum(0)

    def step(center, chol, share):
        bins = np.clip(np.floor(np.log2(d2(center, chol) + 1e-9) * 32), -320, 1280)
        need, total, near = int(np.ceil(n * share)), 0, np.zeros(n, bool)
        for b in np.unique(bins):
            if total < need:
                near |= bins == b
            total += (bins == b).sum()
        return x[near].mean(0), factor(np.cov(x[near].T, bias=True))

    plain = np.diag(np.maximum(np.abs(x - center).mean(0), floor))
    unit = (x - center) / scale
    length = np.sqrt((unit**2).sum(1, keepdims=True))
    signs = np.rint(1000 * np.divide(unit, length, out=np.zeros_like(unit), where=length > 0))
    signed = factor(signs.T @ signs / n * 4 / 1e6 * np.outer(scale, scale))
    found = []
    for chol, share in ((plain, quality.COVERAGE), (plain, 0.5), (signed, quality.COVERAGE)):
        fit = step(*step(center, chol, share), quality.COVERAGE)
        found.append((np.log(np.diag(fit[1])).sum().round(9), len(found), fit))
    fit = min(found)[2]
    for _ in range(quality.C_STEPS - quality.TRIAL_STEPS):
        fit = step(*fit, quality.COVERAGE)
    return d2(*fit) / quality.CONSISTENCY


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        text = prose(i, int(rng.integers(40, 300)))
        if i % 40 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en" if i % 4 else "de", "s", 1))
    rows += [(1000 + i, prose(5000 + i, 60), None, None, 1) for i in range(5)]  # too small a group
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    z = {r.doc_id: [r[d] for d in quality.DIMS] for r in quality._vector(quality.text_statistics(docs)).collect()}
    for lang in ("en", "de"):
        ids = [r[0] for r in rows if r[2] == lang and not got[r[0]].base_failed]
        d2 = brute_mcd(np.array([z[i] for i in ids], float))
        assert np.allclose([got[i].d2 for i in ids], d2, rtol=1e-4, atol=1e-4)
    assert all(got[i].kept != (i % 40 == 0) for i in range(400))
    assert all(got[1000 + i].kept and got[1000 + i].d2 is None for i in range(5))


def test_small_groups_are_judged_by_wider_estimates(spark):
    rows = []
    for i in range(160):
        text = prose(i, 40 + 5 * (i % 40))
        if i % 20 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en" if i < 140 else "de", f"s{i % 7}", 1))  # 20 rows a source, and 20 rows of a language
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    z = {r.doc_id: [r[d] for d in quality.DIMS] for r in quality._vector(quality.text_statistics(docs)).collect()}
    assert not any(r.base_failed for r in got.values())
    for ids, pool in ((range(140), range(140)), (range(140, 160), range(160))):
        d2 = brute_mcd(np.array([z[i] for i in pool], float))[[pool.index(i) for i in ids]]
        assert np.allclose([got[i].d2_wide for i in ids], d2, rtol=1e-4, atol=1e-4)
        assert all(got[i].d2 is None and got[i].kept == (i % 20 != 0) for i in ids)
    few = quality.quality_scores(docs.where("doc_id BETWEEN 1 AND 30")).collect()
    assert [r.doc_id for r in few if not r.kept] == [20] and all(r.d2_wide is not None for r in few)


def test_rows_that_share_an_id_are_judged_apart(spark):
    good, bad = prose(1, 60), "too short"
    docs = spark.createDataFrame([(1, good, "en", "a", 1), (1, bad, "en", "a", 1), (None, good, "en", "a", 1), (None, None, None, None, None), (2, bad, None, "a", 1)], DOCS)
    assert Counter((r.doc_id, r.text) for r in quality.quality_filter(docs).collect()) == Counter([(1, good), (None, good)])


def test_quality_edges(clashing, no_docs):
    out = quality.quality_filter(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(map(str, ids)) == sorted(["None", "10", "5", "6", "6", "9"])
    assert quality.quality_filter(no_docs).count() == 0
