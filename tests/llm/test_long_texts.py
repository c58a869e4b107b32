"""Texts of more than one chunk of the text kernels, end to end."""

from collections import Counter

import pytest

from samples import DOCS, prose
from latticework.llm import decontam, line_dedup, minhash, quality, substring, textkernel
from test_lines_and_quality import base
from test_near_and_passages import brute_passages


@pytest.fixture(scope="module")
def rows():
    long, item = prose(1, 300_000), prose(77, 40)
    words = long.split()
    assert len(long) > textkernel.CHUNK
    middle = " ".join([*words[:150_000], "zz", *item.split()[:20], "edit", *item.split()[20:], *words[150_000:]])
    return [(1, " ".join(words[:90_000])), (2, "x " + long), (3, long + " and an end"), (4, prose(2, 60)), (5, middle), (6, prose(2, 60) + " " + prose(3, 9)), (7, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)


def test_near_copies(docs):
    got = {r.doc_id: r.component_id for r in minhash.near_classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 2, 6: 4, 7: 7}


def test_passages(docs, rows):
    got = substring.passage_report(docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute_passages(rows))


def test_leaks(spark, docs):
    bench = spark.createDataFrame([(9, prose(77, 40)), (8, prose(78, 40))], "item_id long, text string")
    (hit,) = decontam.contaminated(docs, bench).collect()
    assert (hit.doc_id, hit.item_id, hit.distance) == (5, 9, len("edit "))


def test_statistics_and_lines(docs, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs).collect()}
    assert got == {d: base(t) for d, t in rows}
    assert Counter((r.doc_id, r.n_removed) for r in line_dedup.line_report(docs).collect()) == Counter((d, 0) for d, _ in rows)
