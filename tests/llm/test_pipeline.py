"""The pipeline's run() against stages worked out by brute force."""

import zlib

import numpy as np

import corpus_pipeline
from samples import CLASHING, DOCS, prose
from latticework.llm import decontam, queries
from test_lines_and_quality import base, brute_lines
from test_near_and_passages import brute_classes


def rows_of():
    rows = []
    for i in range(120):
        text = prose(i, 30 + i % 50)
        if i % 10 == 3:
            text = prose(i - 3, 30 + (i - 3) % 50) + " end"  # near copy of the document three before
        if i % 12 != 5:
            text += "\nshared by all sites"
        if i % 15 == 7:
            text += "\n" + prose(777, 15)
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
    rows += [(500, "too short", "en", "s1", 9), (501, None, None, None, None), (502, "", "en", "s2", 0), (503, " ".join(["again and again we say"] * 9), "en", "s3", 1)]
    return rows


def test_run_against_brute_force(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(777, 15))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def passes(text):
        n, _, _, _, repeats = base(text)
        return n >= 10 and 100 * repeats <= 20 * n

    now = [r for r in rows if passes(r[1])]  # groups are too small for an estimate
    now = list(zip([r[0] for r in now], [t for _, t in brute_lines(now, 10)]))
    root = brute_classes(now)
    now = [(d, t) for d, t in now if root[d] == d]
    item = decontam.normal(prose(777, 15))
    now = [(d, t) for d, t in now if item not in decontam.normal(t)]
    assert {r.doc_id for r in got} == {d for d, _ in now} and len(now) < 110
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in now}
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)


def test_stages_keep_columns(spark, clashing, no_docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
        assert stage(spark, no_docs, sf).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
