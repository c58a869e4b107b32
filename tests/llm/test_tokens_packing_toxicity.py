import random
import zlib
from collections import Counter

import numpy as np
import pytest

from samples import DOCS, awkward_docs, prose
from latticework.llm import packing, queries, rollup, tokens, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_cached_ids_equal_the_tokenizer(tokenizer):
    encoder = tokens.Encoder.at(queries.tokenizer_path())
    rng = random.Random(5)
    bits = ["a", "b c", " ", "  ", "\n", "\t", "\u00e9", "'s", "12", ".", "\u6f22", "word ", "\u00a0", "<|endoftext|>", "\r\n", "x" * 50]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    for text in (f"a {special[0]} b" if special else "a b", "".join(special), "x" + "y ".join(special)):
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.whole != encoder._reference  # the quick path is in use


def check_packing(rows, texts, tokenizer, capacity=1024):
    """Pieces, checksums, offsets and capacity; returns the number of sequences and the lower bound."""
    by_doc, by_seq, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, found in by_doc.items():
        ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts[doc]]
        want = Counter()
        for x in ids:
            first = len(x) % capacity if len(x) > capacity else len(x)
            edges = sorted({0, *([first] if first else []), *range(first, len(x) + 1, capacity), len(x)})
            want.update((k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
            total += len(x)
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-total // capacity)


def test_packing(spark, tokenizer, clashing, no_docs):
    texts = {}
    for d, t, *_ in awkward_docs():
        texts.setdefault(d, []).append(t)
    rows = packing.pack_documents(clashing, queries.tokenizer_path()).collect()
    n, bound = check_packing(rows, texts, tokenizer)
    assert n <= bound + 1 and set(texts) == {r.doc_id for r in rows}
    assert packing.pack_documents(no_docs, queries.tokenizer_path()).count() == 0


def test_packing_on_many_islands(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 1024, 3000)]
    parts = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], packing._PIECES)
    monkeypatch.setattr(packing, "REPACK", 300)
    rows = packing.pack(parts, island=200).collect()
    load = Counter()
    for r in rows:
        load[r.sequence_id] += r.length
    bound = -(-sum(sizes) // 1024)
    assert len(rows) == 3000 and max(load.values()) <= 1024 and len(load) <= bound * 1.02 + 1


def test_pieces_that_cannot_share_a_sequence(spark, monkeypatch):
    """Badly filled bins that nothing improves stay where they are: no group grows with the table."""
    sizes = np.random.default_rng(3).integers(520, 1000, 6000).tolist()
    parts = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], packing._PIECES)
    monkeypatch.setattr(packing, "REPACK", 256)
    rows = packing.pack(parts, island=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 6000 and all(r.offset == 0 for r in rows)
    largest = max(Counter(r.sequence_id >> 24 for r in rows).values())
    assert largest <= 2 * 256


def test_a_single_island_evolves(spark):
    sizes = np.random.default_rng(10).integers(150, 700, 60).tolist()
    assert len(packing.evolve(sorted(sizes, reverse=True), 0, generations=1)) == 28
    rows = packing.pack(spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], packing._PIECES)).collect()
    assert len({r.sequence_id for r in rows}) == 27 == -(-sum(sizes) // 1024)


def test_genetic_operators():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(200, 520, 300)]
    every = sorted(range(300))
    one = packing.best_fit(every, sizes, [], 1024)
    two = packing.best_fit(every[150:], sizes, packing.best_fit(every[:150], sizes, [], 1024), 1024)
    for p in (one, two, packing.crossover(one, two, sizes, 1024, rng), packing.from_patterns([[sizes[i] for i in b] for b in one[:20]] + [[9999]], sizes, 1024), packing.evolve(sizes, 7)):
        assert sorted(i for b in p for i in b) == every and all(sum(sizes[i] for i in b) <= 1024 for b in p)
    assert packing.evolve(sizes, 7) == packing.evolve(sizes, 7) and len(packing.evolve(sizes, 7)) <= len(one)
    assert packing.cut_pieces(1024) == [(0, 1024)] and packing.cut_pieces(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut_pieces(2048) == [(0, 1024), (1024, 1024)]


def facts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def test_rollup(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "r"))
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in store.totals().collect()}
    assert totals() == {}
    a = facts(spark, [(1, "s", "en", "v1", 10, 40), (2, "s", "en", "v1", 5, 20), (3, None, None, "v1", 0, 0), (3, None, None, "v1", 0, 0)])
    assert store.commit("a", rollup.inserts(a)) and not store.commit("a", rollup.inserts(a))
    assert totals() == {("s", "en", "v1"): (2, 15, 60), (None, None, "v1"): (2, 0, 0)}
    one = a.where("doc_id = 1")
    assert store.commit("b", rollup.revisions(one, facts(spark, [(1, "s", "en", "v2", 12, 41)])))
    assert totals() == {("s", "en", "v1"): (1, 5, 20), ("s", "en", "v2"): (1, 12, 41), (None, None, "v1"): (2, 0, 0)}
    spark.createDataFrame([("x", "x", "x", 9, 9, 9)], rollup._DELTA).write.parquet(str(tmp_path / "r/delta-lost"))  # died before its log entry
    store.compact()
    assert store.commit("c", rollup.deletes(a.where("doc_id = 2"))) and not store.commit("b", rollup.inserts(a))
    assert totals() == {("s", "en", "v2"): (1, 12, 41), (None, None, "v1"): (2, 0, 0)}
    assert store.commit("none", rollup.inserts(a.where("false")))
    store.compact()
    assert totals() == {("s", "en", "v2"): (1, 12, 41), (None, None, "v1"): (2, 0, 0)}


def test_counts(clashing, no_docs, tokenizer):
    got = Counter((r.doc_id, r.n_tokens, r.n_chars) for r in rollup.counted(clashing, queries.tokenizer_path(), "v").collect())
    assert got == Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids), len(t or "")) for d, t, *_ in awkward_docs())
    assert rollup.counted(no_docs, queries.tokenizer_path(), "v").count() == 0


def test_rollup_of_repeated_ids(spark, tokenizer, tmp_path):
    rows = [(1, "a b", "en", "s"), (1, "c d", "en", "s"), (2, "a b", "en", "s"), (2, "e", "de", "t"), (3, "e", "de", "t"), (3, "f", "en", "t"), (3, "f", "en", "t"), (None, "f", "en", "t"), (None, None, None, None), (5, "", "fr", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer): r.n_docs for r in queries.op9_token_rollup(spark, str(tmp_path)).collect()}
    # one row of each text stays: "a b" and "c d" of 1, "e" of 2, "f" without an id, and one empty one
    assert got == {("s", "en", "byte_bpe_50k+end"): 2, ("t", "de", "byte_bpe_50k"): 1, ("t", "en", "byte_bpe_50k+end"): 1, (None, None, "byte_bpe_50k"): 1}


def test_rollup_query_against_brute_force(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in queries.op9_token_rollup(spark, sf).collect()}
    want, seen = {}, set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        if r.text in seen:
            continue
        seen.add(r.text)
        english = r.lang == "en"
        key = (r.source, r.lang, "byte_bpe_50k+end" if english else "byte_bpe_50k")
        old = want.get(key, (0, 0, 0))
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + english
        want[key] = (old[0] + 1, old[1] + n, old[2] + len(r.text))
    assert got == want


# ---- toxicity


def plain_clauses(text, lexicon):
    """The rules of the grammar, read as sentences: a list of the outputs that each clause matches."""
    clauses, clause = [], []
    for raw in (text or "").split():
        word = raw.lower().strip(toxicity._STRIP)
        insult = lexicon.get(word) == 1 or any(lexicon.get(word[:n]) == 0 for n in toxicity.STEMS)
        clause.append((word, insult))
        if raw[-1] in toxicity._ENDS:
            clauses, clause = [*clauses, clause], []
    out = []
    for clause in [*clauses, clause]:
        kind = lambda i, words: 0 <= i < len(clause) and not clause[i][1] and clause[i][0] in words  # noqa: E731, B023
        found = set()
        for i, (word, insult) in enumerate(clause):
            threat = not insult and word in toxicity.THREATS and any(kind(i - d, toxicity.INTENTS) for d in range(1, 5))
            target = any(kind(i + d, toxicity.TARGETS) for d in (-4, -3, -2, -1, 1, 2, 3, 4))
            if (insult and (target or len(clause) > 1)) or (threat and target):
                negated = any(kind(i - d, toxicity.NEGATIONS) for d in range(1, 4))
                reported = any(kind(i - d, toxicity.REPORTS) for d in range(1, 7))
                found.add(toxicity.hit(threat, negated + 2 * reported + 4 * target))
        out.append(found)
    return out


def test_grammar_marks_clauses():
    insult, threat, lexicon = toxicity.hit(False), toxicity.hit(True, toxicity.TARGETED), {"idiot": 1, "lowe": 0}
    machine = toxicity.Machine(lexicon)

    def at(text):
        counts = machine.counts(text)
        return {} if counts is None else {s: int(n) for s, n in zip(toxicity.OUTPUTS, counts) if n}

    assert at("what an idiot") == {insult: 1}
    assert at("You are an IDIOT!") == {insult + 4: 1} and at("idiot, that; Idiot you.") == {insult + 4: 1}
    assert at("that is not an idiot") == {insult + 1: 1}
    assert at("she said you are no idiot") == {insult + 7: 1}
    assert at("i will kill you") == {threat: 1} and at("you, i am going to kill them") == {threat: 1}
    assert at("he said i will not hurt you") == {threat + 3: 1}
    assert at("lowest sort und lowered. low idiotic") == {insult: 1}
    # words that stand alone, verbs without intent or target
    for text in ("idiot", "Idiot! idiot? IDIOT.", "kill", "kill you", "i will kill", "i will kill time. you", "nothing here", "", " "):
        assert at(text) == {}


def test_grammar_against_a_plain_interpreter():
    lexicon = {"idiot": 1, "moron": 1, "lowe": 0}
    machine, rng = toxicity.Machine(lexicon), random.Random(8)
    words = ["idiot", "moron.", "lowest", "kill", "hurt,", "will", "gonna", "you", "them!", "not", "never", "said", "wrote;", "word", "other", "thing", "it.", "plain"]
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
        want = Counter(x for c in plain_clauses(text, lexicon) for x in c)
        counts = machine.counts(text)
        assert Counter({s: int(n) for s, n in zip(toxicity.OUTPUTS, counts if counts is not None else []) if n}) == want, text


def test_toxicity_query_against_the_interpreter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op4_toxic_grammar(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        counts = Counter(x for c in plain_clauses(r.text, model.lexicon) for x in c)
        z = model.weights[0] + sum(min(np.log2(1 + counts[s]), 3) * w for s, w in zip(toxicity.OUTPUTS, model.weights[1:]))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9


def toxic_rows(n):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(i, rng.randrange(20, 60)).split(), i % 5 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkel", "grunto", "vexu" + rng.choice(["a", "bim", "con", "do", "el", "fin", "gra", "hul"])]))
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = toxic_rows(900)
    docs = spark.createDataFrame(rows, DOCS)
    labels += [labels[0], (None, 1, 1), (5, 1, None)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, df)
    assert {"zorkel", "grunto"} <= set(model.lexicon) and model.lexicon.get("vexu") == 0
    got = toxicity.score(docs, model).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in out) / len(out)
    assert right >= 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_read(spark):
    rows, labels = toxic_rows(300)
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, quality int, toxic int"
    flip = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, schema)) for x in (labels, flip))
    assert one.lexicon == two.lexicon and np.allclose(one.weights, two.weights)


def test_toxicity_edges(spark, clashing, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(clashing, none).collect()
    assert len(got) == len(awkward_docs()) and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity(no_docs, none).count() == 0
