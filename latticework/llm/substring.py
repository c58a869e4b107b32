"""Repeated passages by prefix-partitioned, sparse suffix trees.

A window is `WINDOW` consecutive words. A window of a document is a repeat if its words also start in
a document with a lesser doc_id; words covered by repeats are removed.

Suffixes are partitioned by words that they hold near their beginning. Every window has an anchor, the
run of `GRAM` words in it with the least hash; equal windows have equal anchors at equal places, so
suffixes need to meet only suffixes with the same anchor, and about two in forty positions are anchors.
Anchors of one document alone cannot hold a repeat and end here, before any text moves. For the others
the words that their windows span are sent to the anchor's group, where the suffix subtree of these spans
is built from sorted suffixes and the common prefixes of neighbours. Its internal nodes of `WINDOW` words
or more are the repeats: every suffix takes the deepest one above it that also holds a lesser document,
and that node's words are a span to remove.

The shared words are lengthened until a group fits a task. Groups above `GROUP` anchors are split by the
`_CORE` words that all windows of a block hold, a block being up to `BLOCK` windows at fixed places about
the anchor; cores of one document end here. Groups of cores that are still too large are split by the full
depth: there the shared words are a deep node themselves, and its least document comes from a
min-aggregate that is combined before the shuffle. Windows go as whole blocks first, so a passage that
very many documents share moves as a few blocks a document, and only the first document of each block
looks its windows up one by one.

Equal word sequences are collapsed first: of a group of copies only the least document enters the
trees, as it holds the least doc_id of each of their windows; the others are repeats as a whole.

Edge cases. Null text: no words. Texts below `WINDOW` words: nothing removed. Null doc_id: neither
removed nor removing. Rows with one doc_id do not remove each other's words. Empty table: empty
result. Extra columns are ignored by `repeated_passages` and kept by `passage_dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as T
from .common import cut, drop_written, map_arrow, written

WINDOW = 50
GRAM = 10
#: Anchors of a group that one task takes whole.
GROUP = 500
BLOCK = 8
#: Up to this many document ids (long) go to all executors, to pick their texts before a shuffle.
BROADCAST_IDS = 200_000
#: Up to this many anchors (9 bytes) go to all executors.
BROADCAST_ANCHORS = 400_000
_SPAN = WINDOW - GRAM + 1
#: Words that all windows of a block hold.
_CORE = WINDOW - BLOCK + 1
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, last window, anchor) for all runs of windows with one anchor."""
    grams = T.window_hashes(hashes, GRAM)
    has = words.counts >= WINDOW
    if not has.any():
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keys, _SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = np.where(has, words.counts - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    local = np.arange(n.sum()) - begin[text]
    at = least[local + words.ptr[:-1][text]]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(at)) - 1
    return text[lo], grams[at[lo]], local[lo], local[hi], at[lo] - words.ptr[:-1][text[lo]]


def _digests(words: T.Words, hashes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    out = []
    for base in (int(T._STEP[60]), int(T._STEP[61])):  # noqa: SLF001
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * T.powers(np.uint64(base), len(hashes)), out=sums[1:], dtype=np.uint64)
        back = T.powers(np.uint64(pow(base, -1, 2**64)), len(hashes) + 1)
        out.append(T.mix((sums[words.ptr[1:]] - sums[words.ptr[:-1]]) * back[words.ptr[:-1]] + words.counts.astype(np.uint64)).view(np.int64))
    return out


_SCANNED = "doc_id long, body long, n_words long, c1 long, c2 long, sha string, anchor array<long>, lo array<int>, hi array<int>, mid array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, buf, offsets in T.chunks(batch.column(1)):
            words = T.Words(buf, offsets)
            hashes = words.hashes(lower=False)
            text, anchor, lo, hi, mid = anchors(words, hashes)
            ends = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
            column = lambda x, t: pa.ListArray.from_arrays(ends, pa.array(x.astype(t)))
            raw = buf.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[s:e].split())).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            c1, c2 = _digests(words, hashes)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(c1), pa.array(c2), pa.array(sha), column(anchor.view(np.int64), np.int64), column(lo, np.int32), column(hi, np.int32), column(mid, np.int32)], names=["doc_id", "body", "n_words", "c1", "c2", "sha", "anchor", "lo", "hi", "mid"])


def _same(words: T.Words, hashes: np.ndarray, batch: pa.RecordBatch, a: int) -> np.ndarray:
    """Whether a row's text is the one that its anchors were found in (rows may share a doc_id)."""
    c1, c2 = _digests(words, hashes)
    n = len(c1)
    return (c1 == batch.column(2).slice(a, n).to_numpy()) & (c2 == batch.column(3).slice(a, n).to_numpy())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, c1, c2, anchor, lo, hi) to (anchor, doc_id, c1, c2, lo, words of the anchor's windows)."""
    for batch in batches:
        for a, b, buf, offsets in T.chunks(batch.column(1)):
            words = T.Words(buf, offsets)
            same = _same(words, words.hashes(lower=False), batch, a)
            raw = buf.tobytes()
            rows = [[], [], [], [], [], []]
            for i in np.flatnonzero(same).tolist():
                doc, c1, c2 = (batch.column(k)[a + i].as_py() for k in (0, 2, 3))
                p = int(words.ptr[i])
                for anchor, lo, hi in zip(*(batch.column(k)[a + i].as_py() for k in (4, 5, 6))):
                    span = raw[words.starts[p + lo] : words.ends[p + hi + WINDOW - 1]]
                    for column, value in zip(rows, (anchor, doc, c1, c2, lo, b" ".join(span.split()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "doc_id", "c1", "c2", "lo", "words"])


_BLOCKS = "core long, b1 long, b2 long, doc_id long, c1 long, c2 long, at int, w1 array<long>, w2 array<long>"


def _full_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, c1, c2, anchor, lo, hi, mid) to blocks of windows: hash of the core, hash of the
    block, document, first window, and hashes of its windows. Blocks end at multiples of `BLOCK` before the
    anchor; the core of a place is the `_CORE` words that all windows there hold, whichever a run has."""
    for batch in batches:
        for a, b, buf, offsets in T.chunks(batch.column(1)):
            words = T.Words(buf, offsets)
            hashes = words.hashes(lower=False)
            rows = np.flatnonzero(_same(words, hashes, batch, a))
            lists = [[batch.column(k)[a + int(i)].as_py() for i in rows] for k in (5, 6, 7)]
            row = np.repeat(rows, [len(x) for x in lists[0]])
            lo, hi, mid = (np.array([v for x in one for v in x], np.int64) for one in lists)
            n = hi - lo + 1
            run = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - (np.cumsum(n) - n)[run] + lo[run]
            place = (mid[run] - at) // BLOCK
            new = np.ones(len(at), bool)
            new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first, len(at))
            where = at + words.ptr[:-1][row[run]] if len(at) else at
            both = [T.window_hashes(hashes, WINDOW, seed)[where] for seed in (20, 21)] if len(at) else [np.zeros(0, np.uint64)] * 2
            size = np.diff(ends).astype(np.uint64)
            # first and last window span the block's words
            names = [T.mix(w[first] * T._STEP[50] + w[ends[1:] - 1] * T._STEP[51] + size).view(np.int64) for w in both] if len(at) else [np.zeros(0, np.int64)] * 2  # noqa: SLF001
            core = np.zeros(0, np.int64)
            if len(at):
                of_block = run[first]
                core = T.window_hashes(hashes, _CORE, 22)[words.ptr[:-1][row[of_block]] + mid[of_block] - BLOCK * place[first]].view(np.int64)
            owner = pa.array(row[run[first]] + a if len(at) else np.zeros(0, np.int64))
            keys = [batch.column(k).take(owner) for k in (0, 2, 3)]
            arrays = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.view(np.int64))) for w in both]
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(names[0]), pa.array(names[1]), *keys, pa.array(at[first].astype(np.int32)), *arrays], names=["core", "b1", "b2", "doc_id", "c1", "c2", "at", "w1", "w2"])


def _hot_repeats(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, c1, c2, begin, stop) of repeated windows in blocks, from min-aggregates of documents; a
    written table that it reads)."""
    # checkpointed, so that the joins read two shuffles, which adaptive execution can split
    least = cut(blocks.groupBy("b1", "b2").agg(F.min("doc_id").alias("least")))
    known = blocks.join(least, ["b1", "b2"])
    copies = known.where("doc_id > least").select("doc_id", "c1", "c2", F.col("at").alias("begin"), (F.col("at") + F.size("w1") - 1 + WINDOW).cast("int").alias("stop"))
    own = known.where("doc_id = least").select("doc_id", "c1", "c2", "at", F.posexplode(F.arrays_zip("w1", "w2")).alias("k", "w"))
    windows = written(own.select("w.w1", "w.w2", "doc_id", "c1", "c2", (F.col("at") + F.col("k")).cast("int").alias("at")), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least")
    first = cut(first)
    deep = windows.join(first, ["w1", "w2"]).where("doc_id > least").select("doc_id", "c1", "c2", F.col("at").alias("begin"), (F.col("at") + WINDOW).cast("int").alias("stop"))
    return copies.unionByName(deep), windows


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Words (4 bytes each) that two suffixes have in common at their beginning, `known` or more."""
    low, high = known, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if a[: 4 * mid] == b[: 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def subtree(rows: list[tuple[int, bytes]], depth: int = WINDOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(leaves, nodes) of the suffix tree of rows (document, words), but for what lies above `depth`.

    Leaves are (document, row, place) in the order of suffixes; words become 4-byte numbers, so suffixes
    sort as bytes. Nodes are the internal nodes of `depth` or deeper, (depth, first leaf, leaf behind the
    last), made from the common prefixes of neighbours with a stack; parents come before children.
    """
    number: dict[bytes, bytes] = {}
    suffixes = []
    for r, (doc, text) in enumerate(rows):
        codes = b"".join([number.setdefault(w, len(number).to_bytes(4, "big")) for w in text.split(b" ")])
        suffixes += [(codes[4 * j :], doc, r, j) for j in range(len(codes) // 4 - depth + 1)]
    suffixes.sort()
    nodes, stack, reach = [], [], 4 * depth
    for i in range(1, len(suffixes) + 1):
        a = suffixes[i - 1][0]
        both = _agree(a, suffixes[i][0], depth) if i < len(suffixes) and a[:reach] == suffixes[i][0][:reach] else 0
        first = i - 1
        while stack and stack[-1][0] > both:
            size, first = stack.pop()
            nodes.append((size, first, i))
        if both and (not stack or stack[-1][0] < both):
            stack.append((both, first))
    nodes.sort(key=lambda n: (n[1], -n[2], n[0]))
    return [s[1:] for s in suffixes], nodes


def repeats_of(rows: list[tuple[int, bytes]], depth: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(row, place, words): for every suffix the deepest node above it that also holds a lesser document."""
    leaves, nodes = subtree(rows, depth)
    found: dict[int, int] = {}
    for size, a, b in nodes:
        least = min(leaves[a:b])[0]
        for i in range(a, b):
            if leaves[i][0] > least:
                found[i] = size
    for i, size in found.items():
        yield leaves[i][1], leaves[i][2], size


def _spans(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans (begin, stop) as disjoint spans."""
    out: list[list[int]] = []
    for begin, stop in sorted(parts):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([begin, stop])
    return [tuple(x) for x in out]


_REPEATS = "doc_id long, c1 long, c2 long, begin int, stop int"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; each anchor's group becomes a subtree. A group may span batches."""

    def repeats(group):
        if len({g[0] for g in group}) < 2:
            return
        parts: dict[int, list[tuple[int, int]]] = {}
        for r, j, size in repeats_of([(g[0], g[4]) for g in group]):
            begin = group[r][3] + j
            parts.setdefault(r, []).append((begin, begin + size))
        for r, own in parts.items():
            for begin, stop in _spans(own):
                yield *group[r][:3], begin, stop

    def batch_of(rows):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "c1", "c2", "begin", "stop"])

    now, group = None, []
    for batch in batches:
        out = []
        for anchor, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if anchor != now:
                out += repeats(group)
                now, group = anchor, []
            group.append(row)
        yield batch_of(out)
    yield batch_of(list(repeats(group)))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, c1, c2, spans) to the words that stay."""
    for batch in batches:
        rows = [[], [], [], [], []]
        for doc, text, c1, c2, spans in zip(*(batch.column(k).to_pylist() for k in range(5))):
            raw = (text or "").encode()
            found = raw.split()
            keep = np.ones(len(found), bool)
            for s in spans:
                keep[s["begin"] : s["stop"]] = False
            kept = b" ".join([w for w, k in zip(found, keep.tolist()) if k])
            for column, value in zip(rows, (doc, c1, c2, int(len(found) - keep.sum()), kept.decode())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "c1", "c2", "n_removed", "kept"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined to `wanted` by doc_id; few wanted ids pick the texts before the shuffle."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"], "left_semi")
    return docs.join(wanted, "doc_id")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """(key, big) of keys that stand in two documents or more; big: too many rows for a task."""
    found = rows.groupBy(key).agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    return cut(found.select(key, (F.col("n") > GROUP).alias("big")))


def _of_shared(rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """rows with `big`, of shared keys only. Keys of large groups are looked up where the rows lie."""
    if shared.count() <= BROADCAST_ANCHORS:
        return rows.join(F.broadcast(shared), key)
    big = shared.where("big")
    if big.count() > BROADCAST_ANCHORS:
        return rows.join(shared, key)
    rest = rows.join(F.broadcast(big.select(key)), key, "left_anti")
    return rows.join(F.broadcast(big), key).unionByName(rest.join(shared.where("NOT big"), key))


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan, removals): scan has doc_id, xxhash64 of the text (body), n_words, c1, c2, sha of each row; removals the rows that lose
    words, by (doc_id, c1, c2), with n_removed and the kept words joined by spaces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = written(map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("body")), _scan, _SCANNED), "substring")
    key = ["c1", "c2", "n_words"]
    long_ones = scan.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    classes = long_ones.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    least = long_ones.join(classes, key)
    copies = least.where("doc_id > rep").select("doc_id", "c1", "c2", F.col("n_words").alias("n_removed"), F.lit("").alias("kept")).distinct()
    heads = least.where("doc_id = rep").select("doc_id", "c1", "c2", F.explode(F.arrays_zip("anchor", "lo", "hi", "mid")).alias("x")).select("doc_id", "c1", "c2", "x.*").distinct()
    heads = written(heads, "anchors")
    runs = F.collect_list(F.struct("anchor", "lo", "hi", "mid")).alias("x")
    found = cut(_of_shared(heads, _shared(heads, "anchor"), "anchor").groupBy("doc_id", "c1", "c2", "big").agg(runs))

    def with_text(found: DataFrame) -> DataFrame:
        return _texts_of(docs, found).select("doc_id", "text", "c1", "c2", F.col("x.anchor").alias("anchor"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"), F.col("x.mid").alias("mid"))

    def contexts(found: DataFrame) -> DataFrame:
        return map_arrow(with_text(found), _contexts, "anchor long, doc_id long, c1 long, c2 long, lo int, words binary")

    groups, used, repeats = contexts(found.where("NOT big")), [heads], None
    if found.where("big").limit(1).count():
        # longer prefixes: the core of each block, and the full depth where that is too frequent as well
        blocks = written(map_arrow(with_text(found.where("big")), _full_depth, _BLOCKS), "blocks")
        cored = _of_shared(blocks, _shared(blocks, "core"), "core")
        few = cored.where("NOT big").select("doc_id", "c1", "c2", F.col("core").alias("anchor"), F.col("at").alias("lo"), (F.col("at") + F.size("w1") - 1).alias("hi"), F.col("at").alias("mid"))
        groups = groups.unionByName(contexts(cut(few.groupBy("doc_id", "c1", "c2").agg(runs))))
        repeats, windows = _hot_repeats(cored.where("big").drop("core", "big"))
        used += [blocks, windows]
    trees = map_arrow(groups.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "lo"), _subtrees, _REPEATS)
    repeats = trees if repeats is None else trees.unionByName(repeats)
    spans = cut(repeats.groupBy("doc_id", "c1", "c2").agg(F.collect_set(F.struct("begin", "stop")).alias("spans")))
    for folder in used:
        drop_written(folder)
    some = map_arrow(_texts_of(docs, spans).select("doc_id", "text", "c1", "c2", "spans"), _own(_remove), "doc_id long, c1 long, c2 long, n_removed long, kept string")
    return scan.select("doc_id", "body", "n_words", "c1", "c2", "sha"), copies.unionByName(some.dropDuplicates(["doc_id", "c1", "c2"]))


def _own(kernel):
    """Drops rows whose text is not the one that the row's key was made from, then runs the kernel."""

    def run(batches):
        def own():
            for batch in batches:
                keep = []
                for a, _, buf, offsets in T.chunks(batch.column(1)):
                    words = T.Words(buf, offsets)
                    keep.append(_same(words, words.hashes(lower=False), batch, a))
                if keep:
                    yield batch.filter(pa.array(np.concatenate(keep)))

        return kernel(own())

    return run


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) for each row."""
    scan, removed = repeated_passages(docs)
    removed = removed.select(F.col("doc_id").alias("_d"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha"))
    on = (scan["doc_id"] == F.col("_d")) & (scan["c1"] == F.col("_c1")) & (scan["c2"] == F.col("_c2"))
    out = scan.join(removed, on, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """All rows; `text` of rows with repeats is their kept words joined by spaces. Rows may share a doc_id."""
    scan, removed = repeated_passages(docs)
    key = ["doc_id", "c1", "c2"]
    found = cut(scan.select(*key, F.col("body").alias("found_body")).distinct().join(removed.select(*key, F.col("kept").alias("found_kept")), key).withColumnRenamed("doc_id", "found_id").drop("c1", "c2"))
    own = (docs["doc_id"].cast("long") == found["found_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["found_body"])
    out = docs.join(found, own, "left")
    return out.select(*[F.coalesce(found["found_kept"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
