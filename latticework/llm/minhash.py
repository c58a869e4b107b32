"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature: sigma sends each shingle to a cell of a circle of 2^32 cells, pi is one permutation of the
cells, and coordinate k is the least pi over the shingles' cells after turning the circle by k steps.
Two permutations thus give all `K` coordinates.

Candidates: documents that agree in one of `BANDS` bands of `ROWS` coordinates. A pair at similarity
0.75 is missed with probability (1 - 0.75^4)^40 = 3e-7. Equal shingle sets (by 128-bit digest) are
collapsed first, so a group of copies is one node however large it is. In each bucket every member is
compared with the bucket's least member only, where signatures allow a link (95 of 160 four-bit
coordinates agree; 122 are expected at 0.75, with deviation 5.3); first each member with the least of
these, then, where the two are not in one component yet, with the others. So these links grow with
members. Links are checked on full sets of 64-bit shingle hashes.

Buckets of three or more that still hold several components are compared whole, in two steps. First
signatures alone meet, up to `CAP` members a task, and tell which members may be linked to another
component. Then only the texts of these meet, and a task finds all intersections of their full sets as
a matrix product and returns a spanning forest of the links, never pairs. Larger buckets are cut into
parts: all pairs of parts meet but for those within the bucket's largest component. So every pair that
shares any bucket is compared or connected otherwise; what grows with the square of a bucket, and only
of its members outside the largest component, are rows of ids and signatures, never texts of members
without a partner.

Edge cases. Null or blank text: empty set, linked with nothing. Rows with one doc_id are one document.
Null doc_id: its row comes back with null component_id, kept, linked with nothing. Empty table: empty
result. Extra columns: ignored by `near_classes`, kept by `near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as T
from .common import cut, drop_written, map_arrow, release, written
from .components import components

K, ROWS = 160, 4
BANDS = K // ROWS
AGREE = 95
SHINGLE = 5
#: Members of a bucket that meet in one task.
CAP = 800
#: Copies above which a class of equal sets is sent out instead of shuffled to.
HOT = 1000
#: Up to this many document ids (long) go to all executors, to fetch their texts without a shuffle.
BROADCAST_IDS = 200_000
#: Members that one task compares with one leader in a row.
SALT = 1000
_TURN = np.uint32(0x9E3779B1)
_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>"


def signatures(flat: np.ndarray, ptr: np.ndarray, k: int = K) -> np.ndarray:
    """(sets, k) uint32 coordinates; sets must not be empty."""
    out = np.empty((len(ptr) - 1, k), np.uint32)
    cells = (T.mix(flat ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(ptr) - 1:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + 32768, "right")) - 1)
        cell, at = cells[ptr[i] : ptr[j]], ptr[i:j] - ptr[i]
        x, y = np.empty_like(cell), np.empty_like(cell)
        turn = np.uint32(0)
        for c in range(k):
            np.add(cell, turn, out=x)  # the circle turned by c steps
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # pi
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[i:j, c] = np.minimum.reduceat(x, at)
            with np.errstate(over="ignore"):
                turn = np.uint32((int(turn) + int(_TURN)) & 0xFFFFFFFF)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        key = T.mix((key ^ wide[:, :, r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
    return key.view(np.int64)


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates in a 64-bit number."""
    low = (sig & np.uint32(15)).astype(np.uint64).reshape(len(sig), K // 16, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, buf, offsets in T.chunks(batch.column(1)):
            flat, ptr = T.shingle_sets(buf, offsets, SHINGLE)
            sizes = np.diff(ptr)
            full = np.flatnonzero(sizes)
            own = np.append(ptr[:-1][full], len(flat))
            digests = [np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)]
            keys, sig = np.zeros((0, BANDS), np.int64), np.zeros((0, K // 16), np.int64)
            if len(full):
                for digest, seed in zip(digests, (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5)):
                    digest[full] = np.add.reduceat(T.mix(flat ^ np.uint64(seed)), own[:-1]).view(np.int64)
                coordinates = signatures(flat, own)
                keys, sig = band_keys(coordinates), packed(coordinates)
            lists = []
            for values in (keys, sig):
                ends = np.zeros(b - a + 1, np.int32)
                np.cumsum((sizes > 0) * values.shape[1], out=ends[1:])
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1))))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), *lists], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set digest, band keys and four bits of each coordinate, for every row."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sign, _SCHEMA)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.75 or more."""
    if not len(x) or not len(y):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, role, id, text), sorted: a leader's own row (role 0) comes before its members."""
    leader, held = None, []
    for batch in batches:
        leaders, roles, ids = (batch.column(i).to_pylist() for i in (0, 2, 3))
        a_out, b_out = [], []
        for a, b, buf, offsets in T.chunks(batch.column(4)):
            flat, ptr = T.shingle_sets(buf, offsets, SHINGLE)
            for i in range(a, b):
                s = flat[ptr[i - a] : ptr[i - a + 1]]
                if roles[i] == 0:
                    held = [*(held if leader == leaders[i] else []), s.copy()]
                    leader = leaders[i]
                elif leader == leaders[i] and any(_linked(x, s) for x in held):
                    a_out.append(leaders[i])
                    b_out.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked, checked on full shingle sets."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("n"))
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), "b")
    row = lambda role, c: dealt.select(F.col("a").alias("leader"), "salt", F.lit(role).alias("role"), F.col(c).alias("id"))
    wanted = cut(row(1, "b").unionByName(row(0, "a").distinct()))
    rows = _texts_of(docs, wanted).select("leader", "salt", "role", "id", "text")
    return map_arrow(rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role"), _verify, "a long, b long")


def _alike(x: str, y: str) -> Column:
    """Whether sizes and signatures allow a similarity of 0.75."""
    fold = lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1))
    differ = F.lit(0)
    for i in range(K // 16):
        v = F.get(f"{x}_sig", F.lit(i)).bitwiseXOR(F.get(f"{y}_sig", F.lit(i)))
        v = fold(v)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        differ = differ + F.bit_count(v.bitwiseAND(F.lit(0x1111111111111111)))
    size = (4 * F.least(f"{x}_n", f"{y}_n")) >= (3 * F.greatest(f"{x}_n", f"{y}_n"))
    return size & (differ <= K - AGREE)


def _with_attributes(rows: DataFrame, attributes: DataFrame, side: str) -> DataFrame:
    """rows with `{side}_n` and `{side}_sig` of the document in column `side`."""
    own = attributes.select(F.col("id").alias(side), F.col("n_shingles").alias(f"{side}_n"), F.col("sig").alias(f"{side}_sig"))
    return rows.join(own, side)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one component."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c")), side, "left")
    return pairs.where(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, id, lead, component, size) of buckets of three or more that hold several components.

    Of buckets with the same members one stays.
    """
    named = members.where("size > 2").join(labels, members["id"] == labels["node"], "left")
    named = cut(named.select("key", "id", "lead", "size", F.coalesce("component", "id").alias("component")))
    groups = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    once = groups.groupBy("members", "n").agg(F.min("key").alias("key")).select("key")
    return cut(named.join(once, "key", "left_semi"))


def _tasks(mixed: DataFrame) -> DataFrame:
    """(task, id, lead, component): tasks of `CAP` members at most, in which all pairs of a bucket meet but for
    those within its largest component."""
    small = mixed.where(F.col("size") <= CAP).select(F.col("key").alias("task"), "id", "lead", "component")
    large = mixed.where(F.col("size") > CAP)
    counts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    major = cut(counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all")))
    if not major.limit(1).count():
        return small
    half = max(1, CAP // 2)
    large = large.join(major, "key").withColumns({"most_parts": F.ceil(F.col("most") / half).cast("int"), "few_parts": F.ceil((F.col("all") - F.col("most")) / half).cast("int")})
    own = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    task = lambda kind, *cols: F.xxhash64(F.lit(kind), "key", *cols).alias("task")
    rest = ("id", "lead", "component")
    most, few = large.where("component = major").withColumn("p", own(F.col("most_parts"))), large.where("component <> major").withColumn("q", own(F.col("few_parts")))
    return (
        small.unionByName(most.withColumn("q", every("few_parts")).select(task("most", "p", "q"), *rest))
        .unionByName(few.withColumn("p", every("most_parts")).select(task("most", "p", "q"), *rest))
        .unionByName(few.withColumn("o", every("few_parts")).select(task("few", F.least("q", "o"), F.greatest("q", "o")), *rest))
    )


def _alike_matrix(sizes: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """What `_alike` says of all pairs of rows."""
    n = len(sizes)
    differ = np.zeros((n, n), np.uint8)
    for column in np.ascontiguousarray(sigs.view(np.uint64).T):
        v = column[:, None] ^ column[None, :]
        v |= v >> np.uint64(1)
        v |= v >> np.uint64(2)
        differ += np.bitwise_count(v & np.uint64(0x1111111111111111))
    return (4 * np.minimum.outer(sizes, sizes) >= 3 * np.maximum.outer(sizes, sizes)) & (differ <= K - AGREE)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, id, lead, component, n_shingles, sig) sorted by task, to (task, id) of the members that
    signatures allow a link to a member of another component; pairs with the lead are tested already."""

    def found(rows):
        ids, lead, component, sizes, sigs = (np.concatenate(x) for x in zip(*rows))
        if len(ids) < 2 or (component == component[0]).all():
            return ids[:0]
        alike = _alike_matrix(sizes, sigs) & (component[:, None] != component[None, :])
        led = ids == lead
        alike[led], alike[:, led] = False, False
        return ids[alike.any(1)]

    def batch_of(out):
        tasks = np.concatenate([np.full(len(x), t, np.int64) for t, x in out]) if out else np.zeros(0, np.int64)
        ids = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(ids)], names=["task", "id"])

    now, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        tasks, *columns = (batch.column(i).to_numpy() for i in range(5))
        columns.append(batch.column(5).flatten().to_numpy().reshape(len(tasks), K // 16))
        edges = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
        out = []
        for a, b in zip(edges, edges[1:]):
            if tasks[a] != now:
                if rows:
                    out.append((now, found(rows)))
                now, rows = tasks[a], []
            rows.append([c[a:b] for c in columns])
        yield batch_of(out)
    if rows:
        yield batch_of([(now, found(rows))])


def _bucket_links(sets: list[np.ndarray], ids: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets: exact intersections by blocks of columns."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        block = np.zeros((n, min(width, int(column[j - 1]) - a + 1)), np.float32)
        block[owner[i:j], column[i:j] - a] = 1
        both += block @ block.T
    sizes = np.array([len(x) for x in sets], np.float64)
    linked = 100 * both.astype(np.float64) >= 75 * (sizes[:, None] + sizes[None, :] - both)
    out, todo = [], np.ones(n, bool)
    for start in range(n):
        if todo[start]:
            todo[start], stack = False, [start]
            while stack:
                i = stack.pop()
                near = np.flatnonzero(linked[i] & todo)
                todo[near] = False
                stack += near.tolist()
                out += [(ids[i], ids[j]) for j in near.tolist()]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, id, text) sorted by task; a task's members may span batches."""
    now, sets, ids = None, [], []

    def batch_of(links):
        links = [(min(x), max(x)) for x in links if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        tasks, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for a, b, buf, offsets in T.chunks(batch.column(2)):
            flat, ptr = T.shingle_sets(buf, offsets, SHINGLE)
            for i in range(a, b):
                if tasks[i] != now:
                    out += _bucket_links(sets, ids) if len(sets) > 1 else []
                    now, sets, ids = tasks[i], [], []
                sets.append(flat[ptr[i - a] : ptr[i - a + 1]].copy())
                ids.append(names[i])
        yield batch_of(out)
    yield batch_of(_bucket_links(sets, ids) if len(sets) > 1 else [])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (id, ...) with texts; few wanted ids pick the texts before the shuffle."""
    ids = wanted.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"], "left_semi")
    return wanted.join(docs.withColumnRenamed("doc_id", "id"), "id")


def _representatives(full: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, rep) of every document; large classes are looked up where the documents lie."""
    key = ["d1", "d2", "n_shingles"]
    docs, classes = full.select("doc_id", *key), classes.select(*key, "rep", "copies")
    hot = cut(classes.where(F.col("copies") > HOT).drop("copies"))
    if 0 < hot.count() <= BROADCAST_IDS:
        rest = docs.join(F.broadcast(hot), key, "left_anti").join(classes.drop("copies"), key)
        docs = docs.join(F.broadcast(hot), key).unionByName(rest)
    else:
        docs = docs.join(classes.drop("copies"), key)
    return docs.select("doc_id", "rep")


def _compared(tasks: DataFrame, attributes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each task, from full sets of the members under suspicion."""
    rows = tasks.join(attributes, "id").select("task", "id", "lead", "component", "n_shingles", "sig")
    suspects = cut(map_arrow(rows.repartition("task").sortWithinPartitions("task", "id"), _suspects, "task long, id long").distinct())
    rows = _texts_of(texts, suspects).select("task", "id", "text")
    return map_arrow(rows.repartition("task").sortWithinPartitions("task", "id"), _compare, "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.where("doc_id IS NOT NULL")
    signed = written(sign(docs), "minhash")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("d1", "d2", "n_shingles", "copies", F.col("x.doc_id").alias("rep"), "x.bands", "x.sig"), "classes")
    named = cut(_representatives(full, classes))
    # texts that share a doc_id are one document
    least = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = named.join(least, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))
    attributes = classes.select(F.col("rep").alias("id"), "n_shingles", "sig")
    banded = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("z"), F.count(F.lit(1)).alias("size")).where("lead < z").drop("z")
    members = written(banded.join(buckets, "key"), "members")

    # each member with the least ones of its buckets: the least of these first, the others if still apart
    pairs = members.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    alike = _with_attributes(_with_attributes(pairs, attributes, "a"), attributes, "b").where(_alike("a", "b"))
    alike = cut(alike.select("a", "b").distinct())
    release(spark)
    first = alike.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(links.unionByName(_confirmed(first, texts)))
    others = cut(_apart(alike.join(first, ["a", "b"], "left_anti"), components(links)))
    links = cut(links.unionByName(_confirmed(others, texts)))
    release(spark)
    # what shares a bucket but neither is linked with its least member
    tasks = _tasks(_mixed(members, components(links)))
    links = cut(links.unionByName(_compared(tasks, attributes, texts)))
    labels = components(links)
    release(spark)

    final = named.join(labels, named["rep"] == labels["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    final = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))
    out = cut(out)
    for folder in (members, classes, signed):
        drop_written(folder)
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents without near copies of a document with a lesser doc_id; all columns stay.

    Ids of copies go to where documents lie, if they are few by count; else texts move once.
    """
    gone = cut(near_classes(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
