"""Best-fit packing by a grouping genetic algorithm on islands.

Every document becomes one piece, or pieces of exactly `CAPACITY` tokens after a shorter first one.
Full pieces are a sequence each. All others are dealt by hash to islands of about `ISLAND` pieces, so
a task holds one island whatever the table's size. An island evolves packings of its pieces:
crossover injects whole well-filled bins of one parent into the other, bins that would hold a piece
twice are removed, and their displaced pieces go back by best fit. Evolution ends early at the lower
bound, total tokens over capacity, which a packing often reaches at once.

Between two epochs elites migrate: as pieces of equal length are interchangeable, an island sends its
neighbour the length patterns of its best-filled bins, and the neighbour builds those bins from its
own pieces. Badly filled bins of neighbouring islands are packed again together, about `REPACK` pieces
at a time, level by level, until one group is left, nothing can be gained, or a level saves less than
one bin in a hundred (texts that cannot share a sequence); so waste does not grow with the number of
islands, and no group with the table.

Edge cases. Null or empty text: a piece of length 1 (the end token). Null doc_id and repeated rows:
each row is packed on its own. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, map_arrow, written
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2
ISLAND = 4096
#: Pieces of badly filled bins that are packed again together, at most about.
REPACK = 16_384
POPULATION, GENERATIONS = 4, 6
#: A bin with this much room or less is well filled.
SLACK = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pieces(tokenizer, capacity, end_id), _PIECES, tokens=True)


# ---- one island: packings are lists of bins, a bin is a list of item numbers


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, longest first, each in the fullest bin that has room; bins is extended."""
    room_of = [capacity - sum(sizes[i] for i in b) for b in bins]
    open_bins = sorted((r, k) for k, r in enumerate(room_of) if r)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(open_bins, (sizes[i], -1))
        if at == len(open_bins):
            k, room = len(bins), capacity
            bins.append([])
        else:
            room, k = open_bins.pop(at)
        bins[k].append(i)
        if room > sizes[i]:
            insort(open_bins, (room - sizes[i], k))
    return bins


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """Inject well-filled bins of `one` into `two`, drop bins with duplicates, best-fit the displaced."""
    full = [b for b in one if sum(sizes[i] for i in b) >= capacity - SLACK]
    take = [full[k] for k in rng.permutation(len(full))[: max(1, len(full) // 2)]] if full else []
    taken = {i for b in take for i in b}
    kept, loose = [list(b) for b in take], []
    for b in two:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    # the emptiest bins are opened as well, so that displaced pieces find new company
    kept.sort(key=lambda b: -sum(sizes[i] for i in b))
    for _ in range(min(len(kept) - len(take), 4)):
        if sum(sizes[i] for i in kept[-1]) < capacity - SLACK:
            loose += kept.pop()
    return best_fit(loose, sizes, kept, capacity)


def from_patterns(patterns: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Build immigrant bins (lists of lengths) from own items where there are such, best-fit the rest."""
    free = defaultdict(list)
    for i, s in enumerate(sizes):
        free[s].append(i)
    bins = []
    for p in patterns:
        if all(len(free[s]) >= n for s, n in Counter(p).items()):
            bins.append([free[s].pop() for s in p])
    return best_fit([i for f in free.values() for i in f], sizes, bins, capacity)


def evolve(sizes: list[int], seed: int, capacity: int = CAPACITY, immigrants: list[list[int]] | None = None, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing found; deterministic for sizes, seed and immigrants."""
    bound = -(-sum(sizes) // capacity)
    best = best_fit(list(range(len(sizes))), sizes, [], capacity)
    if len(best) <= bound:
        return best
    rng = np.random.Generator(np.random.PCG64(seed))
    fitness = lambda p: (len(p), -sum(sum(sizes[i] for i in b) ** 2 for b in p))
    people = [best]
    if immigrants:
        people.append(from_patterns(immigrants, sizes, capacity))
    while len(people) < POPULATION:
        order = rng.permutation(len(sizes)).tolist()
        half = order[: len(order) // 2]
        people.append(best_fit(order[len(order) // 2 :], sizes, best_fit(half, sizes, [], capacity), capacity))
    for _ in range(generations):
        people.sort(key=fitness)
        if len(people[0]) <= bound:
            break
        a, b = rng.integers(0, 2), rng.integers(1, len(people))
        people[-1] = crossover(people[a], people[b], sizes, capacity, rng)
        people[-2] = crossover(people[b], people[a], sizes, capacity, rng)
    return min(people, key=fitness)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, island long, bin long, fill int"
_ORDER = ["length", "doc_id", "piece", "ids_crc32", "start"]


def _ordered(pdf):
    return pdf.sort_values(_ORDER, ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)


def _placed(pdf, packing, sizes):
    pdf["bin"], pdf["fill"] = 0, 0
    where, fills = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int32)
    for k, b in enumerate(packing):
        where[b] = k
        fills[b] = sum(sizes[i] for i in b)
    pdf["bin"], pdf["fill"] = where, fills
    return pdf


def _pack(capacity: int, generations: int):
    def run(key, pdf):
        pdf = _ordered(pdf)
        sizes = pdf["length"].tolist()
        return _placed(pdf, evolve(sizes, int(key[0]), capacity, generations=generations), sizes)[["doc_id", "piece", "start", "length", "ids_crc32", "island", "bin", "fill"]]

    return run


def _repack(capacity: int):
    """Second epoch: an island's first packing against one seeded with its neighbour's patterns."""

    def run(key, own, guests):
        own = _ordered(own)
        sizes = own["length"].tolist()
        now = list(own.groupby("bin").indices.values())
        now = [b.tolist() for b in now]
        if sizes and len(now) > -(-sum(sizes) // capacity):
            other = evolve(sizes, int(key[0]) + 1, capacity, immigrants=[list(p) for p in guests["pattern"]])
            now = min(now, other, key=len)
        return _placed(own, now, sizes)[["doc_id", "piece", "start", "length", "ids_crc32", "island", "bin", "fill"]]

    return run


def _amounts(packed: DataFrame) -> tuple[int, int, int]:
    """Pieces, tokens and bins of packed pieces; a bin's lengths add up to its fill."""
    r = packed.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.col("length") / F.col("fill"))).first()
    return r[0], r[1] or 0, round(r[2] or 0)


def pack(parts: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for rows of `pieces`."""
    ship(parts.sparkSession)
    parts = written(parts, "pieces")
    whole = parts.where(F.col("length") == capacity)
    rest = parts.where(F.col("length") < capacity)
    n = max(1, -(-rest.count() // island))
    place = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n))
    dealt = rest.withColumn("island", place)
    # several islands evolve on after migration and when their loose bins meet; a single one does it here
    packed = cut(dealt.groupBy("island").applyInPandas(_pack(capacity, 1 if n > 1 else GENERATIONS), _PACKED))
    # elites migrate around the ring: patterns of full bins, a bounded number from each island
    if n > 1:
        full = packed.where(F.col("fill") == capacity).where(F.pmod("bin", F.lit(8)) == 0)
        patterns = full.groupBy("island", "bin").agg(F.sort_array(F.collect_list("length")).alias("pattern"))
        guests = patterns.select(F.pmod(F.col("island") + 1, F.lit(n)).alias("island"), "pattern")
        packed = cut(packed.groupBy("island").cogroup(guests.groupBy("island")).applyInPandas(_repack(capacity), _PACKED))
    done, level = [], 0
    loose = F.col("fill") < capacity - 8
    while n > 1:
        count, tokens, bins = _amounts(packed.where(loose))
        if bins <= -(-tokens // capacity):
            break
        groups = min(max(1, -(-count // REPACK)), n - 1)
        done.append(packed.where(~loose).withColumn("level", F.lit(level)))
        left = packed.where(loose).withColumn("island", F.floor(F.col("island") * groups / n)).drop("bin", "fill")
        packed = cut(left.groupBy("island").applyInPandas(_pack(capacity, GENERATIONS), _PACKED))
        n, level = groups, level + 1
        if bins - _amounts(packed)[2] < bins / 100:
            break
    done.append(packed.withColumn("level", F.lit(level)))
    binned = done[0]
    for d in done[1:]:
        binned = binned.unionByName(d)
    at = W.partitionBy("level", "island", "bin").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32", "start").rowsBetween(W.unboundedPreceding, -1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = binned.select(*names, (F.col("level").cast("long") * (1 << 56) + F.col("island") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(at), F.lit(0)).cast("long").alias("offset"))
    # full pieces: negative numbers, distinct among themselves
    alone = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
