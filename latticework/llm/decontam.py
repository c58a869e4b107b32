"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased with white space collapsed. An item of m characters may differ by a
budget of k = floor(m * RATE) edits. It is split into k + 1 pieces; if it stands in a text within k
edits, at least one piece stands there unchanged. An Aho-Corasick automaton finds all piece hits of all
items in one pass over a text; around them the item's least edit distance to any stretch of the text is
computed by Myers' bit-parallel algorithm, on integers as long as the item. So no match is missed.

Texts are not shuffled and the result has one row for each (document, item) match. Items go to the
executors in blocks of about `BLOCK_CHARS` characters, with one pass over the texts for each block, so
what is broadcast is bounded however large the benchmark is.

Edge cases. Null or empty text or item: no match. Items below `SHORT` characters match whole words
only, as their letters stand inside others by chance. Repeated items match under each id; repeated documents each match. Null ids are kept
as null. Empty tables: empty result. Extra columns are ignored, and kept by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_key, without

RATE = 0.08
#: Shorter items match whole words only.
SHORT = 20
BLOCK_CHARS = 4_000_000
_SCHEMA = "doc_id long, item_id long, begin int, stop int, distance int, budget int, _r1 long, _r2 long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places."""
    edges = [len(item) * j // (budget + 1) for j in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """An item's bit masks for Myers' algorithm."""

    def __init__(self, item: str):
        self.m = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """(least edit distance to any stretch of text, end of the first such stretch)."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best, end = full, 0, self.m, self.m, 0
        masks = self.masks.get
        for j, c in enumerate(text):
            eq = masks(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(horizontal | up))
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1) & full
            up = ((minus << 1) & full) | (full & ~(vertical | plus))
            down = plus & vertical
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        # a short item keeps a space on both sides, as texts do, so that it matches whole words only
        self.items = [(i, f" {text} " if len(text) < SHORT else text, int(len(text) * rate)) for i, text in items]
        self.patterns: dict[int, Pattern] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for at, piece in split_pieces(text, budget):
                pieces.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, begin, end, distance, budget): the best match of each item that is within budget."""
        if not self.items:
            return
        text = f" {text} "
        found: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                found.setdefault(n, []).append(end + 1 - size - at)
        for n, starts in found.items():
            item_id, item, budget = self.items[n]
            if n not in self.patterns:
                self.patterns[n] = Pattern(item)
            best = None
            for a, b in self._windows(sorted(starts), len(item), budget):
                a = max(0, a)
                distance, end = self.patterns[n].best(text[a:b])
                if distance <= budget and (best is None or distance < best[1]):
                    best = (a + end, distance)
            if best:  # places without the spaces
                stop = min(best[0] - 1 - (len(item) > 1 and item[0] == " "), len(text) - 2)
                yield item_id, max(0, stop - len(item.strip())), stop, best[1], budget

    @staticmethod
    def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        a, b = starts[0] - k, starts[0] + m + k
        for s in starts[1:]:
            if s - k <= b:
                b = max(b, s + m + k)
            else:
                yield a, b
                a, b = s - k, s + m + k
        yield a, b


def _kernel(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = [[] for _ in range(8)]
            for doc, text, r1, r2 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for match in matcher.matches(normal(text.as_py())):
                    for column, value in zip(rows, (doc, *match, r1, r2)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "item_id", "begin", "stop", "distance", "budget", "_r1", "_r2"]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=names)

    return run


def _matches(rows: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """_SCHEMA for rows (doc_id, text, _r1, _r2)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        block = [(r.item_id, normal(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        block = sorted(((i, t) for i, t in block if t), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        hits = map_arrow(rows, _kernel(block, rate), _SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, begin, stop (places in the normalised text; begin is stop less the item's length),
    distance, budget: every item that stands in a text within its budget."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.lit(0).cast("long").alias(c) for c in ("_r1", "_r2")])
    return _matches(rows, benchmark, rate).drop("_r1", "_r2")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; all columns stay. Rows go by their text, whatever their doc_id."""
    hits = _matches(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key(F.col("text"))), benchmark, RATE)
    return without(docs, hits, docs["text"])
