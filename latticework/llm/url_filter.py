"""URL filtering by rules compiled into a Bloom filter cascade.

The key universe is every distinct (host, path) of the corpus; a key is listed if a block list has it.
Level 1 of a cascade encodes the listed keys. Level 2 encodes those other keys of the universe that
level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until none is
left. The first level that rejects a key tells what it is: an odd level an unlisted key, an even one a
listed key. Over its universe the cascade is exact, in a few bits a key.

Keys are dealt to shards of about `SHARD_KEYS` by hash, one cascade each, so building is bounded. If
all cascades together are below `BROADCAST_BYTES`, urls are judged where they are read; else urls and
cascades meet by shard, cascades first, in a stream that holds one cascade at a time; urls of a shard
are salted, so that a frequent url is dealt over tasks.

Edge cases. Null url, or one without `://`: host and path empty, no rule, judged by the cascade like
any key. Repeated urls are judged alike. Null page_id stays. Empty table: empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkernel as T
from .common import cut, hash128, map_arrow

#: (verdict, host and path): a rule fits its host and all subdomains; the longest that fits wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
SHARD_KEYS = 8192
BROADCAST_BYTES = 32_000_000
SALTS = 32
MAX_LEVELS = 64
_LEVEL = "shard int, level int, n_bits long, n_hashes int, bits binary"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null without one. Equal lengths: first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    a = T.mix(h1 ^ T.mix(np.array([level * 2 + 1], np.uint64)))
    b = T.mix(h2 + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(n_hashes, dtype=np.uint64)[None, :]) % np.uint64(n_bits)


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels (bits, hashes, packed bits) of the cascade of one shard; no level if nothing is listed."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, np.ndarray]] = []
    while len(inside):
        rate = 0.5 if levels else min(0.5, max(1e-4, 0.7 * len(inside) / max(1, len(outside))))
        n_hashes = max(1, round(-np.log2(rate)))
        n_bits = max(64, int(np.ceil(1.4427 * n_hashes * len(inside))))
        bits = np.zeros(n_bits, bool)
        bits[_positions(h1[inside], h2[inside], len(levels), n_bits, n_hashes)] = True
        levels.append((n_bits, n_hashes, np.packbits(bits)))
        wrong = outside[bits[_positions(h1[outside], h2[outside], len(levels) - 1, n_bits, n_hashes)].all(1)]
        inside, outside = wrong, inside
        if len(levels) > MAX_LEVELS:
            raise RuntimeError("two keys of the universe have equal hashes")
    return levels


def probe(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys are listed."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    listed, open_ = np.full(len(h1), len(levels) % 2 == 1), np.arange(len(h1))
    for n, (n_bits, n_hashes, packed) in enumerate(levels):
        at = _positions(h1[open_], h2[open_], n, n_bits, n_hashes)
        hit = ((packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)
        listed[open_[~hit]] = n % 2 == 1
        open_ = open_[hit]
    return listed


def _build_kernel(key, table):
    listed = table.column("listed").to_numpy(zero_copy_only=False).astype(bool)
    levels = build(*(np.ascontiguousarray(table.column(c).to_numpy()) for c in ("h1", "h2")), listed)
    shard = key[0].as_py()
    columns = [[shard] * len(levels), range(len(levels)), [x[0] for x in levels], [x[1] for x in levels], [x[2].tobytes() for x in levels]]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["shard", "level", "n_bits", "n_hashes", "bits"])


def cascade(universe: DataFrame, shards: int) -> DataFrame:
    """One row a shard and level from keys (h1, h2, listed), which must be distinct."""
    ship(universe.sparkSession)
    keyed = universe.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "listed")
    return keyed.groupBy("shard").applyInArrow(_build_kernel, _LEVEL)


def _judge_kernel(cascades):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = cascades.value
        for batch in batches:
            listed = np.zeros(batch.num_rows, bool)
            shard, h1, h2 = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in ("shard", "h1", "h2"))
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
            for a, b in zip(edges, edges[1:]):
                at = order[a:b]
                if len(at):
                    listed[at] = probe(shards.get(int(shard[at[0]]), []), h1[at], h2[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed)], names=[*batch.schema.names, "listed"])

    return run


def _stream_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt, role, level): a shard's levels come before its urls."""
    now, levels = None, []
    for batch in batches:
        listed = np.zeros(batch.num_rows, bool)
        shard, salt, role, h1, h2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "role", "h1", "h2"))
        edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1])]).tolist() + [len(shard)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if (shard[a], salt[a]) != now:
                now, levels = (shard[a], salt[a]), []
            if role[a] == 0:
                part = batch.slice(a, b - a)
                levels += [(x["n_bits"], x["n_hashes"], np.frombuffer(x["bits"], np.uint8)) for x in part.select(["n_bits", "n_hashes", "bits"]).to_pylist()]
            else:
                listed[a:b] = probe(levels, np.asarray(h1[a:b], np.int64), np.asarray(h2[a:b], np.int64))
        keep = pa.array(role == 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("page_id", "host", "path")), pa.array(listed).filter(keep)], names=["page_id", "host", "path", "listed"])


def listed_pages(pages: DataFrame, listed: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, listed for pages (page_id, host, path).

    `listed` is the block list as a condition on host and path; it is evaluated on the distinct keys
    of the universe only, and pages are judged by the cascade alone.
    """
    spark = pages.sparkSession
    keyed = pages.select("page_id", "host", "path", *hash128(F.col("host"), F.col("path")))
    universe = cut(keyed.withColumn("listed", listed).groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-universe.count() // SHARD_KEYS))
    keyed = keyed.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    levels = cut(cascade(universe, shards))
    size = levels.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= broadcast_bytes:
        held: dict[int, list] = {}
        for r in levels.orderBy("shard", "level").collect():
            held.setdefault(r.shard, []).append((r.n_bits, r.n_hashes, np.frombuffer(r.bits, np.uint8)))
        return map_arrow(keyed, _judge_kernel(spark.sparkContext.broadcast(held)), f"{keyed._jdf.schema().toDDL()}, listed boolean").select("page_id", "host", "path", "listed")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    left = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("shard", "salt", F.lit(0).alias("role"), "level", "n_bits", "n_hashes", "bits", none("long", "page_id"), none("string", "host"), none("string", "path"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    right = keyed.select("shard", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("role"), F.lit(0).alias("level"), none("long", "n_bits"), none("int", "n_hashes"), none("binary", "bits"), "page_id", "host", "path", "h1", "h2")
    rows = left.unionByName(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role", "level")
    return map_arrow(rows, _stream_kernel, "page_id long, host string, path string, listed boolean")


def judge_urls(pages: DataFrame, rules=RULES, also_listed: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url).

    The block list is what the rules block, and keys without a rule that `also_listed` (a condition
    on host and path) names. Verdicts come from the cascade; `rule` tells which rule fits.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    other = F.coalesce(also_listed, F.lit(False)) if also_listed is not None else F.lit(False)
    judged = listed_pages(rows, F.when(verdict.isNotNull(), verdict == "block").otherwise(other), broadcast_bytes)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
