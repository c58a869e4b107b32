"""Token counts as rollups that are maintained by deltas.

A batch holds signed facts: an insert adds a document's counts, a delete subtracts them, and a revision
(a new text or tokenizer version) subtracts the old and adds the new. A batch is aggregated by source,
language and tokenizer version, map-side first, and only that small delta is stored. Totals are the sum
of all deltas, so batches may come in any order.

Commits are idempotent. A batch's delta is written to a folder of its own; then a log entry, written
aside, is renamed to a name made from the batch id. A batch whose entry exists is not applied again, and
a folder without an entry (a driver or an executor was lost midway) is never read. `compact` folds
entries into one. The file system must rename atomically and refuse to rename onto a file, as HDFS does;
on others let one writer commit at a time.

Edge cases. Null source or language: a group of its own (null). Null text: zero tokens and characters.
Null or repeated doc_ids count as often as they stand. An empty batch commits an empty delta. A batch
id may be any text. Groups whose counts return to zero leave the totals. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash128, map_arrow, shared_dir
from .tokens import Encoder

KEYS = ("source", "lang", "tokenizer")
VALUES = ("n_docs", "n_tokens", "n_chars")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _count_kernel(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            tokens, chars = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                tokens.append(len(encoder.encode(text)) // 4)
                chars.append(len(text))
            rest = batch.columns[1:]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(chars, pa.int64()), *rest], names=["n_tokens", "n_chars", *batch.schema.names[1:]])

    return run


def counted(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars and a 128-bit hash (h1, h2) of the text for each row."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *hash128(F.coalesce(text, F.lit(""))))
    out = map_arrow(rows, _count_kernel(tokenizer), "n_tokens long, n_chars long, doc_id long, source string, lang string, h1 long, h2 long", tokens=True)
    return out.withColumn("tokenizer", F.lit(version))


def copies(rows: DataFrame) -> DataFrame:
    """Counted rows by text, source and language: keys, tokens and characters of one of them, `n_rows`, and
    `n_copies`, how many of them repeat a text. Of each text one row is no copy, that with the least
    (doc_id, source, language); so rows may share a doc_id, and a frequent text is combined before it moves.
    """
    text = ["h1", "h2"]
    groups = rows.groupBy(*text, *KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("doc_id")).alias("_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_chars").alias("n_chars"))
    groups = cut(groups.withColumn("_first", F.struct("_id", *KEYS)))
    first = groups.groupBy(*text).agg(F.min("_first").alias("_least"))
    out = groups.join(first, text)
    return out.select(*KEYS, "n_tokens", "n_chars", "n_rows", (F.col("n_rows") - F.col("_first").eqNullSafe(F.col("_least")).cast("long")).alias("n_copies"))


def inserts(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Facts that add rows; `times` names a column with how many rows each one stands for."""
    n = F.col(times) if times else F.lit(1).cast("long")
    return rows.select(*KEYS, n.alias("n_docs"), (n * F.col("n_tokens")).alias("n_tokens"), (n * F.col("n_chars")).alias("n_chars"))


def deletes(rows: DataFrame, times: str | None = None) -> DataFrame:
    return inserts(rows, times).select(*KEYS, *[(-F.col(v)).alias(v) for v in VALUES])


def revisions(old: DataFrame, new: DataFrame, times: str | None = None) -> DataFrame:
    return deletes(old, times).unionByName(inserts(new, times))


def _sums(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*KEYS).agg(*[F.sum(v).cast("long").alias(v) for v in VALUES])


class Rollup:
    """A rollup in a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.path}/_log"))

    def _entry(self, batch: str) -> str:
        return f"{self.path}/_log/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._entry(batch)))

    def commit(self, batch: str, facts: DataFrame) -> bool:
        """Apply a batch once; False if it has been applied before."""
        if self.committed(batch):
            return False
        folder = f"delta-{uuid.uuid4().hex}"
        _sums(facts).write.parquet(f"{self.path}/{folder}")
        return self._log(self._entry(batch), {"batch": batch, "folder": folder})

    def _log(self, name: str, entry: dict) -> bool:
        """Create a log entry; False if another writer was first. Readers see it whole or not at all."""
        part = self._path(f"{self.path}/_tmp-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = self._path(name)
        if not self._fs.exists(target) and self._fs.rename(part, target):
            return True
        self._fs.delete(part, False)
        return False

    def _entries(self) -> list[dict]:
        found = []
        for status in self._fs.listStatus(self._path(f"{self.path}/_log")):
            stream = self._fs.open(status.getPath())
            try:
                found.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        covered = {b for e in found for b in e.get("covers", ())}
        return [e for e in found if e["batch"] not in covered]

    def totals(self) -> DataFrame:
        folders = sorted(e["folder"] for e in self._entries())
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/{f}" for f in folders])
        return _sums(rows).where(" OR ".join(f"{v} <> 0" for v in VALUES))

    def compact(self) -> None:
        """Fold all committed deltas into one; their batches stay committed."""
        entries = self._entries()
        if len(entries) < 2:
            return
        folder, name = f"delta-{uuid.uuid4().hex}", f"compact-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{folder}")
        covers = sorted(e["batch"] for e in entries)
        self._log(self._entry(name), {"batch": name, "folder": folder, "covers": covers})


def new_rollup(spark: SparkSession) -> Rollup:
    return Rollup(spark, f"{shared_dir(spark)}/latticework-rollup-{uuid.uuid4().hex}")
