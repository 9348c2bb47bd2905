"""Exact deduplication by a sharded cuckoo-filter index of content digests.

Each shard is a bucketised cuckoo filter: four 16-bit fingerprints to a bucket,
two candidate buckets to a key. A fingerprint hit is only a maybe, so each slot
keeps the whole digest beside it and a hit counts once that agrees. Live digests
can be inserted and deleted; when a chain of evictions gets too long, the shard
doubles and is rebuilt from its stored keys.

Every task indexes what it reads first, so a group of copies leaves a task as one
row however large it is. Those rows then meet in the shard of their digest,
sorted, so that a task holds one small range of digests at a time. Only ids and
digests are shuffled, never texts.

Defined results: a null text counts as empty, and all empty texts are one group;
a null id loses against any other; rows that repeat the id that stays are all
marked as kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch, small_batches


class CuckooIndex:
    """A cuckoo filter over byte digests, each with a value, that keeps its keys."""

    SLOTS, EVICTIONS = 4, 200

    def __init__(self, buckets: int = 256):
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.prints = [0] * (buckets * self.SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * self.SLOTS)
        self.values: list[Any] = [None] * (buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[-8:], "little")
        print_ = (h >> 48) or 1
        first = h & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x9E3779B1 >> 7)) & self.mask

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1. A fingerprint that agrees is checked against the stored digest."""
        print_, first, second = self._places(key)
        for bucket in (first, second):
            at = bucket * self.SLOTS
            for slot in range(at, at + self.SLOTS):
                if self.prints[slot] == print_ and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value: Any = None) -> None:
        """A live key's value is replaced."""
        slot = self.find(key)
        if slot >= 0:
            self.values[slot] = value
        elif (left := self._place(key, value)) is not None:
            self._grow(left)

    def _place(self, key: bytes, value: Any) -> tuple[bytes, Any] | None:
        """None, or the entry that found no place."""
        print_, bucket, second = self._places(key)
        for turn in range(self.EVICTIONS):
            for b in (bucket, second):
                for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot], self.values[slot] = print_, key, value
                        self.size += 1
                        return None
            out = second * self.SLOTS + (turn + print_) % self.SLOTS
            (print_, key, value), (self.prints[out], self.keys[out], self.values[out]) = (self.prints[out], self.keys[out], self.values[out]), (print_, key, value)
            bucket = second
            second = self._other(bucket, print_)
        return key, value

    def _grow(self, left: tuple[bytes, Any]) -> None:
        """Doubles until the stored keys and the one left over all have a place."""
        held, buckets = [*self.items(), left], self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(*x) is None for x in held):
                return

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, Any]]:
        return ((k, v) for p, k, v in zip(self.prints, self.keys, self.values, strict=True) if p)

    def __contains__(self, key: bytes) -> bool:
        return self.find(key) >= 0

    def __len__(self) -> int:
        return self.size


#: Entries a map task holds before it passes them on.
TASK_KEYS = 100_000
ENTRY = "digest binary, n_points long, doc_id long, copies long"


def normalised(text: Column) -> Column:
    """The text without space, tab, newline, vertical tab, form feed and carriage return."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\v\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original), digest (SHA-256 of the normalised text)."""
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))


def _rank(n_points: int, doc_id: int | None) -> tuple:
    return n_points, doc_id is not None, -(doc_id or 0)


def _absorb(index: CuckooIndex, columns: list[list]) -> None:
    """Adds entries; of two with one digest, the longer and then the smaller id stays."""
    for key, n, doc, copies in zip(*columns, strict=True):
        slot = index.find(key)
        if slot < 0:
            index.insert(key, (n, doc, copies))
        else:
            a, b, c = index.values[slot]
            index.values[slot] = ((n, doc) if _rank(n, doc) > _rank(a, b) else (a, b)) + (c + copies,)


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 10_000):
        part = rows[at : at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(3))],
            names=["digest", "n_points", "doc_id", "copies"],
        )


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        _absorb(index, [batch.column(c).to_pylist() for c in ("digest", "n_points", "doc_id")] + [[1] * len(batch)])
        if len(index) > TASK_KEYS:
            yield from _emit(index)
            index = CuckooIndex()
    yield from _emit(index)


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted, so all of a digest's lie between two flushes."""
    index, last = CuckooIndex(), b""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("digest", "n_points", "doc_id", "copies")]
        start = 0
        if len(index) > TASK_KEYS:
            while start < len(columns[0]) and columns[0][start] == last:
                start += 1
            _absorb(index, [c[:start] for c in columns])
            if start < len(columns[0]):
                yield from _emit(index)
                index = CuckooIndex()
        if start < len(columns[0]):
            _absorb(index, [c[start:] for c in columns])
            last = columns[0][-1]
    yield from _emit(index)


def build_index(keys: DataFrame) -> DataFrame:
    """One row for each live digest: digest, n_points, doc_id (the row that stays), copies.

    ``keys`` is what :func:`digests` gives. The result is the index's stored content: what
    :func:`update_index` changes and a shard is rebuilt from.
    """
    small_batches(keys.sparkSession)
    local = keys.select("digest", "n_points", "doc_id").mapInArrow(_index_task, ENTRY)
    return local.repartition("digest").sortWithinPartitions("digest").mapInArrow(_index_shard, ENTRY)


def update_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The index after new documents came and others went.

    ``inserted`` is what :func:`digests` gives; ``deleted`` holds a ``digest`` for each
    document that went, and a digest whose copies are all gone is deleted from the index.
    The index holds one row of each digest's copies, so after a deletion it can only name
    another where ``live``, the digests of all documents that are there afterwards, is
    given; of it only the rows of deleted digests are used. Without it the row that stays is
    not chosen anew while copies remain.
    """
    small_batches(index.sparkSession)
    rows = index.select("digest", "n_points", "doc_id", "copies")
    if deleted is not None and live is not None:
        touched = deleted.select("digest").distinct()
        rest = rows.join(touched, "digest", "left_anti").select(*rows.columns)
        if inserted is not None:
            rest = rest.unionByName(inserted.join(touched, "digest", "left_anti").select("digest", "n_points", "doc_id").mapInArrow(_index_task, ENTRY))
        again = live.join(touched, "digest", "left_semi").select("digest", "n_points", "doc_id").mapInArrow(_index_task, ENTRY)
        return rest.unionByName(again).repartition("digest").sortWithinPartitions("digest").mapInArrow(_index_shard, ENTRY)
    if inserted is not None:
        rows = rows.unionByName(inserted.select("digest", "n_points", "doc_id").mapInArrow(_index_task, ENTRY))
    if deleted is not None:
        gone = deleted.groupBy("digest").agg((-F.count("*")).alias("copies"))
        rows = rows.unionByName(gone.select("digest", F.lit(-1).cast("long").alias("n_points"), F.lit(None).cast("long").alias("doc_id"), "copies"))
    return rows.repartition("digest").sortWithinPartitions("digest", F.col("copies").desc()).mapInArrow(_update_shard, ENTRY)


def _update_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def live(done: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in done:
            index = CuckooIndex()
            _absorb(index, [batch.column(c).to_pylist() for c in ("digest", "n_points", "doc_id", "copies")])
            for key, value in list(index.items()):
                if value[2] <= 0:
                    index.delete(key)
            yield from _emit(index)

    return live(_index_shard(batches))


def exact_duplicates(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    The join with the index has one row a digest on its right, and adaptive execution may
    split a hot digest on its left.
    """
    small_batches(spark)
    keys = scratch(spark, digests(documents, doc_id, text), "digests")
    index = build_index(keys).select(F.col("digest").alias("_digest"), F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))
    return keys.join(index, keys["digest"] == index["_digest"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM k)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
