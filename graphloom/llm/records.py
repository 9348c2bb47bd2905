"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file is a row of records. A record is framed as ``length (8 bytes) | checksum of the length (4) | data | checksum of the
data (4)``, little-endian; checksums are CRC-32C, masked (rotated right by 15 bits, plus a constant), so that a checksum
over framed data does not vouch for itself. This is the framing that common training-data readers
take. The data of a record is a header of 16 bytes (id, number of ids, 2 or 4 bytes an id, whether the id is null) and the ids, two
bytes each where the tokenizer's vocabulary fits, else four; an odd number of two-byte ids is padded.

* **Writing.** Documents are dealt to tasks by ranges of the id, sorted, and encoded there, so nothing but the text
  is shuffled. A task hands out blocks of about ``BLOCK_BYTES``, ``FILE_BLOCKS`` for a file, through Spark's own text writer, whose
  line separator is the framed empty record: every block ends in one, and a cut file is noticed. Files
  come with the writer's commit protocol: lost tasks and second attempts leave none behind.
* **Index.** One pass over the committed files, some ``BLOCK_BYTES`` at a time, checks all frames and writes where each record
  is: file, offset, bytes, id, number of ids, and how many ids all records before it hold (ids are summed
  up by file, then over groups of files, then over groups).
* **Reading.** ``read`` goes through files in order. ``read_shuffled`` deals index rows out in a seeded random order and
  fetches each record by its offset, without reading others.

Defined results: a null or empty text is a record of the end id alone; a null id comes before all others; rows that
repeat an id are records of their own, in the order of their texts' hashes; a text of any length is one record (of 2 GB at most, as
any value in Spark); an empty table gives no records and an empty index. Only the id and the text are read, so further columns may
have any name. Damaged files raise ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read as read_table
from graphloom.llm.common import scratch, scratch_path, small_batches
from graphloom.llm.packing import _tokenizer, default_tokenizer, encode

#: Bytes of records after which a block ends, and blocks of a file.
BLOCK_BYTES, FILE_BLOCKS = 4 << 20, 32
#: Bytes of text for each task that writes.
TASK_BYTES = 64 << 20
END = 1
#: Files whose ids are summed up together in the index.
GROUP_FILES = 1000
#: Words whose checksums are found together.
WORDS = 1 << 20
#: Rotation and constant of the mask (fixed values of the framing).
ROTATE, DELTA = 15, 0xA282EAD8
#: The reflected polynomial of CRC-32C (a fixed value).
CASTAGNOLI = 0x82F63B78
HEADER = struct.Struct("<qIHH")
INDEX = "file string, part int, chunk int, offset long, bytes long, doc_id long, n_tokens long, own long"


@cache
def _steps(level: int) -> np.ndarray:
    """Four tables of 256: what a register becomes after ``4 * 2**level`` zero bytes, by each of its bytes."""
    if level == 0:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, table >> 1 ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
        out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(4):
            out = table[out & 0xFF] ^ out >> np.uint32(8)
        return out
    half = _steps(level - 1)
    return _advanced(half.ravel(), half).reshape(4, 256)


def _advanced(words: np.ndarray, steps: np.ndarray) -> np.ndarray:
    parts = words.view(np.uint8) if words.flags.c_contiguous else np.ascontiguousarray(words).view(np.uint8)
    return steps[0][parts[0::4]] ^ steps[1][parts[1::4]] ^ steps[2][parts[2::4]] ^ steps[3][parts[3::4]]


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(ROTATE) | crc << np.uint32(32 - ROTATE)) + np.uint32(DELTA)


def checksums(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The masked CRC-32C of each of several messages, which are given as 32-bit words end to end; none is empty."""
    counts = counts.astype(np.int64)
    upto = np.cumsum(counts)
    out, first = [np.zeros(0, np.uint32)], 0
    while first < counts.size:  # as many as there is room for
        begin = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, begin + WORDS, side="right")))
        out.append(_checksums(words[begin : int(upto[last - 1])], counts[first:last]))
        first = last
    return np.concatenate(out)


def _checksums(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of messages together.

    Neighbouring words are folded into one until each message is a single word: the checksum is linear, so
    ``fold(a, b)`` is ``a`` moved on over ``b``'s length, plus ``b``. Zeros in front of a message change nothing.
    """
    words = words.astype("<u4")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    words[first] ^= np.uint32(0xFFFFFFFF)
    words = _advanced(words, _steps(0))
    level = 0
    while counts.size and counts.max() > 1:
        odd = counts & 1
        if odd.any():
            words = np.insert(words, np.concatenate([[0], np.cumsum(counts)[:-1]])[odd == 1], 0)
        words = _advanced(np.ascontiguousarray(words[0::2]), _steps(level)) ^ words[1::2]
        counts = (counts + odd) // 2
        level += 1
    return masked(words ^ np.uint32(0xFFFFFFFF))


def framed(datas: list[bytes]) -> bytes:
    """Records end to end; the length of each data is a multiple of four and not 0."""
    sizes = np.array([len(d) for d in datas], "<u8")
    heads = checksums(sizes.view("<u4"), np.full(sizes.size, 2)).astype("<u4")
    bodies = checksums(np.frombuffer(b"".join(datas), "<u4"), sizes.astype(np.int64) // 4).astype("<u4")
    out = []
    for size, head, data, body in zip(sizes, heads, datas, bodies, strict=True):
        out += [size.tobytes(), head.tobytes(), data, body.tobytes()]
    return b"".join(out)


@cache
def empty_record() -> bytes:
    """The framed record without data, which ends a file."""
    head = checksums(np.zeros(2, "<u4"), np.array([2])).astype("<u4").tobytes()
    return bytes(8) + head + masked(np.zeros(1, np.uint32)).astype("<u4").tobytes()


def serialised(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """The data of a record."""
    body = ids.astype(f"<u{width}").tobytes()
    return HEADER.pack(doc_id or 0, ids.size, width, doc_id is None) + body + bytes(-len(body) % 4)


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the ids of a record's data."""
    doc_id, n, width, null = HEADER.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", n, HEADER.size)


def unframed(content: bytes, file: str = "", ended: bool = True) -> tuple[list[int], list[bytes]]:
    """Offsets and datas of all records with data; lengths, checksums and, with ``ended``, the last empty record are checked."""
    offsets, datas, heads, sums, at, last = [], [], [], [], 0, None
    view = memoryview(content)
    while at < len(view):
        size = int.from_bytes(view[at : at + 8], "little")
        if at + 16 + size > len(view) or size % 4:
            raise ValueError(f"cut or damaged record at {at} of {file}")
        heads.append((size, bytes(view[at + 8 : at + 12])))
        last = size
        if size:
            offsets.append(at)
            datas.append(bytes(view[at + 12 : at + 12 + size]))
        sums.append(bytes(view[at + 12 + size : at + 16 + size]))
        at += 16 + size
    if ended and last not in (None, 0):
        raise ValueError(f"no end of {file}")
    if heads:
        want = checksums(np.array([s for s, _ in heads], "<u8").view("<u4"), np.full(len(heads), 2)).astype("<u4").tobytes()
        bodies = iter(checksums(np.frombuffer(b"".join(datas), "<u4"), np.array([len(d) // 4 for d in datas])).astype("<u4")) if datas else iter(())
        rest = b"".join(next(bodies).tobytes() if s else empty_record()[12:] for s, _ in heads)
        if want != b"".join(h for _, h in heads) or rest != b"".join(sums):
            raise ValueError(f"wrong checksum in {file}")
    return offsets, datas


def write(spark: SparkSession, documents: DataFrame, path: str, tokenizer: str, end: int = END, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, file_blocks: int = FILE_BLOCKS) -> None:
    """Writes ``path/data`` (records in ascending order of ids) and ``path/index``."""
    small_batches(spark)
    width = 2 if max(_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else 4

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([framed(held)], pa.binary())], names=["block"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist(), tokenizer), strict=True):
                if size > block_bytes:
                    yield block()
                    held, size = [], 0
                held.append(serialised(doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(end)), width))
                size += len(held[-1]) + 16
        if held:
            yield block()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # equal ids are spread by their texts, and equal texts by where they stand
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("again", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "again"]
    dealt = rows.repartitionByRange(max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // (4 << 20)))), *order).sortWithinPartitions(*order)
    blocks = dealt.select("doc_id", "text").mapInArrow(task, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", empty_record().decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_blocks).text(f"{path}/data")
    index(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, part, chunk, size: the files in the order of (part, chunk), as Spark's writer names them; contents are not read here."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    number = [F.regexp_extract(F.col("path"), pattern, 1).cast("int").alias(name) for pattern, name in ((r"/part-(\d+)-[^/]*$", "part"), (r"-c(\d+)\.[^/-]*$", "chunk"))]
    return found.select(F.col("path").alias("file"), *number, F.col("length").alias("size"))


class _Open:
    """Open files of a task, the latest few; paths are URIs of any store that Arrow reads."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def __call__(self, uri: str):
        from pyarrow.fs import FileSystem

        if uri not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).close()
            store, name = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            self.held[uri] = store.open_input_file(name)
        return self.held[uri]


def _complete(content: bytes) -> int:
    """Where the last record of which all is there ends."""
    at = 0
    while at + 16 <= len(content):
        after = at + 16 + int.from_bytes(content[at : at + 8], "little")
        if after > len(content):
            break
        at = after
    return at


def records(opened: _Open, file: str, size: int, most: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and datas of a file's records, some at a time; frames are checked, and that the file ends as it should."""
    at, rest, begin, last = 0, b"", 0, b""
    while at < size:
        # a record longer than this is read on until it is there, twice as far each time
        rest += opened(file).read_at(min(max(most, len(rest)), size - at), at)
        at = begin + len(rest)
        end = _complete(rest)
        if end:
            offsets, datas = unframed(rest[:end], file, ended=False)
            yield [begin + o for o in offsets], datas
            last = rest[max(0, end - 16) : end]
            rest, begin = rest[end:], begin + end
    if rest or (size and last != empty_record()):
        raise ValueError(f"no end of {file}")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
    opened = _Open(1)
    for batch in batches:
        for file, part, chunk, size in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "chunk", "size")), strict=True):
            own = 0
            for offsets, datas in records(opened, file, size):
                heads = [HEADER.unpack_from(d) for d in datas]
                n = len(heads)
                before = list(accumulate((h[1] for h in heads), initial=own))
                own = before.pop()
                columns = ([file] * n, [part] * n, [chunk] * n, offsets, [len(d) + 16 for d in datas], [None if h[3] else h[0] for h in heads], [h[1] for h in heads], before)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _earlier(value: str, order: list[str], *by: str) -> Column:
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, bytes, doc_id, start (ids of all records before it), n_tokens: from the files, all frames checked.

    It can be made again at any time. One row a group of files is summed up in one task.
    """
    entries = scratch(spark, _files(spark, path).mapInArrow(_entries, INDEX), "records-index")
    files = entries.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP_FILES))
    files = files.withColumn("before", _earlier("n", ["part", "chunk"], "group"))
    groups = files.groupBy("group").agg(F.sum("n").alias("m"))
    groups = groups.select("group", _earlier("m", ["group"]).alias("groups_before"))
    starts = files.join(groups, "group").select("part", "chunk", (F.col("before") + F.col("groups_before")).alias("first"))
    return entries.join(starts, ["part", "chunk"]).select("file", "offset", "bytes", "doc_id", (F.col("first") + F.col("own")).alias("start"), "n_tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, doc_id, ids (binary, 32-bit little-endian): all records, file by file, frames checked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Open(1)
        for batch in batches:
            for file, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), strict=True):
                for offsets, datas in records(opened, file, size):
                    rows = [parsed(d) for d in datas]
                    columns = [pa.array([file] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array([r[0] for r in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary())], names=["file", "offset", "doc_id", "ids"])

    return _files(spark, path).mapInArrow(task, "file string, offset long, doc_id long, ids binary")


def fetch(entries: DataFrame) -> DataFrame:
    """doc_id, start, ids: the records that these rows of the index name, in their order, each read by its offset alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Open()
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "bytes")), strict=True)
            raw = b"".join(opened(file).read_at(size, offset) for file, offset, size in places)  # checked together
            rows = [parsed(d) for d in unframed(raw, "records of the index", ended=False)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), batch.column("start"), pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary())], names=["doc_id", "start", "ids"])

    small_batches(entries.sparkSession)
    return entries.select("file", "offset", "bytes", "start").mapInArrow(task, "doc_id long, start long, ids binary")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """doc_id, start, ids of all records in a random order that depends on the seed alone, by way of the index."""
    kind = "file string, offset long, bytes long, doc_id long, start long, n_tokens long"
    place = F.xxhash64(F.lit(seed), "start")
    entries = spark.read.schema(kind).parquet(f"{path}/index")
    total = entries.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // (4 << 20))))
    return fetch(entries.repartitionByRange(parts, place, "start").sortWithinPartitions(place, "start"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    write(spark, read_table(spark, sf_dir, "documents"), path, default_tokenizer())
    ids = F.col("ids")
    return read_shuffled(spark, path).select("doc_id", "start", F.floor(F.octet_length(ids) / 4).alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
