import struct
from zlib import crc32

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from graphloom.llm import records as R

MASK = 0xFFFFFFFF


def crc32c(data):
    """Bit by bit, by the definition."""
    c = MASK
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ MASK


def masked(data):
    c = crc32c(data)
    return ((c >> 15 | c << 17) & MASK) + 0xA282EAD8 & MASK


def plain(text):
    return np.array([*R._tokenizer(R.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.fixture
def out(spark):
    from graphloom.llm.common import scratch_path

    return scratch_path(spark, "records-test")


def test_checksums_are_those_of_the_definition():
    assert crc32c(b"123456789") == 0xE3069283  # the published check value
    rng = np.random.default_rng(1)
    datas = [rng.bytes(4 * n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 31, 100, 1)] + [bytes(8), bytes(12)]
    got = R.checksums(np.frombuffer(b"".join(datas), "<u4"), np.array([len(d) // 4 for d in datas]))
    assert got.tolist() == [masked(d) for d in datas]


def test_framing_by_the_definition():
    datas = [b"abcd", b"12345678"]
    assert R.framed(datas) == b"".join(struct.pack("<QI", len(d), masked(struct.pack("<Q", len(d)))) + d + struct.pack("<I", masked(d)) for d in datas)
    assert R.empty_record() == struct.pack("<QII", 0, masked(bytes(8)), masked(b""))
    assert R.unframed(R.framed(datas) + R.empty_record()) == ([0, 20], datas)


def test_query_against_whole_encoding(spark):
    got = {r["doc_id"]: r for r in R.op13_records(spark, SMALL).collect()}
    start = 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    for r in docs:
        ids = plain(r["text"])
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, ids.size, crc32(ids.tobytes()))
        start += ids.size
    assert len(got) == len(docs)


def test_files_index_and_shuffled_reads(spark, docs, out):
    rows = [(i * 7 % 90, f"text number {i * 7 % 90} " * (i % 9)) for i in range(90)]
    R.write(spark, docs(*rows).repartition(4), out, R.default_tokenizer(), block_bytes=300, file_blocks=2)
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(f"{out}/data").select("path").collect())
    assert len(files) > 5
    index = spark.read.parquet(f"{out}/index").orderBy("start").collect()
    assert [r["doc_id"] for r in index] == list(range(90))  # ascending, over all files
    assert [r["start"] for r in index] == np.cumsum([0, *[r["n_tokens"] for r in index]])[:-1].tolist()
    whole = {r["doc_id"]: r["ids"] for r in R.read(spark, out).collect()}
    assert whole == {i: plain(t).tobytes() for i, t in rows}
    shuffled = R.read_shuffled(spark, out, seed=1).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in shuffled} == whole
    order = [r["doc_id"] for r in shuffled]
    assert order != sorted(order) and order == [r["doc_id"] for r in R.read_shuffled(spark, out, seed=1).collect()]
    assert order != [r["doc_id"] for r in R.read_shuffled(spark, out, seed=2).collect()]
    some = R.fetch(spark.read.parquet(f"{out}/index").filter("doc_id in (3, 80)"))
    assert {r["doc_id"]: bytes(r["ids"]) for r in some.collect()} == {i: whole[i] for i in (3, 80)}
    again = R.index(spark, out).orderBy("start").collect()
    assert again == index


def test_damage_is_noticed():
    content = R.framed([b"abcdefgh", b"1234"]) + R.empty_record()
    for at in range(len(content)):
        broken = bytearray(content)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            R.unframed(bytes(broken))
    for end in range(1, len(content)):
        with pytest.raises(ValueError):
            R.unframed(content[:end])


def test_files_are_read_in_pieces(tmp_path):
    """Pieces of any size give the same records; a file that is cut, or goes on, is noticed."""
    rng = np.random.default_rng(8)
    datas = [rng.bytes(4 * int(n)) for n in rng.integers(1, 60, 40)]
    content = R.framed(datas[:25]) + R.empty_record() + R.framed(datas[25:]) + R.empty_record()
    file = tmp_path / "records"
    file.write_bytes(content)
    whole = R.unframed(content)
    for most in (1, 17, 100, 5000, 1 << 20):
        parts = list(R.records(R._Open(), f"file://{file}", len(content), most))
        assert ([o for p in parts for o in p[0]], [d for p in parts for d in p[1]]) == whole
    for broken in (content[:-16], content[:-3], content + b"x" * 5):
        file.write_bytes(broken)
        with pytest.raises(ValueError):
            list(R.records(R._Open(), f"file://{file}", len(broken), 100))


def test_both_widths():
    ids = np.array([5, 70_000, 0], "<u4")
    assert R.parsed(R.serialised(9, ids, 4))[1].tolist() == ids.tolist()
    doc, got = R.parsed(R.serialised(None, ids[[0, 2, 0]], 2))
    assert doc is None and got.tolist() == [5, 0, 5] and len(R.serialised(1, ids, 2)) % 4 == 0


def test_edge_cases(spark, docs, out):
    R.write(spark, docs(), f"{out}/none", R.default_tokenizer())
    assert R.read_shuffled(spark, f"{out}/none").collect() == [] and R.read(spark, f"{out}/none").collect() == []
    rows = [(None, "no id"), (3, None), (3, ""), (2, "twice"), (2, "twice"), (-1, "word " * 60_000), (3, "other")]
    frame = docs(*rows)
    for clash in ("tie", "again", "block", "file", "offset", "ids", "start"):
        frame = frame.withColumn(clash, F.lit("x"))
    R.write(spark, frame, f"{out}/some", R.default_tokenizer())
    index = spark.read.parquet(f"{out}/some/index").orderBy("start").collect()
    assert [r["doc_id"] for r in index] == [None, -1, 2, 2, 3, 3, 3]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in R.read(spark, f"{out}/some").collect())
    assert got == sorted((i is not None, i or 0, plain(t).tobytes()) for i, t in rows)
