"""Best-fit packing of token sequences by a configuration linear program.

Documents become tokens; those longer than a sequence are cut. What has to be
packed is then a histogram of at most ``capacity`` lengths, however many pieces
there are. Over it stands the linear program whose variables are configurations
(multisets of lengths that fit a sequence) and whose rows demand every length as
often as it occurs. It is solved by multiplicative weights: lengths still short
of their share get heavier, and a knapsack dynamic program finds the heaviest
configurations under the current weights, until all demand is met. The fractional
solution is rounded configuration by configuration; what is left over, at most as
many sequences as there are configurations, is placed best-fit decreasing, in
the room that configurations leave first.

The plan (configuration, first sequence, how many) stays small, so pieces find
their places in parallel: a piece's rank among those of its length, counted by
task and offset by a running sum over tasks, falls into one range of the plan.

Defined results: a null or empty text is one piece that holds only the end id;
repeated ids are separate documents, told apart by nothing but their order; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch, small_batches

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Words whose ids a worker keeps.
MEMO = 700_000
#: How often the program is solved for what is left of the histogram.
PASSES = 3
#: Lengths that occur less often than this are not taken more often by a configuration than they occur.
RARE = 8


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


MARKS = ".,;:!?*%&$#|()\""
#: What a tokenizer must do with text before its model for words to be encoded apart (fixed values).
WORDWISE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A word of Latin-1 letters, which the tokenizer's normalisation leaves alone but for capitals.
PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
#: Characters of text that are taken apart together, unless one text is longer.
SPAN = 4_000_000


@cache
def wordwise(path: str) -> bool:
    """Whether this tokenizer never joins what white space parts, so that its words can be encoded apart."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    steps = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}
    same = all((held.get(k) or {}).get(inner) == WORDWISE[k] for k, inner in steps.items())
    plain = not (held.get("truncation") or held.get("padding")) and held["model"]["type"] == "BPE"
    return same and plain and all(t["content"].startswith("<") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in held["added_tokens"])


@cache
def _letters(path: str) -> dict[int, str]:
    """What the model sees in place of each Latin-1 letter beyond ASCII."""
    step = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    return {c: "".join(part for part, _ in step(chr(c))) for c in range(0x80, 0x100) if chr(c).isalpha()}


def _parts(units: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Units as lower-case words and the marks after them, where the tokenizer takes them apart so anyway.

    That is sure for plain words before marks that are no apostrophe; any other unit stays whole.
    """
    words = pc.utf8_rtrim(units, characters=MARKS)
    plain = pc.match_substring_regex(words, PLAIN)
    size = pc.subtract(pc.binary_length(units), pc.binary_length(words))  # marks are a byte each
    longest = pc.max(size).as_py() or 0
    marks = pa.repeat(pa.scalar("", units.type), len(units))
    for n in range(1, min(longest, 8) + 1):
        marks = pc.if_else(pc.equal(size, n), pc.utf8_slice_codeunits(units, -n), marks)
    plain = pc.and_(plain, pc.less_equal(size, 8))
    return pc.if_else(plain, pc.utf8_lower(words), units), pc.if_else(plain, marks, pa.scalar("", units.type))


class _Memo:
    """The ids of words and marks, end to end in one array; the first is the empty one."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = array("I"), array("q", [0, 0])

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of each of these words; what is not remembered is encoded."""
        held = parts.dictionary_encode()
        words = held.dictionary.to_pylist()
        known = self.known
        fresh = [w for w in words if w not in known]
        # a plain lower-case word passes all steps before the model as it is, but for the letters that stand for bytes
        whole, model, letters = _tokenizer(self.path).encode, _tokenizer(self.path).model.tokenize, _letters(self.path)
        for word in fresh:
            if word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff"):
                self.ids.extend([t.id for t in model(word if word.isascii() else word.translate(letters))])
            else:
                self.ids.extend(whole(word, add_special_tokens=False).ids)
            known[word] = len(self.ends) - 1
            self.ends.append(len(self.ids))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))[held.indices.to_numpy()]


_MEMO: dict[str, _Memo] = {}


def _together(texts: list[str], memo: _Memo) -> Iterator[bytes]:
    """The ids of texts whose words are looked up together."""
    if len(memo.known) > MEMO:
        memo.forget()
    split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
    units = split.flatten().dictionary_encode()
    number = np.stack([memo.numbers(part) for part in _parts(units.dictionary)], axis=1)[units.indices.to_numpy()].ravel()
    ends = np.frombuffer(memo.ends, np.int64)
    start, count = ends[number], ends[number + 1] - ends[number]
    after = np.concatenate([[0], np.cumsum(count)])
    ids = np.frombuffer(memo.ids, np.uint32)[np.repeat(start - after[:-1], count) + np.arange(after[-1])].astype("<u4")
    borders = after[2 * split.offsets.to_numpy().astype(np.int64)]
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield ids[a:b].tobytes()


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers.

    Where the tokenizer never joins what white space parts, texts are taken apart at
    spaces and newlines, and each distinct word is encoded once while it is remembered;
    with any other tokenizer, whole texts are encoded.
    """
    if not wordwise(path):
        for text in texts:
            yield np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return
    if path not in _MEMO:
        _MEMO[path] = _Memo(path)
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > SPAN:
            yield from _together(held, _MEMO[path])
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from _together(held, _MEMO[path])


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task and rank: the piece is the rank-th of its length in that task."""
    small_batches(documents.sparkSession)
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, encode(batch.column("text").to_pylist(), tokenizer), strict=True):
                ids += END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc, piece, at // 4, length, crc32(part), number, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=list(names))

    frame = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return frame.mapInArrow(task, ", ".join(f"{n} long" for n in names))


def fillings(lengths: np.ndarray, weights: np.ndarray, capacity: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By room: the weight of the heaviest multiset that fits; the length it took last, if any; whether it can take one more of each.

    An unbounded knapsack; with ``limit``, no rare length is taken more often than that,
    and the best extension of the smaller rooms' multisets is kept.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_size, index = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    by_size[lengths], index[lengths] = weights, np.arange(lengths.size)
    backwards = np.zeros(capacity + 1)  # best, from the end: rooms left by ever longer lengths stand side by side
    # takings are counted of rare lengths only; what is in good supply is hardly taken up by one multiset
    tight = np.zeros(0, np.int64) if limit is None else np.flatnonzero(limit < np.minimum(capacity // lengths, RARE))
    column = np.full(lengths.size, -1)
    column[tight] = np.arange(tight.size)
    taken = np.zeros((capacity + 1, tight.size), np.int16)
    fitting = np.searchsorted(lengths[tight], np.arange(capacity + 1), side="right").tolist()
    most, sizes, columns = (limit[tight] if tight.size else tight), lengths[tight], np.arange(tight.size)
    for room in range(int(lengths[0]), capacity + 1):
        values = by_size[1 : room + 1] + backwards[capacity - room + 1 :]
        if few := fitting[room]:
            values[sizes[:few][taken[room - sizes[:few], columns[:few]] >= most[:few]] - 1] = -1.0
        at = values.argmax()
        if (value := values[at]) > best[room - 1]:
            k = index[at + 1]
            best[room], last[room] = value, k
            if tight.size:
                taken[room] = taken[room - at - 1]
                if (c := column[k]) >= 0:
                    taken[room, c] += 1
        else:
            best[room], last[room] = best[room - 1], -1
            if tight.size:
                taken[room] = taken[room - 1]
        backwards[capacity - room] = best[room]
    able = np.ones(lengths.size, bool)
    if tight.size:
        able[tight] = taken[capacity - sizes, columns] < most
    return best, last, able


def filling(lengths: np.ndarray, last: np.ndarray, room: int) -> dict[int, int]:
    """How often each length (by its place) is taken by the multiset that :func:`fillings` found for a room."""
    out: dict[int, int] = {}
    while room > 0:
        k = int(last[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


def heaviest(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is taken by the heaviest multiset that fits."""
    out = np.zeros(lengths.size, np.int64)
    for k, n in filling(lengths, fillings(lengths, weights, capacity)[1], capacity).items():
        out[k] = n
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None, near: float = 0.04) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Configurations (indices of lengths, how often each) and how often the fractional solution uses each.

    Multiplicative weights on the covering program: the weight of a length falls as
    the share of its demand that is met grows, and one that is met takes no further part,
    so nothing is covered too often. One knapsack gives the heaviest
    configuration around every length; each round buys the heaviest and those nearly as
    heavy that share no length with it or each other, each as far as it meets the scarcest
    of its lengths by one step. It ends when all are met, or after ``rounds``: every
    round brings a length one step on, and the fewer lengths, the finer the steps.
    """
    step = 1 / min(64, max(1, 2000 // lengths.size))
    met, most = np.zeros(lengths.size), np.minimum(demand, capacity // lengths).astype(np.int16)
    held: dict[bytes, list] = {}
    done = 0
    while (open_ := np.flatnonzero(met < 1 - 1e-6)).size and (rounds is None or done < rounds):
        done += 1
        # long ones weigh somewhat more than their share, so that short ones are left to fill up
        weights = (lengths[open_] / capacity) ** 1.1 * np.exp(-2 * (met[open_] - met[open_].min()))
        best, last, able = fillings(lengths[open_], weights, capacity, most[open_])
        room = capacity - lengths[open_]
        values = np.where(able, weights + best[room], 0.0)
        free = np.ones(open_.size, bool)
        for k in (-1, *(k for k in np.argsort(-values, kind="stable").tolist() if values[k] >= (1 - near) * best[capacity])):
            if k >= 0 and not free[k]:
                continue
            row = filling(lengths[open_], last, capacity if k < 0 else int(room[k]))
            use = np.array(list(row), np.int64)
            if not free[use].all():
                continue
            if k >= 0:
                row[k] = row.get(k, 0) + 1
                use = np.array(list(row), np.int64)
            each = np.array(list(row.values()), np.int64)
            free[use] = False
            which = open_[use]
            amount = float((np.minimum(step, 1 - met[which]) * demand[which] / each).min())
            met[which] += amount * each / demand[which]
            order = np.argsort(which)
            which, each = which[order], each[order]
            held.setdefault(which.tobytes() + each.tobytes(), [which, each, 0.0])[2] += amount
    return [(which, each) for which, each, _ in held.values()], np.array([amount for _, _, amount in held.values()])


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """What the program places, as (length -> how many, sequences of that kind), and the rest.

    Each of ``PASSES`` solves the program for what is left and rounds the fuller half of
    its solution, which is mostly full to the last place: amounts in turn are added up, and a
    configuration gets the whole numbers its share of the sum passes, as far as its
    lengths last. It ends early when the rest fills no more sequences than there were configurations.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    out: dict[tuple, int] = {}
    most = 0
    for _ in range(PASSES):
        if sum(k * n for k, n in left.items()) <= most * capacity:
            break
        lengths = np.array(sorted(left))
        demand = np.array([left[int(k)] for k in lengths])
        found, amounts = solve(lengths, demand.astype(float), capacity, rounds)
        most = len(found)
        # fullest first, and those used often before those used rarely
        fill = np.array([int(lengths[use] @ each) for use, each in found])
        order = np.lexsort((-amounts, -fill))
        upto = np.cumsum(amounts[order])
        least = fill[order[int(np.searchsorted(upto, upto[-1] / 2))]]
        total, given = 0.0, 0
        for i in order[fill[order] >= least]:
            total += float(amounts[i])
            use, each = found[i]
            n = min(int(total - given + 1e-9), int((demand[use] // each).min()))
            if n > 0:
                given += n
                demand[use] -= n * each
                key = tuple(zip(lengths[use].tolist(), each.tolist(), strict=True))
                out[key] = out.get(key, 0) + n
        if not given:
            break
        left = {int(k): int(n) for k, n in zip(lengths, demand, strict=True) if n}
    return [(dict(key), n) for key, n in out.items()], left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """(length -> how many, sequences of that kind): every piece of the histogram has a place."""
    full = histogram.get(capacity, 0)
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    placed, left = configurations({k: n for k, n in histogram.items() if k < capacity}, capacity, rounds)
    return out + best_fit(left, capacity, placed)


def best_fit(left: dict[int, int], capacity: int, begun: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over a histogram, equal fillings in bulk: runs of one length go into the fullest bins that take them, those ``begun`` among them."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}  # room -> (filling, how many)
    rooms = np.zeros(capacity + 1, np.int64)
    for filling, n in begun:
        room = capacity - sum(length * each for length, each in filling.items())
        bins.setdefault(room, []).append((filling, n))
        rooms[room] += n
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            usable = np.flatnonzero(rooms[length:])
            if usable.size:
                room = length + int(usable[0])
                filling, m = bins[room].pop()
            else:
                room, filling, m = capacity, {}, n  # as many new bins as it could need
                each = capacity // length
                m = max(1, n // each)
            each = 1 if filling else min(n, capacity // length)
            k = max(1, min(m, n // each))
            if k < m and filling:
                bins[room].append((filling, m - k))
            if filling:
                rooms[room] -= k
            after = room - each * length
            bins.setdefault(after, []).append((filling | {length: filling.get(length, 0) + each}, k))
            rooms[after] += k
            n -= k * each
    return [entry for entries in bins.values() for entry in entries]


def ranges(packed: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset), sorted: where each rank of a length goes."""
    rows, ranks, sequence = [], {}, 0
    for filling, n in packed:
        offset = 0
        for length, each in filling.items():
            rows.append((length, ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(len(rows), 5)


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = scratch(spark, pieces(documents, tokenizer, capacity), "pieces")
    by_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = ranges(plan(histogram, capacity)) if histogram else np.zeros((0, 5), np.int64)
    shared = spark.sparkContext.broadcast(where)  # its size follows the number of configurations, not of pieces
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_task.select(F.col("length").alias("_length"), F.col("task").alias("_task"), earlier.alias("before"))
    ranked = table.join(starts, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    kept = ("doc_id", "piece", "start", "length", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            found = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1] if len(rank) else rows[:0]
            inside = rank - found[:, 1]
            sequence = found[:, 2] + inside // np.maximum(found[:, 3], 1)
            offset = found[:, 4] + inside % np.maximum(found[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in (*kept, "sequence_id", "offset")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"), default_tokenizer())
