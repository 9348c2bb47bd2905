"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A benchmark item contaminates a document when some stretch of the document is
within ``share`` of the item's length of it in edit distance, both normalised (A-Z
lower-cased, other ASCII that is not a letter or digit as one space). Three steps:

* Windows. An item with at most k edits keeps one of k + 1 disjoint segments
  whole (pigeonhole), so item-sized windows are laid where a segment occurs; and it
  keeps all but 4 k of its four-byte grams, so windows with fewer are none. No
  stretch within the bound is missed here.
* LSH. A CGK walk copies a string, advancing at each step by a random bit that
  depends on step and character; few edits leave most output positions alike. Walks
  start at the segment that laid the window and go both ways from there, so edits before
  it shift nothing. Each walk is sampled at some positions, which make a bucket key;
  ``tables`` says how many walks it takes for a target recall at a given rate of unlike
  positions, and ``UNLIKE`` is the rate measured at the bound (see the tests).
* Verification. A window that shares a bucket with its item is compared by Myers'
  bit-parallel algorithm, anywhere in the window and a margin of k around it.

The bound counts bytes: a letter beyond ASCII has two or more. Items under 16 normalised
bytes have no room for edits; they are searched verbatim, on word borders, if ``verbatim``
is set, as the query and the pipeline do, and otherwise not at all.

Documents stay where they are; items travel, in blocks whose size as sent is bounded.
Defined results: null and empty texts contaminate nothing, and so do items without
letters and digits; an item that occurs several times in a document gives one row, the
first found; rows that repeat an id each count; items that repeat an id or a text each
count; empty tables give an empty result. Only ids and texts are read, so further columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, small_batches

SHARE = 0.1
#: Bytes, as sent, of a block of items that goes to all tasks: an item's text, and its segments at some 40 bytes each.
BLOCK_BYTES = 6_000_000
GRAM, LEAST_ITEM = 8, 16
#: Bytes of documents looked at together, and windows, and bytes of windows, embedded together.
SPAN, WINDOWS, WINDOW_BYTES = 4_000_000, 1_024, 300_000
APART, SPACE = 0xFF, 32
#: Steps of walks whose random bits are kept.
HELD_STEPS = 1_024
#: Share of unlike walk positions at the bound (0.49 for replacements, 0.68 for insertions, 0.69 for deletions, with room for
#: the worse ones among them), and the recall that the number of walks is set for.
UNLIKE, RECALL = 0.75, 0.995


@cache
def _table() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for low, high, to in ((48, 57, 48), (65, 90, 97), (97, 122, 97), (128, 255, 128)):
        out[low : high + 1] = np.arange(to, to + high - low + 1)
    return out


def normalised(raw: bytes) -> np.ndarray:
    """Normalised bytes; runs of spaces are one."""
    codes = _table()[np.frombuffer(raw, np.uint8)]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    return codes[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; beyond the end are zeros."""
    wide = np.concatenate([codes, np.zeros(GRAM - 1, np.uint8)]).astype(np.uint64)
    two = wide[:-1] | wide[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


#: Short grams, hashed to so many slots, of which a window must hold enough of an item's.
SMALL, SMALL_SLOTS = 4, 1 << 14


def small_grams(codes: np.ndarray) -> np.ndarray:
    """The hashed four bytes from each position on (along the last axis)."""
    wide = codes.astype(np.uint32)
    whole = wide[..., :-3] | wide[..., 1:-2] << np.uint32(8) | wide[..., 2:-1] << np.uint32(16) | wide[..., 3:] << np.uint32(24)
    return whole * np.uint32(0x9E3779B1) >> np.uint32(18)


def edits_within(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """The least edit distance from ``pattern`` to a stretch of ``text``, and where that ends; None if above ``most``."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, top, every = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1
    best, at = m, 0
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(zero | up) & every, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & every, minus << 1 & every
        up, down = minus | ~(zero | plus) & every, plus & zero
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


def tables(unlike: float, sampled: int, recall: float) -> int:
    """How many bucket keys of ``sampled`` positions find a pair with that rate of unlike positions at that recall."""
    hit = (1 - unlike) ** sampled
    return ceil(log(1 - recall) / log(1 - hit))


class Walks:
    """CGK walks both ways from an anchor, and the positions sampled from each."""

    def __init__(self, walks: int | None = None, sampled: int = 2, seed: int = 5):
        self.walks = tables(UNLIKE, sampled, RECALL) if walks is None else walks
        self.sampled = sampled
        rng = np.random.default_rng(seed)
        self.places = rng.random((self.walks, sampled))
        self.weights = rng.integers(1, 1 << 62, (self.walks, sampled), np.int64).astype(np.uint64) | np.uint64(1)
        self.salts = rng.integers(1, 1 << 62, (2, self.walks), np.int64).astype(np.uint64)
        self.held: list[np.ndarray] = [np.zeros((0, self.walks * 256), np.uint8)] * 2

    def _advance(self, side: int, start: int, stop: int) -> np.ndarray:
        """For each of these steps, whether a walk advances at a character (walks one after the other, 256 places each)."""
        letters = np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        steps = np.arange(start, stop, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        mixed = (steps[:, None, None] ^ self.salts[side][None, :, None] ^ letters) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(63)).astype(np.uint8).reshape(stop - start, -1)

    def _copied(self, side: int, strings: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """What each walk copies at each step of each string: (steps, walks, strings); beyond a string's end, zeros."""
        if len(self.held[side]) < min(steps, HELD_STEPS):
            self.held[side] = self._advance(side, 0, min(HELD_STEPS, max(256, 1 << (steps - 1).bit_length())))
        held = self.held[side]
        width = strings.shape[1] + 1
        flat = np.hstack([strings, np.zeros((len(strings), 1), np.uint8)]).ravel()
        base = np.arange(len(strings)) * width
        walk = (np.arange(self.walks) * 256)[:, None]
        end = (base + lengths)[None]
        place = np.repeat(base[None], self.walks, axis=0)
        out = np.zeros((max(steps, 1), self.walks, len(strings)), np.uint8)
        for step in range(steps):
            out[step] = seen = flat[place]
            bits = held[step] if step < len(held) else self._advance(side, step, step + 1)[0]
            place += bits[walk + seen]
            np.minimum(place, end, out=place)
        return out

    def buckets(self, after: np.ndarray, after_size: np.ndarray, before: np.ndarray, before_size: np.ndarray) -> np.ndarray:
        """Bucket keys, a column for each walk, of strings given as what follows the anchor and, backwards, what precedes it (a row each, filled up with zeros)."""
        walks, rows = np.arange(self.walks)[None, :, None], np.arange(len(after))[:, None, None]
        # a walk advances at every second step on average
        at = (self.places[None] * (2 * (after_size + before_size))[:, None, None]).astype(np.int64)
        border = 2 * after_size[:, None, None]
        ahead = at < border
        at_after, at_before = np.where(ahead, at, 0), np.where(ahead, 0, at - border)
        one, two = (self._copied(side, strings, size, int(places.max(initial=-1)) + 1) for side, strings, size, places in ((0, after, after_size, at_after), (1, before, before_size, at_before)))
        seen = np.where(ahead, one[at_after, walks, rows], two[at_before, walks, rows]).astype(np.uint64) + np.uint64(1)
        return (seen * self.weights[None]).sum(axis=2, dtype=np.uint64)


def filled(strings: list[np.ndarray], width: int) -> np.ndarray:
    """Strings as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(strings), width), np.uint8)
    for row, codes in zip(out, strings, strict=True):
        row[: codes.size] = codes
    return out


class Items:
    """A block of benchmark items, and their segments to look up, by how many bytes of a segment are looked up."""

    def __init__(self, ids: list[int], texts: list[str], share: float, walks: Walks, verbatim: bool = False):
        held = [(i, normalised((t or "").encode("utf-8", "surrogatepass"))) for i, t in zip(ids, texts, strict=True)]
        held = [(i, c if c.size >= LEAST_ITEM else np.frombuffer(c.tobytes().strip(b" "), np.uint8)) for i, c in held]
        held = [(i, c) for i, c in held if c.size >= (1 if verbatim else LEAST_ITEM)]
        self.ids, self.codes, self.walks = [i for i, _ in held], [c for _, c in held], walks
        self.size = np.array([c.size for c in self.codes], np.int64)
        self.short = self.size < LEAST_ITEM
        self.most = np.where(self.short, 0, (share * self.size + 1e-9).astype(np.int64))
        segments: dict[int, list[tuple]] = {}
        for number, (codes, most) in enumerate(zip(self.codes, self.most.tolist(), strict=True)):
            found, parts = grams(codes), most + 1
            width = min(GRAM, codes.size // parts)
            mask = np.uint64((1 << 8 * width) - 1)
            for part in range(parts):
                start = part * codes.size // parts
                gap = min((part + 1) * codes.size // parts - start, 2 * width) - width
                segments.setdefault(width, []).append((found[start] & mask, found[start + gap] & mask, gap, number, start))
        self.by_width = {}
        for width, rows in segments.items():
            rows.sort(key=lambda s: int(s[0]))
            first, last = (np.array([r[i] for r in rows], np.uint64) for i in (0, 1))
            known = np.zeros(1 << 20, bool)
            known[self._slot(first)] = True
            self.by_width[width] = (known, first, last, *(np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4)))

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, starts in ``codes`` of the windows that a whole segment proposes, and where the segment is in the item."""
        out = [np.zeros((3, 0), np.int64)]
        every = grams(codes) if codes.size else np.zeros(0, np.uint64)
        for width, (known, first, last, gap, item, start) in self.by_width.items():
            found = every & np.uint64((1 << 8 * width) - 1)
            at = np.flatnonzero(known[self._slot(found)])
            low, high = (np.searchsorted(first, found[at], side=s) for s in ("left", "right"))
            count = high - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            segment = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            end = at + gap[segment]
            right = (end < found.size) & (found[np.minimum(end, found.size - 1)] == last[segment])
            segment, at = segment[right], at[right]
            out.append(np.stack([item[segment], at - start[segment], start[segment]]))
        item, start, anchor = np.concatenate(out, axis=1)
        # windows of an item that start at one place are one
        order = np.lexsort((anchor, start, item))
        item, start, anchor = item[order], start[order], anchor[order]
        fresh = np.ones(item.size, bool)
        fresh[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        return item[fresh], start[fresh], anchor[fresh]

    def enough_grams(self, item: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Whether windows, given as their short grams, hold enough of their items' ones: each edit spoils four at most."""
        which, row = np.unique(item, return_inverse=True)
        held = np.zeros((which.size, SMALL_SLOTS), bool)
        for at, number in enumerate(which.tolist()):
            held[at, small_grams(self.codes[number])] = True
        return held[row.ravel()[:, None], around].sum(axis=1) >= self.size[item] - SMALL + 1 - SMALL * self.most[item]

    def alike(self, item: np.ndarray, anchor: np.ndarray, codes: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether windows share a bucket with their items; both walk from the anchor."""
        size = self.size[item]
        sides = []
        for ahead in (True, False):
            length = size - anchor if ahead else anchor
            step = np.arange(int(length.max(initial=0)))
            at = (start + anchor)[:, None] + (step if ahead else -1 - step)
            inside = (step[None] < length[:, None]) & (at >= first[:, None]) & (at < last[:, None])
            sides += [np.where(inside, codes[np.clip(at, 0, codes.size - 1)], np.uint8(0)), length]
        # items walk along with the windows, once for each segment
        pairs, row = np.unique(np.stack([item, anchor]), axis=1, return_inverse=True)
        own, cut, n = [self.codes[i] for i in pairs[0]], pairs[1], item.size
        theirs = ([c[a:] for c, a in zip(own, cut, strict=True)], self.size[pairs[0]] - cut, [c[:a][::-1] for c, a in zip(own, cut, strict=True)], cut)
        both = [np.concatenate([a, b]) if a.ndim == 1 else np.vstack([a, filled(b, a.shape[1])]) for a, b in zip(sides, theirs, strict=True)]
        keys = self.walks.buckets(*both)
        return (keys[:n] == keys[n:][row.ravel()]).any(axis=1)


def _spans(docs: list[int | None], texts: list[str | None]) -> Iterator[tuple[list[int | None], bytes]]:
    held, size, ids = [], 0, []
    for doc, text in zip(docs, texts, strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > SPAN:
            yield ids, bytes([APART]).join(held)
            held, size, ids = [], 0, []
        held.append(raw)
        ids.append(doc)
        size += len(raw)
    if held:
        yield ids, bytes([APART]).join(held)


def _verbatim(items: Items, codes: np.ndarray, item: np.ndarray, start: np.ndarray, inside: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, start) of short items, once for each document, where they stand between word borders."""
    border = np.concatenate([(codes == SPACE) | (codes == APART), [True]])
    for number in np.unique(item).tolist():
        one, size = item == number, int(items.size[number])
        at, doc = start[one], inside[one]
        right = (at >= 0) & (at + size <= last[one])
        at, doc = at[right], doc[right]
        right = border[at - 1] & border[at + size] & (codes[at[:, None] + np.arange(size)] == items.codes[number]).all(axis=1)
        doc, which = np.unique(doc[right], return_index=True)
        yield from ((int(d), number, int(a)) for d, a in zip(doc, at[right][which], strict=True))


def _match(items: Items, docs: list[int | None], raw: bytes) -> Iterator[tuple[int | None, int, int, int]]:
    """(document, item, normalised start, distance) for documents joined by ``APART``."""
    codes = normalised(raw)
    borders = np.concatenate([[-1], np.flatnonzero(codes == APART), [codes.size]])
    item, start, anchor = items.windows(codes)
    if not item.size:
        return
    inside = np.searchsorted(borders, start + anchor, side="right") - 1
    first, last = borders[inside] + 1, borders[inside + 1]
    short = items.short[item]
    for doc, number, at in _verbatim(items, codes, *(x[short] for x in (item, start, inside, last))):
        yield docs[doc], items.ids[number], at - int(borders[doc] + 1), 0
    able = ~short & (last - first >= items.size[item] - items.most[item])
    item, start, anchor, inside, first, last = (x[able] for x in (item, start, anchor, inside, first, last))
    if not item.size:
        return
    together = max(1, min(WINDOWS, WINDOW_BYTES // int(items.size[item].max())))
    held = []
    for at in range(0, item.size, together):
        part = np.arange(at, min(at + together, item.size))
        size, most = items.size[item[part]], items.most[item[part]]
        reach = start[part][:, None] + np.arange(-int(most.max()), int((size + most).max()))
        inner = (reach >= np.maximum(first[part], start[part] - most)[:, None]) & (reach < np.minimum(last[part], start[part] + size + most)[:, None])
        held.append(part[items.enough_grams(item[part], small_grams(np.where(inner, codes[np.clip(reach, 0, codes.size - 1)], np.uint8(0))))])
    left = np.concatenate(held)
    left = left[np.lexsort((start[left], item[left], inside[left]))]
    item, start, anchor, inside, first, last = (x[left] for x in (item, start, anchor, inside, first, last))

    # windows of one item that lie within the margin of each other are verified together, if any shares a bucket
    apart = np.ones(item.size, bool)
    apart[1:] = (inside[1:] != inside[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > np.maximum(items.most[item[1:]], 1))
    group = np.cumsum(apart) - 1
    begin = np.flatnonzero(apart)
    end = np.append(begin[1:], item.size)
    passed = np.zeros(begin.size, bool)
    middle = (begin + end) // 2
    for tried in (middle, np.setdiff1d(np.arange(item.size), middle)):
        tried = tried[~passed[group[tried]]]
        for at in range(0, tried.size, together):
            part = tried[at : at + together]
            alike = items.alike(item[part], anchor[part], codes, start[part], first[part], last[part])
            passed[group[part[alike]]] = True
    done: set[tuple[int, int]] = set()
    for g in np.flatnonzero(passed).tolist():
        low, high = int(begin[g]), int(end[g]) - 1
        number, doc = int(item[low]), int(inside[low])
        if (doc, number) in done:
            continue
        size, most = int(items.size[number]), int(items.most[number])
        a, b = max(int(first[low]), int(start[low]) - most), min(int(last[low]), int(start[high]) + size + most)
        if found := edits_within(items.codes[number].tobytes(), codes[a:b].tobytes(), most):
            done.add((doc, number))
            yield docs[doc], items.ids[number], max(0, a + found[1] - size - int(first[low])), found[0]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of items, cut into blocks of bounded size as they come."""
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        own = 200 + 6 * len((row["text"] or "").encode("utf-8", "surrogatepass"))
        if ids and size + own > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += own
    yield ids, texts


def contaminated(
    spark: SparkSession, documents: DataFrame, benchmark: DataFrame, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", walks: Walks | None = None, verbatim: bool = False
) -> DataFrame:
    """doc_id, item_id, start (in the normalised document), distance: every item found in every document."""
    small_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    out = None
    for ids, texts in _blocks(wanted):
        shared = spark.sparkContext.broadcast(Items(ids, texts, share, walks or Walks(), verbatim))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows = [r for span in _spans(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for r in _match(items, *span)]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "distance"])

        found = docs.mapInArrow(task, "doc_id long, item_id long, start long, distance long")
        out = found if out is None else out.unionByName(found)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), verbatim=True)
