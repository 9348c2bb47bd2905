"""Spelling variants of words: near words, the form each is a variant of, and the root of the chain.

Words are near when one inserted, deleted or replaced code point tells them apart. A word of ``n`` letters, padded by two
marks at each end, has ``n + 2`` trigrams with positions; one edit spoils three at most and moves the others by one
place at most. Near words therefore share ``max(n, m) - 1`` trigrams at positions one apart or less.

1. Tasks count words in memory and hand on sums; counts of words are summed up exactly.
2. Trigram frequencies (a table bounded by the alphabet) set an order, rare ones first. Near words share one of the
   first four trigrams of each, and three of the first six. So the inverted index holds each word under its first four
   only: a posting list for each trigram and position, which words that have it one place earlier visit too.
3. In each list, postings by the other of the first six trigrams are merged in sorted order under the limits: lengths are equal
   and positions too, or one word is a letter longer and its position the same or the next. For words that
   meet twice more, all common trigrams are counted, and pairs above the bound are verified by edit distance. A pair is
   taken in the list of its first common trigram.
4. Lists of more than ``LIST`` words are split: words with one edit share the first or the last half of what has not been split yet. So
   it goes on until lists are short; when a letter is left, a list holds no more words than the alphabet.
5. The near word of largest count is a word's form if it has at least twice the word's count. Roots
   come from doubling the links, as many rounds as the logarithm of the longest chain.

Defined results: a null text has no words; a null id counts as an empty one; repeated rows count as often as they
occur; ties between near words go to the smallest in code-point order; words of any length are taken whole; an empty
table gives an empty result. Only the id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch, small_batches

LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Of so many (document, run) pairs, one loses a code point.
DROP = 97
#: Entries that a task holds before it hands them on.
HELD = 400_000
#: Words of a posting list that are merged in one go; longer lists are split.
LIST = 2048
#: Letters of lists that are merged together.
CHUNK = 1 << 19
#: Pairs whose trigrams are counted together.
PAIRS = 1 << 20
#: How many of a word's rarest trigrams are in the index, and how many are merged; so many more than its list's must two words share of these.
INDEXED, MERGED, MORE = 4, 6, 2

#: Latin-1 as runs see it: letters lower-cased (A-Z only), all else a gap.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Letters as numbers of 7 bits; 0 is no letter, 91 and 92 stand before and after a word.
_LETTERS = np.array([b - 96 if 97 <= b <= 122 else b - 0xC0 + 27 if b >= 0xC0 else 0 for b in range(256)], np.int64)
_BEFORE, _AFTER = 91, 92
GRAMS = 1 << 21


def runs(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, in Latin-1; a character beyond it is a gap."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def result(lead: int, run: bytes) -> bytes:
    """The run, or the run without a code point; ``lead`` is the checksum of what goes before it."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), lead)
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least ``LEAST_LETTERS`` code points that occur at least ``LEAST_TIMES`` times."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lead = crc32(f"{doc}:".encode())
                for run, n in Counter(runs(body)).items():
                    if len(run) >= LEAST_LETTERS and len(word := result(lead, run)) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


class Words:
    """The trigrams of words, end to end: ``code`` by word and position; word ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        # two marks before each word and two after it; trigrams that span two words are left out
        self.first = np.concatenate([[0], np.cumsum(self.length + 2)])
        padded = np.full(int((self.length + 4).sum()) + 2, _AFTER, np.int64)
        begin = np.concatenate([[0], np.cumsum(self.length + 4)[:-1]])
        padded[begin] = padded[begin + 1] = _BEFORE
        letters = _LETTERS[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        inside = np.arange(letters.size) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        padded[np.repeat(begin + 2, self.length) + inside] = letters
        self.word = np.repeat(np.arange(len(words)), self.length + 2)
        self.place = np.arange(self.word.size) - self.first[self.word]
        at = begin[self.word] + self.place
        self.code = padded[at] << 14 | padded[at + 1] << 7 | padded[at + 2]

    def rarest(self, rarity: np.ndarray, most: int) -> np.ndarray:
        """The places (words x most, counted over all words) of each word's first trigrams in the order of rarity."""
        order = np.argsort(self.word << 32 | rarity[self.code].astype(np.int64) << 21 | self.code, kind="stable")
        return order[self.first[:-1, None] + np.arange(most)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many trigrams of ``a`` the word ``b`` has at a place one apart at most; for lengths one apart at most."""
        size = self.length[a] + 2
        pair = np.repeat(np.arange(a.size), size)
        inside = np.arange(pair.size) - np.repeat(np.cumsum(size) - size, size)
        mine = self.code[self.first[a][pair] + inside]
        begin, many = self.first[b][pair], self.length[b][pair] + 2
        met = np.zeros(pair.size, bool)
        for shift in (-1, 0, 1):
            place = inside + shift
            there = (place >= 0) & (place < many)
            met |= there & (self.code[np.where(there, begin + place, 0)] == mine)
        return np.bincount(pair[met], minlength=a.size)


def rarity_of(spark: SparkSession, words: DataFrame) -> np.ndarray:
    """For each trigram, the logarithm of how many words' places hold it (in steps of an eighth, a byte): rare ones first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(Words(batch.column("word").to_pylist()).code, minlength=GRAMS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["code", "n"])

    out = np.zeros(GRAMS, np.uint8)
    summed = words.select("word").mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most 92^3 rows
    out[summed["code"].to_numpy()] = np.minimum(255, 1 + 6 * np.log2(summed["n"].to_numpy() + 1)).astype(np.uint8)
    return out


def postings(words: DataFrame, rarity) -> DataFrame:
    """code, place, role, word, n: each word under its rarest trigrams (role 0), and as a visitor of the next place (role 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = Words(batch.column("word").to_pylist())
            at = held.rarest(rarity.value, INDEXED).ravel()
            code, place, word = held.code[at], held.place[at], held.word[at]
            role = np.repeat(np.array([0, 1], np.int8), at.size)
            rows = np.concatenate([word, word])
            columns = [np.concatenate([code, code]).astype(np.int32), np.concatenate([place, place + 1]).astype(np.int32), role]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows))], names=["code", "place", "role", "word", "n"])

    return words.mapInArrow(task, "code int, place int, role byte, word string, n long")


def _merged(held: Words, name: np.ndarray, rarity: np.ndarray, group: np.ndarray, code: np.ndarray, place: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of one list that share enough trigrams, each in the list of its first common trigram."""
    n = group.size
    at = held.rarest(rarity, MERGED)
    own = place - role  # where the word has the list's trigram
    codes, places = held.code[at], held.place[at]
    other = ~((codes == code[:, None]) & (places == own[:, None]))
    word = np.repeat(np.arange(n), MERGED).reshape(n, MERGED)[other]
    # a posting's number: list, length, trigram, place (lengths and places by their last bits: what meets by chance is told apart later)
    lead, code_, spot = group[word] << 43, codes[other] << 16, places[other]
    size = held.length[word]
    key = lead | (size & 63) << 37 | code_ | spot & 0xFFFF
    order = np.argsort(key)
    key, word = key[order], word[order]
    longer = (lead | (size + 1 & 63) << 37 | code_)[order]
    spot = spot[order]
    found = []
    # equal lengths at the same place; a letter more at the same place, or at the next one
    for target in (key, longer | spot & 0xFFFF, longer | spot + 1 & 0xFFFF):
        begin = np.arange(1, key.size + 1) if target is key else np.searchsorted(key, target, side="left")
        many = np.maximum(np.searchsorted(key, target, side="right") - begin, 0)
        first = 0
        upto = np.cumsum(many)
        while first < many.size:  # runs in turn, so that pairs stay within bounds
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
            part = many[first:last]
            x = np.repeat(word[first:last], part)
            y = word[np.repeat(begin[first:last] - np.cumsum(part) + part, part) + np.arange(x.size)]
            moved, grown = own[y] - own[x], held.length[y] - held.length[x]
            good = np.flatnonzero((name[x] != name[y]) & ((role[x] == 0) | (role[y] == 0)) & ((moved == 0) | ((moved == 1) & (grown == 1))))
            x, y = x[good], y[good]
            found.append(np.where((grown[good] == 0) & (x > y), y * n + x, x * n + y))
            first = last
    pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    begins = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs = pairs[begins[np.diff(begins, append=pairs.size) >= MORE]]
    a, b = pairs // n, pairs % n  # the second as long as the first, or a letter longer
    # a pair with an earlier common trigram is taken in that one's list
    rank = rarity[held.code].astype(np.int64) << 21 | held.code
    mine = rarity[code].astype(np.int64) << 21 | code
    x, y = at[a, :INDEXED], at[b, :INDEXED]
    moved = held.place[y][:, None, :] - held.place[x][:, :, None]
    same = (held.code[x][:, :, None] == held.code[y][:, None, :]) & ((moved == 0) | ((moved == 1) & (held.length[b] > held.length[a])[:, None, None]))
    sooner = held.place[x][:, :, None] + held.place[y][:, None, :] < (own[a] + own[b])[:, None, None]
    earlier = (rank[x] < mine[a][:, None])[:, :, None] | ((rank[x] == mine[a][:, None])[:, :, None] & sooner)
    fresh = ~(same & earlier).any(axis=(1, 2))
    a, b = a[fresh], b[fresh]
    # a word can be in a list twice, as one of its own and as a visitor
    lesser, greater = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
    once = np.unique(group[a] << 40 | lesser << 20 | greater, return_index=True)[1]
    a, b = a[once], b[once]
    keep = np.zeros(a.size, bool)
    first = 0
    upto = np.cumsum(held.length[a] + 2)
    while first < a.size:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
        p, q = a[first:last], b[first:last]
        keep[first:last] = held.common(p, q) >= np.maximum(held.length[p], held.length[q]) - 1
        first = last
    return a[keep], b[keep]


def _lists(rarity):
    """The task that merges lists, which come sorted; as many lists at once as their letters allow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merge(rows: pa.Table) -> pa.RecordBatch:
            words = rows["word"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
            columns = {c: rows[c].to_numpy().astype(np.int64) for c in ("list", "code", "place", "role")}
            group = np.concatenate([[0], np.cumsum(np.diff(columns["list"]) != 0)]).astype(np.int64)
            a, b = _merged(Words(words.to_pylist()), words.dictionary_encode().indices.to_numpy().astype(np.int64), rarity.value, group, columns["code"], columns["place"], columns["role"])
            counts = rows["n"].combine_chunks()
            picked = [column.take(pa.array(at)) for at in (a, b) for column in (words, counts)]
            return pa.RecordBatch.from_arrays(picked, names=["a", "n_a", "b", "n_b"])

        held: list[pa.RecordBatch] = []
        letters = 0
        for batch in batches:
            held.append(batch)
            letters += batch.column("word").nbytes
            if letters > CHUNK:
                rows = pa.Table.from_batches(held)
                ids = rows["list"].to_numpy()
                end = int(np.searchsorted(ids, ids[-1], side="left")) if len(ids) else 0  # the last list may go on
                if end:
                    yield merge(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
                    letters = sum(b.column("word").nbytes for b in held)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield merge(rows)

    return task


def _halves(cut: Column, begin: Column, size: Column, word: Column) -> Column:
    """array<struct(side, shared text, cut, begin, size)>: what words one edit apart share of the rest, and what is left of it.

    ``cut`` is the shorter word's rest, ``size`` this word's. When one letter is left, words with it replaced make one list, and a
    letter more stands before or behind the other's.
    """
    half = F.floor(cut / 2).cast("int")
    back = cut - half

    def part(side: str, at: Column, n: Column, left: Column, left_at: Column, left_size: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.substr(word, at, n).alias("shared"), left.cast("int").alias("cut"), left_at.cast("int").alias("begin"), left_size.cast("int").alias("size"))

    first = part("F", begin, half, back, begin + half, size - half)
    last = part("L", begin + size - back, back, half, begin, size - back)
    front, behind = (part(side, at, F.lit(1), F.lit(0), begin, F.lit(0)) for side, at in (("F", begin), ("L", begin + size - 1)))
    alone = part("S", begin, F.lit(0), F.lit(0), begin, F.lit(0))
    return F.when(cut > 1, F.array(first, last)).when(size == 1, F.array(alone, front, behind)).otherwise(F.array(front, behind))


def near_words(spark: SparkSession, words: DataFrame, most: int = LIST) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once; ``words`` (word, n) has distinct words of ``LEAST_LETTERS`` letters or more."""
    rarity = spark.sparkContext.broadcast(rarity_of(spark, words))  # a byte for each possible trigram
    index = scratch(spark, postings(words, rarity), "postings")
    kind = "a string, n_a long, b string, n_b long"

    def merged(lists: DataFrame) -> DataFrame:
        sorted_ = lists.select("list", "code", "place", "role", "word", "n").repartition("list").sortWithinPartitions("list")
        return sorted_.mapInArrow(_lists(rarity), kind).filter(F.levenshtein("a", "b", 1) == 1)

    lists = index.withColumn("list", F.xxhash64("code", "place"))
    long = scratch(spark, lists.groupBy("list").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("list"), "long-lists")
    out = merged(lists.join(long, "list", "left_anti"))
    rest = lists.join(long, "list", "left_semi")
    # a pair is cut by its shorter word's length, so each word is cut for its own and for that less one
    size = F.char_length("word")
    rest = rest.withColumn("cut", F.explode(F.array(size, size - 1))).withColumn("begin", F.lit(1)).withColumn("size", size)
    split = None
    while not long.isEmpty():
        parts = rest.withColumn("part", F.explode(_halves(F.col("cut"), F.col("begin"), F.col("size"), F.col("word"))))
        fields = [F.col(f"part.{c}").alias(c) for c in ("cut", "begin", "size")]
        name = F.xxhash64("list", "cut", "part.side", "part.shared")
        lists = scratch(spark, parts.select(name.alias("list"), "code", "place", "role", "word", "n", *fields), "split-lists")
        long = scratch(spark, lists.filter(F.col("cut") > 0).groupBy("list").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("list"), "long-lists")
        short = merged(lists.join(long, "list", "left_anti"))
        split = short if split is None else split.unionByName(short)
        rest = lists.join(long, "list", "left_semi")
    # parts of a split list can share pairs, others cannot
    return out if split is None else out.unionByName(split.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct())


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root: where the links word -> form end; counts double along them, so they end."""
    links = scratch(spark, forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = scratch(spark, links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    small_batches(spark)
    words = scratch(spark, vocabulary(documents, doc_id, text), "words")
    pairs = scratch(spark, near_words(spark, words), "near-words")
    sides = F.array(*[F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.struct((-F.col(m)).alias("less"), F.col(v).alias("form")).alias("near")) for w, n, v, m in (("a", "n_a", "b", "n_b"), ("b", "n_b", "a", "n_a"))])
    best = pairs.select(F.inline(sides)).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    form_n = -F.col("near.less")
    best = scratch(spark, best.select("word", "n_near", F.when(form_n >= 2 * F.col("n"), F.struct(F.col("near.form").alias("form"), form_n.alias("form_n"))).alias("to")).select("word", "n_near", "to.form", "to.form_n"), "forms")
    ends = roots(spark, best.filter(F.col("form").isNotNull()))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, read(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH RECURSIVE polynomial AS (SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda x: 0::UBIGINT), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS steps FROM polynomial),
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS n FROM found GROUP BY ALL HAVING length(run) >= 5),
bytes AS (SELECT run, d, n, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255)::BIGINT + 1])), 4294967295) AS h FROM bytes, crc),
results AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
variants AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS near, b.n AS m FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM variants a JOIN words b ON a.v = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM variants a JOIN words b ON a.v = b.word)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min(struct_pack(a := -m, b := near)) AS best FROM pairs GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN -best.a >= 2 * n THEN best.b END AS form, CASE WHEN -best.a >= 2 * n THEN -best.a END AS form_n FROM best),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms WHERE form IS NOT NULL))
SELECT w.word, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form, f.form_n::BIGINT AS form_n, coalesce(e.root, w.word) AS root FROM words w LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)"""
