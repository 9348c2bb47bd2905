import random

from helpers import SMALL

from graphloom.llm import decontaminate as D


def plain(text):
    return D.normalised(text.encode())


def test_whole_table_finds_all_verbatim_items(spark):
    docs = [(r["doc_id"], plain(r["text"]).tobytes()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], plain(r["text"]).tobytes()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.op10_decontaminate(spark, SMALL).collect()}
    verbatim = {(d, i) for d, x in docs for i, y in items if len(y) >= D.LEAST_ITEM and y in x}
    assert verbatim and verbatim <= set(rows)
    text, pattern = dict(docs), dict(items)
    for (d, i), distance in rows.items():  # nothing beyond the bound
        assert D.edits_within(pattern[i], text[d], int(0.1 * len(pattern[i])))[0] <= distance <= 0.1 * len(pattern[i])


def test_edit_distance_against_a_table():
    rng = random.Random(2)
    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (12, 25))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            last, row[0] = row[0], 0
            for j, x in enumerate(p, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != c))
            best = min(best, row[-1])
        assert D.edits_within(p, t, len(p))[0] == best


def test_recall_of_edited_items(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items = D.Items(list(range(len(texts))), texts, 0.1, D.Walks())
    rng, found, total = random.Random(4), 0, 0
    for number, text in enumerate(texts):
        for share in (0.03, 0.06, 0.09):
            raw = bytearray(plain(text))
            for _ in range(int(share * len(raw))):
                at = rng.randrange(len(raw))
                raw[at : at + rng.randrange(2)] = bytes([rng.choice(b"abcdef ")]) * rng.randrange(2)
            hits = D._match(items, [1], b"Some words before it. " + bytes(raw) + b" and some after.")
            total += 1
            found += any(h[1] == number for h in hits)
    assert found / total >= 0.95


def test_edge_cases(spark, docs):
    bench = spark.createDataFrame([(1, "A benchmark question, that is long enough to search?"), (2, "short"), (3, None)], "item_id long, text string")
    frame = docs((1, None), (2, ""), (3, "so: a benchmark question that is long enough to search!"), (3, "nothing"), (None, "x " * 200_000 + "a benchmark question that is long enough to search"), (5, "short"))
    rows = D.contaminated(spark, frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(3, 1), (None, 1)}
    assert D.contaminated(spark, frame.limit(0), bench).count() == 0 and D.contaminated(spark, frame, bench.limit(0)).count() == 0


def test_tables_for_recall():
    assert D.tables(0.3, 4, 0.95) == 11


def edited(raw, kind, k, rng):
    raw, places = bytearray(raw), None
    places = sorted(rng.sample(range(len(raw)), k), reverse=True)
    for at in places:
        c = bytes([rng.choice(b"abcdefghijklmnopqrstuvwxyz")])
        raw[at : at + (kind != "insert")] = b"" if kind == "delete" else c
    return bytes(raw)


def test_recall_at_the_bound_by_kind_of_edit():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SMALL}/benchmark.parquet")["text"].to_pylist()
    items = D.Items(list(range(len(texts))), texts, 0.1, D.Walks())
    rng = random.Random(8)
    for kind in ("insert", "delete", "replace"):
        found = total = 0
        for number, text in enumerate(texts):
            pattern = plain(text).tobytes()
            for _ in range(6):
                raw = b"Some words before it. " + edited(pattern, kind, int(0.1 * len(pattern)), rng) + b" and some after it too."
                if D.edits_within(pattern, plain(raw.decode("utf-8", "replace")).tobytes(), int(0.1 * len(pattern))):
                    total += 1
                    found += any(h[1] == number for h in D._match(items, [1], raw))
        assert total > 150 and found / total >= 0.95, (kind, found, total)


def test_bound_of_short_items():
    for size in range(16, 42):
        text = ("abcdefghijklmnopqrstuvwxyz0123456789" * 2)[:size]
        items = D.Items([1], [text], 0.1, D.Walks(64))
        k = size // 10
        assert items.most[0] == k
        raw = bytearray(text.encode())
        for part in range(k):  # in the middle of segments
            raw[(2 * part + 1) * size // (2 * k + 2)] = ord("#")
        assert [h[3] for h in D._match(items, [1], b"it is " + bytes(raw).replace(b"#", b"~") + b" then")] in ([k], [])
        rng = random.Random(size)
        hits = sum(bool(list(D._match(items, [1], b"it is " + edited(text.encode(), "replace", k, rng) + b" then"))) for _ in range(20))
        assert hits >= 19


def test_short_items_verbatim_on_word_borders(spark, docs):
    bench = spark.createDataFrame([(1, "Short one"), (2, "a"), (3, "?!"), (4, ""), (5, None), (6, "short one."), (6, "short one.")], "item_id long, text string")
    frame = docs((1, "This short, one is."), (2, "short ones"), (3, "SHORT ONE"), (4, "a short one and a short one"), (5, None), (None, "xa"))
    rows = [(r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(spark, frame, bench, verbatim=True).collect()]
    ones = [(d, i, 0) for d in (1, 3, 4) for i in (1, 6, 6)]
    assert sorted(rows) == sorted([*ones, (4, 2, 0)])
    assert not D.contaminated(spark, frame, bench).collect()


def test_blocks_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 900)
    text = "what is the capital of the country with the longest coast"
    bench = spark.createDataFrame([(n % 3, text, "i", 0) for n in range(6)], "item_id long, text string, doc_id string, start int")
    assert sum(1 for _ in D._blocks(bench)) == 6
    frame = spark.createDataFrame([(1, "So, what is the capital of that country with the longest coast?", 9, "d")], "doc_id long, text string, item_id int, distance string")
    rows = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(spark, frame, bench).collect())
    assert rows == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (1, 2)]
