from helpers import SMALL, same

from graphloom.llm import line_dedup as L

BASE = "one two three four five six seven eight nine ten eleven"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least=10):
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    out = {}
    for d, i, x in sorted(lines):
        stays = (d, i)
        if x.strip(" \t\r"):
            w = x.split(" ")
            near = [(e, j) for e, j, y in lines if (e, j) < (d, i) and (x == y or (y.strip(" \t\r") and min(len(w), len(y.split(" "))) >= least and distance(w, y.split(" ")) <= 1))]
            first = min(e for e in [*[(e, j) for e, j, y in lines if y == x]])
            stays = min([first, *[n for n in near if first == (d, i)]]) if first == (d, i) else out.get(first, (first,))[0]
        out[d, i] = (stays, stays == (d, i))
    return out


def test_matches_sql(spark, duck):
    same(L.op9_line_dedup(spark, SMALL), duck, L.OP9_SQL)


def test_against_brute_force(spark, docs):
    w = BASE.split()
    edits = [" ".join(w[:p] + ["x"] + w[p + 1 :]) for p in range(len(w))] + [" ".join(w[:p] + w[p + 1 :]) for p in range(len(w))] + [" ".join([*w[:p], "y", *w[p:]]) for p in range(len(w) + 1)]
    far = " ".join(["q", *w[1:10], "z"])
    rows = [(1, "\n".join([BASE, "", "short", " "])), (2, "\n".join([*edits, far])), (3, "short\n" + BASE), (4, None), (5, ""), (6, " ".join(f"v{i}" for i in range(3000)))]
    out = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in L.duplicate_lines(spark, docs(*rows)).collect()}
    assert out == brute(rows)
    clean = {r["doc_id"]: r["text"] for r in L.without_duplicates(docs(*rows), L.duplicate_lines(spark, docs(*rows))).collect()}
    assert clean[2] == far and clean[3] == "" and clean[4] is None and clean[1] == rows[0][1]
    assert L.duplicate_lines(spark, docs((1, "a")).limit(0)).count() == 0


def test_lines_of_a_null_id_take_part(spark, docs):
    near, again = BASE.replace("four", "x"), BASE.replace("nine", "y")
    rows = L.duplicate_lines(spark, docs((None, BASE + "\n" + near), (2, again), (3, BASE))).collect()
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in rows} == {
        (None, 0): (None, 0, True),
        (None, 1): (None, 0, False),
        (2, 0): (None, 0, False),
        (3, 0): (None, 0, False),
    }


def near_or_equal(x, y):
    """The rule, spelled out: one word where both have ten or more, one character where both have fewer words but ten characters."""
    a, b = x.split(" "), y.split(" ")
    if x == y:
        return True
    if min(len(a), len(b)) >= 10:
        return distance(a, b) <= 1
    return max(len(a), len(b)) < 10 and min(len(x), len(y)) >= 10 and distance(x, y) <= 1


def spelled_out(rows):
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    key = lambda d, i: (d is not None, d or 0, i)
    first = {}
    for d, i, x in lines:
        if x not in first or key(d, i) < key(*first[x]):
            first[x] = (d, i)
    out = []
    for d, i, x in lines:
        stays = (d, i)
        if x.strip(" \t\r"):
            near = [at for y, at in first.items() if y.strip(" \t\r") and key(*at) < key(*first[x]) and near_or_equal(x, y)]
            stays = min(near, key=lambda at: key(*at), default=first[x])
        out.append(((d, i), stays, stays == (d, i)))
    return sorted(out, key=repr)


def found(rows):
    return sorted((((r["doc_id"], r["line_no"]), (r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in rows.collect()), key=repr)


def test_short_lines_by_character(spark, docs):
    line = "Heti eror anesti."
    edits = [line[:p] + "x" + line[p + 1 :] for p in range(len(line))] + [line[:p] + line[p + 1 :] for p in range(len(line))] + [line[:p] + "ß" + line[p:] for p in range(len(line) + 1)]
    rows = [(2, "\n".join(edits)), (1, line + "\nHeti, eror anestu."), (3, "nine chr.\nnine chr\n0123456789\n012345678\n0123456780"), (None, "Heti eror anesti!\nb\na"), (None, ""), (4, "\U0001f600 ten chars\n\U0001f601 ten chars\n \t")]
    assert found(L.duplicate_lines(spark, docs(*rows))) == spelled_out(rows)


def test_long_lines_of_blocks(spark, docs):
    import random

    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" for _ in range(2500)]
    chars = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(0, " ".join(words)), (1, chars)]
    for n, size in ((2, 40), (3, 64), (4, 65), (5, 66), (6, 129)):
        own = words[:size]
        rows.append((n * 10, " ".join(own)))
        rows += [(n * 10 + 1 + k, " ".join(e)) for k, e in enumerate((own[:7] + own[8:], [*own[:30], "x", *own[30:]], [*own[:-1], "y"], ["z", *own[1:-1], "z"]))]
    rows += [(100 + k, " ".join(words[:p] + words[p + 1 :])) for k, p in enumerate((0, 900, 2499))] + [(110, " ".join([*words[:99], "x", *words[99:]]))]
    rows += [(120 + k, chars[:p] + "e" + chars[p + 1 :]) for k, p in enumerate((0, 1500, 2999))] + [(130, chars[:50] + chars[51:])]
    assert found(L.duplicate_lines(spark, docs(*rows))) == spelled_out(rows)


def test_ties_and_clashing_names(spark):
    rows = [(1, BASE, "a"), (1, BASE.replace("two", "x"), "b"), (1, BASE, "c"), (2, BASE.replace("two", "x"), "d")]
    frame = spark.createDataFrame([(*r, "h", "k", 1) for r in rows], "doc_id long, text string, line string, h1 string, keys string, count int")
    out = [((r["doc_id"], r["line_no"]), (r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in L.duplicate_lines(spark, frame).collect()]
    assert sorted(out) == [((1, 0), (1, 0), True)] * 3 + [((2, 0), (1, 0), False)]
