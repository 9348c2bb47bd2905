import re

from helpers import SMALL

from graphloom.llm import pii


def run(spark, docs, *rows):
    return {r["doc_id"]: r for r in pii.pseudonymise(spark, docs(*rows)).collect()}


def test_formats_and_coreference(spark, docs):
    out = run(spark, docs, (1, "Mr. John Smith or MR. SMITH, +1 (499) 555-6503, +1 499 555 6503, Jo.S@mail.example.com."), (2, "Mrs. Jane Smith; JO.S@MAIL.EXAMPLE.COM 10.2.3.4. 4111 1111 1111 1111 4111111111111111"), (3, None), (4, ""), (5, "Господин Иван Петров"), (6, "clean"))
    one, two = out[1]["text"], out[2]["text"]
    surname = re.match(r"Mr\. \w+ (\w+) or MR\. (\w+),", one)
    assert surname[2] == surname[1].upper() and f"Mrs. {two.split()[1]} {surname[1]};" in two
    a, b = re.findall(r"\+1 \(?(\d{3})\)? (\d{3})[- ](\d{4})", one)
    assert a == b and "555" not in one.split("@")[0].split("SMITH")[-1][:0]
    mail = re.search(r"\S+@\S+\.com", one)[0]
    assert mail.upper() in two and mail != "Jo.S@mail.example.com"
    cards = re.search(r"((?:\d{4} ){3}\d{4}) (\d{16})", two)
    assert cards[1].replace(" ", "") == cards[2]
    digits = [int(c) for c in reversed(cards[2])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"Господин [А-яё]+ [А-яё]+", out[5]["text"]) and out[5]["text"] != "Господин Иван Петров"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[6]["text"] == "clean"


def test_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(400)], "kind string, value string")
    rows = pii.assign(spark, entities.filter("value < '400'"), "k").collect()
    assert len(rows) == len({r["surrogate"] for r in rows}) == 400
    assert not {r["surrogate"] for r in rows} & {r["value"] for r in rows}


def test_whole_table_leaves_no_entity(spark):
    src = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    email = re.compile(r"[\w.]+@[\w.]+\.com")
    for r in pii.op4_pii_surrogates(spark, SMALL).collect():
        assert not set(email.findall(r["text"])) & set(email.findall(src[r["doc_id"]]))
        if not r["n_entities"]:
            assert r["text"] == src[r["doc_id"]]
    assert pii.pseudonymise(spark, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)).count() == 0


def test_secrets_without_digits_are_replaced(spark, docs):
    secrets = ["sk-" + "abcdefGHIJ" * 3, "ghp_" + "klmnoPQRST" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefab" * 4, "ABCDEFAB" * 4]
    out = run(spark, docs, *((i, f"the key is {s} there") for i, s in enumerate(secrets)))
    for i, s in enumerate(secrets):
        assert out[i]["n_entities"] == 1 and s not in out[i]["text"]


def test_one_given_name_across_forms_of_address(spark, docs):
    out = run(spark, docs, (1, "Mr. John Smith met Dr. John Smith"), (2, "Dr. Alex Doe"), (3, "Mrs. Robin Roe, Prof. Robin Roe, Mr. Robin Poe, Mrs. Robin Poe"))
    a, b = re.fullmatch(r"Mr\. (\w+ \w+) met Dr\. (\w+ \w+)", out[1]["text"]).groups()
    assert a == b and a != "John Smith"
    mrs, prof, mr, again = re.findall(r"(?:Mrs?|Prof)\. (\w+)", out[3]["text"])
    assert mrs == prof == again != mr


def test_one_number_with_and_without_the_country(spark, docs):
    out = run(spark, docs, (1, "call +1 499 555 6503 or 499 555 6503 or (499) 555-6503"), (2, "+44 20 7946 0018, 020 7946 0018"))
    a, b, c = re.findall(r"\d{3}\W{1,2}\d{3}\W\d{4}", out[1]["text"])
    assert len({re.sub(r"\D", "", x) for x in (a, b, c)}) == 1 and "499" not in out[1]["text"] and out[1]["text"].startswith("call +1 ")
    abroad, at_home = out[2]["text"].split(", ")
    assert re.sub(r"\D", "", abroad)[2:] == re.sub(r"\D", "", at_home)[1:] and abroad.startswith("+44 ") and at_home.startswith("0")


def test_numbers_that_only_look_like_entities_stay(spark, docs):
    texts = ["Order 2019 100 2000 shipped", "12 345 6789 units", "card 4111111111111112", "version 300.1.2.3", "9807915762804491 is no card"]
    out = run(spark, docs, *enumerate(texts))
    assert [out[i]["text"] for i in range(len(texts))] == texts and all(r["n_entities"] == 0 and r["kinds"] == [] for r in out.values())


def test_account_numbers_keep_their_check_digits(spark, docs):
    out = run(spark, docs, (1, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432"))
    for iban in re.findall(r"[A-Z]{2}\d{2}[ 0-9A-Z]{14,}?(?= and|$)", out[1]["text"]):
        flat = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert "3704" not in out[1]["text"] and "WEST" not in out[1]["text"] and out[1]["n_entities"] == 2


def test_long_and_odd_texts(spark, docs):
    labels = "x@" + "a." * 100_000
    long = "word 12 " * 1_200_000 + "jo@mail.example.com"
    out = run(spark, docs, (1, labels), (2, long), (3, "a\x01b\x01\x02c \x01\x03 jo@mail.example.com\x01"), (4, "x@" + "ab." * 20 + "com"))
    assert out[1]["text"] == labels and len(out[2]["text"]) == len(long) and out[2]["n_entities"] == 1
    assert re.fullmatch("a\x01b\x01\x02c \x01\x03 [a-z]{2}@[a-z]{4}\\.[a-z]{7}\\.com\x01", out[3]["text"]) and "jo@" not in out[3]["text"]
    assert out[4]["n_entities"] == 1


def test_repeated_and_null_ids_and_clashing_names(spark):
    rows = [(None, "jo@mail.example.com"), (None, "Mr. Poe"), (7, "jo@mail.example.com"), (7, "jo@mail.example.com"), (7, None), (7, "")]
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, row string, kinds string, n int")
    out = pii.pseudonymise(spark, frame).collect()
    assert len(out) == 6
    mails = {r["text"] for r in out if r["text"] and "@" in r["text"]}
    assert len(mails) == 1 and "jo@mail.example.com" not in mails


PHONES = ["+14995556503", "+1 499 555 6503", "+1 (499) 555-6503", "(499) 555-6503", "499-555-6503", "499.555.6503", "01 23 45 67 89", "01.23.45.67.89", "01-23-45-67-89", "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "+4915112345678", "0301234567", "030/1234567", "020 7946 0018", "+44 20 7946 0018"]
CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005", "3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
OTHERS = ["jo.s+x@mail.example.co.uk", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "192.168.10.20", "078-05-1120", "sk-" + "a1B2" * 6, "Mr. John Smith", "Frau Schmidt", "Κυρία Παπαδοπούλου"]
FRAMES = ["{}", "call {} now", "({})", "at {}, or later", "it is {}.", "one: {}; two", "\u201c{}\u201d", "line\n{}\nline"]


def test_recall_of_all_formats(spark, docs):
    kinds = dict.fromkeys(PHONES, "phone") | dict.fromkeys(CARDS, "card") | dict.fromkeys(OTHERS)
    rows = [(f.format(e), e, kind) for e, kind in kinds.items() for f in FRAMES]
    out = run(spark, docs, *((i, text) for i, (text, _, _) in enumerate(rows)))
    missed = [(text, out[i]["text"], out[i]["kinds"]) for i, (text, e, kind) in enumerate(rows) if e in out[i]["text"] or out[i]["n_entities"] != 1 or kind not in (None, *out[i]["kinds"])]
    assert not missed
    for i, (text, e, kind) in enumerate(rows):
        if kind:  # digits for digits, and all else in its place
            assert re.sub("[0-9]", "0", out[i]["text"]) == re.sub("[0-9]", "0", text)


def test_one_number_in_pairs_and_with_a_stroke(spark, docs):
    out = run(spark, docs, (1, "+33 1 23 45 67 89, 01 23 45 67 89, 01.23.45.67.89"), (2, "030/1234567, 0301234567"))
    for r, n in ((out[1], 9), (out[2], 9)):
        assert len({re.sub(r"[^0-9]", "", x)[-n:] for x in r["text"].split(", ")}) == 1
    assert out[1]["text"].startswith("+33 ")


def test_other_numbers_stay(spark, docs):
    texts = ["0.0301234567 of it", "3,0123456789", "part 0x0301234567", "id A0301234567", "000123456789", "1234567890", "x+14995556503", "2021-01-02-03", "01 02 03", "01/02/2024", "1 23 45 67 89", "3782 822463 10006", "030/1234567/12", "0301234567.5", "+1234567", "99 12 34 56 78"]
    out = run(spark, docs, *enumerate(texts))
    assert [out[i]["text"] for i in range(len(texts))] == texts
