"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected entities (mail addresses, telephone, card and account numbers, network
addresses, secrets, names after a form of address) are replaced by values of the same
kind and format: digits stay digits and separators stay where they are, a number
that passes the Luhn test gets one that does, an address keeps its top-level domain,
a name keeps its script, capitals and the gender of its form of address.

A number that only looks like one of these stays as it is: a card without a valid
check digit, an address with a part above 255, digits that are not grouped as telephone
numbers are (``plausible``). A number without any separator is a telephone number behind a plus
sign (8 to 15 digits) or one zero (9 to 12 digits); behind a plus sign its country's code cannot be told
from the rest, but for 1, so it is no spelling of the national number. Names without a form of address are not looked for.

A surrogate is a keyed hash of kind and canonical value, so an entity has the same one
in all its spellings and in all documents; a telephone number with and without the
country's code is one entity. A given name has the gender of its form of address, and after
one that tells none, that which the name has elsewhere in the corpus, most often. All
entities go through a collision check: where two get one surrogate, or a surrogate is
itself an entity of the corpus, all but one are drawn again with the next attempt number
until none collide. Built-in functions only. One pass over a text marks the places of
its entities. Only entities are shuffled, not texts of documents without any, and the
entity table is pre-aggregated, so a frequent entity is one row for each task; those that make
up a thousandth of all occurrences are joined by broadcast (a thousand at most).

Defined results: null texts stay null and have no entities, and empty texts stay empty;
rows that repeat an id, a null one too, are each treated whole; an empty table gives an
empty result. Only the id and the text are read, so further columns may have any name.
The key is a parameter; the default is for tests and must not guard real data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")
FORMS = "|".join(form for f in MALE + FEMALE + NEUTRAL for form in (f, f.upper()))

#: Groups of two digits behind a zero or a country's code, all with one separator.
PAIRS = "|".join(rf"(?:\+[0-9]{{1,3}}[ .-]?(?:\(0\) ?)?|0)[1-9](?:{sign}[0-9]{{2}}){{4}}" for sign in (" ", r"\.", "-"))
#: Telephone numbers in pairs, without separators behind a plus sign or a zero, and with a stroke behind the area.
TELEPHONE = rf"(?<![0-9A-Za-z+.,/-])(?:{PAIRS}|\+[0-9]{{8,15}}|0[1-9][0-9]{{1,4}}/[0-9]{{5,8}}|0[1-9][0-9]{{7,10}})(?![0-9A-Za-z]|[.,/-][0-9])"

#: Kinds in order of precedence, with the pattern of each.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:ghp_|sk-)[A-Za-z0-9]{20,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9.-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{1,7}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|" + TELEPHONE,
    "name": r"(?<![\p{L}])(?=[" + "".join(sorted({form[0] for form in MALE + FEMALE + NEUTRAL})) + r"])(?:" + FORMS + r")\.? \p{Lu}[\p{L}'-]++(?![0-9])(?: \p{Lu}[\p{L}'-]++(?![0-9])){0,2}",
}
#: A cheap test that each text with an entity passes, if it has no "@".
INITIALS = "".join(sorted({form[0] for form in MALE + FEMALE + NEUTRAL}))
HINT = r"[0-9][ .()-]{0,2}[0-9][ .()-]{0,2}[0-9][ .()-]{0,2}[0-9]|[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}|(?=[" + INITIALS + r"])(?:" + FORMS + r")\.? \p{Lu}|AKIA[0-9A-Z]{16}|ghp_|sk-[0-9A-Za-z]|[0-9a-f]{32}|[0-9A-F]{32}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What stands before a national telephone number.
ABROAD = r"^(?:\+[0-9]{1,3}[ .-]|\+1(?=[0-9]{10}$))?\(?0*"
#: Marks around entities in a text, in which the first character is escaped by the third.
ESCAPE, MARK, ESCAPED = "\x01", "\x01\x03", "\x01\x02"
#: Entities that make up this share of all occurrences, or more, are joined by broadcast.
HOT = 1000

SYLLABLES = {
    "latin": ("ba", "da", "fe", "ga", "ho", "ja", "ka", "le", "ma", "ne", "or", "pa", "ri", "sa", "ti", "ul", "va", "we", "yo", "ze"),
    "cyrillic": ("ба", "да", "фе", "га", "хо", "жа", "ка", "ле", "ма", "не", "ор", "па", "ри", "са", "ти", "ул", "ва", "ве", "йо", "зе"),
    "greek": ("βα", "δα", "φε", "γα", "χο", "ζα", "κα", "λε", "μα", "νε", "ορ", "πα", "ρι", "σα", "τι", "ου", "βε", "θε", "ιο", "ξε"),
}
ENDINGS = {
    "latin": {"m": ("an", "or", "in"), "f": ("a", "ina", "ia"), "n": ("el", "en", "is"), "s": ("son", "er", "ez")},
    "cyrillic": {"m": ("ан", "ор", "ин"), "f": ("а", "ина", "ия"), "n": ("ен", "ис", "ел"), "s": ("ко", "ук", "ян")},
    "greek": {"m": ("ος", "ης", "ας"), "f": ("α", "ινα", "ια"), "n": ("εν", "ις", "ελ"), "s": ("ιδης", "ακης", "ου")},
}


def kind_of(found: Column) -> Column:
    """The first kind whose pattern the whole match has."""
    return F.coalesce(*[F.when(found.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("phone"))


def _gender(form: Column) -> Column:
    plain = F.regexp_replace(form, r"\.$", "")
    return F.when(plain.isin(*MALE, *map(str.upper, MALE)), "m").when(plain.isin(*FEMALE, *map(str.upper, FEMALE)), "f").otherwise("n")


def _name_words(found: Column) -> Column:
    return F.slice(F.split(found, " "), F.lit(2), F.greatest(F.size(F.split(found, " ")) - 1, F.lit(0)))


def canonical(found: Column, kind: Column) -> Column:
    """The same value for all spellings of an entity."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    national = F.regexp_replace(F.regexp_replace(found, ABROAD, ""), "[^0-9]", "")
    return F.when(kind == "phone", national).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(found)).otherwise(found)


def plausible(found: Column, kind: Column) -> Column:
    """Whether a match is what its pattern looks for, as far as its digits tell."""
    octets = F.forall(F.split(found, r"\."), lambda o: F.length(o) <= 3) & F.forall(F.split(found, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    phone = found.rlike(r"^[+(0]|^[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-]?[0-9]{4}$")
    return F.when(kind == "card", _luhn(F.regexp_replace(found, "[^0-9]", "")) == 0).when(kind == "ipv4", octets).when(kind == "phone", phone).otherwise(True)


def entities_of(found: Column) -> Column:
    """array<struct<kind, value>> that a match stands for: a name's words, the last one as surname, or the match itself; empty if it only looks like one."""
    kind = kind_of(found)
    words, gender = _name_words(found), _gender(F.get(F.split(found, " "), F.lit(0)))
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given-"), gender)).alias("kind"), F.lower(w).alias("value")))
    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(~plausible(found, kind), nothing).when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canonical(found, kind).alias("value"))))


def _draw(key: str, attempt: int, kind: Column, value: Column) -> Column:
    """128 hexadecimal digits from key, kind, value and attempt."""
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, value, F.lit(str(attempt))), 512)


def _number(draw: Column, at: Column | int) -> Column:
    """A number below 65,536 from a draw; places beyond it wrap around."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(draw, F.pmod(at * 3, F.lit(125)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _pick(options: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(number, F.lit(len(options))))


def _mapped(value: Column, draw: Column) -> Column:
    """Each digit as a digit, each letter as a letter of its case, all else as it is."""

    def one(c: Column, i: Column) -> Column:
        n = _number(draw, i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.char(F.lit(97) + F.pmod(n, F.lit(26))))
            .when(c.rlike("[A-Z]"), F.char(F.lit(65) + F.pmod(n, F.lit(26))))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10: 0 if valid."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(value: Column) -> Column:
    """An account number, its first four places moved to the end and letters counted from 10 on, modulo 97: 1 if valid."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def surrogate(key: str, attempt: int, kind: Column, value: Column, kinds: set[str] | None = None) -> Column:
    """A canonical surrogate for a canonical value; with ``kinds``, only those occur, and the expression is so much smaller."""
    draw = _draw(key, attempt, kind, value)
    digits = _mapped(value, draw)
    wanted = lambda k: kinds is None or k in kinds
    cases: list[tuple[Column, Column]] = []
    if wanted("email"):
        domain = F.substring_index(value, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        # a domain is drawn by itself, so people of one domain stay together
        hosted = _mapped(host, _draw(key, 0, F.lit("domain"), domain))
        cases.append((kind == "email", F.concat(_mapped(F.substring_index(value, "@", 1), draw), F.lit("@"), hosted, F.lit("."), top)))
    if wanted("secret"):
        drawn = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substr(draw, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))), "")
        hexadecimal = F.when(value.rlike("[a-f]"), F.lower(drawn)).otherwise(F.upper(drawn))
        cases.append((kind == "secret", F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hexadecimal).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(4)), _mapped(F.substr(value, F.lit(5)), draw)))))
    if wanted("ipv4"):
        cases.append((kind == "ipv4", F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (F.pmod(_number(draw, i), F.lit(254)) + 1).cast("string")), ".")))
    if wanted("card"):
        # the last digit is what makes the Luhn sum come out
        short = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
        valid = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.lit(10) - _luhn(short), F.lit(10)).cast("string"))
        cases.append((kind == "card", F.when(_luhn(value) == 0, valid).otherwise(digits)))
    if wanted("iban"):
        country, account = F.substr(value, F.lit(1), F.lit(2)), _mapped(F.substr(value, F.lit(3)), draw)
        rest = F.substr(account, F.lit(3))
        check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
        cases.append((kind == "iban", F.concat(country, F.when(_mod97(value) == 1, F.concat(check, rest)).otherwise(account))))
    if wanted("phone"):
        # a national number does not begin with a zero
        cases.append((kind == "phone", F.concat((F.pmod(_number(draw, 40), F.lit(8)) + 2).cast("string"), F.substr(digits, F.lit(2)))))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    for s, endings in ENDINGS.items():
        for r, choice in endings.items():
            own = "surname" if r == "s" else f"given-{r}"
            if wanted(own):
                stem = F.concat(*[_pick(SYLLABLES[s], _number(draw, i)) for i in range(3 + attempt // 3)])
                cases.append(((kind == own) & (script == s), F.concat(stem, _pick(choice, _number(draw, 30)))))
    out = digits
    for condition, drawn in reversed(cases):
        out = F.when(condition, drawn).otherwise(out)
    return out


def assign(spark: SparkSession, entities: DataFrame, key: str, most_attempts: int = 40) -> DataFrame:
    """kind, value, surrogate: one for each distinct entity, no two alike within a kind and none an entity itself."""
    originals = scratch(spark, entities.select("kind", "value").distinct(), "entities")
    family = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    pending, done = originals, None
    for attempt in range(most_attempts):
        kinds = {r["kind"] for r in pending.select("kind").distinct().collect()}  # a dozen at most
        drawn = pending.select("kind", "value", surrogate(key, attempt, F.col("kind"), F.col("value"), kinds).alias("surrogate"), family.alias("family"))
        drawn = scratch(spark, drawn, "drawn")
        taken = originals.select(family.alias("family"), F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("family", "surrogate"))
        first = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("who"))
        first = first.join(taken, ["family", "surrogate"], "left_anti")
        good = first.select(F.col("who.kind").alias("kind"), F.col("who.value").alias("value"), "surrogate", "family")
        done = good if done is None else done.unionByName(good)
        done = scratch(spark, done, "assigned")
        pending = scratch(spark, drawn.join(good, ["kind", "value"], "left_anti").select("kind", "value"), "pending")
        if pending.isEmpty():
            return done.select("kind", "value", "surrogate")
    raise RuntimeError("no distinct surrogates found")


def _laid_out(found: Column, kind: Column, drawn: Column) -> Column:
    """A canonical surrogate in the format of an occurrence."""
    slots = F.regexp_replace(found, "[^0-9A-Za-z]", "")

    def place(c: Column, i: Column, keep: str, of: Column) -> Column:
        upto = F.length(F.regexp_replace(F.substr(of, F.lit(1), i + 1), keep, ""))
        return F.when(c.rlike(keep), c).otherwise(F.substr(F.regexp_replace(drawn, keep, ""), upto, F.lit(1)))

    # what stands before a national number stays
    before = F.when(kind == "phone", F.length(F.regexp_extract(found, ABROAD, 0))).otherwise(0)
    rest = F.substr(found, before + 1, F.length(found))
    digits = F.concat(F.substr(found, F.lit(1), before), F.array_join(F.transform(F.split(rest, ""), lambda c, i: place(c, i, "[^0-9]", rest)), ""))
    spaced = F.array_join(F.transform(F.split(found, ""), lambda c, i: place(c, i, " ", found)), "")
    capital = (F.upper(found) == found) & (F.lower(found) != found)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).when((kind == "email") & capital & (slots != ""), F.upper(drawn)).otherwise(drawn)


def _like(word: Column, drawn: Column) -> Column:
    """A name in the capitals of the word it stands for."""
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(drawn)).otherwise(F.concat(F.upper(F.substr(drawn, F.lit(1), F.lit(1))), F.substr(drawn, F.lit(2))))


def _with_gender(entities: DataFrame) -> DataFrame:
    """``entities`` (kind, value, n) with ``as``: the kind, with the gender that a given name has most often where its form of address tells none."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    known = entities.filter(F.col("kind").isin("given-m", "given-f")).groupBy("value").agg(count("given-m").alias("m"), count("given-f").alias("f"))
    gender = F.when(F.col("m") >= F.col("f"), "given-m").otherwise("given-f")
    own = F.when((F.col("kind") == "given-n") & F.col("m").isNotNull(), gender).otherwise(F.col("kind"))
    return entities.join(known, "value", "left").select("kind", "value", "n", own.alias("as"))


def _marked(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row (a number of its own), doc_id, text, parts: the text taken apart, every second part a match; null, and the text as it is, if it has none."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = F.regexp_replace(F.replace(F.col("text"), F.lit(ESCAPE), F.lit(ESCAPED)), ANY, f"{MARK}$0{MARK}")
    docs = docs.withColumn("parts", F.when(F.col("text").contains("@") | F.col("text").rlike(HINT), F.split(marked, MARK, -1)))
    return docs.select("row", "doc_id", "text", F.when(F.size("parts") > 1, F.col("parts")).alias("parts")).select("row", "doc_id", F.when(F.col("parts").isNull(), F.col("text")).alias("text"), "parts")


def pseudonymise(spark: SparkSession, documents: DataFrame, key: str = "graphloom-test-key", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (of each entity, in order)."""
    nothing = F.array().cast("array<string>")
    docs = scratch(spark, _marked(documents, doc_id, text), "marked")
    clean = docs.filter("parts is null").select("doc_id", "text", F.lit(0).alias("n_entities"), nothing.alias("kinds"))
    plain = F.transform("parts", lambda p: F.replace(p, F.lit(ESCAPED), F.lit(ESCAPE)))
    held = docs.filter("parts is not null").select("row", "doc_id", plain.alias("parts"))
    held = held.select("row", "doc_id", F.filter("parts", lambda _, i: i % 2 == 0).alias("pieces"), F.filter("parts", lambda _, i: i % 2 == 1).alias("found"))
    held = scratch(spark, held.withColumn("of", F.transform("found", entities_of)), "held")

    rows = held.select("row", F.explode(F.array_distinct(F.flatten("of"))).alias("e")).select("row", "e.kind", "e.value")
    every = held.select(F.explode(F.flatten("of")).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
    entities = scratch(spark, _with_gender(every), "genders")
    assigned = assign(spark, entities.select(F.col("as").alias("kind"), "value").distinct(), key).withColumnRenamed("kind", "as")
    assigned = scratch(spark, entities.join(assigned, ["as", "value"]).select("kind", "value", "n", "surrogate"), "surrogates")
    total = assigned.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * HOT >= total
    often = F.broadcast(assigned.filter(hot).drop("n"))  # at most a thousand make up a thousandth each
    drawn_rows = rows.join(often, ["kind", "value"]).unionByName(rows.join(often, ["kind", "value"], "left_anti").join(assigned.filter(~hot).drop("n"), ["kind", "value"]))
    maps = drawn_rows.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "kind", "value"), "surrogate"))).alias("_map"))
    drawn = lambda e: F.element_at(F.col("_map"), F.concat_ws("\x00", e["kind"], e["value"]))

    def replaced(found: Column, of: Column) -> Column:
        words = _name_words(found)
        form = F.get(F.split(found, " "), F.lit(0))
        named = F.concat_ws(" ", F.concat(F.array(form), F.transform(words, lambda w, i: _like(w, drawn(F.get(of, i))))))
        first = F.get(of, F.lit(0))
        return F.when(F.size(of) == 0, found).when(first["kind"].startswith("given") | (first["kind"] == "surname"), named).otherwise(_laid_out(found, first["kind"], drawn(first)))

    new = F.zip_with("found", "of", replaced)
    whole = F.array_join(F.zip_with("pieces", new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.filter(F.zip_with("found", "of", lambda f, of: F.when(F.size(of) > 0, kind_of(f))), lambda k: k.isNotNull())
    changed = held.join(maps, "row", "left").select("doc_id", whole.alias("text"), kinds.alias("kinds"))
    return changed.select("doc_id", "text", F.size("kinds").alias("n_entities"), "kinds").unionByName(clean)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark, read(spark, sf_dir, "documents"))
