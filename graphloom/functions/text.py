"""Text functions, all built from Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "Main topic classifications"
ARROW = " -> "


def strip(x: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def one_line(x: Column) -> Column:
    """Lines stripped, blank ones dropped, the rest joined by a space."""
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != ""), " ")


def without_prefix(x: Column, prefix: str = "Category:") -> Column:
    return F.when(x.startswith(prefix), F.substr(x, F.lit(len(prefix) + 1))).otherwise(x)


def http_date(x: Column) -> Column:
    """A timestamp from e.g. ``Mon, 2 Apr 2007 19:18:42 GMT``; the day's name is not looked at."""
    return F.to_timestamp(F.substring_index(x, ", ", -1), "d MMM yyyy HH:mm:ss z")


def first_version(versions: Column) -> Column:
    """The creation text of the version with the smallest number (``v10`` comes after ``v2``)."""
    numbered = F.transform(versions, lambda v: F.struct(F.substr(v["version"], F.lit(2)).cast("int").alias("n"), v["created"].alias("created")))
    return F.array_min(numbered)["created"]


def adjacent_pairs(items: Column) -> Column:
    """array<struct<src, dst>> of neighbours; empty for fewer than two items."""
    return F.zip_with(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def path_lines(x: Column) -> Column:
    """The stripped lines of a generated text that are not blank."""
    return F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != "")


def is_path(line: Column, root: str = ROOT) -> Column:
    """Root, then one or more concepts, parted by arrows; no concept holds an arrow."""
    return line.rlike(rf"^{root}( -> ((?!(\n|->)).)+)+$")


def parse_paths(x: Column, root: str = ROOT) -> Column:
    """struct<relations: array<struct<src, dst>> (distinct), total, invalid> of a generated text."""
    lines = path_lines(F.coalesce(x, F.lit("")))
    valid = F.filter(lines, lambda line: is_path(line, root))
    relations = F.array_distinct(F.flatten(F.transform(valid, lambda line: adjacent_pairs(F.split(line, ARROW)))))
    return F.struct(relations.alias("relations"), F.size(lines).alias("total"), (F.size(lines) - F.size(valid)).alias("invalid"))


def parse_concepts(x: Column) -> Column:
    """Comma-separated concepts without quotes, commas, full stops and white space around them; empty ones stay."""
    return F.transform(F.split(x, ","), lambda part: F.btrim(part, F.lit(" \n\t\"',.")))


def parse_triplets(x: Column) -> Column:
    """array<struct<head, type, tail>> from text marked with <triplet>, <subj> and <obj>.

    Each <triplet> begins a head, each <subj> behind it a tail, and the words after the tail's last <obj> are its relation. A tail
    without <obj> has the relation of the tail before it, and a relation that comes before any tail of its
    head has the tail before the head. What has a relation comes out; the last of all needs head and tail too.
    """
    marks = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), ("<s>", "<pad>", "</s>"), F.coalesce(x, F.lit("")))
    # each token with spaces of its own, so that marks side by side are found
    spaced = F.array_join(F.transform(F.filter(F.split(marks, r"\s+"), lambda t: t != ""), lambda t: F.concat(F.lit(" "), t, F.lit(" "))), "")
    words = lambda t: F.replace(F.trim(t), F.lit("  "), F.lit(" "))
    pair = lambda tail, type_: F.struct(tail.alias("tail"), type_.alias("type"))

    def part(text: Column, k: Column) -> Column:
        pieces = F.split(text, " <obj> ", -1)
        return pair(F.when(k > 0, words(pieces[0])), F.when(F.size(pieces) > 1, words(F.element_at(pieces, -1))))

    def chunk(text: Column, k: Column) -> Column:
        head = F.when(k > 0, words(F.split(text, " <(?:subj|obj)> ", 2)[0])).otherwise("")
        return F.struct(head.alias("head"), F.transform(F.split(text, " <subj> ", -1), part).alias("parts"))

    def whole(chunks: Column) -> Column:
        def triplets(c: Column, i: Column) -> Column:
            def triplet(p: Column, j: Column) -> Column:
                before = F.filter(F.slice(c["parts"], F.lit(1), j), lambda q: q["type"].isNotNull())
                type_ = F.coalesce(p["type"], F.when(j > 0, F.try_element_at(before, F.lit(-1))["type"]), F.lit(""))
                earlier = F.filter(F.flatten(F.transform(F.slice(chunks, F.lit(1), i), lambda d: d["parts"])), lambda q: q["tail"].isNotNull())
                tail = F.coalesce(p["tail"], F.when(p["type"].isNotNull() & (i > 0), F.try_element_at(earlier, F.lit(-1))["tail"]), F.lit(""))
                last = (i == F.size(chunks) - 1) & (j == F.size(c["parts"]) - 1)
                return F.struct(c["head"].alias("head"), type_.alias("type"), tail.alias("tail"), last.alias("last"))

            return F.transform(c["parts"], triplet)

        kept = F.filter(F.flatten(F.transform(chunks, triplets)), lambda t: (t["type"] != "") & (~t["last"] | ((t["head"] != "") & (t["tail"] != ""))))
        return F.transform(kept, lambda t: F.struct(t["head"].alias("head"), t["type"].alias("type"), t["tail"].alias("tail")))

    # bound to a name once, as it is looked at from each of its parts
    return F.element_at(F.transform(F.array(F.transform(F.split(spaced, " <triplet> ", -1), chunk)), whole), 1)


#: The relations that make an edge.
RELATIONS = ("subclass of", "instance of", "member of", "part of")


def triplet_edges(triplets: Column, relations: tuple[str, ...] = RELATIONS) -> Column:
    """Distinct edges from tail (parent) to head (child) of whole triplets with one of the relations."""
    whole = F.filter(triplets, lambda t: t["head"].isNotNull() & t["tail"].isNotNull() & F.coalesce(t["type"].isin(*relations), F.lit(False)))
    return F.array_distinct(F.transform(whole, lambda t: F.struct(t["tail"].alias("src"), t["head"].alias("dst"))))


def malformed_triplets(triplets: Column) -> Column:
    """How many triplets lack a part."""
    return F.size(F.filter(triplets, lambda t: t["head"].isNull() | t["type"].isNull() | t["tail"].isNull()))


def tagged_relation(line: Column) -> Column:
    """struct<child, parent, rule> of a line ``child|||parent|||rule``, null if it is none."""
    pattern = r"^(.+)\|\|\|(.+)\|\|\|(.+)"
    parts = [F.trim(F.regexp_extract(line, pattern, i)) for i in (1, 2, 3)]
    return F.when(line.rlike(pattern), F.struct(parts[0].alias("child"), parts[1].alias("parent"), parts[2].alias("rule")))


def response_length(x: Column) -> Column:
    return F.size(F.split(x, "->", -1))


def run_number(name: Column) -> Column:
    return F.substring_index(name, "-", -1).cast("int")


def find_sublist(items: Column, part: Column) -> Column:
    """The first index (from 0) at which ``part`` lies in ``items``; null if nowhere."""
    last = F.size(items) - F.size(part)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (last >= 0) & (F.slice(items, i + 1, F.size(part)) == part))
    return F.get(hits, F.lit(0))


NP = r"NP_[\w'-]+"
#: Surface patterns: (name, phrase between, whether the parent comes first).
HEARST = (("such as", ",? such as ", True), ("as", ",? as ", True), ("include", ",? include ", True), ("especially", ",? especially ", True), ("and other", "(?:and|or) other ", False))


def hearst_pairs(x: Column, rules: tuple = HEARST) -> Column:
    """array<struct<src (parent), dst (child), rule>> from text whose noun phrases are marked ``NP_``.

    Lists are read possessively, so nothing of them is read twice, however long they are: where the parent comes
    last, each list is taken with or without one behind it, and those without go.
    """

    def rule(name: str, between: str, parent_first: bool) -> Column:
        if parent_first:
            clause = rf"{NP}{between}(?:{NP}(?: |,|and|or)*+)++"
        else:
            # a word that begins what stands between list and parent is none of the list's
            clause = rf"(?:{NP}(?:(?!{between}NP_)(?: |,|and|or))*+)++(?:{between}{NP})?"
        found = F.regexp_extract_all(x, F.lit(f"({clause})"), F.lit(1))
        if not parent_first:
            found = F.filter(found, lambda m: m.rlike(rf"{between}{NP}\z"))

        def pairs(phrases: Column) -> Column:
            rest = F.slice(phrases, F.lit(2 if parent_first else 1), F.size(phrases) - 1)
            parent = F.element_at(phrases, 1 if parent_first else -1)
            return F.transform(rest, lambda child: F.struct(parent.alias("src"), child.alias("dst"), F.lit(name).alias("rule")))

        return F.flatten(F.transform(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit(rf"({NP})"), F.lit(1))), pairs))

    return F.concat(*[rule(*r) for r in rules])


def plain_phrase(x: Column) -> Column:
    """A marked noun phrase as lower-case words."""
    return F.lower(F.trim(F.regexp_replace(F.translate(x, "_", " "), r"\bNP ", "")))


def marked_phrase(x: Column) -> Column:
    return F.concat(F.lit("NP_"), F.regexp_replace(F.trim(x), r"\s+", "_"))


def has_stop_word(x: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(x), r"\s+"), F.array(*[F.lit(w) for w in words]))
