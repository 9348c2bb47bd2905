"""Lexico-syntactic patterns over tagged sentences.

A sentence is a list of tokens with word, lemma and part-of-speech tag. Each token becomes one character: of its word,
lemma and tag it tells what the rules ask for and no more. A rule is then a regular expression over single characters, so a run of
nouns is a loop over a character class, and a match's place is the place of its tokens. A noun phrase is a run of
nouns, perhaps of two runs with ``of``, ``--`` or ``'s`` between; adverbs and adjectives may stand before it.

A rule's first phrase is only tried where it can begin: a place within a run of nouns or adverbs gives no match that the run's start does
not give. Each run is thus read a bounded number of times, and a sentence takes time in proportion to
its length. Matches of one rule do not overlap. A tagger is a parameter of the caller (:func:`tagged_documents`); none is built in.

Null sentences have no pairs, as have null tokens, words, lemmas and tags (they count as empty ones).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The words and lemmas that the rules name, and the forms of tags.
WORDS = ("of", "--", "'s", '"', "``", "''", ",", "such", "as", "including", "and", "or", "any", "some", "other", "which", "called", "most", "a", "an", "special", "case", "that", "member", "part", "given", "features", "properties", "Unlike", "Like", "all")
LEMMAS = ("be", "subgenus", "example", "class", "group", "form", "type", "kind")
TAGS = {"noun": "N.+", "adverb": "RB.?", "JJ": "JJ", "JJR": "JJR", "JJS": "JJS", "VBN": "VBN", "DT": "DT"}

_WORD = {w: k for k, w in enumerate(WORDS, 1)}
_LEMMA = {m: k for k, m in enumerate(LEMMAS, 1)}
_TAG = {t: k for k, t in enumerate(TAGS, 1)}
_FORMS = [(re.compile(form), _TAG[name]) for name, form in TAGS.items()]
#: Characters of tokens begin in a private area, which holds all combinations.
_FIRST, _LEMMAS, _TAGS = 0xE000, len(LEMMAS) + 1, len(TAGS) + 1
PAIR = pa.struct([("src", pa.string()), ("dst", pa.string()), ("rule", pa.string())])


@cache
def _tag(tag: str) -> int:
    return next((k for form, k in _FORMS if form.fullmatch(tag)), 0)


def character(word: str, lemma: str, tag: str) -> str:
    """What the rules see of a token."""
    return chr(_FIRST + (_WORD.get(word, 0) * _LEMMAS + _LEMMA.get(lemma, 0)) * _TAGS + _tag(tag))


@cache
def token(*words: str, lemmas: tuple[str, ...] = (), tags: tuple[str, ...] = (), not_words: tuple[str, ...] = ()) -> str:
    """The class of all tokens with one of the words, lemmas and tags, as far as there are any, and none of ``not_words``."""
    of_word = [k for w, k in _WORD.items() if w in words] if words else [k for k in range(len(WORDS) + 1) if k not in {_WORD[w] for w in not_words}]
    of_lemma = [_LEMMA[m] for m in lemmas] if lemmas else range(_LEMMAS)
    of_tag = [_TAG[t] for t in tags] if tags else range(_TAGS)
    return "[" + "".join(chr(_FIRST + (w * _LEMMAS + m) * _TAGS + t) for w in of_word for m in of_lemma for t in of_tag) + "]"


@cache
def rules() -> list[tuple[str, re.Pattern, bool]]:
    """(name, pattern with two groups, whether the parent is the first): the families, each list length a rule of its own."""
    noun, adverb = token(tags=("noun",)), token(tags=("adverb",))
    phrase = f"{noun}+(?:{token('of', '--', chr(39) + 's')}{noun}+)?"
    adjective, participle = token(tags=("JJ", "JJR", "JJS")), token(tags=("JJ", "JJR", "JJS", "VBN"))
    quote, comma, be = token('"', "``", "''"), token(","), token(lemmas=("be",))

    def named(before: str, lead: str = "") -> str:
        """A phrase with what may stand before and around it; ``lead`` is for one at the beginning of a rule."""
        begins = f"(?<!{adverb})" if lead else ""
        return f"{quote}?(" + f"(?:{begins}{adverb}*{before}{noun}|{lead}{noun})" + f"{noun}*(?:{token('of', '--', chr(39) + 's')}{noun}+)?)" + f"{quote}?"

    # a place behind a noun gives a match only if the place before it does
    one, first, adjective_one = named(participle), named(participle, f"(?<!{noun})"), named(adjective)
    # where two tokens of any kind go before: behind a noun, the place before it would do but for these tokens
    third = named(participle, f"(?<!{token(not_words=('features', 'properties'))}{token(not_words=('of',))}{noun})")
    listed = lambda times: f"(?:{phrase}{comma}){times}"
    other = token("and", "or") + token("any", "some") + "?" + token("other")
    such, with_ = token("such") + token("as"), token("including")
    kinds = token("which") + "?" + be + token("a", "an") + token(tags=("JJ",)) + "?" + token(lemmas=LEMMAS[1:]) + token("of")
    # The rules' names and what each asks for.
    plain = [
        ("example of", f"{first}{comma}?{kinds}{one}", False),
        ("and other 0", f"{first}{comma}?{other}{one}", False),
        ("which is called", f"{first}{comma}?{token('which')}{be}{token('called')}{one}", False),
        ("is JJS", f"{first}{comma}?{be}{token(tags=('JJS',))}{token('most')}?{one}", False),
        ("special case of", f"{first}{be}{token('a')}{token('special')}{token('case')}{token('of')}{token(tags=('DT',))}?{one}", False),
        ("is an X that", f"{first}{be}{token('a', 'an')}?{adjective_one}{token('that')}", False),
        ("is a [!part]", f"{token(tags=('DT',))}{one}{be}{token('a', 'an')}{token(not_words=('member', 'part', 'given'))}{one}", False),
        ("!features such as", f"{token(not_words=('features', 'properties'))}{token(not_words=('of',))}{third}{such}{one}", True),
        ("like most", f"{token('Unlike', 'Like')}{token('most', 'all', 'any', 'other')}{one}{comma}{token(tags=('DT',))}?{one}", True),
        ("including 0", f"{first}{comma}?{with_}{one}", True),
        ("such as &", f"{first}{comma}?{such}{listed('{1,9}')}{phrase}{comma}?{token('and')}{one}", True),
        ("including &", f"{first}{comma}?{with_}{phrase}(?:{comma}{phrase}){{0,10}}{comma}?{token('and')}{one}", True),
    ]
    lists = [(f"such as {n}", f"{first}{comma}?{such}{listed(f'{{{n}}}')}{one}", True) for n in range(1, 7)]
    lists += [(f"and other {n}", f"{first}(?:{comma}{phrase}){{{n}}}{comma}?{other}{one}", False) for n in range(1, 6)]
    lists += [(f"including {n}", f"{first}{comma}?{with_}{listed(f'{{{n}}}')}{one}", True) for n in range(1, 6)]
    return [(name, re.compile(pattern), parent_first) for name, pattern, parent_first in plain + lists]


def pairs_of(words: list[str], characters: str) -> list[tuple[str, str, str]]:
    """(parent, child, rule) of one sentence."""
    out = []
    for name, pattern, parent_first in rules():
        rest, at = characters, 0
        while found := pattern.search(rest):
            a, b = (" ".join(words[at + found.start(k) : at + found.end(k)]) for k in (1, 2))
            out.append((a, b, name) if parent_first else (b, a, name))
            # what went before is no longer there for the next match to look back at
            at += found.end()
            rest = rest[found.end() :]
    return out


@F.arrow_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("src", "dst", "rule")])))
def _pairs(sentences: pa.Array) -> pa.Array:
    flat = sentences.flatten()
    words, lemmas, tags = ([x or "" for x in flat.field(k).to_pylist()] for k in range(3))
    plain = [w.replace(" ", "_") for w in words]
    characters = "".join(map(character, words, lemmas, tags))
    ends = sentences.offsets.to_pylist()
    begin, out = ends[0], []
    for a, b, there in zip(ends[:-1], ends[1:], sentences.is_valid().to_pylist(), strict=True):
        found = pairs_of(plain[a - begin : b - begin], characters[a - begin : b - begin]) if there else None
        out.append(found if found is None else [{"src": x, "dst": y, "rule": r} for x, y, r in found])
    return pa.array(out, pa.list_(PAIR))


def tagged_pairs(tokens: Column) -> Column:
    """array<struct<src (parent), dst (child), rule>> of tagged sentences, in Arrow batches."""
    part = lambda t, k: F.coalesce(t[k], F.lit(""))
    return _pairs(F.transform(tokens, lambda t: F.struct(part(t, "word").alias("word"), part(t, "lemma").alias("lemma"), part(t, "tag").alias("tag"))))


def tagged_documents(documents: DataFrame, tagger: Callable[[str], list[list[tuple[str, str, str]]]], doc_id: str = "id", text: str = "text") -> DataFrame:
    """id, sentence, tokens: what ``tagger`` makes of each text, as sentences of (word, lemma, tag), in Arrow batches."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, [{"word": w, "lemma": m, "tag": t} for w, m, t in sentence]) for i, x in zip(frame["id"], frame["text"], strict=True) for n, sentence in enumerate(tagger(x or ""))]
            yield pd.DataFrame(rows, columns=["id", "sentence", "tokens"])

    frame = documents.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return frame.mapInPandas(task, "id string, sentence int, tokens array<struct<word:string,lemma:string,tag:string>>")
