"""Prompts, responses and chat text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import ARROW, ROOT

# The wordings of the prompts, with their spelling, and the form of a response.
PATHS_OPENING = """The following is an article's title and abstract. Your task is to assign this article to suitable category hierarchy. A category is typically represented by a word or a short phrase, representing broader topics/concepts that the article is about. A category hierarchy represented by a collection of paths from the generic root category "Main topic classifications" to a specific category suitable for the article. The topics titles should become more and more specific as you move from the root to the leaf. 

"""
PATHS_FORMAT = """You must answer in the format of:
Main topic classifications -> Broad topic 1 -> Subtopic 1 -> ... -> Most specific topic 1
Main topic classifications -> Borad topic 2 -> Subtopic 2 -> ... -> Most specific topic 2
...
"""
PATHS_CLOSING_EXAMPLES = "\nProvide a category hierarchy for the above article. Use the same format as the examples above.\n"
PATHS_CLOSING_FORMAT = "\nProvide a category hierarchy for the above article. Use the format described above.\n"
REASONING_OPENING = """The following is an article's title and abstract. Briefly break down the topics (both specific and general concepts) relevant to this article. Explain your reasoning step by step.

"""
HIERARCHY_REQUEST = """Your task now is to assign this article to suitable category hierarchy. A category is typically represented by a word or a short phrase, representing broader topics/concepts that the article is about. A category hierarchy is represented by a collection of paths from the generic root category "Main topic classifications" to a specific category suitable for the article. The topics titles should become more and more specific as you move from the root to the leaf. 

You must answer in the format of:
Main topic classifications -> Broad topic 1 -> Subtopic 1 -> ... -> Most specific topic 1
Main topic classifications -> Borad topic 2 -> Subtopic 2 -> ... -> Most specific topic 2
...
"""
CONCEPTS_OPENING = """The following is an article's title and abstract. Suggest the categories that this article belongs to. A category is typically represented by a word or a short phrase, representing broader topics/concepts that the article is about. You should include both general and specific categories.

"""
CONCEPTS_CLOSING = "\nGive your answer as a comma-separated string.\n"
RESPONSE = r"""^(Main topic classifications( -> [\w()\-\–\—,.?!/\\&\"\'+=\[\]\{\} ]+)+\n)*(Main topic classifications( -> [\w()\-\–\—,.?!/\\&\"\'+=\[\]\{\} ]+)+)\n?$"""
#: A concept of it, for :func:`is_response`.
CONCEPT = r"""(?U)\A[\w()\-\–\—,.?!/\\&\"\'+=\[\]\{\} ]+\z"""


def article(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n"), abstract)


def blank_line_article(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n\n"), abstract)


def framed(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("### ARTICLE ###\n"), article(title, abstract), F.lit("\n### END ARTICLE ###\n"))


def response(paths: Column) -> Column:
    """One path a line."""
    return F.array_join(F.transform(paths, lambda p: F.concat(F.array_join(p, ARROW), F.lit("\n"))), "")


def paths_prompt(title: Column, abstract: Column, examples: Column | None = None) -> Column:
    """Zero-shot, or few-shot with ``examples``: array<struct<title, abstract, paths>>."""
    if examples is None:
        return F.concat(F.lit(PATHS_OPENING + PATHS_FORMAT + "\n"), framed(title, abstract), F.lit(PATHS_CLOSING_FORMAT))

    def shot(e: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return F.concat(F.lit("### EXAMPLE "), number, F.lit(" ###\n"), framed(e["title"], e["abstract"]), response(e["paths"]), F.lit("### END EXAMPLE "), number, F.lit(" ###\n"))

    return F.concat(F.lit(PATHS_OPENING), F.array_join(F.transform(examples, shot), ""), F.lit("\n"), framed(title, abstract), F.lit(PATHS_CLOSING_EXAMPLES))


def reasoning_prompt(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit(REASONING_OPENING), framed(title, abstract))


def concepts_prompt(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit(CONCEPTS_OPENING), framed(title, abstract), F.lit(CONCEPTS_CLOSING))


def instruct_chat(messages: Column, begin: str = "<s>", end: str = "</s>") -> Column:
    """Alternating user and assistant messages, users' in [INST] marks; other orders raise an error."""

    def turn(m: Column, i: Column) -> Column:
        stop = F.raise_error(F.lit("roles must alternate between user and assistant")).cast("string")
        user, assistant = F.concat(F.lit("[INST] "), m["content"], F.lit(" [/INST]")), F.concat(m["content"], F.lit(end))
        return F.when((m["role"] == "user") & (i % 2 == 0), user).when((m["role"] == "assistant") & (i % 2 == 1), assistant).otherwise(stop)

    return F.concat(F.lit(begin), F.array_join(F.transform(messages, turn), ""))


def is_response(x: Column) -> Column:
    """Whether a text is of the form of ``RESPONSE``: paths line by line, the last line perhaps ended too.

    Lines and their concepts are looked at one by one, so a long text is no deep match. Letters are those of any script.
    """
    lines = F.split(F.regexp_replace(x, r"\n\z", ""), "\n", -1)

    def path(line: Column) -> Column:
        parts = F.split(line, ARROW, -1)
        return (parts[0] == ROOT) & (F.size(parts) > 1) & F.forall(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda c: c.rlike(CONCEPT))

    return F.forall(lines, path)
