"""Column functions on text (F1-F16, F18, N2, V5-V7). All but F14 run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between Unicode white space, as written."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """lower-case words."""
    return words(F.lower(text))


def token_count(text: Column) -> Column:
    """V7: number of words."""
    return F.size(words(text)).cast("long")


def overlap(text: Column, terms: Column) -> Column:
    """Number of terms that the text contains, case-insensitively; equal terms count each."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.contains(low, t).cast("int"))


def keyword_score(text: Column, terms: Column) -> Column:
    """share of the terms contained in the text; null without terms."""
    return F.try_divide(overlap(text, terms).cast("double"), F.size(terms))


def rerank_score(text: Column, query: Column) -> Column:
    """share of the query's terms in the text, 0.25 more where the whole query stands in it."""
    terms, phrase = tokens(query), F.lower(trimmed(query))
    bonus = F.when(F.contains(F.lower(text), phrase), 0.25).otherwise(0.0)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.least(F.lit(1.0), keyword_score(text, terms) + bonus))


def normalized(text: Column) -> Column:
    """lower case, runs of white space as one space."""
    return F.lower(F.array_join(words(text), " "))


def near_duplicate(a: Column, b: Column) -> Column:
    """one contains the other and their byte lengths differ by a tenth at most."""
    short, long = F.least(F.octet_length(a), F.octet_length(b)), F.greatest(F.octet_length(a), F.octet_length(b))
    return (short > 0) & (F.contains(a, b) | F.contains(b, a)) & (10 * short >= 9 * long)


def citation_snippet(text: Column, limit: int = 160) -> Column:
    """trimmed text, cut with three dots."""
    t = trimmed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit)), r"(?U)\s+$", ""), F.lit("...")))


def search_snippet(text: Column, limit: int = 240) -> Column:
    """F8: text as it is, cut with an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("…")))


def session_title(message: Column) -> Column:
    """first 60 characters."""
    return F.left(message, F.lit(60))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)


def cache_key(hash_col: Column, version: str) -> Column:
    """hash and version."""
    return F.concat_ws(":", hash_col, F.lit(version))


def slug(heading: Column) -> Column:
    """lower case, word characters and hyphens only, white space as hyphens."""
    return F.regexp_replace(F.regexp_replace(trimmed(F.lower(heading)), r"[^\w\s-]", ""), r"\s+", "-")


def latex_delimiters(text: Column) -> Column:
    r"""``\[..\]`` to ``$$..$$`` and ``\(..\)`` to ``$..$``; blank ones stay."""
    display = F.regexp_replace(text, r"\\\[\s*(?!\s|\\\])((?:(?!\\\])[\s\S])*?)\s*\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(display, r"\\\(\s*(?!\s|\\\))((?:(?!\\\))[\s\S])*?)\s*\\\)", r"\$$1\$")


def highlight_parts(text: Column, query: str) -> Column:
    """the text cut at each case-insensitive match of a literal, matches kept."""
    if not query.strip():
        return F.array(text)
    import re

    literal = "(?i)" + "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 and not c.isspace() else c for c in query)
    assert re.compile(literal)
    marked = F.regexp_replace(text, f"({literal})", "\u0001$1\u0001")
    return F.split(marked, "\u0001")


def without_fence(text: Column) -> Column:
    """the inside of a code fence around the whole text."""
    t = trimmed(text)
    return F.when(t.startswith("```"), trimmed(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"(?s)```(?!.*```).*$", ""))).otherwise(t)


#: Strings (the last one may be open), braces, and what lies between them.
_PIECES = r'(?s)"(?:[^"\\]|\\.)*+"|".*+|[{}]|[^"{}]++'


def first_object(text: Column) -> Column:
    """the first balanced ``{...}`` outside strings; the text itself where there is none."""
    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + (piece == "{").cast("int") - (piece == "}").cast("int")
        begin = F.when((piece == "{") & (s["depth"] == 0), s["at"]).otherwise(s["begin"])
        closed = (s["end"] == 0) & (piece == "}") & (depth == 0) & (begin >= 0)
        end = s["at"] + 1
        found = s["end"] > 0
        return F.struct(depth.alias("depth"), (s["at"] + F.length(piece)).alias("at"), F.when(found, s["begin"]).otherwise(begin).alias("begin"), F.when(closed, end).otherwise(s["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("begin"), F.lit(0).alias("end"))
    place = lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))
    found = F.aggregate(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), start, step, place)
    cut = lambda s: F.when(s["end"] > 0, F.substring(text, s["begin"] + 1, s["end"] - s["begin"])).otherwise(text)
    return F.element_at(F.transform(F.array(found), cut), 1)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else (a value alone may be followed by more, one within brackets may not)."""
    return F.try_parse_json(text).isNotNull() & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()


def json_text(text: Column) -> Column:
    """what stands in a fence, whole where it is JSON as it stands, else the first object in it."""
    inside = without_fence(text)
    return F.when(is_json(inside), inside).otherwise(first_object(inside))


def revision_line(node: Column, mastery: Column, weakness: Column, attempts: Column) -> Column:
    """one line of a revision plan."""
    return F.format_string("concept %d: mastery %.2f, weakness %.2f, attempts %d", node, mastery, weakness, attempts)


#: Own default instructions; callers pass theirs.
TUTOR = "You are a tutor. Treat the context as the main source, add general knowledge where it does not suffice, and cite it as [n]."
REVIEW = "You help with a literature review. Compare the labelled sources, say where they agree and differ, and cite them as [n]."
COMPARISON = "You compare sources. Keep each source's claims apart, name what each lacks, and cite them as [n]."
MATHS = "Write all mathematics in LaTeX between dollar signs."
NO_CONTEXT = "(The search of this workspace came back empty. Say that, then answer from what you know.)"
NO_SOURCES = "(The chosen sources hold nothing on this. Say that, then answer from what you know.)"


def prompt(query: Column, hits: Column, system: str = TUTOR) -> Column:
    """prompt of numbered passages (an array of texts)."""
    numbered = F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h)), "\n\n")
    return _assembled(system, "PASSAGES", F.when(F.size(hits) > 0, numbered).otherwise(NO_CONTEXT), "QUESTION", query)


def research_prompt(query: Column, hits: Column, system: str = REVIEW) -> Column:
    """F16: prompt of numbered, labelled passages (an array of structs label, text)."""
    numbered = F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), h["label"], F.lit(")\n"), h["text"])), "\n\n")
    return _assembled(system, "SOURCES", F.when(F.size(hits) > 0, numbered).otherwise(NO_SOURCES), "QUESTION", query)


def _assembled(system: str, context_title: str, context: Column, question_title: str, query: Column) -> Column:
    rule = "\n\n---\n\n"
    return F.concat(F.lit(f"SYSTEM\n\n{system}\n\n{MATHS}{rule}{context_title}\n\n"), context, F.lit(f"{rule}{question_title}\n\n"), query, F.lit(f"{rule}REPLY\n\nWrite the answer only."))


def context_budget(window: Column, ceiling: int = 4096, reserve: int = 1024) -> Column:
    """V5: tokens left for context."""
    return F.least(F.lit(ceiling), F.greatest(window - reserve, F.lit(0)))


def context_size(prompt_words: Column, window: Column) -> Column:
    """V6: context to ask a model for."""
    return F.least(F.greatest(prompt_words + 1024, F.lit(2048)), F.coalesce(window, F.lit(4096)))


def looks_like_text(text: Column) -> Column:
    """Nine tenths of the characters are ASCII graphics or white space."""
    odd = F.length(F.regexp_replace(text, r"[\x21-\x7E\s]", ""))
    return (F.length(trimmed(text)) > 0) & (10 * odd <= F.length(text))
