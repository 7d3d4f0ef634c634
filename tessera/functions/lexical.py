"""Query terms (driver side) and the lexical score (Catalyst)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and signs that are treated specially, and patterns of paths and name parts.
STOPWORDS = frozenset(("a", "an", "and", "at", "for", "in", "is", "of", "the", "to", "what", "where", "which"))
LONE_SIGNS = frozenset("%_$")
LOW_INFORMATION = frozenset(("api", "class", "code", "controller", "endpoint", "file", "http", "method", "module", "path"))
PATH = re.compile(r"/(?:[\w{}:.-]+/)*[\w{}:.-]+")
CAMEL_SHAPE = re.compile(r"[a-z\d][A-Z]|[A-Z]{2,}[a-z]")
CAMEL_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
MAX_TERMS = 12


def fold(text: str | None) -> str:
    """NFC and case folding; None reads as empty."""
    return unicodedata.normalize("NFC", text or "").casefold()


def camel_parts(name: str) -> list[str]:
    return CAMEL_PART.findall(name) if name.isascii() else [name]


def _starts(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind in ("Nl", "Sc", "Pc")


def _goes_on(c: str) -> bool:
    return _starts(c) or unicodedata.category(c)[0] in "MN" or unicodedata.category(c) == "Cf"


def identifiers(text: str) -> Iterator[tuple[int, str]]:
    """(place, token): runs of identifier characters, joined by single dots or dashes before a start character."""
    begin = None
    for i, c in enumerate(text + " "):
        if begin is None:
            begin = i if _starts(c) and i < len(text) else None
        elif i == len(text) or not (_goes_on(c) or (c in ".-" and i + 1 < len(text) and _starts(text[i + 1]))):
            yield begin, text[begin:i]
            begin = None


def _candidates(text: str) -> Iterator[str]:
    """All terms in order, before folding, stop words and repeats."""
    paths = [(m.start(), m.end()) for m in PATH.finditer(text)]
    for low, high in paths:
        yield text[low:high]
        for piece in (p.strip("{}") for p in text[low:high].split("/")):
            if piece:
                yield piece
                yield from camel_parts(piece)
    for at, token in identifiers(text):
        if any(low <= at < high for low, high in paths):
            continue
        yield token
        dotted = re.split(r"\.+", token)
        if len(dotted) == 1 and not re.search(r"[_$-]", token) and not CAMEL_SHAPE.search(token):
            continue
        for segment in dotted:
            if len(dotted) > 1:
                yield segment
            for piece in filter(None, re.split(r"[_$-]+", segment)):
                yield from camel_parts(piece)


def parse_terms(query: str, max_terms: int = MAX_TERMS) -> list[str]:
    """At most ``max_terms`` search terms of a query, in order: paths and their parts first, then identifiers and theirs."""
    if max_terms < 1:
        raise ValueError("max_terms must be at least 1")
    text = unicodedata.normalize("NFC", query)
    if text.strip() in LONE_SIGNS:
        return [text.strip()]
    found: dict[str, None] = {}
    for candidate in _candidates(text):
        term = candidate.casefold()
        if term and term not in STOPWORDS:
            found.setdefault(term)
            if len(found) == max_terms:
                break
    return list(found)


FIELDS = ("name", "qualified_name", "metadata_json", "file_path", "content")


@cache
def special_class() -> str:
    """Pattern of the characters for which lower case alone may differ from :func:`fold`.

    By rule: those that fold to something else than their lower case, those that composition changes
    or that may compose with the character before, and everything outside the first two planes.
    """
    second = {d.split()[1] for c in range(0x20000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    seconds = {int(x, 16) for x in second}

    def odd(c: int) -> bool:
        x = chr(c)
        return x.casefold() != x.lower() or unicodedata.normalize("NFC", x) != x or unicodedata.combining(x) > 0 or c in seconds or 0x1160 <= c < 0x1200 or x in "\u03a3\u0130"

    out, begin = [], None
    for c in range(0x80, 0x20001):
        if begin is None and c < 0x20000 and odd(c):
            begin = c
        elif begin is not None and (c == 0x20000 or not odd(c)):
            out.append(f"\\x{{{begin:X}}}-\\x{{{c - 1:X}}}")
            begin = None
    # the class is asked of characters outside ASCII only
    return f"[^\\x00-\\x7F](?<=[{''.join(out)}\\x{{20000}}-\\x{{10FFFF}}])"


def _fold_rest(values):
    return values.map(lambda x: None if x is None else fold(x))


def folded(df: DataFrame, *columns: str, prefix: str = "folded_") -> DataFrame:
    """``df`` with a column ``prefix + c``, exactly :func:`fold`, for each of ``columns``.

    Lower case in the JVM does for nearly all texts; only those with special characters go to Python.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    odd = F.pandas_udf(_fold_rest, "string")
    rest = {f"rest_{c}": odd(F.when(text[c].rlike(special_class()), text[c])) for c in columns}
    return df.withColumns(rest).withColumns({prefix + c: F.coalesce(F.col(f"rest_{c}"), F.lower(text[c])) for c in columns}).drop(*rest)


def field_score(term: str) -> Column:
    """Score of one term against an entity's :func:`folded` fields: the best of its matches, as literal containment."""
    name, qualified, metadata, path, content = (F.col(f"folded_{c}") for c in FIELDS)
    has = lambda field: field.contains(F.lit(term))
    score = F.when(name == term, 1.0).when(has(qualified), 0.9)
    if term.startswith("/"):
        score = score.when(has(metadata) | has(name), 0.85)
    return score.when(has(name), 0.75).when(has(path), 0.6).when(has(content), 0.4).otherwise(0.0)


def term_scores(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``df`` with one column, ``term_0`` and so on, for the score of each term; fields are folded once."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return folded(df, *FIELDS).select(*kept, *[field_score(t).alias(f"term_{i}") for i, t in enumerate(terms)])


def lexical_score(terms: Sequence[str], first: int = 0, scores: Sequence[Column] | None = None) -> Column:
    """Score from the columns of :func:`term_scores`, those of ``terms`` beginning at ``first``, or from ``scores``.

    One term: its score.  Several: 0.6 of the matched weight and 0.4 of the weighted scores, over all weights.
    """
    scores = scores or [F.col(f"term_{first + i}") for i in range(len(terms))]
    if len(terms) == 1:
        return scores[0]
    weights = [0.25 if t in LOW_INFORMATION else 1.0 for t in terms]
    matched = sum((F.when(s > 0, w).otherwise(0.0) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    weighted = sum((s * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return (matched * 0.6) / sum(weights) + (weighted * 0.4) / sum(weights)
