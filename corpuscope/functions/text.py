"""Text column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode-aware ``str.strip`` / ``str.split`` treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NON_SPACE_RUN = r"(?U)[^\s\x1c-\x1f]+"
# Every character that ends a line besides the line feed.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# White space inside a line of a text whose breaks are all line feeds.
BLANKS = r"[\s\x1c-\x1f&&[^\n]]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def words(c) -> Column:
    """White-space separated words as an array."""
    return F.regexp_extract_all(as_col(c), F.lit(NON_SPACE_RUN), F.lit(0))


def word_count(c) -> Column:
    return F.size(words(c)).cast("bigint")


def count_occurrences(c, token: str) -> Column:
    """Non-overlapping occurrences of ``token``."""
    text = as_col(c)
    removed = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (removed / F.lit(len(token))).cast("bigint")


def normal_breaks(c) -> Column:
    """The text with every kind of line break as a line feed; most texts hold no other and are only searched."""
    text = F.coalesce(as_col(c), F.lit(""))
    unified = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS))
    return F.when(contains_any(text, OTHER_BREAKS), unified).otherwise(text)


def split_lines(normal) -> Column:
    """Lines of a text with normal breaks; a final break opens no further line, an empty text has none.

    Give it a column that already holds :func:`normal_breaks`, so that work is done once.
    """
    text = as_col(normal)
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_count(normal) -> Column:
    """Number of lines of a text with normal breaks, without splitting it."""
    text = as_col(normal)
    ended = (text == "") | F.endswith(text, F.lit("\n"))
    return count_occurrences(text, "\n") + F.when(ended, 0).otherwise(1)


# Letters outside ASCII that match an ASCII letter when case is ignored.
FOLDED_LETTERS = ("İıſK", "iisk")


def folded(c) -> Column:
    """Lower case, with the letters that only case folding maps to ASCII; a cheap test before a pattern that ignores case."""
    text = as_col(c)
    plain = F.translate(text, *FOLDED_LETTERS)
    return F.lower(F.when(contains_any(text, FOLDED_LETTERS[0]), plain).otherwise(text))


def file_name(path) -> Column:
    """Last component of a path, ignoring trailing slashes."""
    return F.substring_index(F.rtrim(as_col(path), F.lit("/")), "/", -1)


def any_of(conditions) -> Column:
    """OR of conditions; false when there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c, phrases) -> Column:
    text = as_col(c)
    return any_of(F.contains(text, F.lit(p)) for p in phrases)


def present(c, phrases) -> Column:
    """The phrases found in the text, in the order they are listed."""
    text = as_col(c)
    found = [F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*found))


def ilike_term(lowered, term: str, literal: bool = False) -> Column:
    """Containment in a lower-case text; ``%`` and ``_`` of the term stay wildcards unless literal.

    Lower the text once and test all terms on it: ``lowered LIKE '%term%'`` is ``text ILIKE '%term%'``.
    """
    text = as_col(lowered)
    if literal:
        return F.contains(text, F.lit(term.lower()))
    return text.like(f"%{term.lower()}%")
