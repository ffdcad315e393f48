"""Column expressions for normalising and tokenising text.

Every function maps Columns to Columns, so Catalyst keeps them inside
whole-stage code generation and pushes nothing through Python.

Java's ``\\w`` and ``\\s`` are ASCII-only, unlike the Unicode-aware classes of
the matcher we follow, so the character classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that reproduce Unicode-aware word,
# alphanumeric and whitespace tests on assigned code points.
WORD_CLASS = r"\p{L}\p{N}_"
ALNUM_CLASS = r"\p{L}\p{N}"
SPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}"

PUNCT_RE = f"[^{WORD_CLASS}{SPACE_CLASS}]"
NON_ALNUM_RE = f"[^{ALNUM_CLASS}]"
SPACE_RUN_RE = f"[{SPACE_CLASS}]+"
WORD_RUN_RE = f"([{WORD_CLASS}]+)"
TERM_RE = f"([{WORD_CLASS}]{{2,}})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_punct(col) -> Column:
    """Lower-case, then delete every character that is neither a word
    character nor whitespace.  Underscores and spaces survive."""
    return F.regexp_replace(F.lower(_c(col)), PUNCT_RE, "")


def alnum_lower(col) -> Column:
    """Keep letters and digits only, lower-cased, no spaces."""
    return F.lower(F.regexp_replace(_c(col), NON_ALNUM_RE, ""))


def word_tokens(col) -> Column:
    """Runs of word characters in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RUN_RE), 1)


def ascii_clean(col) -> Column:
    """Every character outside printable ASCII becomes a space, runs of
    whitespace collapse to one space, ends are trimmed."""
    spaced = F.regexp_replace(_c(col).cast("string"), r"[^\x20-\x7E]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def vector_terms(col) -> Column:
    """Vectoriser terms, runs of two or more word characters, lowered."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TERM_RE), 1)


def split_ws(col) -> Column:
    """Split on whitespace runs, dropping empty pieces (leading space)."""
    return F.filter(F.split(_c(col), SPACE_RUN_RE), lambda x: x != F.lit(""))
