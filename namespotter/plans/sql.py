"""DuckDB SQL fragments for the oracle queries.

Each oracle restates a query independently in SQL over the driver's views.
The character classes are the same fixed values as in ``functions.text``.
DuckDB's edit-distance functions count bytes, so strings are first mapped
one character to one byte: ASCII stays, every non-ASCII character that
occurs in a dictionary name gets its own free one-byte code, and any other
non-ASCII character becomes ``~`` (it can never equal a name character).
Distances and Jaro scores depend only on which characters are equal, so
the mapping keeps them exact.
"""

from __future__ import annotations

# The same classes as functions.text, in RE2 syntax.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
PUNCT = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
NON_ALNUM = r"[^\p{L}\p{N}]"
WORD_RUN = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"

# One-byte codes that never survive normalisation (no letters, digits,
# space or underscore): control bytes and ASCII punctuation except '~'.
FREE_CODES = (list(range(1, 9)) + list(range(14, 28)) + list(range(33, 48))
              + list(range(58, 65)) + [91, 92, 93, 94, 96, 123, 124, 125])


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> '')"


def strip_punct(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{PUNCT}', '', 'g')"


def alnum_lower(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '{NON_ALNUM}', '', 'g'))"


def ents_all() -> str:
    return (f"SELECT item_id * 100000 + g AS entity_id, array_to_string(list_slice(ws, 3 * g + 1, 3 * g + 3), ' ') AS name "
            f"FROM (SELECT item_id, {words('text')} AS ws FROM benchmark) b, unnest(range(0, (len(ws) + 2) // 3)) t(g)")


def windows(words_expr: str, size: int = 3) -> str:
    """doc_id, pos, window for word windows of ``size``."""
    return (f"SELECT doc_id, i AS pos, array_to_string(list_slice(ws, i + 1, i + {size}), ' ') AS wtext "
            f"FROM (SELECT doc_id, {words_expr} AS ws FROM documents) d, "
            f"unnest(range(0, len(ws) - {size - 1})) t(i)")


def char_map_cte(norm_names_rel: str) -> str:
    """One-row relation ``cm(chars)``: the non-ASCII characters of the names."""
    return (f"SELECT coalesce(list_sort(list_distinct(flatten(list(list_filter(string_split(nn, ''), "
            f"lambda c: ord(c) > 127))))), []) AS chars FROM {norm_names_rel}")


def to_bytes(expr: str) -> str:
    """Map ``expr`` one character to one byte (needs ``cm`` in scope)."""
    codes = "[" + ", ".join(str(c) for c in FREE_CODES) + "]"
    return (f"(CASE WHEN {expr} = '' THEN '' ELSE array_to_string(list_transform(string_split({expr}, ''), "
            f"lambda c: CASE WHEN ord(c) < 128 THEN c WHEN list_position(cm.chars, c) > 0 "
            f"THEN chr({codes}[list_position(cm.chars, c)]) ELSE '~' END), '') END)")


def grams(rel: str, key: str, col: str, n: int) -> str:
    """Distinct character n-grams (set semantics)."""
    return (f"SELECT DISTINCT {key}, substring({col}, i, {n}) AS gram FROM {rel}, "
            f"unnest(range(1, length({col}) - {n - 2})) t(i)")


def gram_counts(rel: str, key: str, col: str, n: int) -> str:
    """Character n-grams with counts (bag semantics)."""
    return (f"SELECT {key}, substring({col}, i, {n}) AS gram, count(*) AS n FROM {rel}, "
            f"unnest(range(1, length({col}) - {n - 2})) t(i) GROUP BY ALL")
