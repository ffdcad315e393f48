"""Secret scans by assignment-aware lexing.

Fixed patterns find the plain cases.  Beside them, each text is lexed as source
or configuration syntax into name-literal pairs (``name = "x"``, ``"name": 'x'``,
``export NAME=x``, ``name := "a" + OTHER``); names bound to literals are
propagated through references and concatenations, and a literal is scored by
the sensitivity of the name it reaches and by how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_field, per_document, table, text_field

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(rb"[0-9a-f]{32}")

#: Parts of names that hold secrets, with their weight.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "key": 0.7, "privatekey": 1.0}
_STEMS = re.compile(rb"(?:pass|pwd|secret|token|key|cred|auth|bearer)[\w.\-]*[\"']?[ \t]*(?::=|=>|=|:)")
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|redacted|your[_-]|x{4,}|\*{3,}|\.{3,}", re.I)
#: A match of the pattern above lies in two neighbours' last and first characters, or in one of them.
_EDGE = len("placeholder")
_NOT_FIRST = "$<%{"

_LEX = re.compile(r"""
    (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<bind>:=|=>|=(?!=)|:)
  | (?P<plus>\+)
  | (?P<end>[\n;,{}\[\]()])
  | (?P<word>[^\s"'`=:+;,{}\[\]()]+)
  | (?P<skip>[ \t\r\f\v]+|.)
""", re.X)
#: Of string literals: b"", rb"", u8"", r#""#, $"", @"".
_PREFIX = re.compile(r"(?:[A-Za-z]{1,2}#*|u8|[$@]{1,2})\Z")
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*\Z", re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]


# ------------------------------------------------------------ lexing
def assignments(text: str):
    """(name, parts) of every binding, in order, without parts where none are known; a part is ("literal", start, end)
    or ("name", name).  Quoted names count as names on the left of a bind."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text) if m.lastgroup != "skip"]
    i = 0
    while i < len(tokens):
        if tokens[i][0] == "bind" and i and tokens[i - 1][0] in ("word", "string"):
            kind, a, b = tokens[i - 1]
            name = text[a:b] if kind == "word" else text[a + 1:b - 1]
            if _NAME.match(name):
                typed = _after_type(text, tokens, i)
                parts, i = _value(text, tokens, i + 1)
                yield name, parts
                if typed and (parts := _value(text, tokens, typed + 1)[0]):
                    yield name, parts
                continue
        i += 1


def _after_type(text, tokens, i):
    """The equals sign after the colon at ``i`` and a type on the same line, if there is one."""
    if text[tokens[i][1]] != ":" or tokens[i][2] - tokens[i][1] > 1:
        return None
    depth = 0
    for k in range(i + 1, len(tokens)):
        kind, a, b = tokens[k]
        if kind == "bind":
            return k if text[a:b] == "=" and k > i + 1 and depth <= 0 else None
        if kind == "word":
            depth += text.count("<", a, b) - text.count(">", a, b)
        elif kind == "end" and text[a] in "[(":
            depth += 1
        elif kind == "end" and text[a] in "])" and depth > 0:
            depth -= 1
        elif kind != "end" or text[a] != "," or depth <= 0:
            return None
    return None


def _next_pair(text, tokens, i):
    """Whether the token at ``i`` is the name of a pair."""
    kind, a, b = tokens[i]
    own = text[a:b] if kind == "word" else text[a + 1:b - 1]
    return i + 1 < len(tokens) and tokens[i + 1][0] == "bind" and tokens[i + 1][2] - tokens[i + 1][1] == 1 and _NAME.match(own) is not None


def _value(text, tokens, i):
    """Operands joined by plus signs, or next to each other in brackets, also over
    several lines in brackets or at a plus; anything else that follows ends the value."""
    parts, want, depth, lines = [], True, 0, False
    while i < len(tokens):
        kind, a, b = tokens[i]
        if kind == "end" and text[a] == "\n" and (depth or (want and parts) or _plus_follows(text, tokens, i)):
            lines = True
        elif kind == "end" and text[a] in "([" and want:
            depth += 1
        elif kind == "end" and text[a] in ")]" and depth:
            depth -= 1
        elif kind == "string" and (want or depth) and not (lines and _next_pair(text, tokens, i)):
            parts.append(("literal", a + 1, b - 1))
            want = False
        elif kind == "word" and (want or depth) and i + 1 < len(tokens) and tokens[i + 1][:2] == ("string", b) and _PREFIX.match(text[a:b]):
            pass  # of the string that touches it
        elif want and kind == "word":
            if _next_pair(text, tokens, i):
                break
            parts += [("name", text[a:b])] if _NAME.match(text[a:b]) else []
            parts.append(("bare", a, b))
            want = False
        elif not want and kind == "plus":
            want = True
        else:
            break
        i += 1
    return parts, i


def _plus_follows(text, tokens, i):
    """Whether the next line starts with a plus sign and an operand that is no pair's name."""
    return (i + 2 < len(tokens) and tokens[i + 1][0] == "plus" and tokens[i + 2][0] in ("string", "word")
            and not _next_pair(text, tokens, i + 2))


def name_weight(name: str) -> float:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.rsplit(".", 1)[-1])
    parts = [p for p in re.split(r"[^a-z0-9]+", spaced.lower()) if p]
    joined = ["".join(parts[i:i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


class Made:
    """What a value's weight needs of its text, and the parts it is made of: literal
    spans and other values.  The text itself is never joined."""

    __slots__ = ("length", "counts", "head", "tail", "placeholder", "parts")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        self.length, self.counts, self.parts = len(text), Counter(text), [span] if span else []
        self.head, self.tail, self.placeholder = text[:_EDGE], text[-_EDGE:], _PLACEHOLDER.search(text) is not None

    def add(self, other: Made) -> None:
        """Append another value's text."""
        self.placeholder = self.placeholder or other.placeholder or _PLACEHOLDER.search(self.tail + other.head) is not None
        if len(self.head) < _EDGE:
            self.head = (self.head + other.head)[:_EDGE]
        self.tail = (self.tail + other.tail)[-_EDGE:]
        self.length += other.length
        self.counts.update(other.counts)
        self.parts.append(other)

    def weight(self) -> float:
        """0 for short or placeholder values, else up to 1 with length and entropy."""
        if self.length < 8 or any(map(str.isspace, self.counts)) or self.placeholder:
            return 0.0
        if self.head[0] in _NOT_FIRST or len({c.lower() for c in self.counts}) == 1:
            return 0.0
        n = self.length
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c / n)
        mixed = sum(any(map(f, self.counts)) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in self.counts)
        return min(n, 16) / 16 * min(1.0, bits / 3.5) * (1.0 if mixed > 1 else 0.6)


def literal_weight(value: str) -> float:
    return Made(value).weight()


def literal_spans(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through constants."""
    values: dict[str, Made] = {}
    found, marked = set(), set()
    held = []  # marked values stay, so that their ids do

    def mark(made: Made) -> None:
        stack = [made]
        while stack:
            own = stack.pop()
            if id(own) not in marked:
                marked.add(id(own))
                held.append(own)
                for p in own.parts:
                    if isinstance(p, Made):
                        stack.append(p)
                    elif p[1] > p[0]:
                        found.add(p)

    for name, parts in assignments(text):
        made, known = Made(), bool(parts)
        k = 0
        while k < len(parts):
            part = parts[k]
            if part[0] == "name" and part[1] in values:
                made.add(values[part[1]])
                k += 2  # its bare form follows
                continue
            if part[0] == "name":
                k += 1
                continue
            if part[0] == "bare" and len(parts) > 2:
                known = False  # an unknown name inside an expression
            made.add(Made(text[part[1]:part[2]], part[1:]))
            k += 1
        if known and made.length:
            values[name] = made
        else:
            values.pop(name, None)  # bound to something else now
        if made.parts and name_weight(name) * made.weight() >= least:
            mark(made)
    return sorted(found)


def secret_spans(raw: bytes, least: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans by start, then kind: base spans, and the scored literals that these do not cover whole."""
    low = raw.lower()
    lexed = _STEMS.search(low) is not None
    if not (lexed or b"AKIA" in raw or any(k in low for k in _KEYWORDS) or _LONG_HEX.search(raw)):
        return []
    text = raw.decode()
    found = base_spans(text)
    if lexed:
        covered = sorted((a, b) for k, a, b in found)
        found += [("literal", a, b) for a, b in literal_spans(text, least) if not _covers(covered, a, b)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _covers(spans, a, b):
    """Whether the union of sorted spans holds all of a to b."""
    for s, e in spans:
        if s > a or a >= b:
            break
        a = max(a, e)
    return a >= b


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, least: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``n_literal``, ``base_sha256`` and
    ``spans`` (``kind:start:end``, code points, end exclusive, comma-joined).

    Null and empty texts have no span.
    """
    def start():
        def compute(texts):
            out = [[] for _ in range(6)]
            for t in texts:
                spans = secret_spans(t, least)
                base = [s for s in spans if s[0] != "literal"]
                for k, kind in enumerate(KINDS):
                    out[k].append(sum(s[0] == kind for s in spans))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(spans))
            return out

        return compute

    fields = [long_field(f"n_{k}") for k in KINDS] + [text_field("base_sha256"), text_field("spans")]
    return per_document(docs, fields, start, text_col, keep)


def redacted(raw: bytes, mark: str = "[SECRET]", least: float = 0.5) -> str:
    text, at, out = raw.decode(), 0, []
    for _, a, b in secret_spans(raw, least):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every found span replaced by ``mark``; a null text stays null.
    Where there is a column ``n_chars``, it follows the new text."""
    columns = docs.columns

    def start():
        return lambda texts: [[redacted(t, mark, least) for t in texts]]

    # the text goes in under a name of its own, so that nulls can be told apart
    named = [f"c{i}" for i in range(len(columns))]
    text = named[columns.index(text_col)]
    out = per_document(docs.toDF(*named), [("clean", docs.schema[text_col].dataType, pa.string())], start, text)
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("clean"))).drop("clean").toDF(*columns)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs, keep=["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")
