"""Conversation structure repair: cheapest edits by Viterbi with coalescing survivors.

Rows are shuffled once, by conversation.  Within a task they are sorted (Spark
spills), repeats are marked by a window over the same partitioning, and a
second sort puts them in the order of turns.  Python then streams over the
Arrow batches with one conversation open at a time.

The decoder keeps one survivor per state of the role grammar ``(s?(ua)+)?``:
its cost and the last node of its path in a backpointer tree.  Nodes count
their references; as soon as all survivors share an ancestor, the edits up to
it are final, are emitted (rows that stay go straight into the digest) and are
forgotten.  Runs of deletions that only one path uses share a node.

Paths of equal cost in one state are decided by their complete unresolved
suffixes, without walking them: survivors carry the rank of their path among
all survivors' paths.  A path is the survivor it extends, the rows inserted
since and the edit of the new row, so two paths compare by the ranks of what
they extend and, extending the same one, by the few edits added.  No path ends
up as the beginning of another: both edit the same rows, and the last edit is
that of a row.

A conversation is one stream, since its digest is over its whole repaired text;
a task's memory does not grow with the conversation but for the audit, which is
part of the result, and edits that are unresolved.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
#: States of the grammar: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (EMPTY, ASSISTANT)
#: The state a row of this initial leads to, per state.
STEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}
#: What any continuation from the second state costs more, at most, if it is followed from the first: a row of role s is
#: deleted in place of being kept, an assistant is inserted.
DOMINATES = [(ASSISTANT, SYSTEM, 0), (EMPTY, SYSTEM, 0), (USER, SYSTEM, COSTS[INSERT]), (ASSISTANT, EMPTY, COSTS[DELETE]),
             (USER, EMPTY, COSTS[INSERT] + COSTS[DELETE])]
#: (from, to, states passed): rows inserted one after the other, never in a circle.
INSERTED = [(s, s, ()) for s in range(4)] + [(s, USER, (USER,)) for s in (EMPTY, SYSTEM, ASSISTANT)] + [
    (s, ASSISTANT, (USER, ASSISTANT)) for s in (EMPTY, SYSTEM)] + [(USER, ASSISTANT, (ASSISTANT,))]


class Node:
    """A row's edit and the insertions before it (``count`` equal deletions, where rows follow each other so)."""

    __slots__ = ("parent", "edits", "count", "said", "refs")

    def __init__(self, parent: Node | None, edits: str, said: tuple):
        self.parent, self.edits, self.said, self.count, self.refs = parent, edits, said, 1, 1
        if parent is not None:
            parent.refs += 1


class Decoder:
    """Viterbi over the rows of one conversation."""

    def __init__(self):
        self.root = Node(None, "", ())
        #: per state: cost, rank of the path, last node
        self.alive: list[tuple[int, int, Node] | None] = [(0, 0, self.root), None, None, None]
        self.edits: list[str] = []
        self.digest, self.n_said = hashlib.sha256(), 0
        self.held = self.largest = self.since = 0

    def _entered(self) -> list[tuple[int, int, str, tuple, Node] | None]:
        """Per state the best way to be in it before the next row: cost, rank, insertions, rows inserted, node."""
        best = [None] * 4
        for source, state, passed in INSERTED:
            if self.alive[source] is not None:
                cost, rank, node = self.alive[source]
                way = (cost + COSTS[INSERT] * len(passed), rank, INSERT * len(passed), passed, node)
                if best[state] is None or way[:2] < best[state][:2]:
                    best[state] = way
        return best

    def row(self, initial: str, role: bytes, text: bytes, doomed: bool, truncated: bool) -> None:
        """Take one row; ``doomed`` rows (blank or duplicate) must be deleted."""
        more = TRUNCATED if truncated else 0
        best = [None] * 4

        def offer(state, cost, rank, edits, passed, node, said):
            if best[state] is None or (cost, rank, edits) < best[state][:3]:
                best[state] = (cost, rank, edits, passed, node, said)

        for state, way in enumerate(self._entered()):
            if way is None:
                continue
            cost, rank, edits, passed, node = way
            offer(state, cost + COSTS[DELETE], rank, edits + DELETE, passed, node, None)
            if doomed:
                continue
            if state in STEP.get(initial, ()):
                offer(STEP[initial][state], cost + COSTS[KEEP] + more, rank, edits + KEEP, passed, node, role + b":")
            for new in "ua":
                if state in STEP[new]:
                    to = STEP[new][state]
                    offer(to, cost + COSTS[REROLE] + more, rank, edits + REROLE, passed, node, NAMES[to])
        for strong, weak, more in DOMINATES:  # paths that no continuation can make the cheapest end here
            if best[strong] is not None and best[weak] is not None and best[strong][0] + more < best[weak][0]:
                best[weak] = None
        order = {key: k for k, key in enumerate(sorted(b[1:3] for b in best if b is not None))}
        alive = []
        for found in best:
            if found is None:
                alive.append(None)
                continue
            cost, rank, edits, passed, node, said = found
            rows = tuple(NAMES[s] for s in passed)
            alive.append((cost, order[rank, edits], Node(node, edits, rows if said is None else (*rows, said + text))))
        for old in self.alive:
            if old is not None:
                self._release(old[2])
        self.alive = alive
        self._merge()
        self._coalesce()

    @staticmethod
    def _release(node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def _merge(self) -> None:
        for now in self.alive:
            if now is not None:
                node, above = now[2], now[2].parent
                if above is not self.root and above.refs == 1 and above.edits == node.edits == DELETE:
                    node.count += above.count
                    node.parent = above.parent  # takes over the reference that `above` held

    def _coalesce(self) -> None:
        """Emit the edits all survivors share.  There are some only if one edit
        alone follows the root; the walk to it waits for half as many rows as
        the last one passed, so a row costs constant time on average."""
        self.since += 1
        if self.root.refs > 1 or 2 * self.since < self.held:
            return
        path = []
        node = next(now for now in self.alive if now is not None)[2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        self.largest, self.since = max(self.largest, len(path)), 0
        last = self.root
        while path:
            last = path.pop()
            self._emit(last.edits * last.count, last.said)
            if last.refs > 1:
                break
        self.held = len(path)
        last.parent, self.root = None, last

    def _emit(self, edits: str, said: tuple) -> None:
        self.edits.append(edits)
        for line in said:
            self.digest.update(b"\n" + line if self.n_said else line)
            self.n_said += 1
        if len(self.edits) > 4096:
            self.edits = ["".join(self.edits)]

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and SHA-256 of the repaired text."""
        ways = self._entered()
        cost, _, edits, passed, node = min((ways[s] for s in FINAL if ways[s] is not None), key=lambda w: w[:3])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        self.largest = max(self.largest, len(path))
        for node in reversed(path):
            self._emit(node.edits * node.count, node.said)
        self._emit(edits, tuple(NAMES[s] for s in passed))
        return cost, "".join(self.edits), self.digest.hexdigest()


# ------------------------------------------------------------ rows
BLANK = r"\A[ \t-\r]*+\z"
CUT_SHORT = r"[^.!? \t-\r][ \t-\r]*+\z"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, gone`` with the contract's damage: by
    crc32(``conv:turn``) % 20, 0 drops a row (``gone``), 1 empties its text, 2
    removes its ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls count as
    one space, but ``turn`` and ``conv`` stay null."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                       (kind == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


FIELDS = [("gaps", T.LongType(), pa.int64()), ("blank", T.LongType(), pa.int64()), ("duplicate", T.LongType(), pa.int64()),
          ("truncated", T.LongType(), pa.int64()), ("illegal", T.LongType(), pa.int64()), ("cost", T.LongType(), pa.int64()),
          ("audit", T.StringType(), pa.string()), ("repaired_sha256", T.StringType(), pa.string()),
          ("n_rows", T.LongType(), pa.int64()), ("unresolved_max", T.LongType(), pa.int64())]


class Conversation:
    """The figures of one conversation while its rows stream by."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self, conv):
        self.conv, self.decoder = conv, Decoder()
        self.blank = self.duplicate = self.truncated = self.illegal = self.n = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn, role: bytes, text: bytes, initial: str, blank: bool, repeat: bool, cut: bool) -> None:
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.n and self.before + initial not in self.LEGAL:
            self.illegal += 1
        self.before, self.n = initial, self.n + 1
        repeat, cut = repeat and not blank, cut and not blank and not repeat
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeat, self.truncated + cut
        self.decoder.row(initial, role, text, blank or repeat, cut)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.decoder.finish()
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest, self.n, self.decoder.largest)


def _stream(batches, ident: pa.DataType):
    """One row per conversation from rows sorted by conversation and turn."""
    names = ["conv", *(f[0] for f in FIELDS)]
    types = [ident, *(f[2] for f in FIELDS)]
    now, done = None, []

    def flush():
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for b in batches:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        raw = [cols[c].cast(pa.binary()).to_pylist() for c in ("role", "text")]
        rest = [cols[c].to_pylist() for c in ("conv", "turn", "gone", "initial", "is_blank", "is_repeat", "is_cut")]
        for conv, turn, gone, initial, blank, repeat, cut, role, text in zip(*rest, *raw, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append((now.conv, *now.result()))
                    if len(done) >= 1024:
                        yield flush()
                now = Conversation(conv)
            if not gone:
                now.add(turn, role, text, initial, blank, repeat, cut)
    if now is not None:
        done.append((now.conv, *now.result()))
    if done:
        yield flush()


def repaired(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``rows(conv, turn, role, text, gone)``, its
    identifier under the name ``conv_col``, with the figures of ``FIELDS``.

    ``gone`` rows only make their conversation known.  Rows are taken by turn,
    nulls first, those of one turn by role and text.  Null conversations form
    one conversation; null roles and texts count as one space.  Blank rows have
    no character but white space; a duplicate has the role and the text of an
    earlier row; a truncated row's last other character is not one of ``.!?``.
    Without rows all figures are zero, the audit is empty and the digest is
    that of the empty text.  An empty table gives an empty one.  Extra columns
    are not read.  ``unresolved_max`` is the largest number of edits held.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    own = rows.select("conv", "turn", role.alias("role"), text.alias("text"), "gone").repartition("conv")
    same = Window.partitionBy("conv", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    marked = own.select("*", F.substring("role", 1, 1).alias("initial"), F.rlike("text", F.lit(BLANK)).alias("is_blank"),
                        (F.row_number().over(same) > 1).alias("is_repeat"), F.rlike("text", F.lit(CUT_SHORT)).alias("is_cut"))
    ordered = marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "is_repeat")
    ident = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema["conv"].dataType.simpleString()]
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType)] + [T.StructField(n, t) for n, t, _ in FIELDS])
    return ordered.mapInArrow(lambda batches: _stream(batches, ident), schema).withColumnRenamed("conv", conv_col)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))).drop("unresolved_max")


# ------------------------------------------------------------ SQL
#: One CRC-32 step per byte: the register shifted eight times through the reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::UBIGINT)),
    lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"""


def _sql_way(source: str, cost: str, edit: str, said: str | None = None) -> str:
    """A path (cost, edits, lines) extended by one edit."""
    lines = f"{source}.t" if said is None else f"list_append({source}.t, {said})"
    return f"{{'c': {source}.c + {cost}, 'p': {source}.p || '{edit}', 't': {lines}}}"


def _sql_least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _sql_guarded(condition: str, way: str, other: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {other} END"


def oracle() -> str:
    """The decoder as a recursive query, whole paths in place of a tree."""
    none = "{'c': 1000000000::BIGINT, 'p': '', 't': []::VARCHAR[]}"
    stay = {s: _sql_way(s, "2", "D") for s in "esua"}
    own = "(r.role || ':' || r.text)"

    def enters(to: str, sources: str, initial: str) -> str:
        ways = [stay[to]]
        for s in sources:
            ways.append(_sql_guarded(f"NOT doomed AND initial = '{initial}'", _sql_way(s, "more", "K", own), none))
            if initial != "s":
                named = "user" if initial == "u" else "assistant"
                ways.append(_sql_guarded("NOT doomed", _sql_way(s, "1 + more", "R", f"('{named}:' || r.text)"), none))
        return _sql_least(*ways)

    insert = {s: _sql_way(s, "5", "I", "'user:'") for s in "esa"}
    start = ("{'c': 0::BIGINT, 'p': '', 't': []::VARCHAR[]} AS e, " + none + " AS s, "
             "{'c': 5::BIGINT, 'p': 'I', 't': ['user:']} AS u, {'c': 10::BIGINT, 'p': 'II', 't': ['user:', 'assistant:']} AS a")
    return rf"""
WITH RECURSIVE base AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM base),
harmed AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM harmed),
numbered AS (
  SELECT *, row_number() OVER here AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER here AS before,
    regexp_full_match(text, '[ \t-\r]*') AS blank, regexp_matches(text, '[^.!? \t-\r][ \t-\r]*\z') AS cut
  FROM marked WINDOW here AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, again)),
faults AS (
  SELECT *, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated, blank OR again AS doomed,
    CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS more FROM numbered),
steps AS (
  SELECT DISTINCT g, 0::BIGINT AS i, {start} FROM base
  UNION ALL
  SELECT g, i, e, s, u, {_sql_least('a', _sql_way('u', '5', 'I', "'assistant:'"))} AS a FROM (
    SELECT g, i, e, s, {_sql_least('u', *insert.values())} AS u, a FROM (
      SELECT steps.g, r.i, {stay['e']} AS e, {enters('s', 'e', 's')} AS s, {enters('u', 'esa', 'u')} AS u, {enters('a', 'u', 'a')} AS a
      FROM steps JOIN faults r ON r.g = steps.g AND r.i = steps.i + 1))),
last AS (SELECT g, max_by({_sql_least('e', 'a')}, i) AS best FROM steps GROUP BY g),
figures AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) AS n_rows,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.p AS audit,
  sha256(array_to_string(best.t, chr(10))) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT g, conv_id FROM base) JOIN last USING (g) LEFT JOIN figures USING (g)
"""


ORACLE = oracle()
