"""Conversation repair: the decoder against all edit sequences, the rows against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from namespotter.llm import dialogues
from namespotter.llm.dialogues import Decoder

GRAMMAR = re.compile(r"(s?(ua)+)?")
WS = " \t\n\v\f\r"


def all_repairs(rows):
    """(cost, audit, lines) of every repair with at most two insertions in a place: rows are (role, text, doomed, cut)."""
    names = {"u": "user", "a": "assistant"}
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for role, text, doomed, cut in rows:
        own = [("D", 2, None)]
        if not doomed:
            own += [("K", 5 * cut, (role[:1], f"{role}:{text}"))]
            own += [("R", 1 + 5 * cut, (r, f"{names[r]}:{text}")) for r in "ua"]
        options.append(own)
    for choice in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for k, more in enumerate(put):
                for r in more:
                    cost, audit, initials = cost + 5, audit + "I", initials + r
                    lines.append(f"{names[r]}:")
                if k < len(choice):
                    edit, c, kept = choice[k]
                    cost, audit = cost + c, audit + edit
                    if kept:
                        initials += kept[0] or "-"
                        lines.append(kept[1])
            if GRAMMAR.fullmatch(initials):
                yield cost, audit, "\n".join(lines)


def decoded(rows):
    d = Decoder()
    for role, text, doomed, cut in rows:
        d.row(role[:1], role.encode(), text.encode(), doomed, cut)
    return d.finish(), d


def test_decoder_equals_all_repairs():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 3, 3, 4):
        for _ in range(60 if n < 4 else 6):
            rows = [(rng.choice(["system", "user", "assistant", "tool", "u2", ""]), f"t{k}", rng.random() < .2, rng.random() < .3)
                    for k in range(n)]
            cost, audit, text = min(all_repairs(rows))
            assert decoded(rows)[0] == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def plain(rows):
    """Viterbi with whole strings, for longer rows."""
    inf = (10**9, "", ())

    def insert(st):
        st = list(st)
        for _ in range(3):
            for a, b, r in ((0, 2, "user:"), (1, 2, "user:"), (3, 2, "user:"), (2, 3, "assistant:")):
                c, p, t = st[a]
                st[b] = min(st[b], (c + 5, p + "I", (*t, r)))
        return st

    st = insert([(0, "", ()), inf, inf, inf])
    for role, text, doomed, cut in rows:
        new = [(c + 2, p + "D", t) for c, p, t in st]
        if not doomed:
            for a, b in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                c, p, t = st[a]
                if role[:1] == "-sua"[b]:
                    new[b] = min(new[b], (c + 5 * cut, p + "K", (*t, f"{role}:{text}")))
                if b > 1:
                    new[b] = min(new[b], (c + 1 + 5 * cut, p + "R", (*t, f"{['user', 'assistant'][b - 2]}:{text}")))
        st = insert(new)
    c, p, t = min(st[0], st[3])
    return c, p, hashlib.sha256("\n".join(t).encode()).hexdigest()


def test_decoder_equals_whole_strings_on_long_conversations():
    rng = random.Random(6)
    for kinds in (["user", "assistant"], ["tool"], ["user"], ["system", "user", "assistant", "tool", ""]):
        for _ in range(25):
            rows = [(rng.choice(kinds), f"t{k}", rng.random() < .1, rng.random() < .2) for k in range(rng.randrange(120))]
            assert decoded(rows)[0] == plain(rows)


def test_memory_stays_bounded_where_survivors_coalesce():
    _, d = decoded([("user" if k % 2 == 0 else "assistant", "x" * 20, k % 7 == 3, k % 5 == 1) for k in range(20000)])
    assert d.largest < 20
    result, d = decoded([("user", "", True, False)] * 20000)
    assert d.largest < 8 and result[:2] == (40000, "D" * 20000)
    _, d = decoded([("tool", "t", False, False)] * 3000)  # two ways stay open to the end, and are walked seldom
    assert d.largest >= 1500


# ------------------------------------------------------------ whole operator
def brute(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        harmed = []
        for c, t, r, x in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind == 0:
                continue
            x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
            harmed += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
        harmed.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, rated, counts = set(), [], [0, 0, 0]
        for t, r, x in harmed:
            blank, again = not x.strip(WS), (r, x) in seen
            cut = not blank and not again and x.rstrip(WS)[-1] not in ".!?"
            seen.add((r, x))
            counts = [counts[0] + blank, counts[1] + (again and not blank), counts[2] + cut]
            rated.append((r, x, blank or again, cut))
        turns = [t for t, _, _ in harmed if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(rated, rated[1:], strict=False))
        out[conv] = (gaps, *counts, illegal, *plain(rated), len(harmed))
    return out


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    words = [None, "", " \n", "Hi.", "Hi", "Well? ", "ok!\t", "\u0085", "a\nb.\n", "é?", "x "] + texts
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    made = [(c, t if rng.random() < .9 else None, rng.choice(roles), rng.choice(words))
            for c in [None, *range(60)] for t in range(rng.randrange(14))]
    made += [(7, 3, "user", "Hi.")] * 3 + [(1000, t, "user", "Again.") for t in range(400)]
    made += [(c, t, "user", "Hi.") for c in range(2000, 2060) for t in range(1)]
    return made


def spread(spark, rows):
    schema = "conv_id long, turn long, role string, text string, gone string, copy int, initial int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(7)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows"]


def found(spark, rows, tmp_path):
    spread(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = dialogues.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == NAMES
    return {r["conv_id"]: tuple(r)[1:] for r in got.collect()}


def test_rows_equal_brute_force(spark, rows, tmp_path):
    got, want = found(spark, rows, tmp_path), brute(rows)
    assert got == want and any(v[-1] == 0 for v in want.values())


def test_sql_equals_brute_force(rows):
    conversations = pd.DataFrame([r for r in rows if r[0] != 1000], columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    conversations = conversations.astype({"conv_id": "Int64", "turn": "Int64"})
    got = {r[0]: r[1:] for r in duckdb.sql(f"SELECT {', '.join(NAMES)} FROM ({dialogues.ORACLE})").fetchall()}
    assert got == {k: v for k, v in brute(rows).items() if k != 1000}


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == {}
