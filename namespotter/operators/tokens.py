"""Candidate words (W9) and the token-set-ratio join.

Candidates are the corpus' word tokens (runs of word characters of the
lowered text) of at least ``min_len`` characters with their occurrence
counts; the counting is a partial + final aggregation.  Each distinct word
is compared with every name by token-set ratio; a word is a single token,
so the score is 100 when it is one of the name's tokens and otherwise the
ratio of the word against the name's sorted tokens, bounded by the
character-multiset overlap (ratio <= 200 b / (la + lb)) and by the characters
common in order before difflib runs.
Neighbouring capitalised words (W10) may be candidates as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import full_process, ratio, token_set_ratio
from ..functions.text import WORD_RUN_RE, word_tokens
from .kernels import common_in_order, encode, multiset_overlap, numbered, place_masks
from .nested import against_dictionary


CAPITAL_RE = r"^\p{Lu}"
#: Characters of a bit mask.
MASK = 64


def capital_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, a row for every two neighbouring tokens that both begin
    with a capital in the text as it stands, lowered and joined by a space."""
    tokens = docs.select(F.regexp_extract_all(text_col, F.lit(WORD_RUN_RE), 1).alias("t")).where(F.size("t") > 1)
    both = F.zip_with("t", F.slice("t", 2, F.size("t") - 1), lambda a, b: F.when(
        a.rlike(CAPITAL_RE) & b.rlike(CAPITAL_RE), F.concat(F.lower(a), F.lit(" "), F.lower(b))))
    return tokens.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("word"))


def candidate_words(docs: DataFrame, min_len: int = 5, text_col: str = "text", pairs: bool = False) -> DataFrame:
    """W9 + A6: ``word, occurrences`` over the whole corpus, with ``pairs``
    also of ``capital_pairs`` (off by default, as the capitals are gone once
    a text is lowered, T6)."""
    words = docs.select(F.explode(word_tokens(text_col)).alias("word")).where(F.length("word") >= min_len)
    if pairs:
        words = words.unionByName(capital_pairs(docs, text_col))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))


def token_set_matches(docs: DataFrame, entities: DataFrame, threshold: int = 70, min_len: int = 5,
                      text_col: str = "text", pairs: bool = False) -> DataFrame:
    """(entity, candidate) pairs with token-set ratio >= threshold and the
    candidate's occurrence count; candidates are words, with ``pairs`` also
    neighbouring capitalised words.  A candidate that shares a token with the
    name is scored whatever its characters."""
    words = candidate_words(docs, min_len, text_col, pairs)

    def prepare(block: pd.DataFrame):
        names = block["name"].fillna("").tolist()
        tokens = [set(full_process(n).split()) for n in names]
        having: dict[str, list[int]] = {}
        for k, t in enumerate(tokens):
            for x in t:
                having.setdefault(x, []).append(k)
        texts = [" ".join(sorted(t)) for t in tokens]
        codes, sizes = encode(texts)
        alphabet = np.unique(codes[codes >= 0])
        masks = np.concatenate([place_masks(codes[:, :MASK], alphabet), np.zeros((len(texts), 1), np.uint64)], axis=1)
        return block.reset_index(drop=True), names, texts, having, (codes, sizes), (alphabet, masks), np.argsort(sizes, kind="stable")

    def kernel(batch: pd.DataFrame, prepared) -> pd.DataFrame:
        block, names, texts, having, (nc, nl), (alphabet, masks), by_size = prepared
        words = batch["word"].tolist()
        wp = [full_process(w) for w in words]
        wc, wl = encode(wp)
        least = threshold - 0.5 - 1e-9
        shared = {(q, e) for q, p in enumerate(wp) for token in set(p.split()) for e in having.get(token, [])}
        qi, ni = [], []
        order = np.argsort(wl, kind="stable")
        for lo in range(0, len(order), 256):  # words of like length meet the names whose length allows the ratio
            rows = order[lo:lo + 256]
            low, high = int(wl[rows[0]]), int(wl[rows[-1]])
            other = by_size[(least * (low + nl[by_size]) <= 200.0 * nl[by_size]) & (least * (high + nl[by_size]) <= 200.0 * high)] if least > 0 else by_size
            if not len(other):
                continue
            b = multiset_overlap(wc[rows, :max(high, 1)], nc[other])
            with np.errstate(divide="ignore", invalid="ignore"):
                x, y = np.nonzero(200.0 * b / (wl[rows][:, None] + nl[other][None, :]) >= least)
            qi.append(rows[x])
            ni.append(other[y])
        qi, ni = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (qi, ni))
        # without a common token the ratio is that of the sorted tokens; their characters common in order bound it
        sorted_words = [" ".join(sorted(set(p.split()))) for p in wp]
        sc, sl = encode(sorted_words)
        numbers = numbered(sc, alphabet)
        keep = np.ones(len(qi), bool)
        for lo in range(0, len(qi), 16_384):
            x, y = qi[lo:lo + 16_384], ni[lo:lo + 16_384]
            keep[lo:lo + 16_384] = (nl[y] > MASK) | (200.0 * common_in_order(numbers[x], masks, y) >= least * (sl[x] + nl[y]))
        found = []
        for q, e in {*zip(qi[keep].tolist(), ni[keep].tolist()), *shared}:
            s = token_set_ratio(words[q], names[e]) if (q, e) in shared else ratio(sorted_words[q], texts[e]) if wp[q] and texts[e] else 0
            if s >= threshold:
                found.append((block["entity_id"].iat[e], names[e], words[q], s, batch["occurrences"].iat[q]))
        return pd.DataFrame(found, columns=["entity_id", "name", "word", "score", "occurrences"])

    return against_dictionary(words, entities.select("entity_id", "name"), kernel, prepare,
                              "entity_id long, name string, word string, score int, occurrences long")
