import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from namespotter.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_encoding_equals_the_file_in_its_own_library(texts):
    r = random.Random(2)
    odd = ["".join(r.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "　", "\x1c", "'s", "12", "!?", " ", "<|endoftext|>"]) for _ in range(40))
           for _ in range(400)]
    odd += [t or "" for t in texts] + [" ", "  ", " a", "a ", "a  ", "\n a", "a\n \n b"]
    encoding = packing.file_encoding(PATH)
    assert [encoding.encode_to_numpy(x, allowed_special="all").tolist() for x in odd] == plain(odd)


def test_pieces(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "the same id again"), (None, "no id"), (6, "one <|endoftext|> two<|endoftext|>")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' part", "'y' ids", "'z' length").repartition(5)
    got = packing.packed_pieces(d, PATH, length=64)
    assert got.columns.count("length") == 1 and {"part", "ids"} <= set(got.columns)
    pieces = got.collect()
    want = sorted((str(i), x + [1]) for (i, _), x in zip(rows, plain([t or "" for _, t in rows]), strict=True))
    # rebuild each document from its pieces by global order
    order = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    assert [p["sequence_id"] * 64 + p["offset"] for p in order] == np.cumsum([0] + [p["length"] for p in order])[:-1].tolist()
    docs, ids = [], []
    for p in order:
        part = np.frombuffer(p["piece_ids"], "<u2")
        assert len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
        assert p["start"] == len(ids)
        ids += part.tolist()
        if len(ids) == p["doc_tokens"]:
            docs.append((str(p["doc_id"]), ids))
            ids = []
    assert not ids and sorted(docs) == want
    whole = {s["sequence_id"]: s for s in packing.sequences(got, 64).collect()}
    total = sum(len(x) for _, x in want)
    assert len(whole) == -(-total // 64) and all(s["n_ids"] == 64 for k, s in whole.items() if k < len(whole) - 1)
    assert b"".join(whole[k]["ids"] for k in sorted(whole)) == b"".join(p["piece_ids"] for p in order)
    assert packing.packed_pieces(d.limit(0), PATH).count() == 0
