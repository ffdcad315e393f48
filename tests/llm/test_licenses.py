import random

from namespotter.llm import licenses
from namespotter.llm.common import plain_words


def grams(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(text, templates, least):
    """Names of templates whose shingles some window of the scan's shape holds to the asked share."""
    w, out = plain_words((text or "").encode()), set()
    for k, (_, t) in enumerate(templates):
        tw = plain_words(t.encode())
        width, step = licenses.window_shape(len(tw))
        for a in range(0, max(1, len(w)), step):
            if len(grams(w[a:a + width]) & grams(tw)) >= least * len(grams(tw)):
                out.add(k)
    return out


def test_against_brute_force():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    templates = [(f"t{k}", " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate((5, 6, 8, 12, 20, 40, 90, 200))]
    index = licenses.Index(templates)
    missed = found = 0
    for _ in range(150):
        k = r.randrange(len(templates))
        w = templates[k][1].split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "changed"
        text = " ".join(r.choice(vocab) for _ in range(r.randrange(200))) + " " + " ".join(w) + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(200)))
        words = plain_words(text.encode())
        got = {x[0] for x in index.find(licenses.shingles(words, {}), len(words))}
        want = brute(text, templates, 0.8)
        assert got <= want
        missed, found = missed + len(want - got), found + len(want)
    assert found > 60 and missed <= 1


def test_documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [
        (50, "é text.\nReleased under the MIT License. And more of it."), (51, "x " * 500 + licenses.TEMPLATES[1][1].upper() + " y"),
        (52, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (53, "the MIT License is short")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 matches")
    got = {r["doc_id"]: [(m["license"], r["text"][m["start"]:m["end"]]) for m in r["matches"]] for r in licenses.scan_licenses(d).collect()}
    assert got[50] == [("MIT", "Released under the MIT License")]
    assert [x[0] for x in got[51]] == ["MIT"]
    assert got[52] == [("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]
    assert not any(got[i] for i in range(len(texts))) and not got[53]
    short = licenses.scan_licenses(d, [("X", "MIT License"), ("Y", "")]).where("doc_id = 53").first()["matches"]
    assert [m["license"] for m in short] == ["X"]
    assert licenses.scan_licenses(d.limit(0)).count() == 0
