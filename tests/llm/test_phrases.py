import random
import re
from collections import Counter

import numpy as np
import pytest

from turnscore.llm import phrases
from turnscore.llm.phrases import collocations, multikey


def brute(rows, width=3, least=10, top=2000, share=50):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            own.update(tuple(w[i:i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        inside = {}
        for x, a in own.items():
            if len(x) > 2 and a >= least:
                for y in (x[:-1], x[1:]):
                    inside[y] = max(inside.get(y, 0), a)
        found = []
        for x, a in own.items():
            if len(x) < 2 or a < least or 100 * inside.get(x, -1) >= share * a:
                continue
            score, _, l, r = min((1000000 * a * a // (own[x[:k]] * own[x[k:]]), k, own[x[:k]], own[x[k:]]) for k in range(1, len(x)))
            found.append((" ".join(x), a, l, r, score))
        found.sort(key=lambda t: (-t[4], -t[1], t[0].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(found[:top])]
    return sorted(out, key=repr)


def make(seed, n):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(30)] + ["É", "The", "the", "новый", "𝔸"]
    rows = [(None, "en"), ("", None), (" . ,\n", "fr"), ("one two three", None), ("one two three", "und"), ("ab cd", "")]
    rows += [("hot pair " * 4000, "en"), ("long words\tapart " * 3000 + "\x1c x", "de")]
    for _ in range(n):
        words = r.choices(common, weights=[1 / (i + 1) for i in range(len(common))], k=r.randint(0, 80))
        rows.append(("".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in words), r.choice(["en", "en", "de", None])))
    return rows + rows[6:20]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(t, g, 1, "k") for t, g in rows], "text string, lang string, k0 int, word string").repartition(4)
    got = collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"least": 3, "top": 7, "share": 90}, {"width": 2, "least": 2}, {"width": 5, "least": 4}])
def test_against_brute_force(spark, kw):
    rows = make(len(kw), 250)
    want = brute(rows, **kw)
    assert run(spark, rows, **kw) == want and len(want) > 20


def test_products_beyond_64_bits(spark):
    """a = 3,000,000 makes 1,000,000 * a * a about 10**19."""
    rows = [("x y " * 1_000_000 + "y z " * 500, "en")] * 3
    assert run(spark, rows) == brute(rows)


def test_no_phrases(spark):
    assert run(spark, [("a b", "en"), (None, None)]) == []
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


@pytest.mark.parametrize("small", [1, 7, 1 << 14])
def test_multikey_counts(small, monkeypatch):
    monkeypatch.setattr(phrases, "SMALL", small)
    r = np.random.default_rng(small)
    keys = np.minimum(r.zipf(1.6, (3000, 3)), 50).astype(np.uint64)
    keys[r.random(3000) < 0.2, 2] = 0
    weight = r.integers(1, 5, 3000)
    want = Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        want[tuple(k[:2])] += w
        if k[2]:
            want[tuple(k)] += w
    got = {}
    for depth, p, total in multikey(keys, weight, 10):
        for i, t in zip(p.tolist(), total.tolist()):
            assert got.setdefault(tuple(keys[i, :depth].tolist()), t) == t
    assert got == {k: v for k, v in want.items() if v >= 10}
