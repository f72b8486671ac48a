import itertools
import random
import re

import pytest

from turnscore.llm.decontamination import MASKS, SUBSTITUTED, WINDOW, drop_leaks, leaks
from turnscore.llm.queries import op7_decontamination


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=WINDOW, most=SUBSTITUTED):
    out = {}
    for d, t in docs:
        x = words(t)
        for i, u in items:
            y = words(u)
            n, k = (window, most) if len(y) >= window else (len(y), 0)
            if not n:
                continue
            for a in range(len(x) - n + 1):
                for b in range(len(y) - n + 1):
                    s = sum(p == q for p, q in zip(x[a:a + n], y[b:b + n]))
                    if s >= n - k:
                        f, g, e = out.get((d, i), (a, 0, 0))
                        out[d, i] = min(f, a), max(g, a + n - 1), max(e, s)
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def result(df):
    return sorted(((r.doc_id, r.item_id, r.first_word, r.last_word, r.n_equal) for r in df.collect()), key=str)


def test_masks_miss_no_window():
    for gone in itertools.combinations(range(WINDOW), SUBSTITUTED):
        assert any(all(m[g - o] == "0" for g in gone if 0 <= g - o < len(m))
                   for m in MASKS for o in range(WINDOW - len(m) + 1)), gone


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "the", "Of"]
    items = [(0, None), (1, ""), (2, "w1 w2 w3"), (None, "q1 q2 q3 q4 q5"), (4, "!"), (4, "w7 w8 w9 w3 w4")]
    items += [(i, " ".join(r.choices(vocab, k=r.choice([12, 13, 14, 20, 50])))) for i in range(5, 14)]
    docs = [(0, None), (1, ""), (None, items[8][1]), (None, items[8][1]), (2, "a q1 q2, Q3 q4 q5!")]
    for i in range(3, 60):
        t = r.choices(vocab, k=r.choice([0, 5, 30, 200]))
        if r.random() < 0.6:
            u = words(r.choice(items)[1])
            for _ in range(r.randint(0, 8)):
                if u:
                    u[r.randrange(len(u))] = "new"
            at = r.randint(0, len(t))
            t[at:at] = u[r.randint(0, 3):]
        docs.append((r.choice([i, i, 7]), r.choice([" ", ", ", "\n"]).join(t)))
    seen = {}
    docs = [(d, t) for d, t in docs if seen.setdefault(d, t) == t]  # brute() knows documents by id
    a = spark.createDataFrame([(t, d, 5) for d, t in docs], "text string, doc_id long, item long")
    b = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, seed string")
    assert result(leaks(a, b)) == brute(docs, items)
    bad = {k[0] for k in brute(docs, items)}
    kept = drop_leaks(a, b)
    assert kept.columns == a.columns
    assert sorted((str(k.doc_id), str(k.text)) for k in kept.collect()) == sorted((str(d), str(t)) for d, t in docs if d not in bad)


def test_rows_with_one_id_are_told_apart(spark):
    item = " ".join(f"v{i}" for i in range(20))
    a = spark.createDataFrame([(1, item), (1, "clean words"), (2, "b " + item)], "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (9, item)], "item_id long, text string")
    assert [(r.doc_id, r.text) for r in drop_leaks(a, b).collect()] == [(1, "clean words")]
    assert result(leaks(a, b)) == [(1, 9, 0, 19, 13), (2, 9, 1, 20, 13)]
    assert leaks(a.limit(0), b).collect() == [] and leaks(a, b.limit(0)).collect() == []


def test_query_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(i.item_id, words(i.text)) for i in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op7_decontamination(spark, sf).collect()}
    whole = {(d.doc_id, i) for d in docs for i, u in items if f" {' '.join(u)} " in f" {' '.join(words(d.text))} "}
    assert whole and whole <= got


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, "clean", 1, 2, 3), (3, None, 1, 2, 3)], "doc_id long, text string, _leak_id int, _leak_hash int, _bm_bits int")
    got = drop_leaks(df, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
