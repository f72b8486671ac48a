import hashlib
import re

from turnscore.llm import exact_dedup as X


def brute(rows):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[sha(t)] if x is not None]
        out.append((i, min(ids, default=None), len(groups[sha(t)]), sha(t)))
    return sorted(out, key=str), {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}


def test_odd_rows_and_a_heavy_group(spark):
    rows = [(7, None), (5, ""), (6, " \t\n"), (None, " "), (None, "x  y"), (3, "x\ny"), (3, "x y"), (3, "x y"), (9, "é"), (8, "a " * 50_000)]
    rows += [(100 + i, "very  common" if i % 2 else "very\tcommon") for i in range(600)] + [(1000 + i, f"t{i // 2}") for i in range(400)]
    df = spark.createDataFrame([(t, i, "k", 1, 2) for i, t in rows], "text string, doc_id long, digest string, row int, key int").repartition(7)
    got = X.exact_dedup(df).collect()
    want, best = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert sorted((r.text_sha256, str(r.doc_id)) for r in kept) == sorted((g, str(i)) for g, i in best.items())


def test_empty_table(spark):
    assert X.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_more_frequent_texts_than_counters(spark, monkeypatch):
    monkeypatch.setattr(X, "SKETCHES", 2), monkeypatch.setattr(X, "TOP", 3), monkeypatch.setattr(X, "COUNTERS", 8)
    rows = [(i, f"t{i % 40}") for i in range(400)]
    got = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)[0]
