import hashlib
import random
from collections import Counter

import pytest

from turnscore.llm.queries import op10_suffix_dedup
from turnscore.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    """rows: (id, text) -> (id, n_bytes, n_removed, n_spans, sha) sorted."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(seed, n, alphabet="ab é"):
    r = random.Random(seed)
    text = lambda k: "".join(r.choices(alphabet, k=k))
    shared = [text(r.randint(10, 60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 90), (3, shared[0]), (3, shared[0]), (None, shared[1] * 2), (None, shared[1] * 2)]
    for i in range(4, n):
        t = "".join(r.choice([text(r.randint(0, 30)), r.choice(shared)]) for _ in range(r.randint(1, 8)))
        if r.random() < 0.4:  # near copy of an earlier row
            t = list(rows[r.randrange(len(rows))][1] or "")
            for _ in range(r.randint(0, 2)):
                if t:
                    t[r.randrange(len(t))] = r.choice(alphabet)
            t = "".join(t)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("length,limit", [(16, 100_000), (24, 100_000), (16, 2)])
def test_against_brute_force(spark, length, limit):
    rows = make(length, 60)
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, th string, n int")
    assert result(remove_repeats(df, length=length, part_limit=limit)) == brute(rows, length)


def test_long_strings_with_little_in_common(spark):
    rows = make(5, 40, "abcdefghijklmnop")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, length=20)) == brute(rows, 20)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = result(op10_suffix_dedup(spark, "/root/testdata/sf0.001"))
    want = brute([(d.doc_id, d.text) for d in docs], 400)
    assert got == want and sum(r[2] for r in want) > 0
