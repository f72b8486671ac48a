import random
import re

import numpy as np
import pytest
import xxhash

from turnscore.llm.common import connected_components
from turnscore.llm.queries import op12_simhash_groups
from turnscore.llm.simhash import links_in_cell, near_groups, near_links, pivots
from tests.conftest import SF01


def fingerprint(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(f, most):
    """Least index reachable, by all pairs."""
    f, up = np.array(f, np.uint64), list(range(len(f)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= most):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def brute(rows, width=3, most=2):
    f = [fingerprint(t, width) for _, t in rows]
    roots, least = classes(f, most), {}
    for r, (d, _) in zip(roots, rows):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{x:016x}", least.get(r)) for r, x, (d, _) in zip(roots, f, rows)), key=repr)


def clustered(seed, n):
    r = np.random.default_rng(seed)
    one = np.uint64(1)
    f = [r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, n).astype(np.uint64)]
    for _ in range(5):
        near = f[r.integers(len(f))][: n // 2]
        for _ in range(r.integers(1, 4)):
            near = near ^ (one << r.integers(0, 64, len(near)).astype(np.uint64))
        f.append(near)
    return np.unique(np.concatenate(f))


def test_pivots_are_orthogonal():
    p = pivots()
    assert all((a ^ b).bit_count() == 32 for i, a in enumerate(p) for b in p[:i])


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_links_in_cell(most):
    f = clustered(most, 700)
    d = np.bitwise_count(f[:, None] ^ np.array(pivots(), np.uint64)[None]).astype(np.int8)
    links = links_in_cell(f, d, most)
    up = list(range(len(f)))
    for a, b in links:
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert up == classes(f, most)


def test_cells_lose_no_link(spark):
    f = clustered(9, 500)
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    groups = connected_components(near_links(fps, 2, size=40), "u", "v").collect()
    root = {r.node: r.component for r in groups}
    ids = [root.get(int(x), int(x)) for x in f.view(np.int64)]
    want = classes(f, 2)
    assert len(set(zip(ids, want))) == len(set(ids)) == len(set(want)) < len(f)


def near_texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "The"]
    rows = [(None, "a b c d"), (None, "A  b\nc d"), (0, None), (1, ""), (2, " \n "), (3, "x"), (4, "X"), (5, "x y"), (5, "x y"), (6, "a b c d"),
            (7, " lead"), (8, "long " * 80_000)]
    for k in range(10):
        base = r.choices(words, k=900)
        for i in range(9):
            t = list(base)
            for _ in range(i % 4):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((10 + 10 * k + i, r.choice([" ", "\n", " \t"]).join(t)))
    return rows


def test_against_brute_force(spark):
    rows = near_texts(1)
    df = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, fp int, cell int").repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, near_groups(df, size=20).collect()), key=repr) == want
    assert len({x[2] for x in want}) < len({x[1] for x in want})  # groups beyond equal fingerprints


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_simhash_groups(spark, SF01).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
