import random
import re

import numpy as np
import pytest

from turnscore.llm.ngram_join import ROW, SLOTS, Sizes, counts_of, divide_skip, packed_counts, packed_rows_of, part_signatures, rare_signatures, rarity, keep_one_of_each_group, similar_groups, similar_links
from turnscore.llm.kernels import mix
from turnscore.llm.queries import op9_ngram_join


def sets_of(texts, width):
    out = []
    for t in texts:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width, num, den):
    sets = sets_of([t for _, t in rows], width)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        count = {}
        for x in s:
            for j in lists[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, o in count.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "The", "the"]
    rows = [(None, "a b c d"), (None, "a b c d"), (0, None), (1, ""), (2, " \n "), (3, "x"), (4, "X"), (5, "x y"), (5, "x y")]
    for i in range(6, n):
        if r.random() < 0.6:
            t = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            t = t + r.choices(words, k=r.randint(0, 2))
        else:
            t = r.choices(words, k=r.choice([2, 4, 9, 15, 40, 120, 300]))
        rows.append((i, r.choice([" ", "\n"]).join(t)))
    return rows


@pytest.mark.parametrize("width,num,den,limit", [(3, 90, 100, 1 << 23), (5, 80, 100, 1 << 23), (2, 60, 100, 200)])
def test_against_brute_force(spark, width, num, den, limit):
    rows = make(width, 300)
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, node int")
    assert result(similar_groups(df, width=width, num=num, den=den, cluster_shingles=limit)) == brute(rows, width, num, den)


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(3)
    sizes, rare = Sizes(90, 100), r.integers(0, 4, 1 << 10).astype(np.uint8)
    for n in [9, 10, 11, 12, 15, 20, 33, 70, 150, 600]:
        for _ in range(200):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            most = n - (-(-n * 90 // 100))  # replaced by nothing: still similar
            b = np.sort(r.permutation(a)[most:])
            assert np.intersect1d(rare_signatures(a, sizes, rare), rare_signatures(b, sizes, rare)).size
            assert np.intersect1d(part_signatures(a, sizes), part_signatures(b, sizes)).size


def test_divide_skip_counts():
    r = random.Random(1)
    for _ in range(200):
        n = 50
        lists = [np.array(sorted(r.sample(range(n), r.choice([1, 3, 20, 45])))) for _ in range(r.randint(1, 30))]
        need = r.randint(1, len(lists))
        count = np.bincount(np.concatenate(lists), minlength=n)
        member, got = divide_skip(lists, need, n)
        assert member.tolist() == np.flatnonzero(count >= need).tolist() and got.tolist() == count[member].tolist()


def test_links_connect_a_chain():
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.append(base[k * 3:], 1000 + np.arange(k * 3, dtype=np.uint64))) for k in range(8)]
    assert len(similar_links(sets, 90, 100)) == 7


def test_query_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = brute([(d.doc_id, d.text) for d in docs], 3, 90, 100)
    assert result(op9_ngram_join(spark, "/root/testdata/sf0.01")) == want
    assert any(r[0] != r[2] for r in want)


def test_one_of_each_group_stays(spark):
    rows = make(9, 120)
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, root int")
    out = keep_one_of_each_group(df, width=3, num=90)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    groups = brute(rows, 3, 90, 100)
    full = {d: g for d, n, g in groups if n and d is not None}
    empty = [(i, t) for i, t in rows if not (t or "").split()]
    null_only = {"a b c d"} if not any(full.get(i) is not None and t == "a b c d" for i, t in rows) else set()
    assert [k for k in kept if k[0] is not None] == sorted(
        [(i, t) for i, t in dict(rows).items() if i is not None and (i in full and full[i] == i or (i, t) in empty)], key=str)
    assert [t for i, t in kept if i is None] == sorted(null_only)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, _nj_id int, _nj_th int, _bm_bits int")
    got = keep_one_of_each_group(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", 1, 2, 3)]


def test_packed_counts_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 500, ROW // 3, ROW // 3 + 1, ROW):
        row = np.zeros(ROW, np.uint8)
        row[r.permutation(ROW)[:n]] = r.integers(1, 256, n)
        back = np.zeros(ROW, np.uint32)
        at, c = counts_of(packed_counts(row))
        back[at] += c
        assert (back == row).all()


def test_rows_of_slots_hold_all_counts():
    r = np.random.default_rng(2)
    slots = [r.integers(0, 5 * ROW, 300_000).astype(np.uint32), np.full(700, 3 * ROW + 5, np.uint32), np.arange(ROW, 2 * ROW, dtype=np.uint32)]
    want, got = np.bincount(np.concatenate(slots), minlength=5 * ROW).reshape(-1, ROW), np.zeros((5, ROW), np.int64)
    for k, x in zip(*packed_rows_of(slots)):
        at, c = counts_of(x)
        got[k][at] += c
    assert (got == np.minimum(want, 255)).all()


def test_rare_shingles_are_told_at_several_gigabytes():
    """Counters of a corpus of a thousand million shingles: those of passages of ten copies are not among a set's signatures."""
    r = np.random.default_rng(5)
    part = SLOTS >> 7  # the same load on an 128th of the counters
    own = r.integers(0, 2**63, 10**9 >> 7).astype(np.uint64)
    common = r.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = np.bincount((own % np.uint64(part)).astype(np.int64), minlength=part)
    counts += 10 * np.bincount((common % np.uint64(part)).astype(np.int64), minlength=part)
    sizes, rare, chosen = Sizes(80, 100), rarity(counts), 0
    for k in range(100):
        shared = common[k * 50:k * 50 + 50]
        s = np.unique(np.append(own[k * 50:k * 50 + 50], shared))
        mine = rare_signatures(s, sizes, rare, halves=True)
        chosen += np.isin(mix(shared + np.uint64(sizes.number(len(s)) * 0x8EBC6AF09C88C6E3 % 2**64)), mine).sum()
    assert chosen <= 0.05 * 100 * 21, chosen  # of 21 signatures a set


def test_two_steps_to_a_byte_order_as_one():
    r, sizes = np.random.default_rng(7), Sizes(80, 100)
    counts = r.integers(0, 120, 1 << 10)
    half = rarity(counts)
    whole = np.stack([half & 15, half >> 4], 1).ravel()
    assert (np.diff(whole[np.argsort(counts, kind="stable")].astype(int)) >= 0).all() and whole.max() == 15
    for n in (1, 7, 40, 300):
        s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        assert (rare_signatures(s, sizes, half, halves=True) == rare_signatures(s, sizes, whole)).all()
