import random
import re

import pytest

from turnscore.llm.line_dedup import dedup_lines

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def brute(rows, m, long_chars, many_words=50):
    """(id, text) with distinct ids -> id -> text."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) + [r for r in rows if r[0] is None]
    seen, out = set(), {}
    for d, t in order:
        lines = (t or "").split("\n")
        real = [i for i, x in enumerate(lines) if not BLANK.match(x)]
        gone = set()
        for s, i in enumerate(real):
            for n in {1, m, min(2, m)}:
                run = tuple(lines[j] for j in real[s:s + n])
                words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run)
                if len(run) == n and (n == m or n == 1 and len(run[0]) >= long_chars or n <= 2 and words > many_words):
                    if run in seen:
                        gone.update(range(s, s + n))
                    seen.add(run)
        drop = set()
        for s in gone:
            drop.add(real[s])
            if s + 1 in gone:
                drop.update(range(real[s], real[s + 1]))
        out[d] = None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in drop)
    return out


def make(seed, n):
    r = random.Random(seed)
    lines = [f"line {i}" for i in range(12)] + ["", " ", "a" * 30, "b" * 30, "é\t"]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, "line 1\nline 2\nline 3\nline 4")]
    for i in range(3, n):
        rows.append((i, "\n".join(r.choices(lines, k=r.choice([1, 2, 4, 9, 40])))))
    return rows


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_against_brute_force(spark, m):
    rows = make(m, 40)
    df = spark.createDataFrame([(t, d, 7, "k", 1, 2) for d, t in rows],
                               "text string, doc_id long, th int, _ld_th string, _bm_bits int, _ld_spans int")
    got = dedup_lines(df, min_lines=m, min_chars=30, min_words=3 if m > 3 else 50)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows, m, 30, 3 if m > 3 else 50)


def test_two_lines_of_many_words_are_a_run(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(21))
    rows = [(1, f"{a}\n{b}\nend"), (2, f"x\n{a}\n\n{b}"), (3, f"{a}\n{b[:-4]}"), (4, f"{a} {b}"), (5, f"q\n{a} {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == brute(rows, 3, 200) and got[2] == "x" and got[3] == rows[2][1] and got[5] == "q"


def test_rows_with_one_id(spark):
    t = "p\nq\nr\ns"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "x\n" + t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(df).collect())
    # repeated rows are one document; of the later ones nothing stays but the new line
    assert got == [(1, t), (1, t), (2, ""), (2, "x")]
    assert dedup_lines(df.limit(0)).collect() == []
    rep = dedup_lines(df, report=True).orderBy("doc_id", "n_lines").collect()
    assert [(r.n_lines, r.n_deleted, r.n_spans) for r in rep] == [(4, 0, 0), (4, 0, 0), (4, 4, 1), (5, 4, 1)]
