import random
import re

import pytest

from turnscore.llm.licenses import NOTICES, PHRASES, Finder, edits_allowed, pieces, scan_licenses
from turnscore.llm.queries import op1_license_scan


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def least_edits(notice, text):
    """Fewest edits between the notice and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(t):
    w = words(t)
    base = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    near = {n: least_edits(n, " ".join(w)) for n in NOTICES}
    near = {n: e for n, e in near.items() if e <= edits_allowed(n)}
    at = [i for i, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in base} | {NOTICES[n] for n in near})),
            1.0 if base else max((1 - e / len(n) for n, e in near.items()), default=0.0))


def result(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()}


def test_pieces_cover_the_notice():
    for n in NOTICES:
        assert "".join(p for p, _ in pieces(n)) == n and len(pieces(n)) == edits_allowed(n) + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "CC-BY cc\nby CC by-nc"), (3, "accc by"), (4, "é ccé by All  rights.reserved!"), (5, "cc by")]
    for i in range(6, 160):
        n = list(r.choice(list(NOTICES)))
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(n))
            n[at:at + r.randint(0, 1)] = r.choice(["", "x", "é", " ", "e"])
        filler = lambda: " ".join(r.choices(["the", "license", "general", "of", "É", "12", "rights"], k=r.randint(0, 6)))
        rows.append((i, filler() + r.choice([" ", "\n", ""]) + "".join(n).title() + r.choice([" ", "--", ""]) + filler()))
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, labels string")
    got = result(scan_licenses(df))
    for i, t in rows:
        assert got[i][:6] == brute(t)[:6], (i, t)
        assert got[i][6] == pytest.approx(brute(t)[6]), (i, t)


def test_spans_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "so: Mozila Public Licence now"), (None, "so: Mozila Public Licence now")],
                               "doc_id long, text string")
    rows = scan_licenses(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert [(s.label, s.first_word, s.last_word, s.edits) for s in rows[0].spans] == [("mpl", 1, 3, 2)]
    assert scan_licenses(df.limit(0)).collect() == []


def all_spans(notice, text):
    """Best matches first (fewest edits, first end, shortest), none over another."""
    k, found = edits_allowed(notice), []
    for s in range(len(text)):
        part = text[s:s + len(notice) + k]
        row = list(range(len(part) + 1))
        for i, c in enumerate(notice):
            new = [i + 1]
            for j, d in enumerate(part):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        found += [(e, s + j, -s) for j, e in enumerate(row) if e <= k]
    out = []
    for e, y, x in sorted(found):
        if all(y <= a or b <= -x for a, b, _ in out):
            out.append((-x, y, e))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_spans_of_runs_against_brute_force(seed):
    r = random.Random(seed)
    find = Finder(NOTICES)
    for _ in range(6):
        own, text = r.sample(["general public license", "lesser general public license", "all rights reserved"], 2), ""
        for _ in range(r.randint(1, 6)):
            n = list(r.choice(own))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(n))
                n[at:at + r.randint(0, 1)] = r.choice(["", "x", "é", " ", "e"])
            text += "".join(n)[r.choice([0, 0, 0, 9]):] + r.choice([" ", " ", "", " the "])
        text = " ".join(text.split())
        got = find(text)
        for n in NOTICES:
            assert [(x, y, e) for m, x, y, e in got if m == n] == all_spans(n, text), (n, text)


def test_edited_notice_before_a_better_one(spark):
    df = spark.createDataFrame([(1, "x generl publc license\nGeneral Public License y\ngeneral publik license")], "doc_id long, text string")
    spans = [(s.label, s.first_word, s.last_word, s.edits) for s in scan_licenses(df).first().spans]
    assert spans == [("gpl", 1, 3, 2), ("gpl", 4, 6, 0), ("gpl", 8, 10, 1)]


def test_query_base_columns_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = result(op1_license_scan(spark, "/root/testdata/sf0.001"))
    for d in docs:
        w = words(d.text)
        base = [i for p in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert got[d.doc_id][:4] == (len(w), len(base), min(base, default=None), max(base, default=None))
