import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from turnscore.llm.merkle import COLUMNS, folded, manifest, proofs, verified_manifest
from turnscore.llm.queries import op11_merkle_manifest
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, p):
    out = []
    for level in levels[:-1]:
        k = p // 3 * 3
        out.append(("".join(level[k:p]), "".join(level[p + 1:k + 3])))
        p //= 3
    return out


def brute(rows):
    def digest(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (text if c == "text" else r[c] for c in COLUMNS)])

    by = {}
    for r in rows:
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by.setdefault(r["source"], []).append((r["doc_id"], digest(r, r["text"]), digest(r, text)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for k in names:
        by[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([x[1] for x in by[k]]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for i, k in enumerate(names):
        for p, (doc, leaf, acc) in enumerate(by[k]):
            path = way(trees[k], p) + way(top, i)
            for a, b in path:
                acc = H(a, acc, b)
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], H(*[a + b for a, b in path]), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def run(docs):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, verified_manifest(docs, {"text": text}).collect()), key=repr)


def test_whole_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_merkle_manifest(spark, SF001).collect()), key=repr) == brute(rows)


#: Nulls in every column, empty and long texts, letters beyond ASCII, lone groups, a hot group, repeated ids and rows.
ODD = ([(i, f"line {i}\nend", "en", "hot", i) for i in range(40)] + [(100 + i, "x\ny", "de", f"s{i}", 3) for i in range(5)] +
       [(7, None, None, None, None), (8, "", "fr", None, 0), (None, "a\nb", "en", "hot", 3), (None, "a\nb", "en", "hot", 3),
        (9, "é\n" * 100_000, "fr", "é", 1), (10, "z", "fr", "Z", 1), (11, "same", "en", "hot", 4), (11, "same", "en", "hot", 4)])


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[40:42], ODD[:10]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", pos int, tree string").repartition(5)
    assert run(docs) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_some_leaves(spark):
    docs = spark.createDataFrame(ODD[:45], SCHEMA)
    m = manifest(docs)
    asked = m.leaves.where("id in (0, 17, 39, 102)").select("tree", "pos")
    got = proofs(m, asked).withColumn("back", folded("digest")).select("id", "back", "root", F.size("path").alias("n")).collect()
    assert sorted(r.id for r in got) == [0, 17, 39, 102] and all(r.back == r.root for r in got)
    assert {r.id: r.n for r in got} == {0: 6, 17: 6, 39: 6, 102: 2}  # 4 levels of the hot group and 2 over six groups


def test_equal_subtrees_are_one_record(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)] * 9, SCHEMA)
    m = manifest(docs)
    assert m.records.count() == 2 and m.leaves.count() == 9
