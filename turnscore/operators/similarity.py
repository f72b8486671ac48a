"""Cosine similarity between a real and a synthetic collection of vectors.

* Mean over all pairs (overall or per score group) uses
  mean_{i,j} u_i . v_j = (sum_i u_i) . (sum_j v_j) / (n m) on unit vectors:
  two linear aggregations, no pair is ever formed.
* Exact max / min over all pairs is n x m in the worst case. A metric tree bounds the
  cosine of every pair between two nodes, and only leaf pairs whose bounds
  can hold an extreme are multiplied (matrix products of leaves inside a few blocks
  of vectors, one output row a task), so no pair row is emitted.
* Pairs above a threshold come from the same tree, emitting only the
  pairs that pass (output proportional to the answer); hashing finds most of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.operators import metric_tree as MT
from turnscore.session import materialize


def with_unit(df: DataFrame, emb: str, out: str = "u") -> DataFrame:
    """Adds the L2-normalised DOUBLE array ``out``; a zero vector stays zero (its
    cosine is 0). The norm is its own column so it is computed once per row, not
    once per element inside the lambda."""
    e = F.transform(F.col(emb), lambda x: x.cast("double"))
    d = df.withColumn("_e", e).withColumn("_norm", F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x * x)))
    return d.withColumn(out, F.when(F.col("_norm") > 0, F.transform("_e", lambda x: x / F.col("_norm")))
                        .otherwise(F.transform("_e", lambda x: x * 0.0))).drop("_e", "_norm")


def cosine_mean(df: DataFrame, by: Sequence[str] = (), side: str = "synthetic",
                emb: str = "emb") -> DataFrame:
    """Mean cosine over all (real, synthetic) pairs per group of ``by``; only
    groups present on both sides. ``side`` is a boolean column (True = synthetic).

    One chain of aggregations: per (group, dimension) the component sums and row
    counts of each side (map-side combined), then per group the dot product of
    the two sum vectors. Vectors must be non-empty."""
    by = list(by)
    u = with_unit(df.select(*by, F.col(side).alias("_syn"), emb), emb)
    per_pos = u.select(*by, "_syn", F.posexplode("u").alias("pos", "x")).groupBy(*by, "pos").agg(
        F.sum(F.when(~F.col("_syn"), F.col("x"))).alias("sr"),
        F.sum(F.when(F.col("_syn"), F.col("x"))).alias("ss"),
        F.count(F.when(~F.col("_syn"), F.lit(1))).alias("nr"),
        F.count(F.when(F.col("_syn"), F.lit(1))).alias("ns"))
    g = per_pos.groupBy(*by).agg(
        F.sum(F.coalesce("sr", F.lit(0.0)) * F.coalesce("ss", F.lit(0.0))).alias("dot"),
        F.max("nr").alias("n_real"), F.max("ns").alias("n_synthetic"))
    return g.where((F.col("n_real") > 0) & (F.col("n_synthetic") > 0)).select(
        *by, "n_real", "n_synthetic",
        (F.col("dot") / (F.col("n_real") * F.col("n_synthetic"))).alias("mean_cosine"))


def _tree(df: DataFrame, side: str, idc: str, emb: str, block_rows: int) -> MT.Tree:
    vectors = with_unit(df.select(F.col(side).alias("side"), F.col(idc).alias("id"), emb), emb)
    return MT.build(vectors.select("side", "id", "u"), block_rows)


def _pair_count(df: DataFrame, side: str) -> Column:
    """n_real * n_synthetic as one scalar subquery."""
    return df.select((F.count(F.when(~F.col(side), F.lit(1))) * F.count(F.when(F.col(side), F.lit(1))))
                     .alias("n")).scalar()


def cosine_extremes(df: DataFrame, side: str = "synthetic", idc: str = "id", emb: str = "emb",
                    block_rows: int = MT.LEAF_ROWS) -> DataFrame:
    """Exact max and min cosine over all (real, synthetic) pairs, with the ids of
    one maximising and one minimising pair. ``idc`` is unique.

    Best-first search in a metric tree (``metric_tree``): a dive finds a few leaf pairs
    whose products (numpy matrix products, one output row a task) give limits; then only
    node pairs that may hold a better value are expanded, and only such leaf pairs
    multiplied. The worst case (no pruning) is every leaf pair; ``pairs_examined`` reports
    the work and ``n_pairs`` the number of (real, synthetic) pairs the extremes are over."""
    def best(found):
        # self-contained (numpy / pyarrow only): workers need no import of this package
        import pyarrow as pa
        hi = lo = None
        pairs = 0
        for ids_r, ids_s, m in found:
            pairs += m.size
            for k, better in ((int(np.argmax(m)), True), (int(np.argmin(m)), False)):
                i, j = np.unravel_index(k, m.shape)
                x = float(m[i, j])
                if better and (hi is None or x > hi[0]):
                    hi = x, ids_r[int(i)].as_py(), ids_s[int(j)].as_py()
                if not better and (lo is None or x < lo[0]):
                    lo = x, ids_r[int(i)].as_py(), ids_s[int(j)].as_py()
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64() if n in (0, 3) else pa.int64()) for n, x in enumerate((*hi, *lo, pairs))],
                                             ["mx", "mx_r", "mx_s", "mn", "mn_r", "mn_s", "pairs"])
    schema = "mx DOUBLE, mx_r LONG, mx_s LONG, mn DOUBLE, mn_r LONG, mn_s LONG, pairs LONG"
    tree = _tree(df, side, idc, emb, block_rows)
    first = [(p.no_a, p.no_b) for p in MT.search(tree, MT.dive, "cos-dive", bounds=False).collect()]  # 2 * DIVE a round at most
    known = materialize(MT.products(tree, best, schema, pairs=first), "cos-first")
    limit = known.agg(F.max("mx").alias("hi"), F.min("mn").alias("lo")).first()
    if limit.hi is None:  # one side is empty
        parts = known
    else:
        parts = known.unionByName(MT.products(tree, best, schema, low=limit.lo, high=limit.hi, without=first))
    return parts.agg(
        F.max("mx").alias("max_cosine"),
        F.max_by(F.struct(F.col("mx_r").alias("real_id"), F.col("mx_s").alias("synthetic_id")),
                 F.col("mx")).alias("max_pair"),
        F.min("mn").alias("min_cosine"),
        F.min_by(F.struct(F.col("mn_r").alias("real_id"), F.col("mn_s").alias("synthetic_id")),
                 F.col("mn")).alias("min_pair"),
        F.sum("pairs").alias("pairs_examined")) \
        .withColumn("n_pairs", _pair_count(df, side))


def near_pairs(df: DataFrame, threshold: float, side: str = "synthetic", idc: str = "id",
               emb: str = "emb", block_rows: int = MT.LEAF_ROWS) -> DataFrame:
    """All (real, synthetic) pairs with cosine >= ``threshold``, exactly (SI4).

    Searches the same tree as ``cosine_extremes``: node pairs whose upper bound
    is below the threshold are not expanded; each leaf pair reached is one matrix
    product and emits only the pairs at or above the threshold, so the output is
    proportional to the answer, never to the candidate count."""
    thr = float(threshold)
    tree = _tree(df, side, idc, emb, block_rows)

    def near(found):
        import pyarrow as pa
        for ids_r, ids_s, m in found:
            i, j = np.nonzero(m >= thr)
            if len(i):
                yield pa.RecordBatch.from_arrays([ids_r.take(pa.array(i)), ids_s.take(pa.array(j)), pa.array(m[i, j])],
                                                 ["real_id", "synthetic_id", "cosine"])
    return MT.products(tree, near, "real_id LONG, synthetic_id LONG, cosine DOUBLE", high=thr)


def hash_plan(threshold: float, n: int, recall: float, width: float = 1.0) -> tuple[int, int]:
    """(projections of a key, keys) so that a pair at the threshold shares a key with probability ``recall``
    or more, and a bucket of unrelated vectors has few of ``n``.

    Two vectors at distance c fall into one bucket of a projection with width w with probability
    1 - 2 P(w / c) - 2 c / (sqrt(2 pi) w) (1 - exp(-w^2 / 2 c^2)), P being the normal tail."""
    def meets(c: float) -> float:
        r = width / c
        return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    near, far = meets(math.sqrt(max(2 - 2 * threshold, 1e-6))), meets(math.sqrt(2.0))
    best = None
    for k in range(1, 25):
        keys = math.ceil(math.log(1 - recall) / math.log(1 - near ** k))
        work = keys * (1 + n * far ** k)  # keys and vectors met per vector
        if best is None or work < best[0]:
            best = work, k, keys
    return best[1:]


def near_pairs_hashed(df: DataFrame, threshold: float, side: str = "synthetic", idc: str = "id", emb: str = "emb",
                      recall: float = 0.95, seed: int = 42) -> DataFrame:
    """(real, synthetic) pairs with cosine >= ``threshold`` > 0 by random-projection buckets (SI4): each pair is
    found with probability ``recall`` or more, and none is wrong. ``idc`` is unique; zero vectors have no pairs.

    A key is the floor of several random projections of the unit vector; a vector has as many keys as the
    recall needs (``hash_plan``). Both sides are dealt to a few blocks, and every pair of blocks is a cell, whose task
    sorts its vectors by key, meets them bucket by bucket and computes the cosines of those that share one. A vector is
    shuffled as often as the other side has blocks, whatever the number of keys and of pairs that meet."""
    u = with_unit(df.select(F.col(side).alias("side"), F.col(idc).cast("long").alias("id"), emb), emb)
    u = materialize(u.where(F.exists("u", lambda x: x != 0)).select("side", "id", "u"), "hash-vectors")
    sizes = u.agg(F.count_if(~F.col("side")), F.count_if("side"), F.max(F.size("u"))).first()
    n_r, n_s = (MT.blocks_of(n, sizes[2] or 1) for n in sizes[:2])
    k, keys = hash_plan(threshold, sizes[0] + sizes[1], recall)
    step = MT.PRODUCT // 8

    def met(r, s):
        """(place in r, place in s, cosine) of the pairs found, each at the first key that it shares."""
        import numpy as np
        rng, odd = np.random.default_rng(seed), np.random.default_rng(seed + 1).integers(1, 2**62, k) * 2 + 1
        planes, shift = rng.normal(size=(r.shape[1], k * keys)), rng.random(k * keys)

        def codes(x):
            out = np.empty((keys, len(x)), np.int32)
            for t in range(keys):
                cell = np.floor(x @ planes[:, t * k:(t + 1) * k] + shift[t * k:(t + 1) * k]).astype(np.int64)
                out[t] = ((cell * odd).sum(axis=1) >> 32).astype(np.int32)
            return out
        code_r, code_s = codes(r), codes(s)
        most = max(1, step // r.shape[1])  # pairs at once
        for t in range(keys):
            order = np.argsort(code_r[t], kind="stable")
            ranked = code_r[t][order]
            first = np.searchsorted(ranked, code_s[t], "left")
            stop = np.cumsum(np.searchsorted(ranked, code_s[t], "right") - first)
            for a in range(0, int(stop[-1]), most):
                pair = np.arange(a, min(a + most, int(stop[-1])))
                j = np.searchsorted(stop, pair, "right")
                i = order[first[j] + pair - (stop[j - 1] * (j > 0))]
                cos = np.einsum("ij,ij->i", r[i], s[j])
                near = np.flatnonzero(cos >= threshold)
                i, j, cos = i[near], j[near], cos[near]
                new = np.ones(len(i), bool)
                for e in range(t):
                    new &= code_r[e][i] != code_s[e][j]
                if new.any():
                    yield i[new], j[new], cos[new]

    def run(batches):
        # self-contained (numpy / pyarrow only): workers need no import of this package
        import numpy as np
        import pyarrow as pa

        def found(rows):
            if rows[0] and rows[1]:
                (ids_r, r), (ids_s, s) = ((pa.concat_arrays([x for x, _ in one]), np.concatenate([x for _, x in one])) for one in rows)
                for i, j, cos in met(r, s):
                    yield pa.RecordBatch.from_arrays([ids_r.take(pa.array(i)), ids_s.take(pa.array(j)), pa.array(cos)], ["real_id", "synthetic_id", "cosine"])
        now, rows = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, synthetic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side"))
            cut = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (synthetic[1:] != synthetic[:-1])) + 1, [len(cell)]]).tolist()
            for a, b in zip(cut, cut[1:]):
                if cell[a] != now:
                    yield from found(rows)
                    now, rows = cell[a], ([], [])
                rows[int(synthetic[a])].append((batch.column("id").slice(a, b - a), batch.column("u").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)))
        yield from found(rows)

    def cells(one, own, other):
        return u.where(one).select("side", "id", "u", MT.block("id", own).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
    dealt = cells(~F.col("side"), n_r, n_s).select((F.col("own") * n_s + F.col("other")).alias("cell"), "side", "id", "u").unionByName(
        cells(F.col("side"), n_s, n_r).select((F.col("other") * n_s + F.col("own")).alias("cell"), "side", "id", "u"))
    return dealt.repartition(n_r * n_s, "cell").sortWithinPartitions("cell", "side").mapInArrow(run, "real_id long, synthetic_id long, cosine double")


def encode_texts(df: DataFrame, text: str, load, encode, keep: Sequence[str], out: str = "emb") -> DataFrame:
    """Columns ``keep`` and ``out``, the vectors that a user's encoder gives the texts (SI5): ``load()`` returns the
    model, once per Python worker, and ``encode(model, texts)`` one vector of numbers for each text. Null
    texts are empty. Texts move in Arrow batches and only the vectors leave the workers; write the result
    (``materialize``) where several steps read it."""
    import uuid
    key = uuid.uuid4().hex

    def run(batches):
        # self-contained (numpy / pyarrow only): workers need no import of this package
        import sys
        import types
        import pyarrow as pa
        models = sys.modules.setdefault("_turnscore_models", types.ModuleType("_turnscore_models")).__dict__
        for batch in batches:
            if key not in models:  # a worker runs many tasks
                models[key] = load()
            n = batch.num_rows
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            v = np.asarray(encode(models[key], texts), dtype=np.float64).reshape(n, -1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], rows], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, `{out}` array<double>")


def file_encoder(spark, path: str):
    """(load, encode) of an encoder kept in a Python file that defines both. The file goes to every executor with
    the session's files, so neither the package nor a shared disk is needed there."""
    import os
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def load():
        import importlib.util
        from pyspark import SparkFiles
        spec = importlib.util.spec_from_file_location("turnscore_encoder", SparkFiles.get(name))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.encode, module.load()

    return load, lambda model, texts: model[0](model[1], texts)


# Token pattern: maximal runs of letters or digits (Unicode classes).
TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"


def term_weights(df: DataFrame, idc: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Text -> sparse L2-normalised bag-of-words rows (id, keep..., term, w).

    Whole texts are tokenised (lower case, split on non letter/digit runs). Terms are
    counted inside the row, as runs of its sorted tokens, so no text is shuffled."""
    # a generator computes its array once; a plain column would be put into every use below
    def once(frame, name, array):
        return frame.select("*", F.explode(F.array(array)).alias(name))
    docs = once(df.select(F.col(idc).alias("id"), *keep, F.lower(F.col(text)).alias("_l")), "_t",
                F.sort_array(F.array_remove(F.split("_l", TOKEN_SPLIT), ""))).drop("_l")
    size = F.size("_t")
    docs = once(docs.where(size > 0), "_starts", F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (
        F.element_at("_t", i) != F.element_at("_t", F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(size + 1))
    docs = once(docs, "_terms", F.zip_with("_starts", ends, lambda a, b: F.struct(
        F.element_at("_t", a).alias("term"), (b - a).alias("c")))).drop("_t", "_starts")
    norm = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda s, x: s + x["c"].cast("double") * x["c"]))
    return once(docs, "_norm", norm).select("id", *keep, "_norm", F.explode("_terms").alias("x")) \
        .select("id", *keep, F.col("x.term").alias("term"), (F.col("x.c") / F.col("_norm")).alias("w"))


def cosine_mean_terms(docs: DataFrame, weights: DataFrame, by: Sequence[str] = (),
                      side: str = "synthetic") -> DataFrame:
    """Mean cosine of all (real, synthetic) document pairs per group from sparse
    term weights (which carry ``by`` and ``side``). Document counts come from
    ``docs`` so empty texts (zero vectors, cosine 0) still count."""
    if not by:  # one group: a constant key keeps the final step an equi-join
        docs, weights = docs.withColumn("_g", F.lit(0)), weights.withColumn("_g", F.lit(0))
        return cosine_mean_terms(docs, weights, ["_g"], side).drop("_g")
    by = list(by)
    per_term = weights.groupBy(*by, "term").agg(
        F.sum(F.when(~F.col(side), F.col("w"))).alias("sr"), F.sum(F.when(F.col(side), F.col("w"))).alias("ss"))
    dot = per_term.groupBy(*by).agg(
        F.sum(F.coalesce("sr", F.lit(0.0)) * F.coalesce("ss", F.lit(0.0))).alias("dot"))
    counts = docs.groupBy(*by).agg(
        F.count(F.when(~F.col(side), F.lit(1))).alias("n_real"),
        F.count(F.when(F.col(side), F.lit(1))).alias("n_synthetic"))
    counts = counts.where((F.col("n_real") > 0) & (F.col("n_synthetic") > 0))
    return counts.join(dot, by, "left").select(
        *by, "n_real", "n_synthetic",
        (F.coalesce("dot", F.lit(0.0)) / (F.col("n_real") * F.col("n_synthetic"))).alias("mean_cosine"))


__all__ = ["with_unit", "cosine_mean", "cosine_extremes", "near_pairs", "near_pairs_hashed", "encode_texts", "file_encoder", "term_weights", "cosine_mean_terms"]
