"""Severity of toxic text by cumulative-link ordinal regression.

P(grade > j | x) = sigmoid(w.x - t_j): one weight per word, shared by all ordered
thresholds t_0 < t_1 < ... Features are sparse: whether a word, or a beginning of longer
words, occurs once, twice or more often. The weights are fitted with an L1 penalty on a
bounded sample of labelled rows inside one task; all documents are then scored by array
kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import ship, text_or_empty

#: Labelled rows of each class that are fitted on, at most; features kept, at most.
SAMPLE, VOCABULARY = 3000, 1 << 14
#: Bytes of the word beginnings that are features, and how often a feature may count.
BEGINNINGS, LEVELS = (4, 5, 6, 7), 3
#: L1 penalty per row, and steps of the fit.
PENALTY, STEPS = 1e-3, 500
#: Rows with at least this probability of a grade above 0 are rejected.
REJECT = 0.5


def sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and of the beginnings of every longer word."""
    low = kernels.lower(data)
    start, end, doc = kernels.word_spans(low, off, kernels.ALNUM)
    pre = kernels.prefix(low)
    docs, out = [doc], [kernels.mix(kernels.span_hash(pre, start, end))]
    for n in BEGINNINGS:
        longer = np.flatnonzero(end - start > n)
        docs.append(doc[longer])
        out.append(kernels.mix(kernels.span_hash(pre, start[longer], start[longer] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(out)


class Ordinal:
    """Weights of features, a column for each time they occur, and ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(words)
        self.words, self.thresholds = words[order], thresholds
        self.total = np.cumsum(weights[order], axis=1)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j), one column per threshold."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, v = len(off) - 1, len(self.words)
        if not v:
            return np.zeros(n)
        doc, f = word_features(data, off)
        at = np.searchsorted(self.words, f)
        at[at == v] = 0
        hit = self.words[at] == f
        pair, times = np.unique(doc[hit] * v + at[hit], return_counts=True)
        return np.bincount(pair // v, self.total[pair % v, np.minimum(times, self.total.shape[1]) - 1], n)


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, penalty: float = PENALTY, steps: int = STEPS,
                prior: float | None = None) -> Ordinal:
    """Accelerated proximal gradient over rows of feature hashes (as often as they occur) and grades
    0..K-1. ``prior`` is the share of grades above 0 among all rows, where the sample's differs."""
    top = int(grade.max(initial=0))
    if not len(rows) or top == 0:
        return Ordinal(np.zeros(0, np.uint64), np.zeros((0, 1)), np.array([np.inf]))
    words, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pair, times = np.unique(row * len(words) + col, return_counts=True)
    row, col = pair // len(words), pair % len(words)
    bad = grade > 0
    share = np.bincount(col, bad[row]) / bad.sum() - np.bincount(col, ~bad[row]) / max(1, (~bad).sum())
    keep = np.flatnonzero(np.bincount(col) >= 2)
    keep = keep[np.argsort(-np.abs(share[keep]), kind="stable")[:VOCABULARY]]
    new = np.full(len(words), -1)
    new[keep] = np.arange(len(keep))
    used = new[col] >= 0
    row, col, times, words = row[used], new[col][used], np.minimum(times[used], LEVELS), words[keep]
    level = np.concatenate([np.arange(k) for k in range(1, LEVELS + 1)])
    first_of = np.cumsum(np.arange(LEVELS + 1))[times - 1]
    row, col = np.repeat(row, times), np.repeat(col * LEVELS, times)
    col = col + level[np.repeat(first_of, times) + np.arange(len(col)) - np.repeat(np.cumsum(times) - times, times)]
    n, v = len(rows), len(words) * LEVELS
    # P(grade > j) starts at the shares of the sample
    share = np.array([np.clip((grade > j).mean(), 1e-3, 1 - 1e-3) for j in range(top)])
    first = np.log((1 - share) / share)
    gap = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([first[:1], gap])
    w = np.zeros(v)

    def thresholds(t):
        return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])

    def gradient(w, t):
        s = np.bincount(row, w[col], n)
        th = np.concatenate([[-np.inf], thresholds(t), [np.inf]])
        hi, lo = sigmoid(s - th[grade]), sigmoid(s - th[grade + 1])  # P(y >= grade), P(y > grade)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = -(d_hi - d_lo) / n
        dth = np.zeros(top)
        np.add.at(dth, grade[grade > 0] - 1, d_hi[grade > 0] / n)
        np.add.at(dth, grade[grade < top], -d_lo[grade < top] / n)
        dt = np.array([dth.sum(), *(dth[j + 1:].sum() * np.exp(t[j + 1]) for j in range(top - 1))])
        return np.bincount(col, ds[row], v), dt

    step = 4.0 / max(1.0, np.mean(np.bincount(row, minlength=n)))
    zw, zt, ow, ot, k = w, theta, w, theta, 1.0
    for _ in range(steps):
        gw, gt = gradient(zw, zt)
        w = zw - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = zt - 0.5 * gt
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        zw, zt = w + (k - 1) / nk * (w - ow), theta + (k - 1) / nk * (theta - ot)
        ow, ot, k = w, theta, nk
    w = w.reshape(-1, LEVELS)
    used = (w != 0).any(1)
    shift = 0.0
    if prior is not None:
        odds = lambda p: np.log(p / (1 - p))
        shift = odds(np.clip(bad.mean(), 1e-6, 1 - 1e-6)) - odds(np.clip(prior, 1e-6, 1 - 1e-6))
    return Ordinal(words[used], w[used], thresholds(theta) + shift)


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades where labels say only toxic or not: 0 for clean rows; toxic ones are split at
    the median number of distinct marker features (in 2 % of toxic rows and ten times as
    common there as in clean rows) into 1 and 2."""
    grade = toxic.astype(np.int64)
    if not toxic.any():
        return grade
    rows = [np.unique(r) for r in rows]
    words, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bad = np.bincount(col, toxic[row], len(words)) / toxic.sum()
    fine = np.bincount(col, ~toxic[row], len(words)) / max(1, (~toxic).sum())
    marker = (bad >= 0.02) & (bad >= 10 * fine)
    count = np.bincount(row, marker[col], len(rows))
    grade[toxic & (count > np.median(count[toxic]))] = 2
    return grade


def sample_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(lid, text, toxic) of the distinct texts that ``chosen`` (lid, toxic) names, each with the least id as text:
    of each class at most ``2 * sample``, those with the least hash, however many rows an id has."""
    rows = (docs.select(F.col(id_col).alias("lid"), text_or_empty(text_col).alias("text"))
            .join(F.broadcast(chosen), "lid").withColumn("lid", F.col("lid").cast("string")).withColumn("th", F.xxhash64("text")))
    texts = rows.groupBy("toxic", "th").agg(F.min("lid").alias("lid"))  # hashes only, so many rows are no load
    least = (texts.where("toxic > 0").orderBy("th", "toxic").limit(2 * sample).unionByName(
        texts.where("toxic <= 0").orderBy("th", "toxic").limit(2 * sample)))  # at most 4 * sample rows
    return (rows.join(F.broadcast(least), ["lid", "toxic", "th"]).groupBy("lid", "toxic", "th").agg(F.first("text").alias("text"))
            .select("lid", "text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
        sample: int = SAMPLE) -> Ordinal:
    """The model, from at most ``sample`` labelled rows of each class, those with the least hash of
    their id. Rows without id or label are left out; of several labels of an id the greatest counts.
    Where ids repeat, at most ``2 * sample`` distinct texts of a class are taken, those with the least hash.
    Equal texts are fitted once, and a feature must occur in two texts."""
    known = (labels.select(F.col(id_col).alias("lid"), F.col(toxic_col).cast("int").alias("toxic"))
             .where("lid is not null and toxic is not null").groupBy("lid").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("lid")
    chosen = known.where("toxic > 0").orderBy(order, "lid").limit(sample).unionByName(
        known.where("toxic <= 0").orderBy(order, "lid").limit(sample))
    shares = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    rows = sample_rows(docs, chosen, id_col, text_col, sample)

    def features(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            packed = []
            for _, part, o in kernels.blocks(data, off):
                doc, f = word_features(part, o)
                order = np.lexsort((f, doc))
                doc, f = doc[order], f[order]
                edge = np.searchsorted(doc, np.arange(len(o)))
                packed += [f[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lid"), batch.column("toxic"), pa.array(packed, pa.binary())],
                                             ["lid", "toxic", "packed"])

    def learn(frames):
        frames = list(frames)
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        f = f.sort_values(["lid", "packed"]).drop_duplicates("packed").groupby("toxic").head(2 * sample)
        rows = [np.frombuffer(x, np.uint64) for x in f["packed"]]
        toxic = f["toxic"].to_numpy() > 0
        model = fit_ordinal(rows, severity_grades(rows, toxic), prior=shares)
        each = np.diff(model.total, axis=1, prepend=0)
        yield pd.DataFrame({"word": np.concatenate([np.repeat(model.words.view(np.int64), each.shape[1]), np.arange(len(model.thresholds))]),
                            "value": np.concatenate([each.ravel(), model.thresholds]),
                            "kind": np.concatenate([np.tile(np.arange(each.shape[1]), len(each)), np.full(len(model.thresholds), -1)])})

    got = (rows.mapInArrow(kernels.tidy(features), "lid string, toxic int, packed binary").repartition(1)
           .mapInPandas(kernels.tidy(learn), "word long, value double, kind long").toPandas())
    w, t = got[got["kind"] >= 0].sort_values(["word", "kind"]), got[got["kind"] < 0].sort_values("word")
    if not len(t):
        return fit_ordinal([], np.zeros(0, np.int64))
    levels = int(w["kind"].max() + 1) if len(w) else 1
    words = np.ascontiguousarray(w["word"].to_numpy().astype(np.int64)[::levels]).view(np.uint64)
    return Ordinal(words, w["value"].to_numpy().reshape(-1, levels), t["value"].to_numpy())


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """One row per input row: id, expected_severity (the sum of P(grade > j)), p_toxic, grade (the likeliest), toxic.

    Null and empty texts have no words and are scored by the thresholds alone. Repeated
    rows and null ids are kept as given. Whole texts count, however long. Without
    labelled toxic rows every severity is 0. An empty table gives no rows. Other columns
    are not read, whatever their names."""
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            s = np.concatenate([model.scores(p, o) for _, p, o in kernels.blocks(data, off)] or [np.zeros(0)])
            above = model.above(s)
            each = np.diff(-np.hstack([np.ones((len(s), 1)), above, np.zeros((len(s), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1)),
                 pa.array(above[:, 0] >= reject)], ["id", "expected_severity", "p_toxic", "grade", "toxic"])

    return source.mapInArrow(kernels.tidy(run), f"id {kind}, expected_severity double, p_toxic double, grade long, toxic boolean"
                             ).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``score`` does not reject."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column(at).cast(pa.string()))
            s = np.concatenate([model.scores(p, o) for _, p, o in kernels.blocks(data, off)] or [np.zeros(0)])
            yield batch.filter(pa.array(model.above(s)[:, 0] < reject))

    return docs.mapInArrow(kernels.tidy(run), docs.schema)


ship(__name__)
