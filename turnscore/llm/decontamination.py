"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which words of a window count; the hash of those words joins documents
with benchmark items although other words of the window were replaced. Around every
joined hit the words are compared in place, and a leak is a stretch of WINDOW words
of which at most SUBSTITUTED differ. The masks are chosen so that none is missed:
wherever the replaced words stand in such a stretch, one mask avoids them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import hash_bitmap, materialize, ship, renamed, split_likely, text_or_empty

WINDOW, SUBSTITUTED = 13, 2
#: 1 is a word that counts, 0 one that may differ; lossless for WINDOW and SUBSTITUTED (see tests).
MASKS = ("11101111", "1110110011", "11010010111")
#: Bits of the bitmap of benchmark seeds that the scan looks at; its size does not depend on the data.
BITS = 1 << 26


def seeds(h: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) at every place where the mask fits into one text."""
    span = len(mask)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(n, int(mask, 2), np.uint64)
    for p, bit in enumerate(mask):
        if bit == "1":
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[p:p + n]
    at = np.flatnonzero(doc[:n] == doc[span - 1:])
    return at, kernels.mix(acc[at])


def short_masks(window: int) -> list[str]:
    return ["1" * n for n in range(1, window)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, substituted: int = SUBSTITUTED,
          masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per document and item that share a leak: id, ``text_hash``, item, ``first_word`` and ``last_word``
    (words of the document, from 0, that verified windows cover), ``n_equal`` (equal words of the best window).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An
    item of fewer than ``window`` words must stand in the document whole and unchanged.
    Null or empty texts, on either side, have no words and share nothing. Rows that
    repeat an id are told apart by their text's hash, rows that repeat both share one
    result, and null ids are kept. Repeated items give one row. An empty table on
    either side gives no rows. Other columns are not read, whatever their names."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item"), text_or_empty(item_text_col).alias("text"))
    kind, item_kind = own.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()

    def item_seeds(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            out = {n: [] for n in ("item", "seed", "place", "words")}
            for at, part, o in kernels.blocks(data, off):
                h, doc = kernels.word_hashes(kernels.lower(part), o, kernels.ALNUM)
                for d in range(len(o) - 1):
                    own = h[np.searchsorted(doc, d):np.searchsorted(doc, d + 1)]
                    if not len(own):
                        continue
                    for mask in masks if len(own) >= window else ["1" * len(own)]:
                        for p, s in zip(*seeds(own, np.zeros(len(own), int), mask)):
                            out["item"].append(at + d), out["seed"].append(s), out["place"].append(p)
                            out["words"].append(own[max(0, p - window):p + len(mask) + window].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(out["item"], pa.int64())), pa.array(np.array(out["seed"], np.uint64).view(np.int64)),
                 pa.array([min(int(p), window) for p in out["place"]], pa.int64()), pa.array(out["words"], pa.binary())],
                ["item", "seed", "place", "words"])

    test = materialize(items.mapInArrow(kernels.tidy(item_seeds), f"item {item_kind}, seed long, place long, words binary"), "seeds")
    shared_bits = spark.sparkContext.broadcast(hash_bitmap(test, "seed", BITS))
    lengths = {r.n for r in test.where(F.length("words") < 8 * window).select((F.length("words") / 8).cast("int").alias("n"))
               .distinct().collect()}
    all_masks = [*masks, *(m for m in short_masks(window) if len(m) in lengths)]

    def scan(batches):
        known = shared_bits.value
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            rows, seed, at, words, place = [], [], [], [], []
            for first, part, o in kernels.blocks(data, off):
                h, doc = kernels.word_hashes(kernels.lower(part), o, kernels.ALNUM)
                begin = np.searchsorted(doc, np.arange(len(o)))
                for mask in all_masks:
                    p, s = seeds(h, doc, mask)
                    bit = s & np.uint64(BITS - 1)
                    hit = np.flatnonzero(known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                    for p, s in zip(p[hit].tolist(), s[hit]):
                        d = doc[p]
                        a, b = max(begin[d], p - window), min(begin[d + 1], p + len(mask) + window)
                        rows.append(first + d), seed.append(s), at.append(a - begin[d])
                        words.append(h[a:b].tobytes()), place.append(p - a)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("text_hash").take(take),
                 pa.array(np.array(seed, np.uint64).view(np.int64)), pa.array(at, pa.int64()), pa.array(words, pa.binary()),
                 pa.array(place, pa.int64())], ["id", "text_hash", "seed", "at", "own_words", "own_place"])

    hits = own.mapInArrow(kernels.tidy(scan), f"id {kind}, text_hash long, seed long, at long, own_words binary, own_place long")

    def verify(batches):
        for batch in batches:
            keep, first, last, equal = [], [], [], []
            cols = [batch.column(c).to_pylist() for c in ("at", "own_words", "own_place", "words", "place")]
            for i, (at, x, p, y, q) in enumerate(zip(*cols)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                back = min(p, q)
                n = min(len(x) - p, len(y) - q) + back
                width, allowed = (window, substituted) if len(y) >= window else (len(y), 0)
                if n < width:
                    continue
                same = np.append(0, np.cumsum(x[p - back:p - back + n] == y[q - back:q - back + n]))
                score = same[width:] - same[:-width]
                good = np.flatnonzero(score >= width - allowed)
                if len(good):
                    begin = at + p - back
                    keep.append(i), first.append(begin + int(good[0])), last.append(begin + int(good[-1]) + width - 1)
                    equal.append(int(score.max()))
            part = batch.select(["id", "text_hash", "item"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                                              pa.array(equal, pa.int64())],
                                             ["id", "text_hash", "item", "first_word", "last_word", "n_equal"])

    found = hits.join(test, "seed").select("id", "text_hash", "item", "at", "own_words", "own_place", "words", "place").mapInArrow(kernels.tidy(verify), f"id {kind}, text_hash long, item {item_kind}, first_word long, last_word long, n_equal long")
    return (found.groupBy("id", "text_hash", "item")
            .agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("n_equal").alias("n_equal"))
            .select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col if item_col != id_col else "item"),
                    "first_word", "last_word", "n_equal"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names, that share no leak with the benchmark. Null and
    empty texts stay, rows that repeat an id are judged by their own text, and null ids are kept."""
    columns = docs.columns
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    bad = materialize(leaks(docs, benchmark, id_col, text_col, **options), "leaks")
    bad = bad.select(F.col(id_col).alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    hashed = F.xxhash64(text_or_empty(text_col))
    some, rest = split_likely(docs, hashed, bad, "_leak_hash")
    some = some.join(bad, (hashed == F.col("_leak_hash")) & F.col(id_col).eqNullSafe(F.col("_leak_id")), "left_anti")
    return rest.unionByName(some).toDF(*columns)


ship(__name__)
