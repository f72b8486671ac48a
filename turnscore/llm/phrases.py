"""Phrases whose words belong together, by multikey three-way quicksort of suffix pointers.

1. A first scan counts words per language and notes pairs of words that fill much of a block.
2. A second scan makes a pointer for every place where two or more words follow each
   other. A pointer stands for the words that begin there, up to the longest phrase;
   equal ones of a block are one pointer with a weight. Pointers at words too rare for
   any phrase are left out by a bitmap of the frequent words.
3. Pointers are routed by their two leading words, those of very frequent pairs by three. In each bucket a multikey quicksort splits them into less, equal and
   greater word by word; the weight of an equal partition is the count of the words so
   far, and partitions that weigh less than the threshold are abandoned.
4. Counts of phrases meet those of their parts by joins, and scores are exact decimals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import hash_bitmap, materialize, release, ship

#: Bytes of text and words handled at once.
BLOCK, SLICE = 1 << 21, 1 << 20
#: A pair is noted where it has more than 1 / SHARE of a block's pointers.
SHARE = 128
#: Pointers that are sorted outright instead of being split further.
SMALL = 1 << 14
#: Bits of the bitmap per frequent word, and its largest size.
SPARSE, MOST_BITS = 64, 1 << 27

WORD = np.ones(256, bool)
WORD[[0x20, 0x09]] = False
CUT = np.zeros(256, bool)  # ends a piece
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD[CUT] = False


def words_of(low: np.ndarray, off: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, text, key and piece of every word. Keys are 64-bit hashes of the word and its text's ``salt``."""
    start, end, doc = kernels.word_spans(low, off, WORD)
    key = kernels.mix(kernels.span_hash(kernels.prefix(low), start, end) ^ salt[doc])
    key[key == 0] = 1  # zero means no word
    return start, end, doc, key, np.cumsum(CUT[low])[start] if len(start) else start


def pointers(key: np.ndarray, doc: np.ndarray, piece: np.ndarray, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pointers as rows of ``width`` keys, zero behind the end of a piece; their weights) at words lo to hi."""
    n = min(len(key), hi + width - 1)
    uniq, code = np.unique(key[lo:n], return_inverse=True)
    at, ids = hi - lo, np.append(code + 1, np.zeros(width, np.int64))
    full, acc = np.ones(at, bool), ids[:at]
    columns = [acc]
    for t in range(1, width):
        nxt = np.zeros(at, np.int64)
        own = np.arange(lo, min(hi, len(key) - t))
        same = (doc[own] == doc[own + t]) & (piece[own] == piece[own + t])
        nxt[:len(own)] = np.where(same & full[:len(own)], ids[t:t + len(own)], 0)
        full = nxt > 0
        columns.append(nxt)
    keep = columns[1] > 0
    columns = [c[keep] for c in columns]
    acc, first = columns[0], np.arange(len(columns[0]))
    for c in columns[1:]:
        _, first, acc = np.unique(acc * (len(uniq) + 1) + c, return_index=True, return_inverse=True)
    named = np.append(np.uint64(0), uniq)
    return np.stack([named[c[first]] for c in columns], 1), np.bincount(acc, minlength=len(first))


def multikey(keys: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, counts) of equal partitions of two or more words that weigh at least ``least``."""
    width, out = keys.shape[1], []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        p, depth = stack.pop()
        if weight[p].sum() < least:
            continue
        if len(p) > SMALL:
            k = keys[p, depth]
            pivot = np.sort(k[::max(1, len(k) // 99)])[len(k[::max(1, len(k) // 99)]) // 2]
            equal = p[k == pivot]
            stack += [(p[k < pivot], depth), (p[k > pivot], depth)]
            if pivot == 0 or not len(equal):  # no further word
                continue
            if depth:
                total = weight[equal].sum(keepdims=True)
                if total[0] < least:
                    continue
                out.append((depth + 1, equal[:1], total))
            if depth + 1 < width:
                stack.append((equal, depth + 1))
            continue
        p = p[np.lexsort([keys[p, d] for d in range(width - 1, depth - 1, -1)])]
        edge = np.zeros(len(p), bool)
        edge[0] = True
        for d in range(depth, width):
            k = keys[p, d]
            edge[1:] |= k[1:] != k[:-1]
            begin = np.flatnonzero(edge)
            total = np.add.reduceat(weight[p], begin)
            good = (total >= least) & (k[begin] != 0)
            if d:
                out.append((d + 1, p[begin[good]], total[good]))
    return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kernels.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _blocks(batch):
    """(languages, language of each text, words of :func:`words_of`, bytes) of the blocks of a batch."""
    from xxhash import xxh64_intdigest
    lang = batch.column("lang").dictionary_encode()
    salts = np.array([xxh64_intdigest((x or "").encode()) for x in lang.dictionary.to_pylist()], np.uint64)
    code = lang.indices.to_numpy(zero_copy_only=False)
    data, off = kernels.buffers(batch.column("text"))
    for at, part, o in kernels.blocks(data, off, BLOCK):
        own, low = code[at:at + len(o) - 1], kernels.lower(part)
        yield lang.dictionary, own, words_of(low, o, salts[own]), low


def word_counts(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Words (key, lang, word, f), and pairs (pair, share) with the pointers they have in blocks they fill."""
    def scan(batches):
        for batch in batches:
            for langs, own, (start, end, doc, key, piece), low in _blocks(batch):
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                raw = low.tobytes()
                words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())]
                yield rows(key[first], count, langs.take(pa.array(own[doc[first]])), words)
                for lo in range(0, len(key), SLICE):
                    k, w = pointers(key, doc, piece, lo, min(lo + SLICE, len(key)), width)
                    pair, n = np.unique(pair_key(k[:, 0], k[:, 1]), return_counts=True)
                    many = n * SHARE > len(k)
                    yield rows(pair[many], n[many], pa.nulls(int(many.sum()), pa.string()), [None] * int(many.sum()))

    def rows(key, count, lang, words):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lang.cast(pa.string()), pa.array(words, pa.string()),
                                           pa.array(count.astype(np.int64))], ["key", "lang", "word", "c"])

    found = materialize(texts.mapInArrow(kernels.tidy(scan), "key long, lang string, word string, c long")
                        .groupBy("key", "lang", "word").agg(F.sum("c").alias("f")), "words")
    return found.where("word is not null"), found.where("word is null").select(F.col("key").alias("pair"), F.col("f").alias("share"))


def phrase_counts(texts: DataFrame, words: DataFrame, heavy: np.ndarray, width: int, least: int) -> DataFrame:
    """(k0, k1, ..., f): phrases of two to ``width`` words (keys, 0 behind the last) with a count of ``least`` or more."""
    spark = texts.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n_parts
    frequent = words.where(F.col("f") >= least)
    bits = 1 << 18
    while bits < min(MOST_BITS, SPARSE * frequent.count()):
        bits *= 2
    shared = spark.sparkContext.broadcast((hash_bitmap(frequent, "key", bits), heavy))

    def scan(batches):
        bitmap, pairs = shared.value
        for batch in batches:
            for _, _, (_, _, doc, key, piece), _ in _blocks(batch):
                place = (key % np.uint64(bits)).astype(np.int64)
                rare = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1) == 0
                piece = piece + np.cumsum(rare)  # no pointer passes a rare word
                piece[rare] = -1 - np.arange(len(key))[rare]
                for lo in range(0, len(key), SLICE):
                    k, w = pointers(key, doc, piece, lo, min(lo + SLICE, len(key)), width)
                    pair = pair_key(k[:, 0], k[:, 1])
                    route = pair.copy()
                    spread = np.isin(pair, pairs)
                    if width > 2:
                        route[spread] = pair_key(route[spread], k[spread, 2])
                    to = (route % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    packed = np.concatenate([k, w.astype(np.uint64)[:, None]], 1)[order]
                    begin = np.flatnonzero(np.append(True, np.diff(to[order]) > 0)) if len(to) else np.zeros(0, np.int64)
                    stop = np.append(begin[1:], len(to))
                    yield pa.RecordBatch.from_arrays([pa.array(to[order][begin], pa.int32()), pa.array(
                        [packed[a:b].tobytes() for a, b in zip(begin, stop)], pa.binary())], ["bucket", "packed"])

    def count(batches):
        _, pairs = shared.value
        now, held = None, []

        def flush():
            if held:
                packed = np.frombuffer(b"".join(held), np.uint64).reshape(-1, width + 1)
                k, w = packed[:, :width], packed[:, width].astype(np.int64)
                pair = pair_key(k[:, 0], k[:, 1])
                spread = np.isin(pair, pairs)
                for depth, p, total in multikey(k, w, least):
                    if depth == 2:  # a spread pair's counts are parts, summed below
                        total, p = total[~spread[p]], p[~spread[p]]
                    yield rows(k[p], depth, total)
                if spread.any():
                    _, first, which = np.unique(pair[spread], return_index=True, return_inverse=True)
                    yield rows(k[spread][first], 2, np.bincount(which, w[spread]).astype(np.int64))

        def rows(k, depth, total):
            k = np.where(np.arange(width) < depth, k, np.uint64(0)).view(np.int64)
            return pa.RecordBatch.from_arrays([*[pa.array(k[:, i].copy()) for i in range(width)], pa.array(total)],
                                              [*[f"k{i}" for i in range(width)], "f"])

        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if b != now:
                    yield from flush()
                    now, held = b, []
                held.append(x.as_py())
        yield from flush()

    names = [f"k{i}" for i in range(width)]
    routed = texts.mapInArrow(kernels.tidy(scan), "bucket int, packed binary").repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    found = routed.mapInArrow(kernels.tidy(count), ", ".join(f"{x} long" for x in names) + ", f long")
    return materialize(found.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = 3, least: int = 10, top: int = 2000,
                 share: int = 50, scale: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``width`` words.

    Texts are cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at blanks and tabs, A-Z
    lower-cased. a is a phrase's count, ``least`` or more; n the language's words. Of the cuts of a phrase in
    two the one with the lowest score floor(scale * a * a / (l * r)) counts, l and r being the parts' counts;
    ties go to the earliest cut. A phrase goes that stands in a longer one with 100 * count >= share * a.
    Order is by score, then a (both descending), then phrase (bytes). Null text is empty, null lang is
    ``und``; an empty table, or one without phrases, gives no rows. Repeated rows count each. Other columns
    are not read. Words are told apart by 64-bit hashes."""
    texts = _texts(docs, text_col, lang_col)
    words, pairs = word_counts(texts, width)
    total = words.agg(F.sum("f")).first()[0] or 0
    # a pair that has much of all pointers is noted in some block; at most SHARE ** 2 pairs pass
    heavy = [r.pair for r in pairs.where(F.col("share") * SHARE * SHARE > total).collect()] if total else []
    counts = phrase_counts(texts, words, np.array(heavy, np.int64).view(np.uint64), width, least)

    known = words.where(F.col("f") >= least).select(
        F.col("key").alias("k0"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf"))
    level = []
    for size in range(2, width + 1):
        own = counts.where((F.col(f"k{size - 1}") != 0) & (F.col(f"k{size}") == 0 if size < width else F.lit(True)))
        own = own.select(*[f"k{i}" for i in range(size)], "f")
        head = known.select(*[f"k{i}" for i in range(size - 1)], "lang", "phrase", "pre")
        tail = known.select(*[F.col(f"k{i}").alias(f"k{i + 1}") for i in range(size - 1)], "last", "suf")
        known = materialize(own.join(head, [f"k{i}" for i in range(size - 1)]).join(tail, [f"k{i + 1}" for i in range(size - 1)]).select(
            *[f"k{i}" for i in range(size)], "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
            F.array_append("pre", F.col("f")).alias("pre"), F.array_append("suf", F.col("f")).alias("suf"), F.col("f").alias("a")), f"phrases-{size}")
        level.append(known)

    out = []
    for i, one in enumerate(level):
        size = i + 2
        wide = F.col("a").cast("decimal(38,0)")
        cuts = []
        for k in range(1, size):
            left, right = F.col("pre")[k - 1], F.col("suf")[size - k - 1]
            s = _quotient(wide * wide * F.lit(scale).cast("decimal(10,0)"), left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))
            cuts.append(F.struct(s.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        best = F.array_min(F.array(*cuts))
        one_out = one.withColumn("best", best)
        if i + 1 < len(level):
            # a longer phrase yet holds the one word longer, which is as frequent at least
            longer = level[i + 1]
            inside = reduce(DataFrame.unionByName, [longer.select(*[F.col(f"k{s + j}").alias(f"k{j}") for j in range(size)], "a") for s in (0, 1)])
            most = inside.groupBy(*[f"k{j}" for j in range(size)]).agg(F.max("a").alias("inside"))
            one_out = one_out.join(most, [f"k{j}" for j in range(size)], "left").where(
                F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * share))
        out.append(one_out.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")))
    return _ranked(materialize(reduce(DataFrame.unionByName, out), "candidates"), words, top)


def _quotient(a, b):
    """Whole part of a quotient of decimals, exact."""
    return F.call_function("div", a, b)


def _ranked(candidates: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; those of 64 random shares of it are found first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return some.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ship(__name__)
