"""Removal of repeated byte strings, by column-wise construction of sorted suffixes.

Every string of ``length`` bytes has one designated anchor: the substring of half
that length with the least hash (the leftmost of equal ones), which depends on the
string's bytes alone. Equal strings therefore meet at equal anchors, at equal
distances, and the collection splits into independent parts by anchor:

1. A scan writes one row per run of strings with a common anchor.
2. Runs that occur whole at two places are settled by counting hashes.
3. What is left of anchors with several different runs is cut into parts whose
   strings share a core of bytes. Each part is a collection of short strings, and
   for these the suffixes are built column by column: every round inserts one
   symbol per string, a stable sort by the new symbol keeps the strings in suffix
   order, and the common prefixes of neighbours follow from range minima of the
   previous round. A string repeats where a neighbour's common prefix reaches
   ``length``. Parts arrive one after the other as sorted shuffle files."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import hash_bitmap, materialize, ship, text_or_empty

LENGTH = 400
#: Strings of a part that are sorted together in a task; larger parts are counted by hash instead.
PART = 100_000
#: Strings a task holds at once, over whole parts.
BATCH = 20_000
#: Bits of the bitmap that spares most texts the second scan's join; its size does not depend on the data.
BITS = 1 << 23


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts in one byte array: text number, first and last start, anchor place, anchor hash, run hash."""
    k = length // 2
    w = length - k + 1
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return empty
    pre = kernels.prefix(data)
    i = np.arange(len(data) - k + 1)
    grams = kernels.mix(kernels.span_hash(pre, i, i + k))
    value = (grams >> np.uint64(32) << np.uint64(32)) | i.astype(np.uint64)
    pad = -len(value) % w
    tiles = np.concatenate([value, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:len(data) - length + 1], ahead[w - 1:w - 1 + len(data) - length + 1])
    # starts whose string stays inside its text
    mark = np.zeros(len(least) + 1, np.int64)
    some = off[1:] - off[:-1] >= length
    np.add.at(mark, off[:-1][some], 1)
    np.add.at(mark, off[1:][some] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    if not len(s):
        return empty
    a = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
    s0, s1, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
    run = kernels.mix(kernels.span_hash(pre, s0, s1 + length) + grams[a] * np.uint64(0xD6E8FEB86659FD93)
                      + (a - s0).astype(np.uint64) * np.uint64(1 << 32) + (s1 - s0).astype(np.uint64))
    doc = np.searchsorted(off, s0, "right") - 1
    o = off[doc]
    return doc, s0 - o, s1 - o, a - o, grams[a], run


def column_wise(part: np.ndarray, left: list[bytes], right: list[bytes], core: int, length: int,
                span: int) -> np.ndarray:
    """Which strings repeat, as a matrix of (row, distance from the part's first start).

    Row r holds as many strings as its flanks reach: ``left`` ends where the core begins
    and ``right`` begins where the core ends, both of at most ``span`` bytes. ``part`` is
    the part of each row, in ascending order."""
    n = len(part)
    missing = 256 + np.arange(n, dtype=np.int64)  # a symbol that matches no other
    rights = np.repeat(missing[:, None], span, 1)
    lefts = rights.copy()
    for r in range(n):
        x = np.frombuffer(right[r], np.uint8)
        rights[r, :len(x)] = x
        x = np.frombuffer(left[r], np.uint8)
        lefts[r, span - len(x):] = x
    order, width = np.arange(n), np.int64(n + 256)
    base = part.astype(np.int64) * width
    common = np.zeros(n, np.int64)  # of order[i] with order[i - 1]; 0 where another part begins
    found = np.zeros((n, span + 1), bool)

    def insert(symbols: np.ndarray):
        nonlocal order, common
        key = (base + symbols)[order]
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(n, np.int64)
        if len(same):
            at = np.stack([move[same - 1] + 1, move[same] + 1], 1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(common, 0), at)[::2] + 1
        order, common = order[move], fresh

    def note(column: int):
        reach = common >= length
        reach[:-1] |= common[1:] >= length
        found[order[reach], column] = True

    for c in range(span - 1, -1, -1):
        insert(rights[:, c])
    same_part = np.append(False, part[order][1:] == part[order][:-1])
    common = np.where(same_part, common + core, 0)
    note(span)
    for c in range(span - 1, -1, -1):
        insert(lefts[:, c])
        note(c)
    return found


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, part_limit: int = PART) -> DataFrame:
    """(id, th, spans): for each (id, text hash) the byte ranges [start, end) of strings that repeat,
    neither sorted nor merged. ``docs`` has id, th and text."""
    kind = docs.schema["id"].dataType.simpleString()
    k = length // 2
    widest = length - k  # the largest distance between a string's start and its anchor

    def scan(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            for at, part, o in kernels.blocks(data, off):
                doc, s0, s1, a, anchor, run = anchor_runs(part, o, length)
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(s0, pa.int64()),
                     pa.array(s1, pa.int64()), pa.array(a, pa.int64()), pa.array(anchor.view(np.int64)),
                     pa.array(run.view(np.int64))], ["id", "th", "s0", "s1", "a", "anchor", "run"])

    runs = materialize(docs.mapInArrow(kernels.tidy(scan), f"id {kind}, th long, s0 long, s1 long, a long, anchor long, run long"), "anchors")
    # written first, so that the join with it is a plain one whose skewed anchors can be split
    often = materialize(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    runs = materialize(runs.join(often, "anchor"), "shared-anchors")
    classes = materialize(runs.groupBy("anchor", "run").agg(
        F.count("*").alias("n"), F.min(F.struct("th", "s0", "s1", "a", "id")).alias("one")), "runs")
    whole = (runs.join(classes.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
             .select("id", "th", F.col("s0").alias("start"), (F.col("s1") + length).alias("end")))

    contested = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1")
    reps = (classes.join(contested.select("anchor"), "anchor", "left_semi")
            .groupBy("one.id", "one.th").agg(F.collect_list(F.struct("one.s0", "one.s1", "one.a", "n")).alias("at")))
    reps = materialize(reps, "contested")
    shared_bits = docs.sparkSession.sparkContext.broadcast(hash_bitmap(reps, "th", BITS))

    def likely(batches):
        one = shared_bits.value
        for batch in batches:
            th = batch.column("th").to_numpy() % BITS
            yield batch.filter(pa.array((one[th >> 3] >> (th & 7) & 1) == 1))

    span = max(1, (length - k) // 3)

    def flanks(batches):
        for batch in batches:
            out = {n: [] for n in ("key", "id", "lo", "first", "left", "right", "n")}
            for i, (text, at) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("at"))):
                text = text.as_py()
                for x in at.as_py():
                    s0, s1, a = x["s0"], x["s1"], x["a"]
                    for b in range((a - s1) // (span + 1), (a - s0) // (span + 1) + 1):
                        near, far = b * (span + 1), b * (span + 1) + span  # distances from start to anchor
                        lo, hi = max(s0, a - far), min(s1, a - near)
                        core = text[max(a - near, 0):a - far + length]
                        out["key"].append(hashlib.blake2b(b"%d:" % b + core, digest_size=16).digest())
                        out["id"].append(i), out["lo"].append(lo), out["first"].append(a - far)
                        out["left"].append(text[lo:a - near])
                        out["right"].append(text[a - far + length:hi + length])
                        out["n"].append(x["n"])
            rows = pa.array(out["id"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.binary()), batch.column("id").take(rows), batch.column("th").take(rows),
                 pa.array(out["lo"], pa.int64()), pa.array(out["first"], pa.int64()), pa.array(out["left"], pa.binary()),
                 pa.array(out["right"], pa.binary()), pa.array(out["n"], pa.int64())],
                ["key", "id", "th", "lo", "first", "left", "right", "n"])

    columns = f"key binary, id {kind}, th long, lo long, first long, left binary, right binary, n long"
    likely_docs = docs.mapInArrow(kernels.tidy(likely), docs.schema)
    one_text = likely_docs.join(reps.withColumnRenamed("id", "rid").withColumnRenamed("th", "rth"),
                                F.col("th").eqNullSafe(F.col("rth")) & F.col("id").eqNullSafe(F.col("rid")))
    strings = materialize(one_text.select("id", "th", "text", "at").mapInArrow(kernels.tidy(flanks), columns), "strings")
    sizes = strings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    strings = materialize(strings.join(sizes, "key"), "parts")

    def sort_parts(frames):
        rest = None
        for f in frames:
            rest = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if len(rest) >= BATCH:
                last = rest["key"].iloc[-1]
                cut = len(rest)
                while cut and rest["key"].iloc[cut - 1] == last:
                    cut -= 1
                if cut:
                    yield settle(rest.iloc[:cut])
                    rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield settle(rest)

    def settle(f):
        part = (f["key"] != f["key"].shift()).cumsum().to_numpy()
        found = column_wise(part, f["left"].tolist(), f["right"].tolist(), length - span, length, span)
        rows, start, end = [], [], []
        for r in np.flatnonzero(found.any(1) & (f["n"].to_numpy() == 1)):
            begin = int(f["first"].iloc[r])
            for x, y in runs_of(found[r]):
                rows.append(r), start.append(begin + x), end.append(begin + y + length)
        got = f.iloc[rows][["id", "th"]].reset_index(drop=True)
        return got.assign(start=np.array(start, np.int64), end=np.array(end, np.int64))

    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = f"id {kind}, th long, start long, end long"
    sorted_parts = (strings.where(F.col("size") <= part_limit).repartition(n_parts, "key").sortWithinPartitions("key")
                    .mapInPandas(kernels.tidy(sort_parts), spans))

    def windows(frames):
        for f in frames:
            out = []
            for key, i, th, lo, first, left, right, n in f.drop(columns=["size"]).itertuples(index=False):
                for s in range(lo, lo + len(left) + 1):
                    tail = right[:s - first]
                    if len(tail) == s - first:
                        d = hashlib.blake2b(key + b"%d:" % (s - first) + left[s - lo:] + b"|" + tail, digest_size=16)
                        out.append((d.digest(), i, th, s, n))
            yield pd.DataFrame(out, columns=["w", "id", "th", "s", "n"])

    single = strings.where(F.col("size") > part_limit).mapInPandas(kernels.tidy(windows), f"w binary, id {kind}, th long, s long, n long")
    twice = single.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    large_parts = single.where("n = 1").join(twice, "w").select("id", "th", F.col("s").alias("start"), (F.col("s") + length).alias("end"))
    return (whole.unionByName(sorted_parts).unionByName(large_parts)
            .groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   part_limit: int = PART, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes).

    A byte goes when a string of ``length`` bytes that covers it also starts anywhere
    else, in the same or another row. Null text is empty. Rows that repeat id and text
    are places of their own, so long ones are removed whole; null ids are kept as
    given. Texts shorter than ``length`` stay as they are. An empty table gives no
    rows. Other columns are not read, whatever their names."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = own.schema["id"].dataType.simpleString()
    spans = repeated_spans(own, length, part_limit).withColumnRenamed("id", "rid").withColumnRenamed("th", "rth")
    spans = materialize(spans, "spans")
    both = own.join(spans, F.col("th").eqNullSafe(F.col("rth")) & F.col("id").eqNullSafe(F.col("rid")), "left")

    def cut(batches):
        for batch in batches:
            n_bytes, removed, n_spans, sha, kept = [], [], [], [], []
            for text, at in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
                text = text.as_py()
                pieces, last, count = [], 0, 0
                for x in sorted(at.as_py() or (), key=lambda x: (x["start"], x["end"])):
                    if not count or x["start"] > last:
                        pieces.append(text[last:x["start"]])
                        count += 1
                    last = max(last, x["end"])
                pieces.append(text[last:])
                rest = b"".join(pieces)
                n_bytes.append(len(text)), removed.append(len(text) - len(rest)), n_spans.append(count)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.select("id", "text", "spans").mapInArrow(kernels.tidy(cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)


ship(__name__)
