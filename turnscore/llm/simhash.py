"""SimHash fingerprints and the groups of nearly equal ones, by pivot distance tables.

1. A bit of a fingerprint is the majority of that bit over the hashes of the text's shingles.
2. Every distinct fingerprint gets its Hamming distances to 64 reference fingerprints, the
   rows of a Hadamard matrix. By the triangle inequality no coordinate of a linked pair
   differs by more than the threshold t. For the 64 rows together, the squared coordinate
   differences of two fingerprints at distance D sum to 64 * D, so that pairs further apart
   than t squared are always discarded.
3. Cells of fingerprints that have too many are split at the median of some coordinates,
   round by round. A fingerprint less than t above a border goes to both sides, so that
   linked pairs meet. In a cell the splitting goes on, then pairs are discarded by their
   maximum coordinate difference and survivors are verified."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import connected_components, materialize, release, ship, text_or_empty

BITS = 64
SEED = 42
#: Fingerprints of a cell that are searched in one task, and coordinates that split cells in one round.
CELL, SPLITS = 4096, 4
#: Fingerprints whose pairs are compared at once, and the coordinates that discard most of them.
LEAF, FIRST = 96, 12
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def pivots() -> list[int]:
    """Reference fingerprints: bit j of the i-th is the parity of i & j."""
    return [sum(((i & j).bit_count() & 1) << j for j in range(BITS)) for i in range(BITS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_places(low: np.ndarray, off: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words joined by single spaces, start and end of each shingle there, first shingle of each text and the end)."""
    start, end, doc = kernels.word_spans(low, off, kernels.NONSPACE)
    word = kernels.NONSPACE[low]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first blank after a word
    place = np.cumsum(keep) - 1
    text = np.where(word, low, np.uint8(0x20))[keep].tobytes()
    n = np.bincount(doc, minlength=len(off) - 1)  # words of each text
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    edge = np.append(0, np.cumsum(count))
    first_word = np.append(0, np.cumsum(n))[:-1]
    own = np.repeat(np.arange(len(n)), count)
    a = first_word[own] + np.arange(edge[-1]) - edge[own]
    b = a + np.minimum(n[own], width) - 1
    if not len(a):
        return text, a, b, edge
    return text, place[start[a]], place[end[b] - 1] + 1, edge


def fingerprints_of(data: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    text, a, b, edge = shingle_places(kernels.lower(data), off, width)
    ones = np.zeros((len(edge) - 1, BITS), np.int64)
    for lo in range(0, len(a), SLICE):
        hi = min(lo + SLICE, len(a))
        h = np.array([xxh64_intdigest(text[x:y], SEED) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d0, d1 = np.searchsorted(edge, lo, "right") - 1, np.searchsorted(edge, hi, "left")
        docs = np.arange(d0, d1)
        docs = docs[edge[docs] < edge[docs + 1]]  # with shingles
        ones[docs] += np.add.reduceat(bits, np.maximum(edge[docs], lo) - lo, axis=0, dtype=np.int64)
    most = ones * 2 > np.diff(edge)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp) of every row, written."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            fp = [fingerprints_of(part, o, width) for _, part, o in kernels.blocks(data, off)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return materialize(own.mapInArrow(kernels.tidy(scan), f"id {own.schema['id'].dataType.simpleString()}, fp long"), "fingerprints")


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, d): the distances of each fingerprint to the pivots."""
    return fps.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte") for p in pivots()]).alias("d"))


def both_sides(codes, value, border, most: int):
    """Array of codes, each extended by 0 below the border, by 1 above it, and by both near it."""
    sides = F.when(value < border, F.array(F.lit(0))).when(value >= border + most, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return F.flatten(F.transform(codes, lambda c: F.transform(sides, lambda x: c * 2 + x)))


def cells(table: DataFrame, most: int, size: int = CELL) -> list[DataFrame]:
    """Tables (cell, fp, d) whose cells have at most about ``size`` rows; fingerprints ``most`` or fewer bits
    apart share a cell. Cells stay larger only where no pivot divides them, so where that many
    fingerprints are within a few bits of each other."""
    out, todo = [], materialize(table.select(F.lit(0).cast("long").alias("cell"), "fp", "d"), "cells")
    for at in range(1, BITS, SPLITS):  # pivot 0 is the zero fingerprint; it comes last
        ks = [k % BITS for k in range(at, at + SPLITS)]
        # borders: per large cell and pivot the least value that half of the rows do not pass
        value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("d")[k].alias("v")) for i, k in enumerate(ks)])).alias("x")
        hist = todo.select("cell", value).groupBy("cell", "x.i", "x.v").agg(F.count("*").alias("c"))
        w = Window.partitionBy("cell", "i")
        below = F.sum("c").over(w.orderBy("v"))
        border = (hist.select("cell", "i", "v", below.alias("below"), F.sum("c").over(w).alias("n")).where("2 * below >= n")
                  .groupBy("cell", "i").agg(F.min("v").alias("v"), F.first("n").alias("n")))
        # t borders side by side in one row; one row a cell
        border = materialize(border.where(F.col("n") > size).groupBy("cell").agg(
            *[F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(SPLITS)]), "borders")
        if not border.count():
            release(border)
            break
        marked, last = todo.join(border, "cell", "left"), todo
        code = F.array(F.lit(0))
        for i, k in enumerate(ks):
            code = both_sides(code, F.col("d")[k], F.col(f"v{i}"), most)
        out.append(materialize(marked.where("v0 is null").select("cell", "fp", "d"), "cells-done"))
        todo = materialize(marked.where("v0 is not null").select("cell", "fp", "d", F.explode(code).alias("code")).select(
            F.xxhash64("cell", "code").alias("cell"), "fp", "d"), "cells")
        release(last), release(border)
    return [*out, todo]


def links_in_cell(fp: np.ndarray, d: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (rows) that connect all fingerprints of a cell that are ``most`` or fewer bits apart."""
    up, links = list(range(len(fp))), []

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def compare(a, b):
        """Pairs of the rows ``a`` and ``b`` that survive their coordinates and the check."""
        near = np.ones((len(a), len(b)), bool)
        for k in range(1, FIRST + 1):
            near &= np.abs(d[a, k][:, None] - d[b, k][None, :]) <= most
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        i, j = i[i < j], j[i < j]
        ok = np.abs(d[i] - d[j]).max(axis=1, initial=0) <= most
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= most
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((x, y))

    stack = [np.arange(len(fp))]
    while stack:
        rows = stack.pop()
        if len(rows) > LEAF:
            some = d[rows[::max(1, len(rows) // 256)]]
            k = int(some.std(axis=0).argmax())
            v = d[rows, k]
            border = int(np.median(v))
            low, high = rows[v < border + most], rows[v >= border]
            if max(len(low), len(high)) <= 0.9 * len(rows):
                stack += [low, high]
                continue
        for x in range(0, len(rows), LEAF):
            for y in range(x, len(rows), LEAF):
                compare(rows[x:x + LEAF], rows[y:y + LEAF])
    return links


def near_links(fps: DataFrame, most: int, size: int = CELL) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``most`` or fewer bits apart. ``fps`` has fp, each once."""
    def search(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        fp = cell.column("fp").to_numpy().view(np.uint64)
        d = np.concatenate([np.asarray(c.values).reshape(-1, BITS) for c in cell.column("d").chunks]).astype(np.int8)
        found = np.array(links_in_cell(fp, d, most), np.int64).reshape(-1, 2)
        return pa.table({"u": fp.view(np.int64)[found[:, 0]], "v": fp.view(np.int64)[found[:, 1]]})

    made = cells(pivot_table(fps), most, size)
    rows = reduce(DataFrame.unionByName, made)
    links = materialize(rows.groupBy("cell").applyInArrow(search, "u long, v long"), "near-links")
    for x in made:
        release(x)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2, size: int = CELL) -> DataFrame:
    """One row per input row: id, fingerprint, component_id.

    Words are runs of characters that are not ASCII white space, A-Z lower-cased; shingles are ``width``
    words joined by single spaces, repeats included, or all words where there are fewer. A bit is 1 if
    more than half of the shingles' XXH64 (seed 42) have it. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Rows link at ``most`` or fewer differing bits;
    component_id is the smallest id reachable. Rows that repeat an id are rows of their own; null ids take
    part but are never smallest, so component_id is null only where all ids of a group are. An empty table
    gives no rows. Other columns are not read."""
    rows = fingerprints(docs, id_col, text_col, width)
    least = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = near_links(least.select("fp"), most, size)
    groups = connected_components(links, "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialize(least.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written first, so that the join below is a plain one whose skewed groups can be split
    named = materialize(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ship(__name__)
