"""Jaccard join of word n-gram sets, and the groups its links form.

1. Equal sets are one node from the start (a fingerprint of the set).
2. Candidate clusters. For high thresholds the hash range is cut into more parts than two
   similar sets can differ in, so similar sets agree wholly in some part. For lower ones,
   where parts are small, a sketch of fixed size orders shingles by rarity, and similar sets
   share one of their rarest, as many as may be missing from the other and one more.
   Nodes of a size class that share such a signature are linked to the least of them, first
   within each task's batch, then across tasks; the connected clusters of these links hold
   all similar pairs.
3. Within a cluster, T-occurrence search by DivideSkip: of a set's inverted lists the
   longest few are set aside, the short ones are merged, sets that occur often
   enough are probed by binary search in the long lists, and those that reach the
   required overlap are linked. Pairs already connected are not counted again.
4. Clusters too large for a task are searched by classes of sizes that may be similar,
   large classes in blocks of which every pair is searched; the links are joined by
   connected components."""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnscore.llm import kernels
from turnscore.llm.common import connected_components, hash_bitmap, materialize, release, renamed, ship, split_likely, text_or_empty

#: Shingles of a cluster that are searched in one task; larger clusters are cut into blocks.
CLUSTER_SHINGLES = 1 << 22
#: Signatures that a task packs at once.
SIGNATURES = 1 << 18
#: Bits of the bitmap that spares most sets the second scan's shuffle; its size does not depend on the data.
BITS = 1 << 23
#: Counters of the sketch that orders shingles by rarity, whatever the data, and those of a row of it. Four bits of each
#: are broadcast. Where many shingles share a counter, rarity blurs, common ones become signatures and clusters grow.
SLOTS, ROW = 1 << 27, 1 << 16
#: Shingles whose counters a task holds at once.
COUNTED = 1 << 22
#: A part of a set has about num / (den - num) shingles; where that is fewer than this, parts are shared by chance
#: too often, and sets are told by their rarest shingles instead.
PART_SHINGLES = 6
#: A signature's upper half (its bucket tells of the lower one; what meets by chance is told apart in the search) and its node.
PAIR = np.dtype([("sig", "<u4"), ("node", "<u8")])
#: DivideSkip's weight between merging and probing.
MU = 0.01


class Sizes:
    """Classes of set sizes, so that similar sets have a class in common."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]

    def number(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 5 // 4))
        return int(np.searchsorted(self.tops, n))

    def of(self, n: int) -> range:
        """The classes of all sets that one of ``n`` may be similar to and that are not larger."""
        return range(self.number(max(1, -(-n * self.num // self.den))), self.number(n) + 1)

    def parts(self, n: int):
        """(class, parts, spare parts) that a set of ``n`` is cut into for each of its classes."""
        for c in self.of(n):
            differ = self.tops[c] * (self.den - self.num) // self.num
            if differ:  # else only equal sets are similar
                spare = 1 + differ // 16
                yield c, differ + 1 + spare, spare


def set_hash(s: np.ndarray) -> np.ndarray:
    return kernels.mix(s * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))


def fingerprint(s: np.ndarray) -> int:
    return int(kernels.mix(np.array([set_hash(s).sum(dtype=np.uint64) + np.uint64(len(s) * BIG % 2**64)]))[0])


BIG = 0xA0761D6478BD642F


#: Least counts of the steps of rarity but the first.
STEPS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 17, 23, 32, 48, 96])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Sketch counts on a scale of 16 steps, two to a byte (the lower half first)."""
    step = np.searchsorted(STEPS, counts, "right").astype(np.uint8)
    return step[0::2] | step[1::2] << np.uint8(4)


def packed_slots(at: np.ndarray, counts: np.ndarray) -> bytes:
    """A row of the sketch by its places with counts (up to 255): three bytes each, or else all of the row's counts."""
    if 3 * len(at) < ROW:
        return at.astype("<u2").tobytes() + counts.astype(np.uint8).tobytes()
    row = np.zeros(ROW, np.uint8)
    row[at] = counts
    return row.tobytes()


def packed_counts(row: np.ndarray) -> bytes:
    """``packed_slots`` of a whole row."""
    at = np.flatnonzero(row)
    return packed_slots(at, row[at])


def packed_rows_of(slots: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Numbers and ``packed_slots`` of the sketch's rows that ``slots`` (uint32, with repetitions) fall into."""
    slot, c = np.unique(np.concatenate(slots), return_counts=True)
    at, c = (slot % ROW).astype(np.int64), np.minimum(c, 255)
    row = slot // ROW
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    return row[begin].tolist(), [packed_slots(at[i:j], c[i:j]) for i, j in zip(begin, np.append(begin[1:], len(row)))]


def counts_of(packed: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """(places, counts) of ``packed_counts``."""
    if len(packed) == ROW:
        return slice(None), np.frombuffer(packed, np.uint8)
    n = len(packed) // 3
    return np.frombuffer(packed, "<u2", n).astype(np.int64), np.frombuffer(packed, np.uint8, n, 2 * n)


def part_signatures(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Signatures of the parts of a sorted set. The hash range is cut into more parts than two similar sets can
    differ in, so they agree wholly in some part. Empty parts have a signature only where the
    set has more of them than the spare parts can make up for."""
    out = []
    total = np.append(np.uint64(0), np.cumsum(set_hash(s)))
    top = s >> np.uint64(32)
    for c, m, spare in sizes.parts(len(s)) if len(s) else ():
        edge = np.searchsorted(top * np.uint64(m) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        sums = total[edge[1:]] - total[edge[:-1]]
        code = np.arange(m, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(c * 0x8EBC6AF09C88C6E3 % 2**64)
        full = edge[1:] > edge[:-1]
        if m - np.count_nonzero(full) > spare:
            full[:] = True
        out.append(kernels.mix(sums + code)[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rare_signatures(s: np.ndarray, sizes: Sizes, rare: np.ndarray, halves: bool = False) -> np.ndarray:
    """Signatures of a set: its shingles but for the most frequent ones, of which similar sets share one at
    least, each once per size class. ``rare`` orders shingles, with ``halves`` two steps to a byte; any order is right
    if all sets use it."""
    n = len(s)
    if not n:
        return s
    slot = (s % np.uint64(len(rare) * (1 + halves))).astype(np.int64)
    step = rare[slot >> 1] >> (slot & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15) if halves else rare[slot]
    key = (step.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    k = n - -(-n * sizes.num // sizes.den)  # at most so many shingles of the set are not in a similar one
    chosen = s[key <= np.partition(key, k)[k]]
    return np.concatenate([kernels.mix(chosen + np.uint64(c * 0x8EBC6AF09C88C6E3 % 2**64)) for c in sizes.of(n)])


def star(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct signature its least node, and distinct links (node, least) of the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    least = node[first][np.cumsum(first) - 1]
    other = node != least
    links = np.unique(np.stack([node[other], least[other]], 1), axis=0) if other.any() else np.zeros((0, 2), node.dtype)
    return sig[first], node[first], links[:, 0], links[:, 1]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def divide_skip(lists: list[np.ndarray], need: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and counts of those that occur in at least ``need`` of the sorted lists."""
    lists = sorted(lists, key=len, reverse=True)
    longest = len(lists[0])
    aside = min(need - 1, int(need / (MU * log2(longest + 1) + 1)), sum(len(x) > 8 for x in lists))
    short = np.concatenate(lists[aside:])
    if len(short) > n // 4:
        count = np.bincount(short, minlength=n)
        member = np.flatnonzero(count >= need - aside)
        count = count[member]
    else:
        short.sort(kind="stable")  # merges the sorted runs
        edge = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        count = np.diff(np.append(edge, len(short)))
        keep = count >= need - aside
        member, count = short[edge[keep]], count[keep]
    for k in range(aside - 1, -1, -1):  # shorter ones first
        if not len(member):
            break
        x = lists[k]
        at = np.searchsorted(x, member)
        at[at == len(x)] = 0
        count = count + (x[at] == member)
        keep = count + k >= need
        member, count = member[keep], count[keep]
    return member, count


def similar_links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets similar by num / den; with ``side``, of the two sides."""
    size = np.array([len(s) for s in sets])
    rank = np.argsort(size, kind="stable")
    sets, size = [sets[i] for i in rank], size[rank]
    other = side[rank] if side is not None else None
    # inverted lists in 32 bits a posting: the sets' numbers by token, and each token's number in place
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.append(True, flat[1:] != flat[:-1])
    del flat
    edge = np.append(np.flatnonzero(first), len(first))
    token = np.empty(len(first), np.int32)
    token[order] = np.cumsum(first, dtype=np.int32) - 1
    owner = owner[order]
    del order, first
    begin = np.append(0, np.cumsum(size))
    forest, label, links = Forest(len(sets)), np.arange(len(sets)), []
    for q in range(len(sets) - 1, 0, -1):  # against all sets of at most its size
        n = int(size[q])
        need = -(-n * num // den)
        lo = int(np.searchsorted(size, need))
        open_ = label[lo:q] != label[q]
        if other is not None:
            open_ &= other[lo:q] != other[q]
        if not open_.any():
            continue
        lists = []
        for t in token[begin[q]:begin[q + 1]].tolist():
            x = owner[edge[t]:edge[t + 1]]
            lists.append(x if lo == 0 and x[-1] == q else x[np.searchsorted(x, lo):np.searchsorted(x, q)])
        lists = [x[:-1] if len(x) and x[-1] == q else x for x in lists]
        lists = [x for x in lists if len(x)]
        if len(lists) < need:
            continue
        member, count = divide_skip(lists, need, len(sets))
        good = count * den >= num * (n + size[member] - count)
        for x in member[good].tolist():
            if (other is None or other[x] != other[q]) and forest.join(q, x):
                links.append((int(rank[q]), int(rank[x])))
                a, b = label[q], label[x]
                label[label == max(a, b)] = min(a, b)
    return links


def grouped_rows(own: DataFrame, width: int, num: int, den: int, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """(id, th, n, root) of every row of ``own`` (id, text, th): n shingles, and a root that is the same for
    linked sets; it is null for an empty set."""
    spark = own.sparkSession
    kind = own.schema["id"].dataType.simpleString()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n_parts
    by_parts = num >= (den - num) * PART_SHINGLES

    def measure(batches):
        """A row per document, and a task's part of the sketch in rows of ROW counters (up to 255)."""
        slots, held, sizes = [], 0, Sizes(num, den)

        def sketch_rows():
            at, packed = packed_rows_of(slots)
            none = [pa.nulls(len(at), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array(packed, pa.binary())],
                                              ["id", "th", "fp", "n", "classes", "block", "packed"])
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            fp, size, classes = [], [], []
            for _, part, o in kernels.blocks(data, off):
                sets = kernels.shingle_sets(part, o, kernels.NONSPACE, width)
                fp += [fingerprint(x) for x in sets]
                size += [len(x) for x in sets]
                classes += [list(sizes.of(len(x))) for x in sets]
                if by_parts:
                    continue
                slots.append((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.uint32))
                held += len(slots[-1])
                if held >= COUNTED:
                    yield sketch_rows()
                    slots, held = [], 0
            n = len(fp)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()),
                 pa.array(classes, pa.list_(pa.int32())), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary())],
                ["id", "th", "fp", "n", "classes", "block", "packed"])
        if slots:
            yield sketch_rows()

    def total(batches):
        seen = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("packed")):
                slot, c = counts_of(x.as_py())
                seen.setdefault(k, np.zeros(ROW, np.uint32))[slot] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([rarity(x).tobytes() for x in seen.values()], pa.binary())],
                                         ["block", "packed"])

    id_type = to_arrow_type(own.schema["id"].dataType)
    measured = materialize(own.mapInArrow(kernels.tidy(measure), f"id {kind}, th long, fp long, n long, classes array<int>, block int, packed binary"), "set-sizes")
    rows = measured.where("block = -1").select("id", "th", "fp", "n")
    rare = np.zeros((0 if by_parts else SLOTS // ROW, ROW // 2), np.uint8)
    for r in (measured.where("block >= 0").select("block", "packed").repartition(min(n_parts, 256), "block")
              .mapInArrow(kernels.tidy(total), "block int, packed binary").toLocalIterator()):
        rare[r.block] = np.frombuffer(bytes(r.packed), np.uint8)
    shared_order = spark.sparkContext.broadcast(rare.ravel())
    del rare

    def sign(batches):
        """Rows with the links found here, and one per bucket of signatures."""
        sizes, order = Sizes(num, den), shared_order.value
        sig, node, held, at = [], [], 0, 0
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            for _, part, o in kernels.blocks(data, off):
                for s in kernels.shingle_sets(part, o, kernels.NONSPACE, width):
                    x = part_signatures(s, sizes) if by_parts else rare_signatures(s, sizes, order, halves=True)
                    sig.append(x), node.append(np.full(len(x), fingerprint(s), np.uint64))
                    held += len(x)
                if held >= SIGNATURES:
                    at += 1
                    yield packed_rows(sig, node, at)
                    sig, node, held = [], [], 0
        if held:
            yield packed_rows(sig, node, at + 1)

    def packed_rows(sig, node, at):
        sig, node, a, b = star(np.concatenate(sig), np.concatenate(node))
        to = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        pairs, to = np.empty(len(sig), PAIR), to[order]
        pairs["sig"], pairs["node"] = (sig >> np.uint64(32))[order], node[order]
        begin = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(to))
        bucket = [*to[begin].tolist(), (int(sig[0]) + at) % buckets if len(sig) else 0]
        packed = [*[pairs[i:j].tobytes() for i, j in zip(begin, stop)], np.stack([a, b], 1).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([False] * len(begin) + [True]), pa.array(packed, pa.binary())],
                                          ["bucket", "linked", "packed"])

    def pairs_out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    def across(batches):
        now, held = None, []

        def flush():
            if len(held) > 1:
                p = np.concatenate([np.frombuffer(x, PAIR) for x in held])
                _, _, a, b = star(p["sig"], p["node"].copy())
                yield pairs_out(a.copy(), b.copy())

        for batch in batches:
            for k, done, x in zip(batch.column("bucket").to_pylist(), batch.column("linked").to_pylist(), batch.column("packed")):
                if done:
                    p = np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2)
                    yield pairs_out(p[:, 0].copy(), p[:, 1].copy())
                    continue
                if k != now:
                    yield from flush()
                    now, held = k, []
                held.append(x.as_py())
        yield from flush()

    edges = (own.select("text").mapInArrow(kernels.tidy(sign), "bucket int, linked boolean, packed binary").repartition(n_parts, "bucket")
             .sortWithinPartitions("bucket").mapInArrow(kernels.tidy(across), "u long, v long"))
    clusters = materialize(connected_components(edges, "u", "v"), "clusters")
    shared_order.unpersist()

    shared_bits = spark.sparkContext.broadcast(hash_bitmap(clusters, "node", BITS))

    def clustered_sets(batches):
        one = shared_bits.value
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            fp, packed, seen = [], [], set()
            for _, part, o in kernels.blocks(data, off):
                for s in kernels.shingle_sets(part, o, kernels.NONSPACE, width):
                    f = fingerprint(s)
                    if len(s) and one[f % BITS >> 3] >> (f % 8) & 1 and f not in seen:
                        seen.add(f), fp.append(f), packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(packed, pa.binary())],
                                             ["node", "packed"])

    # a large cluster is searched by size class, a large class of it in blocks that meet each other, themselves included
    nodes = measured.where("n > 0").groupBy(F.col("fp").alias("node")).agg(F.max("n").alias("n"), F.first("classes").alias("classes"))
    nodes = materialize(clusters.join(nodes, "node"), "nodes")
    large = nodes.groupBy("component").agg((F.sum("n") > cluster_shingles).alias("large"))
    nodes = nodes.join(large, "component").select("node", "component", "n", F.explode(
        F.when(F.col("large"), F.col("classes")).otherwise(F.array(F.lit(-1)))).alias("class"))
    nodes = materialize(nodes, "classes")
    blocks = nodes.groupBy("component", "class").agg(F.ceil(F.sum("n") / cluster_shingles).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    places = nodes.join(blocks, ["component", "class"]).select("node", "component", "class", mine.alias("mine"), "blocks")
    # placed and written first, so that the join below is a plain one
    places = materialize(places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "component", "class", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).alias("second")), "places")
    tasks = own.select("text").mapInArrow(kernels.tidy(clustered_sets), "node long, packed binary").join(places, "node")

    def search(batches):
        now, nodes, held, second = None, [], [], []

        def flush():
            if len(held) > 1:
                side = np.array(second) if now[1] != now[2] else None
                found = similar_links([np.frombuffer(x, np.uint64) for x in held], num, den, side)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()),
                                                  pa.array([nodes[b] for _, b in found], pa.int64())], ["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("component", "class", "i", "j", "node", "second")]
            for c, k, i, j, node, sec, x in zip(*cols, batch.column("packed")):
                if (c, i, j, k) != now:
                    yield from flush()
                    now, nodes, held, second = (c, i, j, k), [], [], []
                if not nodes or nodes[-1] != node:  # equal sets come from several batches
                    nodes.append(node), held.append(x.as_py()), second.append(sec)
        yield from flush()

    links = materialize(tasks.repartition(n_parts, "component", "class", "i", "j").sortWithinPartitions("component", "class", "i", "j", "node")
                        .mapInArrow(kernels.tidy(search), "u long, v long"), "links")
    groups = connected_components(links, "u", "v").select(F.col("node").alias("fp"), F.col("component").alias("root"))

    return materialize(rows.join(groups, "fp", "left").select(
        "id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "fp")).alias("root")), "grouped")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90,
                   den: int = 100, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are runs of characters that are not ASCII white space, A-Z lower-cased; a
    set holds the distinct shingles of ``width`` words, or the whole sequence where
    there are fewer words. Rows link when den * intersection >= num * union;
    component_id is the smallest id reachable by links. Null or blank text has an
    empty set and links with nothing. Rows that repeat an id are rows of their own;
    null ids take part but are never smallest, so component_id is null only where all
    ids of a group are. An empty table gives no rows. Other columns are not read."""
    grouped = grouped_rows(_own(docs, id_col, text_col), width, num, den, cluster_shingles)
    # written first, so that the join below is a plain one whose skewed groups can be split
    least = materialize(grouped.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    linked = grouped.where("n > 0").join(least, "root").select("id", "n", "component_id")
    return linked.unionByName(grouped.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80,
                           den: int = 100) -> DataFrame:
    """``docs``, all columns, with one row of each group of ``similar_groups``: the least by id (null ids
    last) and text hash; of rows that repeat both, any one. Rows with an empty set all stay. Columns may have any name."""
    columns = docs.columns
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    grouped = grouped_rows(_own(docs, id_col, text_col), width, num, den).where("n > 0")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    best = materialize(grouped.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1"), "best")
    lost = materialize(grouped.join(best, "root").where(order > F.col("best")).select(
        F.col("id").alias("_nj_id"), F.col("th").alias("_nj_th")).distinct(), "lost")
    twice = materialize(grouped.join(best, "root").where(order == F.col("best")).groupBy("id", "th").count().where("count > 1")
                        .select(F.col("id").alias("_nj_id"), F.col("th").alias("_nj_th")), "twice")
    same = (F.xxhash64(text_or_empty(text_col)) == F.col("_nj_th")) & F.col(id_col).eqNullSafe(F.col("_nj_id"))
    some, rest = split_likely(docs, F.xxhash64(text_or_empty(text_col)), lost.unionByName(twice), "_nj_th")
    some = some.join(lost, same, "left_anti")
    return rest.unionByName(some.join(twice, same, "left_anti")).unionByName(
        some.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])).toDF(*columns)


ship(__name__)
