"""Best-fit packing of token sequences.

Texts are tokenised in batches inside the tasks; only piece lengths and checksums
leave them. Pieces are dealt at random into groups of about GROUP rows. In a group they
arrive longest first and are packed online by best fit into at most OPEN_BINS open bins: a bitset
whose bit f says that some open bin has exactly f free tokens, and the lowest set bit at
or above the piece's length as the best fit. Where no bin fits and all are open, the fullest
closes first. The bound lets about one bin in a hundred close early (see the README)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import materialize, ship, text_or_empty

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 900
#: Pieces packed together; each group wastes less than one sequence.
GROUP = 4096
#: Distinct text pieces whose ids a worker keeps before it starts afresh.
CACHE = 1 << 20
#: Text pieces handed to the library at once.
ENCODE = 10_000
#: Pieces that are joined to one text for the library, which costs less than a call result for each.
JOIN = 1000


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
LEAD = np.zeros(256, bool)  # lead bytes of non-ASCII white space, among others
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def maybe_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place may be white space."""
    before = data[at - 1]
    return SPACE[before] | (before >= 0x80) & ((data[np.maximum(at - 2, 0)] == 0xC2) | LEAD[data[np.maximum(at - 3, 0)]])


class BatchTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once.

    A byte-level BPE of this kind splits before a single space or line break between
    two characters that are not white space, after such a line break, and between a
    letter (ASCII or Latin-1) and an ASCII punctuation mark. Texts are cut there and the
    ids of the pieces are joined. Marks that occur in added tokens do not cut.

    For the same reason new pieces that begin with a single space are encoded as one text;
    its ids are dealt to them by the bytes that each id stands for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab, added = self.tok.get_vocab(with_added_tokens=True), self.tok.get_added_tokens_decoder()
        self.width = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)  # bytes of each id
        self.width[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))
        self.marks = np.zeros(256, bool)
        self.marks[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
        for i, token in added.items():
            content = token.content.encode()
            self.width[i] = len(content)
            # a mark at the front follows nothing inside the token
            self.marks[list(content[1:])] = False
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places where pieces begin. A neighbour that may belong to a white-space
        character (also a non-ASCII one) prevents a cut."""
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begin = edge.copy()
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[~edge[at] & ~edge[at + 1]]
        at = at[~(SPACE[data[at + 1]] | LEAD[data[at + 1]] | maybe_space_before(data, at))]
        begin[at] = True
        begin[at[data[at] == 0x0A] + 1] = True
        at = np.flatnonzero(self.marks[data])
        at = at[~edge[at]]
        before = data[at - 1]
        letter = ((before | np.uint8(0x20)) >= 0x61) & ((before | np.uint8(0x20)) <= 0x7A)
        # U+00C0 to U+00FF are letters but for the signs of multiplication and division
        letter |= ((before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & ~edge[at - 1]
                   & (data[np.maximum(at - 2, 0)] == 0xC3))
        begin[at[letter]] = True
        return np.flatnonzero(begin[:-1])

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of every piece, where they begin among all ids, and these."""
        size, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        parts, total = [], 0
        second = data[np.minimum(start + 1, len(data) - 1)]
        joins = (data[start] == 0x20) & (end - start > 1) & ~SPACE[second] & ~LEAD[second] & ~maybe_space_before(data, end)
        joined, single = np.flatnonzero(joins), [np.flatnonzero(~joins)]
        for k in range(0, len(joined), JOIN):
            rows = joined[k:k + JOIN]
            length = end[rows] - start[rows]
            stop = np.cumsum(length)
            raw = data[np.repeat(start[rows] - (stop - length), length) + np.arange(stop[-1])].tobytes()
            try:
                ids = np.array(self.tok.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.uint32)
            except UnicodeDecodeError:
                single.append(rows)
                continue
            reach = np.cumsum(self.width[ids])
            last = np.searchsorted(reach, stop)  # the id that ends a piece
            if last[-1] >= len(reach) or (reach[last] != stop).any():
                single.append(rows)
                continue
            size[rows] = np.diff(last, prepend=-1)
            at[rows] = total + last + 1 - size[rows]
            parts.append(ids)
            total += len(ids)
        single = np.concatenate(single)
        for k in range(0, len(single), ENCODE):  # the library's results are large objects
            rows = single[k:k + ENCODE]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rows], end[rows])]
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            size[rows] = np.fromiter(map(len, got), np.int64, len(got))
            at[rows] = total + np.cumsum(size[rows]) - size[rows]
            parts.append(np.fromiter((x for g in got for x in g), np.uint32, int(size[rows].sum())))
            total += len(parts[-1])
        return size, at, np.concatenate(parts)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin."""
        start = self.starts(data, off)
        end = np.append(start[1:], len(data))
        key = kernels.mix(kernels.span_hash(kernels.prefix(data), start, end) + (end - start).astype(np.uint64))
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHE:
            self.clear()
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == uniq[inside]
        if not known.all():
            fresh, where = first[~known], place[~known]
            size, at, ids = self.encode(data, start[fresh], end[fresh])
            self.at = np.insert(self.at, where, len(self.ids) + at)
            self.len = np.insert(self.len, where, size)
            self.ids = np.concatenate([self.ids, ids])
            self.keys = np.insert(self.keys, where, uniq[~known])
            place = np.searchsorted(self.keys, uniq)
        size, at = self.len[place][inverse], self.at[place][inverse]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - (stop - size), size) + np.arange(int(size.sum()))] if len(size) else self.ids[:0]
        begun = np.concatenate([[0], stop])
        return ids, begun[np.searchsorted(start, off)]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by ``end_id``."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = BatchTokenizer(tokenizer_path)
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            names = batch.column("doc_id")
            for at, part, o in kernels.blocks(data, off, 2 << 20):
                ids, begun = encode(part, o)
                doc, piece, first, length, crc = [], [], [], [], []
                for d in range(len(o) - 1):
                    own = np.append(ids[begun[d]:begun[d + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    a, k = 0, 0
                    b = n % capacity or capacity
                    while a < n:
                        doc.append(at + d), piece.append(k), first.append(a), length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        a, b, k = b, b + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(kernels.tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open bins, found by their free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_no = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_no

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_no = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_no)
            self.bits |= 1 << left
            self.open += 1
        return bin_no, self.capacity - free


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and then ``end_id`` stay together unless longer than
    ``capacity``; then they are cut, the first piece taking the remainder. Null or
    empty text is the one id ``end_id``. Null and repeated ids are kept as given:
    every input row is packed on its own. Pieces of equal length go in row order.
    Other columns are not read. An empty table gives no rows.

    Full pieces are sequences by themselves and are not shuffled. Others are packed
    in random groups, longest first, which leaves each group under one sequence
    above the least possible in practice."""
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
                         .withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    parts = min(groups, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task packs several groups
    schema = pieces.drop("row")
    kind = schema.schema["doc_id"].dataType.simpleString()

    def run(frames):
        now, bins = None, None
        for f in frames:
            seq, offset = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for i, (g, n) in enumerate(zip(f["grp"].tolist(), f["length"].tolist())):
                if g != now:
                    now, bins = g, OpenBins(capacity, open_bins)
                b, offset[i] = bins.put(n)
                seq[i] = (g << 32) + b
            f["sequence_id"], f["offset"] = seq, offset
            yield f.drop(columns=["grp", "row"])

    packed = (rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
              .repartition(parts, "grp").sortWithinPartitions("grp", F.desc("length"), "row")
              .mapInPandas(kernels.tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                "sequence_id long, offset long"))
    whole = (pieces.where(F.col("length") == capacity)
             .select(*schema.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return packed.unionByName(whole).withColumnRenamed("doc_id", id_col)


ship(__name__)
