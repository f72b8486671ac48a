"""Search for short licence notices, exactly and with few edits.

A notice of n characters with at most k edits contains one of k + 1 pieces of it
unchanged (pigeonhole), so the pieces are searched for exactly, all in one pass. Only the
surroundings of a hit, each on its own, are matched by the regex library with a bound on
errors, which verifies edits and gives spans."""

from __future__ import annotations

import bisect
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import ship, text_or_empty

#: Phrases whose words are looked for as they are, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that may stand with edits, and their labels.
NOTICES = {
    "general public license": "gpl",
    "lesser general public license": "lgpl",
    "all rights reserved": "reserved",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
}


def edits_allowed(notice: str) -> int:
    return len(notice) // 10


def pieces(notice: str) -> list[tuple[str, int]]:
    """(piece, place) for the pigeonhole split of a notice."""
    parts = edits_allowed(notice) + 1
    edge = [len(notice) * i // parts for i in range(parts + 1)]
    return [(notice[a:b], a) for a, b in zip(edge, edge[1:])]


def pattern(notice: str, edits: int):
    """The notice with at most so many characters inserted, deleted or replaced."""
    import regex
    return regex.compile("(?:%s){e<=%d}" % (regex.escape(notice, special_only=True, literal_spaces=True), edits))


def best_match(notice: str, part: str) -> tuple[int, int, int] | None:
    """(edits, end, start) of the part's match with fewest edits, of these the first to end, then the shortest."""
    at = part.find(notice)
    if at >= 0:
        return 0, at + len(notice), at
    most = edits_allowed(notice)
    if not pattern(notice, most).search(part):
        return None
    edits = next(e for e in range(1, most + 1) if pattern(notice, e).search(part))
    near = pattern(notice, edits)
    # what has a match in it has one in all that holds it, so its borders are found by halving
    ends = range(len(notice) - edits, len(part) + 1)
    end = ends[bisect.bisect_left(ends, True, key=lambda y: near.search(part, 0, y) is not None)]
    starts = range(end, -1, -1)
    start = starts[bisect.bisect_left(starts, True, key=lambda x: near.search(part, x, end) is not None)]
    return edits, end, start


class Finder:
    def __init__(self, notices: dict[str, str]):
        import ahocorasick
        self.best = lru_cache(1 << 14)(best_match)
        seeds: dict[str, list[tuple[str, int]]] = {}
        for n in notices:
            for piece, at in pieces(n):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, end, edits) of matches in words joined by spaces. Of overlapping ones of a notice
        that with fewest edits stays, of these the first to end, then the shortest."""
        around: dict[str, set[tuple[int, int]]] = {}
        for last, (size, of) in self.seeds.iter(text):
            for n, at in of:
                k = edits_allowed(n)
                begin = last - size + 1 - at
                around.setdefault(n, set()).add((max(0, begin - k), min(len(text), begin + len(n) + k)))
        out = [(n, x, y, e) for n, parts in around.items() for x, y, e in self.apart(n, text, parts)]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def apart(self, notice: str, text: str, parts: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice's matches in the parts, best first and none over another."""
        heap: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            m = self.best(notice, text[a:b]) if b - a >= len(notice) - edits_allowed(notice) else None
            if m:
                heapq.heappush(heap, (m[0], a + m[1], -a - m[2], a, b))

        for a, b in parts:
            search(a, b)
        taken: list[tuple[int, int, int]] = []
        while heap:
            e, end, start, a, b = heapq.heappop(heap)
            i = bisect.bisect_right(taken, a, key=lambda t: t[1])  # those before end at or before the part's start
            j = bisect.bisect_left(taken, b, key=lambda t: t[0])
            if all(y <= -start or end <= x for x, y, _ in taken[i:j]):
                bisect.insort(taken, (-start, end, e))
                i, j = bisect.bisect_right(taken, a, key=lambda t: t[1]), bisect.bisect_left(taken, b, key=lambda t: t[0])
            edges = [a, *(p for x, y, _ in taken[i:j] for p in (x, y)), b]
            for x, y in zip(edges[::2], edges[1::2]):  # what is free of the part
                search(x, y)
        return taken


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
                  notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Base
    counts places where a phrase's words stand one after the other, whatever separates
    them; first_word and last_word are the least and greatest of their first words
    (from 0), null without any. ``labels`` adds those of notices matched with at most
    one edit in ten characters; ``spans`` lists label, first word, last word and edits of
    these matches, also of all that stand back to back; of overlapping ones of a notice
    that with fewest edits. ``score`` is 1 for an exact place, else one less the share of edited
    characters of the best match, and 0 without a match. Null and empty texts have no
    words. Repeated rows and null ids are kept as given. An empty table gives no rows.
    Other columns are not read, whatever their names."""
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def base_places(words: bytes) -> list[tuple[int, str]]:
        out, blanks = [], None
        for phrase, label in phrases.items():
            need = b" " + phrase.encode() + b" "
            at = words.find(need)
            while at >= 0:
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
                out.append((int(np.searchsorted(blanks, at)), label))
                at = words.find(need, at + 1)
        return out

    def word_of(text: str, places: list[int]) -> list[int]:
        """The word (from 0) at each place of words joined by spaces."""
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
        return np.searchsorted(blanks, places).tolist()

    def run(batches):
        find = Finder(notices)
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            out = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for _, part, o in kernels.blocks(data, off):
                low = kernels.lower(part)
                raw = np.where(kernels.ALNUM[low], low, np.uint8(0x20)).tobytes()
                for a, b in zip(o.tolist(), o[1:].tolist()):
                    words = raw[a:b].split()
                    joined = b" ".join(words)
                    text = joined.decode("utf-8", "replace")
                    base = base_places(b" " + joined + b" ")
                    near = find(text)
                    at = word_of(text, [p for _, x, y, _ in near for p in (x, max(x, y - 1))]) if near else []
                    spans = [{"label": notices[n], "first_word": at[2 * i], "last_word": at[2 * i + 1], "edits": e}
                             for i, (n, _, _, e) in enumerate(near)]
                    places, own = [p for p, _ in base], {label for _, label in base}
                    out["n_words"].append(len(words)), out["n_base"].append(len(base))
                    out["first_word"].append(min(places, default=None)), out["last_word"].append(max(places, default=None))
                    out["base_labels"].append(",".join(sorted(own)))
                    out["labels"].append(",".join(sorted(own | {s["label"] for s in spans})))
                    out["score"].append(1.0 if base else max((1 - e / len(n) for n, _, _, e in near), default=0.0))
                    out["spans"].append(spans)
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct(
                [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, types.get(n, pa.int64())) for n, v in out.items())],
                                             ["id", *out])

    return source.mapInArrow(kernels.tidy(run), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                  "labels string, score double, spans array<struct<label string, first_word long, "
                                  "last_word long, edits long>>").withColumnRenamed("id", id_col)


ship(__name__)
