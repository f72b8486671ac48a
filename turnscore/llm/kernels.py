"""Array kernels over batches of UTF-8 text, used inside tasks.

They work on the buffers of an Arrow string array: one byte array and the
offsets of its texts. Word hashes are differences of prefix sums, so no Python
code runs per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from turnscore.llm.common import ship

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; bounds the memory of a kernel call.
BLOCK_BYTES = 1 << 20

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True
NONSPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False


def tidy(run):
    """The same function over batches, after whose end the worker returns its free memory to the system."""
    def tidied(batches):
        yield from run(batches)
        trim()
    return tidied


def trim() -> None:
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda n: None)(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK_BYTES):
    """(first text, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(n + (n >> 2) + 2, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(pre))
    return (pre[end] - pre[start]) * down[start]


def word_spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    m = kind[data]
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(m))]
    before[cut] = False
    after[cut - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word of lower-cased bytes."""
    start, end, doc = word_spans(data, off, kind)
    return mix(span_hash(prefix(data), start, end)), doc


def shingle_sets(data: np.ndarray, off: np.ndarray, kind: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text: ``width`` words each, or
    all words as one shingle where there are fewer; none without words."""
    h, doc = word_hashes(lower(data), off, kind)
    n = len(off) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for t in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[t:t + len(acc)]
    acc = mix(acc)
    out = []
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            out.append(np.unique(acc[a:b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for t in h[a:b]:
                x = x * np.uint64(0xA0761D6478BD642F) + t
            out.append(mix(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


ship(__name__)
