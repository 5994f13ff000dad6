"""Numpy helpers on Arrow text columns: byte buffers, hashes of all substrings, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP = 1 << 20
_P = 0x100000001B3
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, STEP + 64)
        for key, base in (("p", _P), ("q", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


class Substrings:
    """Hashes of any substrings of an array of bytes, or of code points, from one pass of prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        p, self.q = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        random = BYTES[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        np.cumsum(random * p[: len(data)], out=self.sums[1:])

    def each(self, n: int) -> np.ndarray:
        """Of all windows of ``n`` bytes, by start."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.q[: len(self.sums) - n]) if len(self.sums) > n else np.zeros(0, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(np.uint64) * BYTES[1])


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n+1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, where, data = col.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(batch: pa.RecordBatch, col: str, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``size`` bytes of text each, at least a row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def segments(texts: list[str | None], size: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All texts in order, a bounded number of characters at a time: (code points, the place in the list of the text of each).

    White space, whatever its kind and number, is one break, 32, and so are both ends of a text. A text longer than
    ``size`` is cut at white space, or at any place where there is none for as long; nothing is left out.
    """
    held: list[tuple[int, str]] = []
    n = 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text) or not at:
            end = len(text)
            if end - at > size:
                end = at + size
                back = max(text.rfind(" ", at + size // 2, end), text.rfind("\n", at + size // 2, end))
                end = back + 1 if back > 0 else end
            if held and n + end - at > size:
                yield _codes(held)
                held, n = [], 0
            held.append((i, text[at:end]))
            n += end - at
            at = end or 1
    if held:
        yield _codes(held)


def _codes(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(f"\n{t}\n" for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.array([i for i, _ in held]), [len(t) + 2 for _, t in held])
    blank = (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | (codes == 0x3000) | (codes >= 0x2000) & (codes <= 0x200A)
    # Of blanks in a row of one text the first stays.
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1] | (row[1:] != row[:-1])
    return np.where(blank, 32, codes)[keep].astype(np.uint32), row[keep]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that stay within a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


#: ASCII capitals become small; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, ASCII letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
