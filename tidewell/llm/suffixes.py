"""Suffix order and common prefixes of one shard by external, recursive induced sorting.

The text is many strings, each closed by a 0, which stands for an end of its own: ends are ordered by place and
share nothing. Suffixes are sorted as in SA-IS. Those at local minima (LMS) come first: their stretches up to the next
one are sorted by induction and named by rank, and the string of names is sorted by the same method, over and over,
until all names differ, or the string of names is so short that its suffixes can be ranked within a part of the
memory limit. Then all larger-than-next (L) suffixes are induced from smaller to larger first letter, and
all smaller-than-next (S) ones from larger to smaller.

What induction puts forward goes through a priority queue: buckets of letters, first in first out, which are read in
order. An entry is a position and its common prefix with the one before of its letter; common prefixes of names become
those of letters on the way up. Text, types, names and all that a queue holds beyond the memory limit lie in files;
numpy works on a bounded number of entries at once. So a shard may be far larger than the limit.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Entries that are induced at once, and entries of a queue that wait to be dealt out.
STRETCH, WAITING = 1 << 16, 1 << 14
NONE = np.iinfo(np.int64).max
#: A string of names is ranked at once if so many bytes a name are within the memory limit.
BASE = 96
_NOTHING = np.zeros(0, np.int64)


class Space:
    """Memory up to a limit, and files of the task's own machine for the rest, which go when the sort ends or fails."""

    def __init__(self, limit: int):
        self.limit, self.spilled = limit, 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0
        self.holders: list[Holder] = []

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, kind: np.dtype | type) -> np.ndarray:
        """Zeros, in memory if they take a small part of the limit."""
        size = n * np.dtype(kind).itemsize
        if size <= self.limit // 32:
            return np.zeros(n, kind)
        self.spilled += size
        return np.asarray(np.memmap(self.path(), kind, "w+", shape=(n,)))

    def chunks(self, n: int) -> Iterator[slice]:
        for at in range(0, n, STRETCH):
            yield slice(at, min(n, at + STRETCH))

    def relieve(self) -> None:
        """Where all that is held is beyond the limit, those that hold the most write it to their files."""
        while sum(h.held for h in self.holders) > self.limit:
            max(self.holders, key=lambda h: h.held).to_file()

    def close(self) -> None:
        for h in self.holders:
            h.shut()
        if self.folder is not None:
            self.folder.cleanup()


class Holder:
    """Sequences of (position, common prefix), by number, in the order in which they came: stretches of arrays in memory, or of one file."""

    def __init__(self, space: Space, many: int):
        self.space, self.held, self.file = space, 0, None
        self.parts: list[list[tuple]] = [[] for _ in range(many)]
        space.holders.append(self)

    def put(self, b: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[b].append((at, lcp))
        self.held += 16 * len(at)

    def to_file(self) -> None:
        """All that is in memory, so that no part of an array stays; a sequence's stretches are joined."""
        if self.file is None:
            self.file = open(self.space.path(), "w+b")  # noqa: SIM115
        where = self.file.seek(0, os.SEEK_END)
        for parts in self.parts:
            k = next((i for i, p in enumerate(parts) if isinstance(p[0], np.ndarray)), len(parts))
            if k < len(parts):
                n = sum(len(p[0]) for p in parts[k:])
                for i in (0, 1):
                    for p in parts[k:]:
                        self.file.write(np.ascontiguousarray(p[i]).data)
                parts[k:] = [(where, n)]
                where += 16 * n
        self.space.spilled += self.held
        self.held = 0

    def _read(self, where: int, first: int, n: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in (0, 1):
            self.file.seek(where + 8 * (i * whole + first))
            out.append(np.frombuffer(self.file.read(8 * n), np.int64))
        return out[0], out[1]

    def take(self, b: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A sequence from its beginning, or its stretches from the end ``back``, a bounded number at once; it is gone then."""
        parts = self.parts[b]
        while parts:
            p = parts.pop(-1 if back else 0)
            if isinstance(p[0], np.ndarray):
                self.held -= 16 * len(p[0])
                pieces = [(p[0][s : s + STRETCH], p[1][s : s + STRETCH]) for s in range(0, len(p[0]), STRETCH)]
                yield from reversed(pieces) if back else pieces
            else:
                starts = range(0, p[1], STRETCH)
                for s in reversed(starts) if back else starts:
                    yield self._read(p[0], s, min(STRETCH, p[1] - s), p[1])

    def many(self, b: int) -> int:
        return sum(len(p[0]) if isinstance(p[0], np.ndarray) else p[1] for p in self.parts[b])

    def shut(self) -> None:
        if self.file is not None:
            self.file.close()
        self.held = 0

    def done(self) -> None:
        self.shut()
        self.space.holders.remove(self)


class Queue:
    """A priority queue of (key, position, common prefix), first in first out within a key. Keys that are put in are never below the bucket that is read.

    Keys are dealt into buckets of ``width``. What comes in is kept together for a while and dealt out in one go.
    """

    def __init__(self, space: Space, keys: int, width: int):
        self.space, self.width = space, width
        self.count = -(-keys // width)
        self.store = Holder(space, self.count)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        # The bucket that is read, and what has come for it since.
        self.at, self.now = -1, []

    def add(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        bucket = key // self.width
        own = bucket == self.at
        if own.any():
            self.now.append((at[own], lcp[own]))
            rest = ~own
            bucket, at, lcp = bucket[rest], at[rest], lcp[rest]
        if len(bucket):
            self.fresh.append((bucket, at, lcp))
            self.waiting += len(bucket)
            if self.waiting > WAITING:
                self.deal()

    def _gather(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate([f[i] for f in self.fresh]) for i in range(3)) if len(self.fresh) > 1 else self.fresh[0]
        self.fresh = [out]
        return out

    def deal(self) -> None:
        if not self.waiting:
            return
        bucket, at, lcp = self._gather()
        order = np.argsort(bucket, kind="stable")
        bucket, at, lcp = bucket[order], at[order], lcp[order]
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cut, cut[1:]):
            self.store.put(int(bucket[a]), at[a:b], lcp[a:b])
        self.fresh, self.waiting = [], 0
        self.space.relieve()

    def open(self, b: int) -> int:
        """Begin to read a bucket; what waits for it goes there. Tells how many entries it has."""
        if self.at != b:
            self.at = b
            if self.waiting:
                bucket, at, lcp = self._gather()
                own = bucket == b
                if own.any():
                    self.store.put(b, at[own], lcp[own])
                    self.fresh = [(bucket[~own], at[~own], lcp[~own])]
                    self.waiting -= int(own.sum())
        return self.store.many(b)

    def stretches(self, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries of a bucket, those too that come in meanwhile, some at a time; small ones are joined; they are gone then."""
        self.open(b)
        got, n = [], 0
        for part in self.store.take(b):
            got.append(part)
            n += len(part[0])
            if n >= STRETCH:
                yield _joined(got)
                got, n = [], 0
        if n:
            yield _joined(got)
        while self.now:
            at, lcp = _joined(self.now)
            self.now = []
            for s in range(0, len(at), STRETCH):
                yield at[s : s + STRETCH], lcp[s : s + STRETCH]

    def come(self) -> tuple[np.ndarray, np.ndarray]:
        """What has come for the open bucket since it was read."""
        got, self.now = self.now, []
        return _joined(got)

    def all_of(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A bucket of few entries at once."""
        self.open(b)
        return _joined([*self.store.take(b), *(self.come(),)]) if self.now else _joined(list(self.store.take(b)))


def _joined(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(got) < 2:
        return got[0] if got else (_NOTHING, _NOTHING)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[start:end]) for each pair, start < end."""
    length = end - start
    out = np.empty(len(start), values.dtype)
    level = np.frexp(length.astype(np.float64))[1] - 1
    now = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = level == k
        if own.any():
            a, b = start[own], end[own] - (1 << k)
            out[own] = np.minimum(now[a], now[b])
        if len(now) > (1 << k):
            now = np.minimum(now[: -(1 << k)], now[1 << k :])
    return out


class _Carry:
    """The common prefix of each entry with the one before of its key, from those of the sources they are induced by.

    Between two sources it is the least of all in between, and one letter more for what they induce. Batches of
    sources that were seen are kept as a staircase of their minima, so one look tells the least since any of them.
    """

    def __init__(self, space: Space, keys: int):
        self.stamp, self.since = space.array(keys, np.int64), space.array(keys, np.int64)
        self.batch = 0
        self.stairs, self.least, self.top = np.zeros(64, np.int64), np.zeros(64, np.int64), 0

    def shared(self, key: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """For entries sorted by key, induced by the sources at ``place`` of a batch with the common prefixes ``lcp``."""
        self.batch += 1
        out = np.zeros(len(key), np.int64)
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first, rest = np.flatnonzero(new), np.flatnonzero(~new)
            if len(rest):
                out[rest] = _range_min(lcp, place[rest - 1] + 1, place[rest] + 1) + 1
            names = key[first]
            until = np.minimum.accumulate(lcp)
            begun = self.stamp[names]
            step = np.searchsorted(self.stairs[: self.top], begun, "right")
            between = np.where(step < self.top, self.least[np.minimum(step, max(0, self.top - 1))], NONE)
            head = np.minimum(np.minimum(self.since[names], between), until[place[first]]) + 1
            out[first] = np.where(begun > 0, head, 0)
            last = place[np.append(first[1:], len(key)) - 1] + 1
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], NONE - 1)
            self.since[names], self.stamp[names] = after[last], self.batch
        if len(lcp):
            low = int(lcp.min())
            while self.top and self.least[self.top - 1] >= low:
                self.top -= 1
            if self.top == len(self.stairs):
                self.stairs, self.least = (np.r_[x, np.zeros_like(x)] for x in (self.stairs, self.least))
            self.stairs[self.top], self.least[self.top] = self.batch, low
            self.top += 1
        return out


class Sorter:
    """Sorted suffixes of ``text`` (numbers up to ``largest``, 0 closes a string, the last is 0)."""

    def __init__(self, text: np.ndarray, space: Space, largest: int, depth: int = 0):
        self.text, self.space, self.keys, self.depth = text, space, largest + 1, depth
        self.n = len(text)
        self.words: np.ndarray | None = None
        if text.dtype == np.uint8:
            padded = space.array(self.n + 8, np.uint8)
            for part in space.chunks(self.n):
                padded[part] = text[part]
            self.text, self.words = padded[: self.n], np.ndarray((self.n,), "<u8", padded, strides=(1,))
        # Buckets of about the root of all entries: then few entries induce others of their own bucket. But no more than
        # leave each, in what memory holds, some dozens of entries, or the lists of stretches would outgrow these.
        self.width = 1 if self.keys <= 257 else max(1, int(self.keys / min(np.sqrt(self.n), max(16, space.limit >> 10))))
        self._find_types()

    def _find_types(self) -> None:
        """``small``: which suffixes are S; ``lms``: where an S one follows an L one, and all ends; ``end``: the ends."""
        self.small = self.space.array(self.n, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        after, kind = 0, True
        for part in reversed(list(self.space.chunks(self.n))):
            x = np.r_[self.text[part], after]
            d = np.flatnonzero(x[1:] != x[:-1])
            types = np.repeat(np.r_[x[d] < x[d + 1], kind], np.diff(np.r_[-1, d, len(x) - 1]))[:-1]
            self.small[part] = types
            after, kind = x[0], bool(types[0])
        counts = np.zeros(2, np.int64)
        for fill in (False, True):
            if fill:
                self.lms, self.end = self.space.array(int(counts[0]), np.int64), self.space.array(int(counts[1]), np.int64)
                counts[:] = 0
            for part in self.space.chunks(self.n):
                text, small = self.text[part], self.small[part]
                before = np.r_[self.small[part.start - 1] if part.start else True, small[:-1]]
                for k, mask in enumerate(((text == 0) | (small & ~before), text == 0)):
                    at = np.flatnonzero(mask)
                    if fill:
                        (self.lms, self.end)[k][counts[k] : counts[k] + len(at)] = at + part.start
                    counts[k] += len(at)

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | int = 0, most: np.ndarray | int = NONE) -> np.ndarray:
        """Common prefixes of suffixes, of which ``known`` letters are equal; no more than ``most`` are counted."""
        limit = np.minimum(np.minimum(self._rest(a), self._rest(b)), most)
        out = np.zeros(len(a), np.int64) + known
        open_ = np.flatnonzero(out < limit)
        while len(open_):
            at = out[open_]
            if self.words is None:
                step, wide = (self.text[a[open_] + at] == self.text[b[open_] + at]).astype(np.int64), 1
            else:
                # Eight letters in one number: the lowest bit that differs tells the letter.
                x = self.words[a[open_] + at] ^ self.words[b[open_] + at]
                lowest = x & (~x + np.uint64(1))
                step, wide = np.where(x == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3), 8
            out[open_] += step
            open_ = open_[(step == wide) & (out[open_] < limit[open_])]
        return np.minimum(out, limit)

    def _rest(self, at: np.ndarray) -> np.ndarray:
        """Letters from each position to the end of its string."""
        return self.end[np.searchsorted(self.end, at)] - at

    def _induce(self, fixed: Queue, up: bool, carry: bool, told: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Induce L suffixes from the LMS ones (``up``), or S suffixes from the L ones, which come in as ``fixed``.

        Sources are taken in order of their keys: letters, or letters from the largest down; within a letter what was
        induced comes before what is fixed. ``told`` gets all of them: positions, common prefixes with the source
        before, and which are fixed.
        """
        text, top = self.text, self.keys - 1
        key_of = (lambda at: text[at].astype(np.int64)) if up else (lambda at: top - text[at].astype(np.int64))
        queue = Queue(self.space, self.keys, self.width)
        memory = _Carry(self.space, self.keys) if carry else None
        last = (-1, -1, True)

        def source(at: np.ndarray, lcp: np.ndarray, is_fixed: np.ndarray) -> None:
            nonlocal last
            if not len(at):
                return
            key = key_of(at)
            if carry:
                same = np.empty(len(key), bool)
                same[0], same[1:] = key[0] == last[1], key[1:] == key[:-1]
                lcp = np.where(same, lcp, 0)
                if is_fixed[-1] or is_fixed.any():
                    before_fixed = np.empty(len(key), bool)
                    before_fixed[0], before_fixed[1:] = last[2], is_fixed[:-1]
                    border = np.flatnonzero(same & is_fixed & ~before_fixed)
                    if len(border):
                        before = np.where(border > 0, at[border - 1], last[0])
                        lcp[border] = self.common(before, at[border])
            last = (int(at[-1]), int(key[-1]), bool(is_fixed[-1]))
            told(at, lcp, is_fixed)
            own = np.maximum(at - 1, 0)
            small = self.small[own]
            use = np.flatnonzero((~small if up else small & (text[own] > 0)) & (at > 0))
            own = own[use]
            new = key_of(own)
            order = np.argsort(new, kind="stable")
            own, new = own[order], new[order]
            queue.add(new, own, memory.shared(new, use[order], lcp) if carry else np.zeros(len(own), np.int64))

        fixed.deal()
        for b in range(queue.count):
            if queue.width == 1:
                for at, lcp in queue.stretches(b):
                    source(at, lcp, np.zeros(len(at), bool))
                for at, lcp in fixed.stretches(b):
                    source(at, lcp, np.ones(len(at), bool))
            elif queue.open(b) + fixed.open(b) <= STRETCH:
                self._mixed(b, queue, fixed, key_of, up, source)
            else:
                self._heavy(b, queue, fixed, key_of, source)
        queue.store.done()
        fixed.store.done()

    def _mixed(self, b: int, queue: Queue, fixed: Queue, key_of, up: bool, source) -> None:
        """A bucket of several keys, all at once: as far as nothing that is still to be induced comes in between."""
        end = (b + 1) * queue.width
        f_at, f_lcp = fixed.all_of(b)
        q_at, q_lcp = queue.all_of(b)
        while len(q_at) + len(f_at):
            at, lcp = np.concatenate((q_at, f_at)), np.concatenate((q_lcp, f_lcp))
            is_fixed = np.arange(len(at)) >= len(q_at)
            key = key_of(at)
            order = np.argsort(key, kind="stable")
            at, lcp, is_fixed, key = at[order], lcp[order], is_fixed[order], key[order]
            before = np.maximum(at - 1, 0)
            small = self.small[before]
            wanted = (at > 0) & (~small if up else small & (self.text[before] > 0))
            soon = np.where(wanted, key_of(before), end)
            to = len(at)
            if soon.min() < end:
                least = np.concatenate(([NONE], np.minimum.accumulate(soon)[:-1]))
                late = np.flatnonzero((key > least) | (key == least) & is_fixed)
                to = int(late[0]) if len(late) else to
            source(at[:to], lcp[:to], is_fixed[:to])
            if to == len(at) and soon.min() >= end:
                return
            inner = ~is_fixed[to:]
            more_at, more_lcp = queue.come()
            q_at, q_lcp = np.concatenate((at[to:][inner], more_at)), np.concatenate((lcp[to:][inner], more_lcp))
            f_at, f_lcp = at[to:][~inner], lcp[to:][~inner]

    def _heavy(self, b: int, queue: Queue, fixed: Queue, key_of, source) -> None:
        """A bucket of many entries: its keys one by one, each a stretch at a time."""
        start, width = b * queue.width, queue.width
        local = lambda at: key_of(at) - start
        fine = [Queue(self.space, width, 1) for _ in range(2)]

        def take(at: np.ndarray, lcp: np.ndarray, is_fixed: bool) -> None:
            source(at, lcp, np.full(len(at), is_fixed))
            at, lcp = queue.come()
            fine[0].add(local(at), at, lcp)

        for q, own in ((queue, fine[0]), (fixed, fine[1])):
            for at, lcp in q.stretches(b):
                own.add(local(at), at, lcp)
        fine[1].deal()
        for k in range(width):
            for at, lcp in fine[0].stretches(k):
                take(at, lcp, False)
            for at, lcp in fine[1].stretches(k):
                take(at, lcp, True)
        for q in fine:
            q.store.done()

    def _both(self, fixed: Queue, carry: bool, told: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """From sorted LMS suffixes all others, in descending order: ``told`` gets (positions, common prefixes with the one before)."""
        log = Holder(self.space, 1)

        def keep(at: np.ndarray, lcp: np.ndarray, is_fixed: np.ndarray) -> None:
            log.put(0, at[~is_fixed], lcp[~is_fixed])
            self.space.relieve()

        self._induce(fixed, True, carry, keep)
        top = self.keys - 1
        back = Queue(self.space, self.keys, self.width)
        after = 0
        for at, lcp in log.take(0, True):
            if len(at):
                # Seen backwards, a suffix shares with the one before what that one shared with it.
                back.add(top - self.text[at[::-1]].astype(np.int64), at[::-1], np.r_[after, lcp[:0:-1]])
                after = int(lcp[0])
        log.done()
        self._induce(back, False, carry, lambda at, lcp, is_fixed: told(at, lcp))

    def _letters_first(self) -> Queue:
        return Queue(self.space, self.keys, self.width)

    def _sorted_lms(self) -> Queue:
        """LMS suffixes in order, by letter, with their common prefixes."""
        lms, n = self.lms, len(self.lms)
        unsorted = self._letters_first()
        for part in self.space.chunks(n):
            unsorted.add(self.text[lms[part]].astype(np.int64), lms[part], np.zeros(part.stop - part.start, np.int64))
        names = self.space.array(n, np.int64)
        distinct, before = 0, -1

        def name(at: np.ndarray, _: np.ndarray) -> None:
            """Name LMS stretches by how many differing ones came before; the largest come first."""
            nonlocal distinct, before
            at = at[self.small[at] & (at > 0)]
            at = at[~self.small[at - 1]]
            if not len(at):
                return
            i = np.searchsorted(lms, at)
            size = lms[i + 1] - at
            new = np.ones(len(at), bool)
            previous = np.append(before, at[:-1])
            size_before = np.append(-1 if before < 0 else lms[np.searchsorted(lms, before) + 1] - before, size[:-1])
            check = np.flatnonzero((size == size_before) & (previous >= 0))
            if len(check):
                a, b, s = previous[check], at[check], size[check]
                same = self.common(a, b, 0, s + 1)
                new[check] = ~((same > s) | (same == s) & (self.text[a + s] == 0) & (self.text[b + s] == 0))
            names[i] = distinct + np.cumsum(new)
            distinct += int(new.sum())
            before = int(at[-1])

        self._both(unsorted, False, name)
        # Names ascend with the stretches; ends are 0.
        most = 0
        for part in self.space.chunks(n):
            own = names[part]
            inner = self.text[lms[part]] > 0
            names[part] = np.where(inner, distinct + 1 - own, 0)
            most += int(inner.sum())
        out = self._letters_first()
        for part in self.space.chunks(len(self.end)):
            out.add(np.zeros(part.stop - part.start, np.int64), self.end[part], np.zeros(part.stop - part.start, np.int64))
        if distinct == most:
            place = self.space.array(most + 1, np.int64)
            for part in self.space.chunks(n):
                place[names[part]] = lms[part]
            for part in self.space.chunks(most):
                at = place[1 + part.start : 1 + part.stop]
                out.add(self.text[at].astype(np.int64), at, self._with_before(at, place[part.start] if part.start else -1))
        elif BASE * n <= self.space.limit:
            self._put_ranked(names, out)
        else:
            order = Holder(self.space, 1)

            def keep(i: np.ndarray, k: np.ndarray) -> None:
                order.put(0, i, k)
                self.space.relieve()

            Sorter(names, self.space, distinct, self.depth + 1).descending(keep)
            self._put(order, out)
        return out

    def _with_before(self, at: np.ndarray, before: int) -> np.ndarray:
        previous = np.r_[before, at[:-1]]
        out = np.zeros(len(at), np.int64)
        known = np.flatnonzero(previous >= 0)
        if len(known):
            out[known] = self.common(previous[known], at[known])
        return out

    def _put(self, order: Holder, out: Queue) -> None:
        """LMS suffixes into ``out``, from places of names, the largest first, with common prefixes in names."""
        after, before = 0, -1
        for i, shared in order.take(0, True):
            if not len(i):
                continue
            i, shared, after = i[::-1], np.r_[after, shared[:0:-1]], int(shared[0])
            at = self.lms[i]
            # As many names are as many letters as their stretches have; what follows differs within one more.
            known = self.lms[i + shared] - at
            lcp = np.zeros(len(at), np.int64)
            own = np.flatnonzero(np.r_[before, at[:-1]] >= 0)
            if len(own):
                lcp[own] = self.common(np.r_[before, at[:-1]][own], at[own], known[own])
            out.add(self.text[at].astype(np.int64), at, lcp)
            before = int(at[-1])
        order.done()

    def _put_ranked(self, names: np.ndarray, out: Queue) -> None:
        """LMS suffixes into ``out`` from a string of names that fits in memory: ranks of twice as many names, over and over."""
        n = len(names)
        ends = np.flatnonzero(names == 0)
        ends = ends[np.searchsorted(ends, np.arange(n))]
        rank, k = names.copy(), 1
        longest = int((ends - np.arange(n)).max()) + 1
        while k <= longest:
            then = np.arange(n) + k
            # Behind the end there is nothing; the end itself, 0, comes after that.
            second = np.where(then <= ends, rank[np.minimum(then, n - 1)] + 1, 0)
            _, new = np.unique(rank * (n + 2) + second, return_inverse=True)
            if new.max() == rank.max() and k > 1:
                break
            rank, k = new, 2 * k
        # Suffixes that are alike to their ends are in the order of these.
        order = np.argsort(rank, kind="stable")
        order = order[names[order] > 0]
        for part in self.space.chunks(len(order)):
            at = self.lms[order[part]]
            out.add(self.text[at].astype(np.int64), at, self._with_before(at, int(self.lms[order[part.start - 1]]) if part.start else -1))

    def descending(self, told: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """All suffixes but the bare ends, the largest first: ``told`` gets positions and common prefixes with the one before, in order."""
        self._both(self._sorted_lms(), True, told)


def sort_suffixes(text: np.ndarray, limit: int, told: Callable[[np.ndarray, np.ndarray], None], largest: int = 255) -> int:
    """``told`` gets the suffixes of ``text``, the largest first, with their common prefixes; the bytes that went to files are returned."""
    space = Space(limit)
    try:
        if len(text):
            Sorter(text, space, largest).descending(told)
        return space.spilled
    finally:
        space.close()


def late_places(text: np.ndarray, length: int, space: Space) -> Iterator[np.ndarray]:
    """Positions whose next ``length`` letters, within their string, also begin at an earlier position, ascending, some at a time.

    Strings that begin alike follow each other in the order of suffixes; of each such run only the least position is
    kept, and those that were not the least are marked in an array of one byte a letter.
    """
    if not len(text):
        return
    late = space.array(len(text), bool)
    least = -1

    def mark(at: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal least
        start = np.r_[0, np.flatnonzero(lcp < length)]
        start = start[1:] if len(start) > 1 and start[1] == 0 else start
        joined = least >= 0 and lcp[0] >= length
        run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(at)]))
        first = np.minimum.reduceat(at, start)
        if joined:
            late[max(first[0], least)] = True
            first[0] = min(first[0], least)
        late[at[at != first[run]]] = True
        least = int(first[-1])

    Sorter(text, space, 255).descending(mark)
    for part in space.chunks(len(text)):
        found = np.flatnonzero(late[part])
        if len(found):
            yield found + part.start


def repeats(text: np.ndarray, length: int, limit: int = 256 << 20) -> np.ndarray:
    """All ``late_places`` of a text at once."""
    space = Space(limit)
    try:
        return np.concatenate([np.zeros(0, np.int64), *late_places(text, length, space)])
    finally:
        space.close()
