"""Exact repeats across a corpus: suffixes of shards, sorted by external induction.

Which bytes can repeat is found first. Of the hashes of all 32-byte windows in any 100 bytes the least is their
anchor; equal strings have equal anchors. All neighbouring strings of one anchor are a stretch of text. Stretches
with an anchor of their own can't repeat and are dropped; of stretches with equal bytes all but the first repeat
it whole. What is left, different stretches around one anchor, is dealt into shards by anchor, so all places of
any string meet in one shard, and there the induced suffix order with its common prefixes tells the repeats. An
anchor whose stretches would fill a shard alone is hot: its strings are dealt out one by one, by their own hash.

Stretches are compared by two 64-bit hashes, of the anchor and of the whole. They have fewer than 170 bytes, far
fewer than strings that defeat sums modulo 2^64 need; of 10^12 different stretches of one anchor the odds that any
two are taken for equal are below 3 per cent, and anchors keep them far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.suffixes import Space, late_places
from tidewell.llm.vec import Substrings, buffers, mix, steps
from tidewell.tables import broadcast_if_small, materialize, table

LENGTH = 100
ANCHOR = 32
#: Bytes of text that a shard is meant to hold; an anchor with more than that is not dealt into shards.
SHARD = 2 << 20
#: Memory of one sort; the rest is in files of the task's machine.
MEMORY = 96 << 20
#: So many different stretches of one anchor, among LOCAL of a task, are dealt out by their content.
HEAVY = 32
#: Stretches of one task that are compared with each other before they leave it.
LOCAL = 400_000
#: Stretches of hot anchors whose strings are hashed at once.
HASHED = 4000
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000
_FIELDS = ["kind", "anchor", "body", "doc", "tie", "lo", "hi"]
_SCHEMA = "kind int, anchor long, body long, doc long, tie long, lo long, hi long"
_TYPES = [pa.int32(), *[pa.int64()] * 6]
# Kinds of rows: a stretch; starts that repeat; a stretch that shares its anchor with a different one; a stretch of which
# that is known; an anchor of which that is known.
STRETCH, REPEATS, SHARED, KNOWN, MIXED = range(5)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if width > have else key


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, anchor hash, content hash): strings of ``length`` that start from ``lo`` to ``hi`` in their row have one anchor."""
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return nothing
    strings = Substrings(data)
    g = strings.each(anchor)
    # The low bits hold the place, so that of equal hashes the last is taken.
    bits = np.uint64(int(len(g)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _least((g & ~low) | (low - np.arange(len(g), dtype=np.uint64)), length - anchor + 1)
    at = (low - (least & low)).astype(np.int64)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), count)
    if not len(row):
        return nothing
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    at = at[start]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], len(row)] - 1
    own = row[first]
    lo, hi = start[first], start[last]
    return own, lo - offsets[own], hi - offsets[own], g[at[first]], strings.of(lo, hi + length)


def _joined(doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of one document that touch, as one."""
    order = np.lexsort((lo, tie, doc))
    doc, tie, lo, hi = doc[order], tie[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (lo[1:] != hi[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], tie[first], lo[first], hi[np.r_[first[1:], len(doc)] - 1] if len(first) else hi


def _batch(kind, anchor, body, doc, tie, lo, hi) -> pa.RecordBatch:
    cols = [np.broadcast_to(kind, len(doc)), anchor, body, doc, tie, lo, hi]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)).cast(t) for c, t in zip(cols, _TYPES)], names=_FIELDS)


def _marks(doc, tie, lo, hi) -> pa.RecordBatch:
    doc, tie, lo, hi = _joined(doc, tie, lo, hi)
    spread = mix(doc.astype(np.uint64) * np.uint64(31) + lo.astype(np.uint64)).view(np.int64)
    return _batch(REPEATS, spread, np.zeros(len(doc)), doc, tie, lo, hi)


def _settled(held: list[tuple[np.ndarray, ...]], heavy_from: int) -> Iterator[pa.RecordBatch]:
    """Of rows with one anchor and content the first, and ranges of the others' starts.

    Where one anchor has many contents, these are KNOWN to differ, and the anchor is told to be MIXED.
    """
    doc, tie, lo, hi, a, b = (np.concatenate([h[i] for h in held]) for i in range(6))
    order = np.lexsort((lo, tie, doc, b, a))
    doc, tie, lo, hi, a, b = doc[order], tie[order], lo[order], hi[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = ~new & ((doc != doc[first]) | (tie != tie[first]) | (lo != lo[first]))
    own = a[new].view(np.int64)
    border = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    many = np.diff(np.r_[border, len(own)])
    heavy = np.repeat(many >= heavy_from, many)
    yield _batch(np.where(heavy, KNOWN, STRETCH), own, b[new].view(np.int64), doc[new], tie[new], lo[new], hi[new])
    if heavy.any():
        anchors = own[border[many >= heavy_from]]
        nothing = np.zeros(len(anchors), np.int64)
        yield _batch(MIXED, anchors, np.full(len(anchors), np.iinfo(np.int64).min), nothing, nothing, nothing, nothing)
    if late.any():
        yield _marks(doc[late], tie[late], lo[late], hi[late])


def find_stretches(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Of ``docs`` (doc, tie, text): stretches, and ranges of starts that repeat one of the same task."""
    heavy = HEAVY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in steps(batch, "text"):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                row, lo, hi, a, b = stretches(*buffers(get("text")), length, anchor)
                held.append((get("doc").to_numpy()[row], get("tie").to_numpy()[row], lo, hi, a, b))
                if sum(len(h[0]) for h in held) >= LOCAL:
                    yield from _settled(held, heavy)
                    held = []
        if held:
            yield from _settled(held, heavy)

    return docs.mapInArrow(run, _SCHEMA)


def compare_stretches(rows: DataFrame) -> DataFrame:
    """REPEATS: starts that repeat an equal stretch, SHARED: stretches that share their anchor with a different one.

    Rows are dealt by anchor, but KNOWN ones by content too, so that those of a passage in a large share of all
    documents meet only their copies; what is left of such an anchor elsewhere is SHARED because it is MIXED. Equal
    stretches of both kinds do not meet here, but both are SHARED and meet where their strings do. Rows come
    sorted by anchor, content and place; a task keeps two rows of what it has seen, however long a run is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the first row of the content last seen
        waiting = None  # that row, while its anchor has shown no other content
        told = None  # the anchor whose contents are already known to differ
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).to_numpy()
            if (kind == REPEATS).any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(kind == REPEATS)).columns, names=_FIELDS)
            own_kind = kind[kind != REPEATS]
            x = np.stack([batch.column(i).to_numpy()[kind != REPEATS] for i in range(1, 7)])
            if not x.shape[1]:
                continue
            a, b = x[0], x[1]
            new = np.ones(x.shape[1], bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = head is None or a[0] != head[0] or b[0] != head[1]
            firsts = x[:, new] if head is None or new[0] else np.c_[head, x[:, new]]
            of = np.cumsum(new) - 1 + (0 if head is None or new[0] else 1)
            own = firsts[:, of]
            stretch = own_kind != MIXED
            late = ~new & stretch & (x[2:5] != own[2:5]).any(0)
            if late.any():
                yield _marks(*x[2:, late])
            head = firsts[:, -1]
            fresh, known = x[:, new], (own_kind == KNOWN)[new]
            stretch = stretch[new]
            if waiting is not None:
                fresh, known, stretch = np.c_[waiting, fresh], np.r_[False, known], np.r_[True, stretch]
            waiting = None
            if fresh.shape[1]:
                f = fresh[0]
                # Of one anchor all rows after the first differ from it, as does the first if another follows.
                differs = np.r_[told is not None and f[0] == told, f[1:] == f[:-1]] | np.r_[f[1:] == f[:-1], False] | known | ~stretch
                if not differs[-1]:
                    waiting = fresh[:, -1]
                else:
                    told = f[-1]
                out = differs & stretch
                if out.any():
                    yield _batch(SHARED, *fresh[:, out])

    deal = F.when(F.col("kind") == KNOWN, F.col("body")).otherwise(F.lit(0).cast("long"))
    return rows.repartition("anchor", deal).sortWithinPartitions("anchor", "body", "doc", "tie", "lo").mapInArrow(run, _SCHEMA)


def cut_stretches(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(shard, doc, tie, lo, body): the bytes of wanted stretches. ``wanted``: doc, tie and ``own``, a list of (shard, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            data, offsets = buffers(get("text"))
            raw = data.tobytes()
            lists = get("own")
            inner = lists.flatten()
            shard, lo, hi = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at = offsets[row] + lo
            ends = at + (hi - lo) + length
            for s in range(0, len(row), 20_000):
                e = slice(s, s + 20_000)
                bodies = [raw[x:y] for x, y in zip(at[e].tolist(), ends[e].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[e]), get("doc").take(pa.array(row[e])), get("tie").take(pa.array(row[e])), pa.array(lo[e]), pa.array(bodies, pa.binary())], names=["shard", "doc", "tie", "lo", "body"]
                )

    rows = docs.withColumnRenamed("doc", "_doc").withColumnRenamed("tie", "_tie").join(wanted, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie")))
    return rows.select("doc", "tie", "text", "own").mapInArrow(run, "shard long, doc long, tie long, lo long, body binary")


def hash_starts(bodies: DataFrame, length: int) -> DataFrame:
    """Of ``bodies``, with the anchor as ``shard``: each string as a stretch of its own, for compare_stretches.

    Equal strings have one anchor and one hash. The hash takes the anchor's place, by which rows are dealt, and the
    anchor that of the content, so however many strings share an anchor, only equal ones meet.
    """
    heavy = HEAVY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for s in range(0, batch.num_rows, HASHED):
                part = batch.slice(s, HASHED)
                anchor, doc, tie, lo = (part.column(i).to_numpy() for i in range(4))
                data, offsets = buffers(part.column(4))
                count = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(count)), count)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                own = Substrings(data).each(length)[offsets[row] + inside]
                held.append((doc[row], tie[row], lo[row] + inside, lo[row] + inside, own, anchor.view(np.uint64)[row]))
                if sum(len(h[0]) for h in held) >= LOCAL:
                    yield from _settled(held, heavy)
                    held = []
        if held:
            yield from _settled(held, heavy)

    return bodies.mapInArrow(run, _SCHEMA)


class Shard:
    """The text of one shard and where its strings are from; beyond a part of the memory both go to files as they come."""

    def __init__(self, memory: int):
        self.space, self.room = Space(memory), memory // 8
        self.parts: list[list[np.ndarray]] = [[], []]
        self.files = ["", ""]
        self.size, self.held, self.last = 0, 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows shard, doc, tie, lo, body in order of place. A document that is twice in the table brings its stretches twice: one is meant."""
        place = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], 1)
        keep = np.ones(len(place), bool)
        keep[1:] = (place[1:] != place[:-1]).any(1)
        keep[0] = self.last is None or (place[0] != self.last).any()
        self.last = place[-1]
        data, offsets = buffers(batch.column(4).filter(pa.array(keep)))
        size = np.diff(offsets)
        # Bytes of UTF-8 are below 255, so one more than each fits a byte and 0 is free to close a string.
        text = np.zeros(len(data) + len(size), np.uint8)
        begin = offsets[:-1] + np.arange(len(size))
        text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data + 1
        for k, x in enumerate((text, np.c_[place[keep], begin + self.size])):
            self.parts[k].append(x)
            self.held += x.nbytes
        self.size += len(text)
        if self.held > self.room:
            self._flush()

    def _flush(self) -> None:
        for k in (0, 1):
            self.files[k] = self.files[k] or self.space.path()
            with open(self.files[k], "ab") as out:
                for x in self.parts[k]:
                    out.write(np.ascontiguousarray(x).tobytes())
            self.parts[k] = []
        self.space.spilled += self.held
        self.held = 0

    def _whole(self, k: int, kind: type) -> np.ndarray:
        if not self.files[k]:
            return np.concatenate(self.parts[k]) if k == 0 else np.concatenate(self.parts[k]).astype(kind)
        self._flush()
        return np.asarray(np.memmap(self.files[k], kind, "r"))

    def repeats(self, length: int) -> Iterator[pa.RecordBatch]:
        """(doc, tie, lo, hi): starts of strings that also begin earlier in the shard."""
        try:
            text, rows = self._whole(0, np.uint8), self._whole(1, np.int64).reshape(-1, 4)
            begin = rows[:, 3]
            for late in late_places(text, length, self.space):
                own = rows[np.searchsorted(begin, late, "right") - 1]
                at = own[:, 2] + late - own[:, 3]
                doc, tie, at, to = _joined(own[:, 0], own[:, 1], at, at)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, tie, at, to)], names=["doc", "tie", "lo", "hi"])
        finally:
            self.space.close()


def sort_shards(bodies: DataFrame, length: int, memory: int) -> DataFrame:
    """(doc, tie, lo, hi): starts of strings that also begin earlier in their shard, from its sorted suffixes. A sort takes some ``memory``, however large its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own is not None and shard[a] != last:
                    yield from own.repeats(length)
                    own = None
                own = own or Shard(memory)
                own.add(batch.slice(a, b - a))
                last = shard[a]
        if own is not None:
            yield from own.repeats(length)

    ordered = bodies.repartition("shard").sortWithinPartitions("shard", "doc", "tie", "lo")
    return ordered.mapInArrow(run, "doc long, tie long, lo long, hi long")


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, memory: int = MEMORY) -> DataFrame:
    """(doc, tie, lo, hi): all starts of strings of ``length`` bytes that also begin at an earlier place. ``docs``: doc, tie, text.

    Ranges may overlap. Rows with equal doc and tie are one document.
    """
    compared = materialize(compare_stretches(find_stretches(docs, length, anchor)))
    marks = compared.where(F.col("kind") == REPEATS).select("doc", "tie", "lo", "hi")
    open_ = compared.where(F.col("kind") == SHARED)
    total = open_.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    if not total:
        return marks
    shards = max(1, -(-total // shard))
    found = ["doc", "tie", "lo", "hi"]

    def wanted(rows: DataFrame, name: Column) -> DataFrame:
        return rows.groupBy("doc", "tie").agg(F.collect_list(F.struct(name.alias("shard"), "lo", "hi")).alias("own"))

    hot = open_.groupBy("anchor").agg(F.sum(F.col("hi") - F.col("lo") + length).alias("n")).where(F.col("n") > shard).select("anchor")
    hot = materialize(hot)
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        # Few documents hold hot stretches as a rule: where these have proved few, no text is moved for them.
        some = materialize(wanted(open_.join(hot, "anchor", "left_semi"), F.col("anchor")))
        single = compare_stretches(hash_starts(cut_stretches(docs, broadcast_if_small(some, 3 * F.size("own")), length), length))
        marks = marks.unionByName(materialize(single.where(F.col("kind") == REPEATS).select(found)))
        open_ = open_.join(hot, "anchor", "left_anti")
    return marks.unionByName(sort_shards(cut_stretches(docs, wanted(open_, F.pmod(F.xxhash64("anchor"), F.lit(shards))), length), length, memory))


def numbered(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, tie, text): documents by place. Null ids come first. Only if some id repeats, its rows are told apart by a hash of the text."""
    ids = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unique = ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return ids.select("doc", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tie"), "text")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, tie, spans, text, kept): each document, the removed byte ranges [from, to) and the bytes that stay.

    ``text``: null is empty. Rows with one id are in order of a hash of their text; rows that are wholly equal are one
    document and have one result. Texts shorter than ``length`` bytes stay whole.
    """
    docs = numbered(df, id_col, text)
    marks = repeated(docs, length).groupBy("doc", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("own"))
    marks = marks.select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                spans, kept = [], []
                for t, own in zip(get("text").to_pylist(), get("own")):
                    raw, found, out, at = t.encode(), [], [], 0
                    if own.is_valid:
                        inner = own.values
                        pairs = np.stack([inner.field(0).to_numpy(), inner.field(1).to_numpy() + length], 1)
                        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                        top = np.maximum.accumulate(pairs[:, 1])
                        first = np.flatnonzero(np.r_[True, pairs[1:, 0] > top[:-1]])
                        found = list(zip(pairs[first, 0].tolist(), top[np.r_[first[1:], len(top)] - 1].tolist()))
                    for a, b in found:
                        out.append(raw[at:a])
                        at = b
                    out.append(raw[at:])
                    spans.append([{"from": a, "to": b} for a, b in found])
                    kept.append(b"".join(out))
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([get("doc"), get("tie"), get("text"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc", "tie", "text", "spans", "kept"])

    joined = docs.join(marks, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select("doc", "tie", "text", "own")
    return joined.mapInArrow(run, "doc long, tie long, text string, spans array<struct<`from`:long,`to`:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its bytes that a 100-byte string covers which also starts earlier."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length("text").cast("long")
    doc = F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))
    return done.select(doc.alias("doc_id"), n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
