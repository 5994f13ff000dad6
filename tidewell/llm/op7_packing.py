"""Packing pieces into sequences: a configuration linear program over the length histogram.

The program's variables are configurations, multisets of lengths that fit one sequence; each length has to be
covered as often as there are pieces of it. It is solved by multiplicative weights: a round prices the lengths by
their weights, a knapsack over the prices finds the configurations that are worth the most, those take fractions
of the round's share, and the weights of lengths that are left behind are multiplied up. The prices bound the
program's value from below. The fractions are rounded to whole sequences; the few pieces that remain are put
best-fit into what is free. All this works on counts by length, so its cost does not grow with the rows; the
pieces then look up their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.vec import steps
from tidewell.tables import materialize, table

SIZE = 2048
#: Words and white-space chunks of which a worker remembers the ids.
WORDS, CHUNKS = 600_000, 300_000
# How the tokenizer file tells words apart, after lower-casing, and what it says about that.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LETTERING = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Texts with a character outside Latin letters, with one that only Python takes for white space, or with a
#: special token, are encoded at once.
OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]|<\\|")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


class WordIds:
    """Ids of whole texts, put together from those of their words, which the tokenizer's model encodes one by one.

    A tokenizer of the known kind never looks across words, so this gives what encoding the text at once gives, and
    a word that was seen before costs one look-up. With any other tokenizer file whole texts are encoded at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        plain = all(t["content"].startswith("<|") and not t["normalized"] for t in told["added_tokens"])
        parts = [(told[k] or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_words = plain and parts == [NORMALIZER, [SPLIT, LETTERING]] and told["model"]["type"] == "BPE"
        self.split = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelled = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())
            found = self.words[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def text(self, text: str) -> bytes:
        if not self.by_words or OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        chunks = text.lower().split()
        known, word = self.chunks, self.word
        for c in set(chunks).difference(known):
            if c.isalpha():
                known[c] = word(c)
            elif c[-1] in ".,!" and c[:-1].isalpha():
                known[c] = word(c[:-1]) + word(c[-1])
            else:
                known[c] = b"".join(map(word, self.split(c)))
        return b"".join([known[c] for c in chunks])

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        return list(map(self.text, texts))


_workers: dict[str, WordIds] = {}


def pieces(df: DataFrame, text: str, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row a piece: the other columns, then piece, start, length, ids_crc32, and (part, local), its rank among its task's pieces of this length.

    A document is its ids and ``end_id``; null is empty. Only documents of more than ``size`` ids are cut.
    Columns of the names that are made here or by ``pack`` are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "piece", "start", "length", "ids_crc32", "part", "local", "rank", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _workers.get(tokenizer) or _workers.setdefault(tokenizer, WordIds(tokenizer))
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.uint32(end_id).tobytes()
        for batch in batches:
            for part in steps(batch, text):
                row, piece, start, length, crc, local = [], [], [], [], [], []
                for i, ids in enumerate(ids_of.batch([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        n = len(own) // 4
                        row.append(i), piece.append(k), start.append(at // 4), length.append(n), crc.append(zlib.crc32(own)), local.append(seen[n])
                        seen[n] += 1
                rows = pa.array(row, pa.int64())
                own = [part.column(part.schema.get_field_index(f.name)).take(rows) for f in kept]
                made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part_id] * len(row), pa.int32()), pa.array(local, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*(f.name for f in kept), "piece", "start", "length", "ids_crc32", "part", "local"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return df.mapInArrow(run, f"{fields}piece int, start long, length long, ids_crc32 long, part int, local long")


class Plan:
    """Groups of equal sequences: ``count`` sequences with ``content`` [(length, how many)] and ``free`` space."""

    def __init__(self, size: int):
        self.size = size
        self.groups: list[list] = []
        self.lower = self.by_program = 0

    def add(self, content: list[tuple[int, int]], count: int) -> None:
        self.groups.append([count, list(content), self.size - sum(n * m for n, m in content)])

    def fill(self, histogram: dict[int, int]) -> None:
        """Best fit, longest first, in bulk: each length goes to the fullest sequences that still hold it."""
        by_free: dict[int, list[int]] = {}
        for i, (_, _, free) in enumerate(self.groups):
            by_free.setdefault(free, []).append(i)
        for n in sorted(histogram, reverse=True):
            left = histogram[n]
            for free in sorted(f for f in by_free if f >= n):
                while left and by_free[free]:
                    i = by_free[free].pop()
                    count, content, _ = self.groups[i]
                    each = free // n
                    if left >= each:
                        used, m = min(count, left // each), each
                    else:
                        used, m = 1, left
                    if used < count:
                        self.groups.append([count - used, list(content), free])
                        by_free[free].append(len(self.groups) - 1)
                    self.groups[i] = [used, content + [(n, m)], free - n * m]
                    by_free.setdefault(free - n * m, []).append(i)
                    left -= used * m
                if not left:
                    break
            while left:
                each = self.size // n
                used, m = (left // each, each) if left >= each else (1, left)
                self.groups.append([used, [(n, m)], self.size - n * m])
                by_free.setdefault(self.size - n * m, []).append(len(self.groups) - 1)
                left -= used * m

    @property
    def sequences(self) -> int:
        return sum(g[0] for g in self.groups)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """The highest price that fits each space up to ``size``, any number of each length, by dynamic programming. ``lengths`` ascend."""
    best = np.zeros(size + 1)
    for c in range(int(lengths[0]), size + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c] = (best[c - lengths[:k]] + prices[:k]).max()
    return best


class Program:
    """The configuration program of a histogram: fractions by configuration, ((index of length, how many), ...), and a lower bound.

    ``rounds`` rounds take an equal share each; in a round the knapsack is solved anew up to ``again`` times, over the
    lengths that still have room. A configuration is taken if it is worth the best price but for ``loose`` of it.
    """

    def __init__(self, lengths: np.ndarray, need: np.ndarray, size: int, rounds: int = 24, rate: float = 0.02, loose: float = 0.001, again: int = 6):
        self.lengths, self.need, self.size = lengths, need, size
        self.fractions: Counter[tuple[tuple[int, int], ...]] = Counter()
        self.lower = 0.0
        covered, weights = np.zeros(len(lengths)), np.ones(len(lengths))
        tokens = float((lengths * need).sum())
        whole = tokens / size
        for t in range(1, rounds + 1):
            prices = lengths * weights
            top = _knapsack(lengths, prices, size)[size]
            # No sequence holds more than ``top``, so the pieces need at least so many.
            self.lower = max(self.lower, float((prices * need).sum()) / top)
            # A length may run ahead of its share by a fiftieth.
            room = np.maximum(0, need * t / rounds * 1.02 - covered)
            share = max(whole, self.lower) * t / rounds - self.fractions.total()
            for _ in range(again):
                own = np.flatnonzero(room > 1e-9 * need)
                if not len(own) or share <= 1e-6 * whole:
                    break
                taken = self._take(own, prices[own], room, covered, share, loose, top)
                if not taken:
                    break
                share -= taken
            behind = t / rounds - covered / need
            weights = np.exp(rate * rounds / t * behind)
            weights *= tokens / (weights * need * lengths).sum()

    def _take(self, own: np.ndarray, prices: np.ndarray, room: np.ndarray, covered: np.ndarray, share: float, loose: float, top: float) -> float:
        """Let the best configurations of the lengths ``own`` take fractions until their room or the share is used up."""
        lengths, size = self.lengths[own], self.size
        best = _knapsack(lengths, prices, size)
        if best[size] < 0.95 * top:
            return 0.0
        bound, taken = loose * best[size], 0.0
        free, limit = room[own], self.need[own]
        least = 1e-9 * limit
        losses = best[size] - best[size - lengths] - prices
        for first in np.argsort(-free * lengths, kind="stable").tolist():
            while losses[first] <= bound and free[first] > least[first] and taken < share:
                count, space, lost = Counter({first: 1}), size - int(lengths[first]), float(losses[first])
                while space >= lengths[0]:
                    k = np.searchsorted(lengths, space, "right")
                    loss = best[space] - best[space - lengths[:k]] - prices[:k]
                    fits = np.flatnonzero((loss <= bound - lost) & (free[:k] > least[:k]))
                    if not len(fits):
                        break
                    j = int(fits[np.argmax(free[fits] * lengths[fits])])
                    if count[j] >= limit[j]:
                        break
                    count[j] += 1
                    space -= int(lengths[j])
                    lost += max(0.0, float(loss[j]))
                if best[size] - sum(float(prices[j]) * m for j, m in count.items()) > bound * 1.0001:
                    break
                part = min(share - taken, min(float(free[j]) / m for j, m in count.items()))
                self.fractions[tuple(sorted((int(own[j]), m) for j, m in count.items()))] += part
                taken += part
                for j, m in count.items():
                    free[j] -= m * part
                    covered[own[j]] += m * part
        room[own] = free
        return taken

    def rounded(self) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
        """Whole numbers of sequences by configuration, and what pieces remain: fractions rounded down, then up by their size while pieces last."""
        rest, whole = self.need.astype(np.int64), Counter()

        def use(config: tuple[tuple[int, int], ...], count: int) -> None:
            count = min([count, *(int(rest[j]) // m for j, m in config)])
            if count > 0:
                whole[config] += count
                for j, m in config:
                    rest[j] -= m * count

        order = sorted(self.fractions.items(), key=lambda x: (-x[1], x[0]))
        for config, x in order:
            use(config, int(x))
        for config, _ in sorted(order, key=lambda x: (-(x[1] % 1), x[0])):
            use(config, 1)
        return sorted(whole.items()), rest


def solve(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Sequences for a histogram {length: pieces}: the program's rounded solution, best fit for the rest.

    ``plan.by_program``: the pieces that configurations hold; ``plan.lower``: no packing has fewer sequences.
    """
    plan = Plan(size)
    left = {n: m for n, m in histogram.items() if m > 0}
    plan.lower = plan.by_program = left.get(size, 0)
    if left.get(size):
        plan.add([(size, 1)], left.pop(size))
    if left:
        lengths = np.array(sorted(left))
        program = Program(lengths, np.array([left[n] for n in lengths.tolist()], float), size)
        whole, rest = program.rounded()
        for config, count in whole:
            plan.add([(int(lengths[j]), m) for j, m in reversed(config)], count)
        left = {int(n): int(r) for n, r in zip(lengths, rest) if r > 0}
        plan.by_program = sum(histogram.values()) - sum(left.values())
        plan.lower += math.ceil(program.lower - 1e-6)
    plan.fill(left)
    return plan


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Give each piece its sequence_id and offset. ``rows``: a written table of ``pieces``; no piece is lost, none is cut again.

    Ranks come from counts by task and length. The driver gets the histogram, at most ``size`` rows, and sends
    back the plan, some ten thousand runs of ranks, whatever the number of pieces. Columns of the added names are replaced.
    """
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = solve(histogram, size)
    first, taken, runs = 0, dict.fromkeys(histogram, 0), []
    for count, content, _ in plan.groups:
        at = 0
        for n, m in content:
            runs.append((n, taken[n], m, first, at))
            taken[n] += count * m
            at += n * m
        first += count
    runs.sort()
    shift = 1 << 48
    keys = np.array([n * shift + r for n, r, *_ in runs], np.int64)
    many, seq, off, begin = (np.array([r[k] for r in runs], np.int64) for k in (2, 3, 4, 1))
    names = [c for c in rows.columns if c not in ("part", "local")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            length, rank = get("length").to_numpy(), get("rank").to_numpy()
            j = np.searchsorted(keys, length * shift + rank, "right") - 1
            k = rank - begin[j]
            made = [pa.array(seq[j] + k // many[j]), pa.array(off[j] + k % many[j] * length)]
            yield pa.RecordBatch.from_arrays([*(get(c) for c in names), *made], names=[*names, "sequence_id", "offset"])

    ranked = rows.join(base, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l"))).select(*names, (F.col("base") + F.col("local")).alias("rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_configuration_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 tokens. Empty and null texts are the one token 0; repeated rows are packed each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(materialize(pieces(docs, "text", tokenizer or default_tokenizer())))
