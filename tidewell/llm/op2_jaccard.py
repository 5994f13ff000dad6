"""Similarity join of documents on their word 5-grams, with Bayesian pruning of candidates.

Documents with equal sets of 5-grams are one class from the start. Candidates share a band of MinHash values.
A pair's values are compared piece by piece, and it is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below the tolerance. What is left is verified exactly on the 5-grams.
No pair is ever a row: a bucket passes on a spanning forest of its surviving pairs, and a cluster of those
counts its verified links in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import free_names, posterior_floor
from tidewell.llm.graph import components
from tidewell.llm.vec import LOWER, WORD, Substrings, buffers, mix, runs, steps
from tidewell.tables import materialize, table

GRAM = 5
THRESHOLD = 0.8
TOLERANCE = 1e-4
VALUES = 128
BANDS, ROWS = 32, 4
#: After so many values a pair is judged.
STAGES = (16, 32, 64, 128)
#: Rows of a block, and 5-grams of its sets. A larger bucket or cluster is dealt out as pairs of blocks, so a task holds two at most.
BLOCK, GRAMS = 2048, 4 << 20
#: Rows of a block whose pairs are judged at once.
STRIP = 256
_RNG = np.random.default_rng(2)
_A = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_MIX = mix(np.arange(101, 101 + GRAM, dtype=np.uint64))


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct hashes of each row's word 5-grams, ascending. Fewer than five words are one gram, none are none."""
    data, offsets = buffers(col)
    start, end = runs(WORD[data], offsets)
    words = Substrings(LOWER[data]).of(start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    k = max(0, len(words) - GRAM + 1)
    h = np.zeros(k, np.uint64)
    for i in range(GRAM):
        h += words[i : i + k] * _MIX[i]
    inside = row[:k] == row[GRAM - 1 :] if k else np.zeros(0, bool)
    grams, of = mix(h[inside]), row[:k][inside]
    short = np.flatnonzero((count > 0) & (count < GRAM))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(GRAM - 1):
            has = count[short] > i
            whole[has] += words[first[short[has]] + i] * _MIX[i]
        grams, of = np.r_[grams, mix(whole + count[short].astype(np.uint64))], np.r_[of, short]
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int64)


def set_ids(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits that name each row's set."""
    n = np.diff(offsets)
    total = [np.r_[np.uint64(0), np.cumsum(mix(grams + np.uint64(s)))] for s in (1, 2)]
    parts = [mix((t[offsets[1:]] - t[offsets[:-1]]) ^ n.astype(np.uint64)) for t in total]
    return [r.tobytes() for r in np.stack(parts, 1)] if len(n) else []


def minhash(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The MinHash values of each row, (rows, 128); rows without grams have the largest values."""
    n = len(offsets) - 1
    out = np.full((n, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        x = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(0, VALUES, 16):
            values = x[None, :] * _A[k : k + 16, None] + _B[k : k + 16, None]
            out[full, k : k + 16] = np.minimum.reduceat(values, offsets[:-1][full], axis=1).T
    return out


def sketch(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, r, id, n, bands, sig) for each row: a hash of its text, its set's name and size, its band keys and low halves of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                grams, offsets = shingles(part.column(part.schema.get_field_index(text)))
                values = minhash(grams, offsets)
                n = np.diff(offsets)
                keys = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + values[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :])
                keys = keys.view(np.int64)
                bands = pa.array([keys[i] if n[i] else keys[i][:0] for i in range(len(n))], pa.list_(pa.int64()))
                low = values.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(id_col)).cast(pa.int64()), part.column(part.schema.get_field_index("__r")), pa.array(set_ids(grams, offsets), pa.binary()), pa.array(n), bands, pa.array([v.tobytes() for v in low], pa.binary())],
                    names=["doc", "r", "id", "n", "bands", "sig"],
                )

    return docs.select(id_col, text, F.xxhash64(text).alias("__r")).mapInArrow(run, "doc long, r long, id binary, n long, bands array<long>, sig binary")


def in_blocks(rows: DataFrame, n: Column, name: Column) -> DataFrame:
    """Rows dealt to pairs of the ``n`` blocks of their group: adds ``i``, ``j`` and ``own``, whether the row is of block i.

    A group of one block is the pair (0, 0). Of a larger one every pair of rows meets in one pair of blocks.
    """
    mine = F.pmod(F.xxhash64(name, F.lit(11)), n).cast("int")
    others = F.sequence(F.lit(0), n - 1)
    dealt = F.transform(others, lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), (o >= mine).alias("own")))
    return rows.withColumn("_d", F.explode(dealt)).select("*", "_d.*").drop("_d")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by them, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = np.array(c.to_pylist(), dtype=object)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, survive) -> list[tuple[int, int]]:
    """Edges that join whatever ``survive(i, others)`` links; others are asked only for rows not yet joined to row i."""
    label = np.arange(n)
    edges = []
    for i in range(n - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            continue
        for j in survive(i, others):
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


def surviving(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each bucket that no stage of the comparison drops. ``rows``: h, i, j, own, id, sig."""
    floors = {n: posterior_floor(n, threshold, tolerance) for n in STAGES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["h", "i", "j"]):
            ids = group["id"].to_pylist()
            if len(ids) < 2:
                continue
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(len(ids), VALUES)
            split = group["i"][0].as_py() != group["j"][0].as_py()
            side = np.array(group["own"].to_pylist()) if split else None

            def survive(i: int, others: np.ndarray) -> np.ndarray:
                if split:
                    others = others[side[others] != side[i]]
                same, seen = np.zeros(len(others), np.int32), 0
                for n in STAGES:
                    same += (sig[others, seen:n] == sig[i, seen:n]).sum(1, dtype=np.int32)
                    keep = same >= floors[n]
                    others, same, seen = others[keep], same[keep], n
                return others

            edges = _forest(len(ids), survive)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in edges], pa.binary()), pa.array([ids[j] for _, j in edges], pa.binary())], names=["a", "b"])

    ordered = rows.select("h", "i", "j", "own", "id", "sig").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return ordered.mapInArrow(run, "a binary, b binary")


def _shared(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many hashes each two rows have in common: frequent ones by matrix products, rare ones pair by pair."""
    m = len(offsets) - 1
    row = np.repeat(np.arange(m), np.diff(offsets))
    _, col, df = np.unique(grams, return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    frequent = df > max(8, m // 64)
    names = np.flatnonzero(frequent)
    place = np.full(len(df), -1)
    place[names] = np.arange(len(names))
    keep = frequent[col]
    r, c = row[keep], place[col[keep]]
    for at in range(0, len(names), 1024):
        x = np.zeros((m, min(1024, len(names) - at)), np.float32)
        own = (c >= at) & (c < at + 1024)
        x[r[own], c[own] - at] = 1
        out += x @ x.T
    rare = ~frequent[col] & (df[col] > 1)
    r, c = row[rare], col[rare]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for d in range(1, max(8, m // 64)):
        if d >= len(c):
            break
        near = c[d:] == c[:-d]
        if not near.any():
            break
        a, b = r[:-d][near], r[d:][near]
        np.add.at(out, (a, b), 1)
        np.add.at(out, (b, a), 1)
    return out


def sets_of(texts: DataFrame, text: str) -> DataFrame:
    """(cluster, blocks, id, grams): the 5-gram hashes of sets, once for each row. ``texts``: cluster, blocks, id, text.

    A doc_id that repeats brings texts of other sets along; they are not meant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                grams, offsets = shingles(get(text))
                meant = np.array([have == want for have, want in zip(set_ids(grams, offsets), get("id").to_pylist())], bool)
                rows = pa.array(np.flatnonzero(meant))
                own = [grams[offsets[k] : offsets[k + 1]].tobytes() for k in np.flatnonzero(meant)]
                yield pa.RecordBatch.from_arrays([*(get(c).take(rows) for c in ("cluster", "blocks", "id")), pa.array(own, pa.binary())], names=["cluster", "blocks", "id", "grams"])

    return texts.select("cluster", "blocks", "id", text).mapInArrow(run, "cluster binary, blocks int, id binary, grams binary")


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links): exact links of each set within its pair of blocks, and the component it is in there.

    ``rows``: cluster, i, j, own, id and grams. Of rows of one set one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cluster", "i", "j"]):
            seen: dict[bytes, int] = {}
            for k, name in enumerate(group["id"].to_pylist()):
                seen.setdefault(name, k)
            if len(seen) < 2:
                continue
            ids, picked = list(seen), list(seen.values())
            raw = group["grams"].take(pa.array(picked)).combine_chunks()
            data, offsets = buffers(raw)
            n = np.diff(offsets) // 8
            common = _shared(data.view(np.uint64), offsets // 8)
            split = group["i"][0].as_py() != group["j"][0].as_py()
            side = np.array(group["own"].to_pylist())[picked] if split else None
            linked = np.zeros((len(ids), len(ids)), bool)
            for at in range(0, len(ids), STRIP):
                part = slice(at, at + STRIP)
                linked[part] = common[part] >= threshold * (n[part, None] + n[None, :] - common[part]) - 1e-9
                if split:
                    linked[part] &= side[part, None] != side[None, :]
            del common
            np.fill_diagonal(linked, False)
            root = np.arange(len(ids))
            left = np.ones(len(ids), bool)
            for k in sorted(range(len(ids)), key=lambda k: ids[k]):
                if not left[k]:
                    continue
                reach = front = np.arange(len(ids)) == k
                while front.any():
                    front = linked[front].any(0) & ~reach
                    reach = reach | front
                root[reach], left = k, left & ~reach
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([ids[k] for k in root], pa.binary()), pa.array(linked.sum(1).astype(np.int64))], names=["id", "root", "links"])

    ordered = rows.select("cluster", "i", "j", "own", "id", "grams").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return ordered.mapInArrow(run, "id binary, root binary, links long")


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document: doc, r (a hash of its text), id (its set), root (the class's set), class_id, n_links, n_copies.

    ``class_id``: the least doc of all documents joined by links (where ids repeat, of two classes perhaps); ``n_links``: how many other texts (sets of
    5-grams) are similar to this one; ``n_copies``: documents with its very set. Null and wordless texts are
    copies of each other and have no links. A null id is one like others; an empty table gives an empty one.
    """
    rows = materialize(sketch(docs, id_col, text))
    sets = materialize(rows.groupBy("id").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    member = sets.select("id", F.explode("bands").alias("h"))
    found = member.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), "id")).alias("y")).where("size > 1")
    # Buckets of the very same sets need but one comparison.
    buckets = materialize(found.groupBy("size", "x", "y").agg(F.min("h").alias("h")).select("h", "size"))
    active = member.join(buckets, "h").join(sets.select("id", "sig"), "id")
    edges = surviving(in_blocks(active, F.ceil(F.col("size") / BLOCK).cast("int"), F.col("id")), threshold, tolerance)
    clusters = materialize(components(edges).select(F.col("node").alias("id"), F.col("root").alias("cluster")))
    members = clusters.join(sets.select("id", "doc", "n"), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / GRAMS)).cast("int")
    sizes = members.groupBy("cluster").agg(blocks.alias("blocks"))
    needed = clusters.join(sizes, "cluster").join(sets.select("id", "doc"), "id")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).join(needed, F.col("_doc").eqNullSafe(F.col("doc")))
    linked = materialize(verified(in_blocks(sets_of(texts, "_text"), F.col("blocks"), F.col("id")), threshold))
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    split = sizes.where("blocks > 1")
    roots = linked.select("id", "root") if split.isEmpty() else components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root")
    placed = sets.select("id", "doc", "n_copies").join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed.select("id", "doc", "n_copies", "root", F.coalesce("links", F.lit(0)).alias("n_links")))
    heads = placed.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = placed.join(heads, "root").select("id", "root", "class_id", "n_links", "n_copies")
    return rows.select("doc", "r", "id").join(named, "id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one of the least id; of rows that share it, that of the least hash of its text.

    All columns stay. A null id is the least of all; null, empty and wordless texts are one class, as copies; rows that
    repeat are one row, whichever; an empty table stays empty.
    """
    found = materialize(similar(docs, id_col, text).select("doc", "r", "root", "class_id"))
    heads = found.where(F.col("doc").eqNullSafe(F.col("class_id")))
    key, r, n = free_names(docs, "__doc", "__r", "__n")
    keep = materialize(heads.groupBy("root").agg(F.first("doc").alias(key), F.min("r").alias(r), F.count(F.lit(1)).alias(n)).drop("root"))
    row = (F.col(id_col).eqNullSafe(F.col(key))) & (F.xxhash64(text) == F.col(r))
    kept = docs.join(keep, row, "left_semi")
    # Rows repeat only if some id does; then equal ones are made one.
    return kept if keep.where(F.col(n) > 1).isEmpty() else kept.dropDuplicates([id_col, text])


def op2_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and links at similarity 0.8 of word 5-grams."""
    found = similar(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_copies")
