"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document's features are its words, its pairs of neighbouring words (those of one word twice are one feature), and the runs of 3 and of 5 characters within
words, whose borders count as a character; all are hashed into buckets. Each bucket has a learned vector; a
document is the mean of its features' vectors, and a softmax layer gives the label. Vectors and layer are learned
together, document by document. For scoring, the layer is folded into the vectors, which leaves one number a
bucket, and every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.frames import fold
from tidewell.llm.vec import Substrings, mix, segments, steps
from tidewell.tables import table

BITS = 17
WINDOWS = (3, 5)
#: The bucket of all pairs of one word with itself, whichever it is.
TWICE = 0
#: Sets the hashes of one length apart from those of others.
KINDS = mix(np.arange(1, 9, dtype=np.uint64))
#: Labelled rows that a model is fitted on, at most: a fixed draw by a hash of doc_id; of no longer texts than ONE, and TOTAL bytes in all.
SAMPLE = 2000
ONE, TOTAL = 1 << 20, 24 << 20


@dataclass
class Model:
    """One weight a bucket and the bias: log odds of label 1 = bias + mean of the features' weights."""

    weights: np.ndarray
    bias: float


def _features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features, and the place in the list of the text of each; some of them at a time."""
    for codes, row in segments(texts):
        blank = codes == 32
        strings = Substrings(codes)
        for n in WINDOWS:
            h = strings.each(n)
            # A run may begin and end with a border, but has none within.
            inside = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inside &= ~blank[k : k + len(h)]
            at = np.flatnonzero(inside)
            yield ((h[at] ^ KINDS[n]) >> np.uint64(64 - BITS)).astype(np.int64), row[at + 1]
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        words, own = strings.of(start, end), row[start]
        yield (words >> np.uint64(64 - BITS)).astype(np.int64), own
        pairs = np.flatnonzero(own[1:] == own[:-1])
        hashed = (mix(words[pairs] * np.uint64(3) + words[pairs + 1]) >> np.uint64(64 - BITS)).astype(np.int64)
        yield np.where(words[pairs] == words[pairs + 1], TWICE, hashed), own[pairs]


def fit(labelled: DataFrame, text: str, label: str, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Model:
    """Learn from a bounded table of whole texts with labels 0 and 1; null texts are empty.

    Features are extracted on the executors; the driver gets bucket numbers and counts. Without rows of both
    labels the model knows only their share. The order of the descent is fixed by the rows' content.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                found = [row << BITS | h for h, row in _features(part.column(part.schema.get_field_index(text)).to_pylist())]
                key, many = np.unique(np.concatenate(found), return_counts=True)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) << BITS)
                pairs = [(key[a:b] & ((1 << BITS) - 1), many[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(label)).cast(pa.int32()), pa.array([x.astype(np.int32).tobytes() for x, _ in pairs], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in pairs], pa.binary())],
                    names=["label", "ids", "counts"],
                )

    rows = labelled.select(label, text).mapInArrow(extract, "label int, ids binary, counts binary").collect()
    docs = [(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows if r["ids"]]
    # By all of their content, so that only rows that are wholly alike tie.
    docs.sort(key=lambda d: (d[1].tobytes(), d[2].tobytes(), d[0]))
    positive = sum(d[0] for d in docs)
    share = (positive + 0.5) / (len(docs) + 1)
    bias = np.array([0.0, float(np.log(share / (1 - share)))])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, dim)).astype(np.float32)
    if 0 < positive < len(docs):
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(docs)):
                y, ids, counts = docs[i]
                part = counts / counts.sum()
                own = vectors[ids]
                x = part @ own
                z = layer @ x + bias
                p = np.exp(z - z.max())
                g = p / p.sum()
                g[y] -= 1
                back = layer.T @ g
                layer -= 0.2 * pace * np.outer(g, x).astype(np.float32)
                bias -= 0.02 * pace * g
                # A step of this length moves the document's mean by pace * gradient, however many features it has.
                vectors[ids] = own - np.outer(part * (pace / (part @ part)), back).astype(np.float32)
    else:
        layer[:] = 0
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(df: DataFrame, text: str, model: Model, name: str = "score") -> DataFrame:
    """Add the probability of label 1 in ``name``, from the whole text. Other columns stay, but one of that name; nothing is shuffled."""
    df = df.drop(name)
    bias = model.bias
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in steps(batch, text):
                total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for h, row in _features(part.column(part.schema.get_field_index(text)).to_pylist()):
                    total += np.bincount(row, w[h], part.num_rows)
                    n += np.bincount(row, minlength=part.num_rows)
                z = bias + total / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` double")


def draw(labels: DataFrame, docs: DataFrame, label: str, keep, size: int, one: int = ONE, total: int = TOTAL) -> DataFrame:
    """Texts and labels of at most ``size`` labelled documents, drawn by a hash of doc_id from those that ``keep`` allows.

    Only texts of at most ``one`` bytes are drawn, and in all at most ``total`` bytes. A doc_id with both labels has
    none; of rows that share a doc_id the one of the least hash of its text is meant, and taken once.
    """
    told = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id")
    told = told.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_other")).where("label = _other")
    first = told.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` narrow rows: the bound is the parameter.
    texts = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    own = F.struct(F.xxhash64("text").alias("_h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_n"))
    meant = texts.groupBy("doc_id").agg(F.min(own).alias("_m")).select("doc_id", "_m.*").where(F.col("_n") <= one)
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = meant.withColumn("_sum", F.sum("_n").over(before)).where(F.col("_sum") <= total).select("doc_id", "_h")
    picked = texts.withColumn("_h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "_h"])
    return picked.dropDuplicates(["doc_id"]).select("label", "text")


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score. Labels come only from documents outside fold 0 of 5.

    Null and empty texts get the score of a document without features. Rows that repeat are scored alike.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(draw(table(spark, sf_dir, "labels"), docs, "quality", fold("doc_id", 5) != 0, SAMPLE), "text", "label")
    scored = score(docs, "text", model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
