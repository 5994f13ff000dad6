"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram is its letters' vectors, shifted by their place
and multiplied; a document is the sum of its trigrams, and so is a language. A document belongs to the language
whose vector is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import fold
from tidewell.llm.vec import STEP, mix, segments, steps
from tidewell.tables import table

DIM = 1024
#: Characters that are looked at at once, and vectors of trigrams and texts that are held at once.
PART, VECTORS, TEXTS = STEP // 2, 8192, 1024


def letters(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vectors of code points; 0 stands for whatever is no letter."""
    words = mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), -1), axis=1)
    return bits[:, :dim].astype(np.int8) * 2 - 1


def bind(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of trigrams, given as three code points of 21 bits in one number."""
    low = np.uint64((1 << 21) - 1)
    out = None
    for place, shift in ((2, 42), (1, 21), (0, 0)):
        own, where = np.unique((grams >> np.uint64(shift)) & low, return_inverse=True)
        vectors = np.roll(letters(own, dim), place, axis=1)[where]
        out = vectors if out is None else out * vectors
    return out.astype(np.float32)


@cache
def _alpha() -> np.ndarray:
    """Which code points are letters."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigrams of all texts and the place in the list of the text of each, some of them at a time. Small letters, and one break for all between words.

    A text with a letter has a trigram at least.
    """
    for codes, row in segments([(t or "").lower() for t in texts], PART):
        known = np.where(_alpha()[codes], codes, 0).astype(np.uint64)
        keep = known > 0
        keep[0] = True
        keep[1:] |= (known[:-1] > 0) | (row[1:] != row[:-1])
        known, row = known[keep], row[keep]
        grams = (known[:-2] << np.uint64(42)) | (known[1:-1] << np.uint64(21)) | known[2:]
        at = np.flatnonzero((known[1:-1] > 0) & (row[:-2] == row[2:]))
        yield grams[at], row[1:-1][at]


def bundled(grams: np.ndarray, row: np.ndarray, n: int, dim: int = DIM) -> np.ndarray:
    """The sums of the vectors of each of ``n`` groups of trigrams, ``row`` telling the group: (n, dim).

    Vectors are made for some distinct trigrams at a time, and counted in for some groups at a time, so that neither
    large alphabets nor many short texts need much memory.
    """
    out = np.zeros((n, dim), np.float32)
    own, where = np.unique(grams, return_inverse=True)
    if len(own) > VECTORS:
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
    for a in range(0, len(own), VECTORS):
        vectors = bind(own[a : a + VECTORS], dim)
        part = slice(*np.searchsorted(where, (a, a + len(vectors)))) if len(own) > VECTORS else slice(None)
        gram, group = where[part] - a, row[part]
        for b in range(0, n, TEXTS):
            inside = (group >= b) & (group < b + TEXTS) if n > TEXTS else slice(None)
            m = min(TEXTS, n - b)
            counts = np.bincount((group[inside] - b) * len(vectors) + gram[inside], minlength=m * len(vectors))
            out[b : b + m] += counts.reshape(m, len(vectors)).astype(np.float32) @ vectors
    return out


def fit(df: DataFrame, text: str, lang: str, dim: int = DIM) -> dict[str, np.ndarray]:
    """One vector for each value of ``lang``, from all rows whose language is known.

    A task sums its rows to one vector a language; the sums of all tasks are added in two steps, so that even a
    language of most rows is never gathered in one place. The result is one vector a language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                names, which = np.unique(np.array(part.column(part.schema.get_field_index(lang)).to_pylist()), return_inverse=True)
                for grams, row in trigrams(texts):
                    for name, vector in zip(names.tolist(), bundled(grams, which[row], len(names), dim)):
                        found[name] = found.get(name, 0) + vector.astype(np.float64)
        if found:
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([part] * len(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["lang", "part", "vector"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in pdf["vector"]], axis=0)
        return pd.DataFrame({"lang": pdf["lang"][:1], "vector": [total.tobytes()]})

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias(lang), text).mapInArrow(bundle, "lang string, part int, vector binary")
    rows = rows.groupBy("lang", "part").applyInPandas(add, "lang string, vector binary")
    rows = rows.groupBy("lang").applyInPandas(add, "lang string, vector binary")
    return {r["lang"]: np.frombuffer(r["vector"]) for r in sorted(rows.collect())}


def identify(df: DataFrame, text: str, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine (below 0: 0). Ties go to the first language by name. Columns of those names are replaced.

    Null texts, and those without a letter, are ``und``; however long a text, it is read whole, a part at a time.
    """
    df = df.drop("lang_pred", "score")
    names = sorted(profiles)
    matrix = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-12) for n in names]).astype(np.float32)
    dim = matrix.shape[1] if names else DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, PART):
                n = part.num_rows
                has = np.zeros(n, bool)
                best, top = np.zeros(n, np.int64), np.zeros(n)
                docs = np.zeros((n, dim), np.float32)
                for grams, row in trigrams(part.column(part.schema.get_field_index(text)).to_pylist()):
                    has[row] = True
                    if names:
                        docs += bundled(grams, row, n, dim)
                if names:
                    cosine = (docs @ matrix.T) / np.maximum(np.linalg.norm(docs, axis=1), 1e-12)[:, None]
                    best, top = cosine.argmax(1), np.clip(cosine.max(1), 0, 1)
                said = [names[b] if h and names else "und" for b, h in zip(best, has)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(np.where(has, top, 0.0).astype(np.float64))], names=[*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language. Profiles come from the documents with a language outside fold 2 of 4.

    Null texts and texts without a letter are ``und`` with score 0; so are all where nothing could be learned.
    """
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(fold("doc_id", 4) != 2), "text", "lang")
    said = identify(docs.select("doc_id", "text"), "text", profiles)
    return said.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
