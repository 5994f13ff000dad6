"""From raw documents to packed training sequences, in five stages.

Each stage reads all that the one before it kept, as a Parquet table, and returns its columns; the last returns packed
pieces. Columns beyond those of documents stay as they are up to the last stage, whatever their names; rows that repeat
are treated alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import op2_jaccard, op5_quality, op7_packing, op8_decontamination, op10_surrogates
from tidewell.llm.frames import fold, free_names
from tidewell.tables import materialize, table

#: Documents below this quality go.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier takes for good. It learns from labelled documents outside fold 0 of 5.

    Null and empty texts are judged as texts without features; ties do not matter, as each is judged alone.
    """
    sample = op5_quality.draw(table(spark, sf_dir, "labels"), docs, "quality", fold("doc_id", 5) != 0, op5_quality.SAMPLE)
    model = op5_quality.fit(sample, "text", "label")
    (name,) = free_names(docs, "_score")
    return op5_quality.score(docs, "text", model, name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one of the least doc_id, a null one before all others.

    Null, empty and wordless texts are copies of each other. Of rows with one doc_id the least hash of the text decides.
    """
    return op2_jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs; null, empty and wordless texts are such."""
    return op8_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data; n_chars, if there, follows the text. Null texts stay null."""
    (name,) = free_names(docs, "_found")
    done = op10_surrogates.replace_entities(docs, op10_surrogates.session_key(spark), "text", name).drop(name)
    counted = [F.coalesce(F.char_length("text"), F.col(f.name)).cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return done.select(counted)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens; null and empty texts are the end token alone."""
    pieces = op7_packing.pieces(docs.select("doc_id", "text"), "text", op7_packing.default_tokenizer())
    return op7_packing.pack(materialize(pieces))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: Learned weights, MinHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
