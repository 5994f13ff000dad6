"""Which input is there, and the reader for it. Paths go through Spark's file systems, so they may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import text_and_archives, vector_files
from tidewell.tables import materialize

# File names of each side, best first; those of A with and without an outlier.
NAMES = {
    "a": ("base.f32bin", "train.f32bin", "train.csv", "base.fvecs", "sift_base.fvecs"),
    "a_with_outlier": ("base_with_outlier.f32bin", "train_with_outlier.f32bin", "base_with_outlier.fvecs", "train_with_outlier.csv"),
    "b": ("query.f32bin", "query.fvecs", "test.f32bin", "test.csv", "sift_query.fvecs"),
}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str | None:
    """The first of ``names`` that is in ``folder``."""
    return next((p for n in names if exists(spark, p := f"{folder.rstrip('/')}/{n}")), None)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``step``: 0, 1, ... in the order in which its files are read, from counts by partition alone."""
    rows = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_part"]], total = total, total + r["_n"]
    # One entry a partition of the files.
    base = F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)) if starts else F.lit(None).cast("map<bigint,bigint>")
    return rows.withColumn("step", base[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(step, vec) of a file or folder, by its suffix."""
    for kind in ("f32bin", "fvecs"):
        if path.endswith(f".{kind}"):
            return vector_files.read_vectors(spark, path, kind)
    if path.endswith(".csv"):
        return numbered(text_and_archives.read_csv_vectors(spark, path)).select("step", "vec")
    if path.endswith((".idx3", "-idx3-ubyte")):
        return text_and_archives.read_idx3(spark, path)
    raise ValueError(f"no reader for {path}")


def load_matrix(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """The rows of the first of ``names`` that is there; none is an error."""
    found = first_existing(spark, folder, names)
    if found is None:
        raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")
    return read_matrix(spark, found)
