"""Exact nearest neighbours and Chamfer sums: against all of a small side at once, else block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.vectors import widen
from tidewell.tables import broadcast_if_small, materialize

#: Rows of one block. A pair of blocks is one unit of work: two matrices of this height and their product.
BLOCK = 2048
#: Numbers in the vectors of a side, counted first, up to which it is sent whole to every executor (64 MB in doubles).
WHOLE = 8_000_000
#: Pairs of rows that are measured at once, and distances that are held at once.
PAIRS, CELLS = 1 << 16, 1 << 22


def distinct_vectors(v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``v``, each with the least of its ids."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(v[order]) + 0.0
    _, first = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True)
    return rows[first], ids[order][first]


def measured(u: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, some at a time."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = ((u[rows[part]] - v[cols[part]]) ** 2).sum(1)
    return out


def least_measured(u: np.ndarray, v: np.ndarray, near: np.ndarray, slack: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``u`` the place of its nearest row of ``v``, and the squared distance; ties go to the least of ``ids``.

    ``near`` are squared distances up to an amount that is the same along a row; matrix products lose digits for close
    pairs, so all within ``slack`` of a row's least are measured again.
    """
    close = near <= (near.min(1) + slack)[:, None]
    rows, cols = np.nonzero(close)
    exact = measured(u, v, rows, cols)
    if len(rows) > len(u):
        order = np.lexsort((ids[cols], exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        rows, cols, exact = rows[first], cols[first], exact[first]
    return cols, exact


def closest(u: np.ndarray, v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``u`` the id of its nearest row of ``v`` and the squared distance; rows of ``v`` are distinct; ties go to the least id."""
    squares = (v * v).sum(1)
    names, least = np.empty(len(u), ids.dtype), np.empty(len(u))
    step = max(1, CELLS // len(v))
    for at in range(0, len(u), step):
        w = u[at : at + step]
        slack = 1e-9 * (1 + (w * w).sum(1) + squares.max())
        cols, exact = least_measured(w, v, squares[None, :] - 2 * (w @ v.T), slack, ids)
        names[at : at + step], least[at : at + step] = ids[cols], exact
    return names, least


def matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls, whose lists are of one length, as a matrix of doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _against_whole(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Neighbours among the rows of a side that has proved small: it is broadcast, ``a`` is not moved."""
    rows = b.where("vec IS NOT NULL").select(F.col(b_id).cast("long"), "vec").toPandas()
    v, ids = distinct_vectors(np.stack(rows["vec"].to_numpy()).astype(np.float64), rows.iloc[:, 0].to_numpy())
    whole = a.sparkSession.sparkContext.broadcast((v, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ids = whole.value
        for batch in batches:
            if batch.num_rows:
                names, sq = closest(matrix(batch.column(1)), v, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.sqrt(sq))], names=[a_id, b_id, "dist"])

    own = a.where("vec IS NOT NULL").select(F.col(a_id).cast("long").alias(a_id), "vec")
    return own.mapInArrow(run, f"`{a_id}` long, `{b_id}` long, dist double")


def _dealt(df: DataFrame, by: list[str], id_col: str, own: int, other: int, side: int) -> DataFrame:
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(own)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    mine, theirs = ("i", "j") if side == 0 else ("j", "i")
    return df.where("vec IS NOT NULL").select(*by, block.alias(mine), F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"), "vec", every.alias(theirs)).select(*by, "i", "j", "side", "id", "vec")


def nearest(a: DataFrame, b: DataFrame, a_id: str = "a_id", b_id: str = "b_id", by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """For each row of ``a`` its nearest row of ``b``: (*by, a_id, b_id, dist); ties go to the smallest ``b_id``.

    ``a`` and ``b`` hold an id, ``vec`` and the columns ``by``, within whose values neighbours are sought. A side ``b``
    of at most WHOLE numbers goes to all executors at once, and ``a`` is read where it lies. Beyond that, and within
    ``by``, each side is dealt into blocks of bounded size by a hash of the id and sent once to every block of the
    other, so a task never holds more than two blocks, whatever the sizes; partial minima are merged by id. Rows with a
    null vector are left out; where ``b`` is empty there are no rows.
    """
    by = by or []
    if not by and block == BLOCK:
        n, width = b.where("vec IS NOT NULL").agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        if n and n * max(width, 1) <= WHOLE:
            return _against_whole(a, b, a_id, b_id)
    if by:
        most = lambda df: (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0)
    else:
        most = lambda df: df.count()
    n_a, n_b = max(1, -(-most(a) // block)), max(1, -(-most(b) // block))
    both = _dealt(a, by, a_id, n_a, n_b, 0).unionByName(_dealt(b, by, b_id, n_b, n_a, 1))
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "id long, other long, sq double"
    names = [*by, "id", "other", "sq"]

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({n: pd.Series(dtype=pdf[n].dtype if n in pdf else "int64" if n == "other" else "float64") for n in names})
        u, v = (np.stack(s.vec.to_numpy()).astype(np.float64) for s in (x, y))
        other, sq = closest(u, *distinct_vectors(v, y.id.to_numpy()))
        out = {c: [pdf[c].iloc[0]] * len(x) for c in by}
        return pd.DataFrame(out | {"id": x.id.to_numpy(), "other": other, "sq": sq})[names]

    parts = both.groupBy(*by, "i", "j").applyInPandas(pair, schema)
    best = parts.groupBy(*by, "id").agg(F.min(F.struct("sq", "other")).alias("m"))
    return best.select(*by, F.col("id").alias(a_id), F.col("m.other").alias(b_id), F.sqrt("m.sq").alias("dist"))


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of nearest distances and the rows of ``a``. No rows of ``a``: 0; none of ``b``: infinite."""
    n_a = a.where("vec IS NOT NULL").count()
    total: Column = F.coalesce(F.sum("dist"), F.lit(float("inf") if n_a else 0.0))
    return nearest(a, b).agg(total.alias("chamfer"), F.lit(n_a).cast("long").alias("n_a"))


class BruteForce:
    """Nearest neighbours among vectors that are put in one by one, as on one machine: clear, insert, size, query."""

    def __init__(self, dim: int):
        self.dim = dim
        self.rows: list[np.ndarray] = []

    def clear(self) -> None:
        self.rows = []

    def insert(self, vec) -> None:
        x = np.asarray(vec, np.float64)
        if x.shape != (self.dim,):
            raise ValueError(f"a vector of dimension {x.shape} among those of {self.dim}")
        self.rows.append(x)

    def size(self) -> int:
        return len(self.rows)

    def query(self, vec) -> tuple[int, float]:
        """The place of the nearest vector and its distance; without vectors there is none, which is an error."""
        if not self.rows:
            raise ValueError("no vectors to search")
        names, sq = closest(np.asarray(vec, np.float64)[None, :], *distinct_vectors(np.stack(self.rows), np.arange(len(self.rows))))
        return int(names[0]), float(np.sqrt(sq[0]))


def require_capacity(df: DataFrame, n_max: int, side: str) -> DataFrame:
    """``df`` if it has at most ``n_max`` rows; more are an error, as what is built for ``n_max`` would not hold for them."""
    n = df.count()
    if n > n_max:
        raise ValueError(f"{n} rows of {side}, but at most {n_max} are allowed")
    return df


def _matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Coordinates are compared by 128 bits. Where the cells of ``b`` are few they are broadcast, and no row of ``a`` is moved."""
    names = [F.xxhash64(widen("vec")), F.xxhash64(F.lit(9), widen("vec"))]
    cells_ = materialize(b.where("vec IS NOT NULL").select(names[0].alias("_c1"), names[1].alias("_c2")).distinct())
    return a.join(broadcast_if_small(cells_), a["vec"].isNotNull() & (names[0] == F.col("_c1")) & (names[1] == F.col("_c2")), how)


def with_exact_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose very coordinates are in ``b``."""
    return _matched(a, b, "left_semi")


def without_exact_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` at a positive distance from all of ``b``."""
    return _matched(a, b, "left_anti")


def cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct coordinates with their counts on both sides."""
    both = a.select("vec", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("vec", F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy("vec").agg(F.sum("x").alias("a_count"), F.sum("y").alias("b_count"))
