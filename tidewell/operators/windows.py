"""Count-based sliding windows: over B alone, or over one merged schedule of A and B."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.exact import BLOCK, CELLS, least_measured

#: Rows of B that a task holds at most.
LONG_BLOCK = 8192


def is_query_step(step: Column | str, window: int, every: int) -> Column:
    """Steps at which a query is asked: not before the window is full, each ``every``-th."""
    s = F.col(step) if isinstance(step, str) else step
    return (s >= window) & (s % every == 0)


def _parts(a: DataFrame, b: DataFrame, window: int, every: int, last: int, block: int, summed: bool) -> DataFrame:
    """Nearest live rows of B at each query step, each distance computed once for all windows that hold the pair.

    ``a``: id, vec, and lo and hi, the query steps at which a row is live; ``b``: pos, vec; ``last``: the last position.
    Positions are cut into segments of at least a window's length, each with the window before it. A task is a segment,
    a block of A and a stretch of B: every distance is computed at most twice over all tasks. A query step then takes
    the least of its stretch of the matrix. Minima of several stretches of B are merged by step and row. ``summed``:
    (step, chamfer, n), with sums made in the tasks, so that |A| rows a step are sent only where B has several
    stretches; otherwise (step, id, sq).
    """
    length = max(window, 1024)
    segments = 1 + last // length
    stretches = -(-(length + window) // LONG_BLOCK)
    direct = summed and stretches == 1
    a = a.where("vec IS NOT NULL")
    blocks = max(1, -(-a.count() // block))
    here = F.sequence(F.floor(F.col("lo") / length).cast("int"), F.least(F.floor(F.col("hi") / length), F.lit(segments - 1)).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i")
    left = a.where("lo <= hi").select(mine, F.explode(here).alias("seg"), F.lit(0).alias("side"), "id", "lo", "hi", "vec")
    left = left.select("i", "seg", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))).alias("j"), "side", "id", "lo", "hi", "vec")
    own = F.floor(F.col("pos") / length).cast("int")
    seen = F.filter(F.array(own, own + 1), lambda s: (s < segments) & (F.col("pos") > s * length - window))
    right = b.where("vec IS NOT NULL").withColumn("seg", F.explode(seen)).withColumn("j", F.floor((F.col("pos") - F.col("seg") * length + window) / LONG_BLOCK).cast("int"))
    zero = F.lit(0).cast("long")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), "seg", "j", F.lit(1).alias("side"), F.col("pos").cast("long").alias("id"), zero.alias("lo"), zero.alias("hi"), "vec")

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        sums: dict[int, list[float]] = {}
        rows: list[pd.DataFrame] = []
        if len(x) and len(y):
            u, v = (np.stack(s.vec.to_numpy()).astype(np.float64) for s in (x, y))
            ids, lo, hi, at = x.id.to_numpy(), x.lo.to_numpy(), x.hi.to_numpy(), y.id.to_numpy()
            first = int(pdf.seg.iloc[0]) * length
            ask = [s for s in range(-(-max(first, window) // every) * every, min(first + length - 1, last) + 1, every)]
            ends = [(s, np.searchsorted(at, s - window, "right"), np.searchsorted(at, s, "right")) for s in ask]
            squares = (v * v).sum(1)
            # As many rows of A at once as keep the matrix of distances small, whatever the window.
            for k in range(0, len(u), max(1, CELLS // len(v))):
                part = slice(k, k + max(1, CELLS // len(v)))
                w = u[part]
                near = squares[None, :] - 2 * (w @ v.T)
                slack = 1e-9 * (1 + (w * w).sum(1) + squares.max())
                for s, begin, end in ends:
                    live = np.flatnonzero((lo[part] <= s) & (s <= hi[part]))
                    if end > begin and len(live):
                        _, sq = least_measured(w[live], v[begin:end], near[live, begin:end], slack[live], at[begin:end])
                        if direct:
                            own = sums.setdefault(s, [0.0, 0])
                            own[0] += np.sqrt(sq).sum()
                            own[1] += len(live)
                        else:
                            rows.append(pd.DataFrame({"step": s, "id": ids[part][live], "sq": sq}))
        if direct:
            return pd.DataFrame([(s, t, n) for s, (t, n) in sums.items()], columns=["step", "chamfer", "n"])
        return pd.concat(rows) if rows else pd.DataFrame({"step": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "sq": np.zeros(0)})

    schema = "step long, chamfer double, n long" if direct else "step long, id long, sq double"
    found = left.unionByName(right).groupBy("i", "seg", "j").applyInPandas(slide, schema)
    if direct:
        return found.groupBy("step").agg(F.sum("chamfer").alias("chamfer"), F.sum("n").alias("n"))
    merged = found if stretches == 1 else found.groupBy("step", "id").agg(F.min("sq").alias("sq"))
    if not summed:
        return merged
    return merged.groupBy("step").agg(F.sum(F.sqrt("sq")).alias("chamfer"), F.count(F.lit(1)).alias("n"))


def _sliding(a: DataFrame, b: DataFrame, window: int, every: int, block: int, summed: bool) -> DataFrame:
    last = b.agg(F.max("step")).first()[0] or 0
    always = a.select(F.col("a_id").cast("long").alias("id"), F.lit(-(-window // every) * every).cast("long").alias("lo"), F.lit(last).cast("long").alias("hi"), "vec")
    return _parts(always, b.select(F.col("step").alias("pos"), "vec"), window, every, last, block, summed)


def sliding_nearest(a: DataFrame, b: DataFrame, window: int, every: int, block: int = BLOCK) -> DataFrame:
    """(step, a_id, dist) for each query step: the nearest of the last ``window`` rows of ``b``. ``a``: a_id, vec; ``b``: step, vec."""
    found = _sliding(a, b, window, every, block, False)
    return found.select("step", F.col("id").alias("a_id"), F.sqrt("sq").alias("dist"))


def sliding_chamfer(a: DataFrame, b: DataFrame, window: int, every: int, block: int = BLOCK) -> DataFrame:
    """(step, chamfer, n_a) for each query step: the sum of the distances of ``sliding_nearest``, added up within the tasks."""
    return _sliding(a, b, window, every, block, True).withColumnRenamed("n", "n_a")


def merge_schedule(n_a: DataFrame, n_b: DataFrame) -> DataFrame:
    """(pos, side, idx): A and B rows in one order, in proportion to their numbers; ``n_a``, ``n_b``: the columns idx, from 0.

    Row i of A stands at (i+1) |B|, row j of B at (j+1) |A|; A goes first where they are equal. The place follows
    from counting: before row i of A are i rows of A and the rows of B that stand strictly before it.
    """
    a, b = n_a.count(), n_b.count()
    pos_a = F.col("idx") + F.when(F.lit(a) == 0, 0).otherwise(F.floor(((F.col("idx") + 1) * b - 1) / F.lit(max(a, 1))))
    pos_b = F.col("idx") + F.when(F.lit(b) == 0, 0).otherwise(F.least(F.lit(a), F.floor((F.col("idx") + 1) * a / F.lit(max(b, 1)))))
    left = n_a.select(pos_a.cast("long").alias("pos"), F.lit("A").alias("side"), F.col("idx").cast("long").alias("idx"))
    return left.unionByName(n_b.select(pos_b.cast("long").alias("pos"), F.lit("B").alias("side"), F.col("idx").cast("long").alias("idx")))


def both_dynamic(a: DataFrame, b: DataFrame, window: int, every: int, pinned: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(step, chamfer, n_a, n_b) where one window of ``window`` places holds rows of both sides. ``a``, ``b``: pos, vec.

    ``pinned``: rows (pos, vec) of A that are live always, with positions of their own below 0. Steps at which a side is
    empty are left out.
    """
    last = a.select("pos").unionByName(b.select("pos")).agg(F.max("pos")).first()[0] or 0
    first = F.greatest(F.ceil(F.greatest(F.col("pos"), F.lit(window)) / every) * every, F.lit(0))
    final = F.least(F.col("pos") + window - 1, F.lit(last))
    live = lambda df: df.withColumn("lo", first.cast("long")).withColumn("hi", (F.floor(final / every) * every).cast("long"))
    rows = live(a).select(F.col("pos").cast("long").alias("id"), "lo", "hi", "vec")
    if pinned is not None:
        always = (F.lit(-(-window // every) * every).cast("long").alias("lo"), F.lit(last // every * every).cast("long").alias("hi"))
        rows = rows.unionByName(pinned.select(F.col("pos").cast("long").alias("id"), *always, "vec"))
    found = _parts(rows, b, window, every, last, block, True)
    counts = live(b).where("vec IS NOT NULL AND lo <= hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_b"))
    counts = counts.select(F.explode(F.sequence("lo", "hi", F.lit(every).cast("long"))).alias("step"), "n_b").groupBy("step").agg(F.sum("n_b").alias("n_b"))
    return found.withColumnRenamed("n", "n_a").join(counts, "step").select("step", "chamfer", "n_a", "n_b")


def block_sliding_min(df: DataFrame, key: str, step: str, value: str, window: int, name: str) -> DataFrame:
    """Add the least ``value`` of the last ``window`` steps of each key, from prefix and suffix minima of window-long blocks.

    Steps must be gapless. Two running minima replace a frame that would be read again for every row.
    """
    block = F.floor(F.col(step) / window)
    down = Window.partitionBy(key, "_b").orderBy(F.col(step)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(key, "_b").orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_b", block).withColumn("_head", F.min(value).over(down)).withColumn("_tail", F.min(value).over(up))
    tails = own.select(F.col(key).alias("_k"), (F.col(step) + window - 1).alias("_s"), F.col("_tail").alias("_before"))
    joined = own.join(tails, (F.col(key) == F.col("_k")) & (F.col(step) == F.col("_s")), "left")
    return joined.withColumn(name, F.least("_head", F.coalesce("_before", F.col("_head")))).drop("_b", "_head", "_tail", "_k", "_s", "_before")
