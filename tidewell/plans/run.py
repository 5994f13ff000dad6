"""A whole run by its configuration: inputs, exact sums, estimates at every query step, and the log of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import ChamferConfig
from tidewell.functions import vectors as V
from tidewell.operators import exact, geometry, lsh, stepwise, windows
from tidewell.sources import probe
from tidewell.sources.text_and_archives import read_exact_cache
from tidewell.tables import materialize


def inputs(spark: SparkSession, config: ChamferConfig) -> tuple[DataFrame, DataFrame]:
    """(a_id, vec) and (step, vec) from the folder: the larger set is A, both cut to their limits, then with the outlier.

    A file with the outlier comes before one without; where there is none, or if asked for, one is put in as A's last row.
    """
    plain, ready = probe.NAMES["a"], probe.NAMES["a_with_outlier"]
    found = None if config.no_outlier or config.inject_outlier else probe.first_existing(spark, config.data_dir, ready)
    a = probe.read_matrix(spark, found) if found else probe.load_matrix(spark, config.data_dir, plain)
    b = probe.load_matrix(spark, config.data_dir, probe.NAMES["b"])
    if a.count() < b.count():
        a, b = b, a
    a, b = (df if most is None else df.where(F.col("step") < most) for df, most in ((a, config.max_a), (b, config.max_b)))
    a = a.withColumnRenamed("step", "a_id")
    if not (config.no_outlier or found):
        a = geometry.inject_outlier(a, "a_id")
    dim = a.select(F.size("vec")).first()
    if dim is None:
        return a, b
    checked = lambda df, side: exact.require_capacity(df, config.n_max, side).withColumn("vec", V.require_dim(V.widen("vec"), dim[0]))
    return materialize(checked(a, "A")), materialize(checked(b, "B"))


def run(spark: SparkSession, config: ChamferConfig) -> DataFrame:
    """The log of a run, a row a query step: exact sum, estimates of the methods asked for, and their errors.

    The exact sums alone with ``exact_only``. Empty sides and an A without a row at a positive distance follow the estimators.
    """
    a, b = inputs(spark, config)
    first = a.where(F.col("a_id") == a.agg(F.min("a_id")).first()[0])
    n_a, n_b, dim = a.count(), b.count(), first.select(F.size("vec")).first()[0]
    window, every = config.windows(n_b)
    budget = config.budget or spark.range(1).select(V.default_t(F.lit(n_a))).first()[0]
    if config.both_dynamic:
        order = materialize(windows.merge_schedule(a.select(F.col("a_id").alias("idx")), b.select(F.col("step").alias("idx"))))
        place = lambda df, key, side: order.where(F.col("side") == side).join(df, F.col("idx") == F.col(key)).select("pos", "vec")
        left, right = materialize(place(a, "a_id", "A")), materialize(place(b, "step", "B"))
        steps = stepwise.Steps(window, every, n_a + n_b - 1)
        live_a, live_b = steps.live(left.withColumnRenamed("pos", "a_id"), "a_id"), steps.live(right.withColumnRenamed("pos", "b_id"), "b_id")
        chamfer = None if config.exact_cache else windows.both_dynamic(left, right, window, every).select("step", "chamfer")
    else:
        steps = stepwise.Steps(window, every, n_b - 1)
        live_a, live_b = steps.always(a), steps.live(b.withColumn("b_id", F.col("step")), "step")
        chamfer = None if config.exact_cache else windows.sliding_chamfer(a, b, window, every).select("step", "chamfer")
    if config.exact_cache:
        chamfer = read_exact_cache(spark, config.exact_cache)
    if config.exact_only:
        return chamfer
    reach = geometry.reach(a.select("vec").unionByName(b.select("vec")), first).first()[0]
    p = lsh.projection_for(config.n_max, dim, reach, config.rho, config.seed, config.k)
    found: dict[str, DataFrame] = {}

    def layers(buckets: stepwise.Buckets) -> stepwise.Layers:
        return stepwise.Layers(live_a, live_b, buckets, p.top, steps)

    if not config.grid_only:
        met = layers(stepwise.hashed(p))
        found["strat_est"] = found["e2lsh_est"] = stepwise.stratified(live_a, live_b, met, p, steps, budget, config.seed)
        if config.with_importance:
            found["is_est"] = stepwise.importance(live_a, live_b, met, p, steps, budget, config.seed)
    if not config.hashing_only:
        met = layers(stepwise.gridded(p.rho, p.top, config.seed))
        found["quadtree_est"] = stepwise.stratified(live_a, live_b, met, p, steps, budget, config.seed)
        found["uniform_est"] = stepwise.uniform(live_a, live_b, met, steps, budget, config.seed)
    layout = "importance" if config.with_importance else "hashing" if config.hashing_only else "tree" if config.grid_only else "full"
    return stepwise.cost_log(chamfer, found, layout)
