"""All queries of the engine by name, each with the SQL that gives the same rows.

The point sets: A is the embeddings of even vec_id, B those of odd vec_id, in which vec_id also gives the step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import allocate, evaluate, exact, geometry, lsh, sampling, stepwise, upkeep, windows
from tidewell.sources import text_and_archives as text_files
from tidewell.sources import vector_files
from tidewell.streaming.sliding import sliding_parts
from tidewell.tables import materialize, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WINDOW, EVERY = 50, 10
SEED = 11
BUDGET = 60
#: Few projections keep the SQL short; the layers reach from rho to twice the diameter of the unit sphere.
HASH = lsh.Projection(k=6, dim=64, rho=1e-3, top=12)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("vec"))


def _b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select(F.col("vec_id").alias("b_id"), ((F.col("vec_id") - 1) / 2).cast("long").alias("step"), F.col("embedding").alias("vec"))


def _points(spark: SparkSession, sf_dir: str, residue: int) -> DataFrame:
    """Line items as two-dimensional points with many repeats: quantity and discount, by the parity of the order."""
    own = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 2 == residue)
    return own.select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity"), F.col("l_discount")).alias("vec"))


_AB = """a AS (SELECT vec_id AS a_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id AS b_id, (vec_id - 1) // 2 AS step, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 2 = 1)"""
_NN = f"{_AB}, nn AS (SELECT a_id, min(list_distance(a.vec, b.vec)) AS dist, arg_min(b_id, (list_distance(a.vec, b.vec), b_id)) AS b_id FROM a, b GROUP BY a_id)"
_PTS = """a AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_discount] AS vec FROM lineitem WHERE l_orderkey % 2 = 0),
b AS (SELECT [l_quantity, l_discount] AS vec FROM lineitem WHERE l_orderkey % 2 = 1)"""


# Exact distances and joins


@_query(f"WITH {_NN} SELECT round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM nn")
def exact_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.chamfer(_a(spark, sf_dir), _b(spark, sf_dir)).select(F.round("chamfer", 4).alias("chamfer"), "n_a")


@_query(f"WITH {_NN} SELECT a_id, round(dist, 6) AS dist FROM nn")
def nn_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.nearest(_a(spark, sf_dir), _b(spark, sf_dir)).select("a_id", F.round("dist", 6).alias("dist"))


@_query(f"WITH {_AB} SELECT a_id, b_id FROM (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY list_distance(a.vec, b.vec), b_id) AS r FROM a, b) WHERE r = 1")
def nn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.nearest(_a(spark, sf_dir), _b(spark, sf_dir)).select("a_id", "b_id")


@_query(f"WITH {_AB} SELECT vec_id, round(list_distance(embedding::DOUBLE[], b.vec), 6) AS l2, round(list_distance(embedding::DOUBLE[], b.vec) ** 2, 6) AS squared, round(list_dot_product(embedding::DOUBLE[], b.vec), 6) AS dot FROM embeddings, b WHERE b_id = 1")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _b(spark, sf_dir).where("b_id = 1").select(F.col("vec").alias("o"))
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(one), F.lit(True))
    return rows.select("vec_id", F.round(V.l2("embedding", "o"), 6).alias("l2"), F.round(V.squared_l2("embedding", "o"), 6).alias("squared"), F.round(V.dot("embedding", "o"), 6).alias("dot"))


@_query(f"WITH {_PTS} SELECT l_orderkey, l_linenumber FROM a WHERE vec IN (SELECT vec FROM b)")
def exact_match_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.with_exact_match(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1)).select("l_orderkey", "l_linenumber")


@_query(f"WITH {_PTS} SELECT l_orderkey, l_linenumber FROM a WHERE vec NOT IN (SELECT vec FROM b)")
def positive_distance_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.without_exact_match(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1)).select("l_orderkey", "l_linenumber")


@_query(f"""WITH {_PTS} SELECT vec[1] AS x, vec[2] AS y, sum(p)::BIGINT AS a_count, sum(q)::BIGINT AS b_count
FROM (SELECT vec, 1 AS p, 0 AS q FROM a UNION ALL SELECT vec, 0, 1 FROM b) GROUP BY vec""")
def exact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.cells(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1)).select(F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), "a_count", "b_count")


# Windows

_SLIDE = f"""WITH {_AB}, q AS (SELECT step AS s FROM b WHERE step >= {WINDOW} AND step % {EVERY} = 0),
m AS (SELECT s, a_id, min(list_distance(a.vec, b.vec)) AS dist FROM q, b, a WHERE b.step > s - {WINDOW} AND b.step <= s GROUP BY s, a_id)"""


@_query(f"{_SLIDE} SELECT s AS step, round(sum(dist), 4) AS chamfer FROM m GROUP BY s")
def sliding_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact_steps(spark, sf_dir).select("step", F.round("chamfer", 4).alias("chamfer"))


@_query(f"{_SLIDE} SELECT s AS step, count(*) AS n_a, round(min(dist), 6) AS least, round(max(dist), 6) AS largest FROM m GROUP BY s")
def sliding_nn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_nearest(_a(spark, sf_dir), _b(spark, sf_dir).select("step", "vec"), WINDOW, EVERY)
    return found.groupBy("step").agg(F.count(F.lit(1)).alias("n_a"), F.round(F.min("dist"), 6).alias("least"), F.round(F.max("dist"), 6).alias("largest"))


@_query(f"SELECT o_custkey, s AS step, min(v) AS least FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS s, o_totalprice AS v0, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM orders) GROUP BY ALL")
def sliding_min_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_custkey", step.cast("long").alias("step"), "o_totalprice")
    return windows.block_sliding_min(rows, "o_custkey", "step", "o_totalprice", 3, "least").select("o_custkey", "step", "least")


_SCHEDULE = """ia AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 4 <> 1),
ib AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 4 = 1),
n AS (SELECT (SELECT count(*) FROM ia) AS na, (SELECT count(*) FROM ib) AS nb),
sch AS (SELECT row_number() OVER (ORDER BY k, side) - 1 AS pos, side, idx, vec FROM (
  SELECT (idx + 1) * nb AS k, 'A' AS side, idx, vec FROM ia, n UNION ALL SELECT (idx + 1) * na, 'B', idx, vec FROM ib, n))"""


def _uneven(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings, three of four in A and the fourth in B, each side numbered from 0 (vec_id is gapless)."""
    e = table(spark, sf_dir, "embeddings")
    of_four = F.col("vec_id") % 4
    index = F.floor(F.col("vec_id") / 4)
    a = e.where(of_four != 1).select((3 * index + F.greatest(of_four - 1, F.lit(0))).cast("long").alias("idx"), F.col("embedding").alias("vec"))
    return a, e.where(of_four == 1).select(index.cast("long").alias("idx"), F.col("embedding").alias("vec"))


def _scheduled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = _uneven(spark, sf_dir)
    s = windows.merge_schedule(a.select("idx"), b.select("idx"))
    own = lambda df, side: s.where(F.col("side") == side).join(df, "idx").select("pos", "vec")
    return own(a, "A"), own(b, "B")


@_query(f"WITH {_SCHEDULE} SELECT pos, side, idx FROM sch")
def merge_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _uneven(spark, sf_dir)
    return windows.merge_schedule(a.select("idx"), b.select("idx"))


_DUAL = f"""WITH {_SCHEDULE}, q AS (SELECT pos AS s FROM sch WHERE pos >= 60 AND pos % 20 = 0),
la AS (SELECT s, pos, vec FROM q, sch WHERE side = 'A' AND pos > s - 60 AND pos <= s <PIN>),
lb AS (SELECT s, pos, vec FROM q, sch WHERE side = 'B' AND pos > s - 60 AND pos <= s),
m AS (SELECT la.s, la.pos, min(list_distance(la.vec, lb.vec)) AS dist FROM la, lb WHERE la.s = lb.s GROUP BY ALL),
nb AS (SELECT s, count(*) AS n_b FROM lb GROUP BY s)
SELECT s AS step, round(sum(dist), 4) AS chamfer, count(*) AS n_a, n_b FROM m JOIN nb USING (s) GROUP BY s, n_b"""
_PIN = "UNION ALL SELECT s, -1, (SELECT vec FROM ia WHERE idx = 0) FROM q"


@_query(_DUAL.replace("<PIN>", ""))
def both_dynamic_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.both_dynamic(*_scheduled(spark, sf_dir), 60, 20).select("step", F.round("chamfer", 4).alias("chamfer"), "n_a", "n_b")


@_query(_DUAL.replace("<PIN>", _PIN))
def both_dynamic_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(-1).cast("long").alias("pos"), F.col("embedding").alias("vec"))
    return windows.both_dynamic(*_scheduled(spark, sf_dir), 60, 20, pin).select("step", F.round("chamfer", 4).alias("chamfer"), "n_a", "n_b")


@_query("SELECT vec_id AS step FROM embeddings WHERE vec_id >= 50 AND vec_id % 17 = 0")
def query_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(windows.is_query_step("vec_id", 50, 17)).select(F.col("vec_id").alias("step"))


# Geometry

_CENTROID = f"WITH {_AB}, x AS (SELECT a_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS pos FROM a), c AS (SELECT pos, avg(v) AS mean FROM x GROUP BY pos)"


@_query(f"{_CENTROID} SELECT pos::INTEGER AS pos, round(mean, 6) AS mean FROM c")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.centroid(_a(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"))


@_query(f"""{_CENTROID}, f AS (SELECT pos, v FROM x WHERE a_id = (SELECT min(a_id) FROM a)), n AS (SELECT count(*) AS n FROM a)
SELECT (SELECT max(a_id) + 1 FROM a) AS a_id, pos::INTEGER AS pos, round(mean + 0.1 * n * (v - mean), 4) AS y FROM c JOIN f USING (pos), n""")
def inject_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir)
    top = a.agg(F.max("a_id")).first()[0]
    return geometry.inject_outlier(a, "a_id").where(F.col("a_id") > top).select("a_id", F.posexplode("vec").alias("pos", "y")).select("a_id", "pos", F.round("y", 4).alias("y"))


@_query("WITH o AS (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0) SELECT round(2 * max(list_distance(embedding::DOUBLE[], o)), 6) AS diameter FROM embeddings, o")
def diameter_2approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return geometry.reach(e, e.where("vec_id = 0")).select(F.round(2 * F.col("reach"), 6).alias("diameter"))


@_query("""WITH o AS (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0), r AS (SELECT max(list_distance(embedding::DOUBLE[], o)) AS r FROM embeddings, o)
SELECT round(r, 6) AS reach, greatest(0, ceil(log2((2 * r - 1e-15) / 1e-4)))::INTEGER AS top FROM r""")
def range_and_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    reach = geometry.reach(e, e.where("vec_id = 0")).first()[0]
    return spark.range(1).select(F.round(F.lit(reach), 6).alias("reach"), F.lit(geometry.levels(reach, 1e-4)).alias("top"))


@_query("SELECT o_orderkey AS n, greatest(1, ceil(4 * ln(8 * o_orderkey::DOUBLE * o_orderkey)))::INTEGER AS k, greatest(1, floor(15 * log2(o_orderkey)))::INTEGER AS t FROM orders WHERE o_orderkey > 0")
def scalar_k_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("n"), V.compute_k("o_orderkey").alias("k"), V.default_t("o_orderkey").alias("t"))


@_query("SELECT vec_id, (floor((100 - vec_id) / 2))::BIGINT AS half FROM embeddings")
def floor_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.floor_half((100 - F.col("vec_id")).cast("long")).alias("half"))


# Hashing and strata; the projection's numbers are written into the SQL as literals.

_G = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in HASH.directions) + "]"
_S = "[" + ", ".join(repr(float(x)) for x in HASH.starts) + "]"
_C = "[" + ", ".join("[" + ", ".join(str(int(x)) for x in row) + "]" for row in HASH.carries) + "]"
_J = range(1, HASH.k + 1)
_H0 = "[" + ", ".join(f"floor((list_dot_product(vec, g[{j}]) + s[{j}]) / {HASH.k * HASH.rho!r})::BIGINT" for j in _J) + "]"
_KEY = "[" + ", ".join(f"(h0[{j}] + c[layer + 1][{j}]) >> layer" for j in _J) + "]"
_LSH = f"""{_AB}, p AS (SELECT {_G}::DOUBLE[][] AS g, {_S}::DOUBLE[] AS s, {_C}::BIGINT[][] AS c), l AS (SELECT unnest(range(0, {HASH.top + 1}))::INTEGER AS layer),
ha AS (SELECT a_id, vec, {_H0} AS h0 FROM a, p), hb AS (SELECT b_id, vec, {_H0} AS h0 FROM b, p),
ka AS (SELECT a_id, vec, layer, {_KEY} AS key FROM ha, l, p), kb AS (SELECT b_id, layer, {_KEY} AS key FROM hb, l, p)"""
_COL = f"""{_LSH}, met AS (SELECT a_id, min(layer) AS layer FROM ka JOIN (SELECT DISTINCT layer, key FROM kb) USING (layer, key) GROUP BY a_id),
fc AS (SELECT a_id, CASE WHEN vec IN (SELECT vec FROM b) THEN -2 ELSE coalesce(met.layer, {HASH.top + 1}) END::INTEGER AS layer FROM a LEFT JOIN met USING (a_id)),
st AS (SELECT layer, count(*) AS n, count(*) * {HASH.rho!r} * 2.0 ** layer AS w FROM fc WHERE layer >= 0 GROUP BY layer)"""


def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.first_collision(_a(spark, sf_dir), _b(spark, sf_dir), HASH)


@_query(f"WITH {_LSH} SELECT a_id, array_to_string(h0, ',') AS h0 FROM ha")
def h0_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.with_h0(_a(spark, sf_dir), HASH).select("a_id", F.array_join(F.col("h0").cast("array<string>"), ",").alias("h0"))


@_query(f"WITH {_LSH} SELECT a_id, layer, array_to_string(key, ',') AS key FROM ka")
def layer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.with_layers(lsh.with_h0(_a(spark, sf_dir), HASH).select("a_id", "h0"), HASH).select("a_id", "layer", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"))


@_query(f"WITH {_LSH} SELECT layer, array_to_string(key, ',') AS key, sum(x)::BIGINT AS a_count, sum(y)::BIGINT AS b_count FROM (SELECT layer, key, 1 AS x, 0 AS y FROM ka UNION ALL SELECT layer, key, 0, 1 FROM kb) GROUP BY layer, key")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.bucket_counts(_a(spark, sf_dir), _b(spark, sf_dir), HASH).select("layer", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"), "a_count", "b_count")


@_query(f"WITH {_COL} SELECT a_id, layer FROM fc")
def first_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collisions(spark, sf_dir)


@_query(f"WITH {_COL} SELECT layer, n FROM st")
def strata_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.strata(_collisions(spark, sf_dir), HASH).select("layer", "n")


@_query(f"WITH {_COL} SELECT layer, round(w, 6) AS w FROM st")
def strata_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.strata(_collisions(spark, sf_dir), HASH).select("layer", F.round("w", 6).alias("w"))


@_query(f"WITH {_COL} SELECT round(sum(w), 6) AS total FROM st")
def total_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.strata(_collisions(spark, sf_dir), HASH).agg(F.round(F.sum("w"), 6).alias("total"))


@_query(f"WITH {_COL} SELECT (SELECT sum(n) FROM st)::BIGINT AS in_strata, (SELECT count(*) FROM a WHERE vec NOT IN (SELECT vec FROM b)) AS positive")
def strata_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = exact.without_exact_match(_a(spark, sf_dir), _b(spark, sf_dir)).agg(F.count(F.lit(1)).alias("positive"))
    # Two single rows.
    return lsh.strata(_collisions(spark, sf_dir), HASH).agg(F.sum("n").alias("in_strata")).join(F.broadcast(positive), F.lit(True))


# Allocation; the nations of a region, by number and balance, are a second set of strata.

_HAM = """{src}, q AS (SELECT *, {total} * w / sum(w) OVER () AS q FROM {rows}), f AS (SELECT *, floor(q) AS fl, {total} - sum(floor(q)) OVER () AS left_ FROM q),
al AS (SELECT *, (fl + CASE WHEN row_number() OVER (ORDER BY q - fl DESC, layer) <= left_ THEN 1 ELSE 0 END)::BIGINT AS e FROM f)"""
_NATIONS = "st AS (SELECT c_nationkey AS layer, count(*) AS n, sum(abs(c_acctbal)::DECIMAL(18, 2))::DOUBLE AS w FROM customer GROUP BY c_nationkey)"
_FULL = _HAM.format(src=_COL, total=f"({BUDGET} - (SELECT count(*) FROM st))", rows="st") + ", gt AS (SELECT layer, n, w, 1 + e AS t_i FROM al)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.sum(F.abs("c_acctbal").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("layer")).agg(F.count(F.lit(1)).alias("n"), balance.alias("w"))


@_query("WITH " + _HAM.format(src=_NATIONS, total=100, rows="st") + " SELECT layer, e AS t_i FROM al")
def hamilton_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.hamilton(_nations(spark, sf_dir), 100).select("layer", "t_i")


@_query("WITH " + _HAM.format(src=_NATIONS, total="(100 - (SELECT count(*) FROM st))", rows="st") + " SELECT layer, 1 + e AS t_i FROM al")
def guaranteed_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.guaranteed(_nations(spark, sf_dir), 100).select("layer", "t_i")


@_query(f"WITH {_FULL} SELECT layer, n, t_i, t_i >= n AS is_full, least(t_i, n) AS n_drawn FROM gt")
def allocation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.allocation_stats(lsh.strata(_collisions(spark, sf_dir), HASH), BUDGET).select("layer", "n", "t_i", "is_full", "n_drawn")


# Sampling


def _u(stream: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}:{stream}'", *(f"({p})::VARCHAR" for p in parts)])
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / {float(1 << 48)!r})"


_RANKED = "rk AS (SELECT a_id, layer, row_number() OVER (PARTITION BY layer ORDER BY a_id) AS rank FROM fc WHERE layer >= 0)"
_DRAWS = f"""{_FULL}, {_RANKED}, tt AS (SELECT layer, n, t_i, unnest(range(1, least(t_i, n) + 1)) AS t FROM gt),
dr AS (SELECT tt.layer, t, a_id, n, t_i FROM tt JOIN rk ON tt.layer = rk.layer AND rk.rank = CASE WHEN t_i >= n THEN t ELSE 1 + floor({_u("stratum", "tt.layer", "t")} * n) END)"""
_D = "d AS (SELECT a_id, min(list_distance(a.vec, b.vec)) AS dist FROM a, b GROUP BY a_id)"


@_query(f"WITH {_DRAWS} SELECT layer, t, a_id FROM dr")
def stratified_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collisions(spark, sf_dir)
    return sampling.stratified_draws(c, allocate.allocation_stats(lsh.strata(c, HASH), BUDGET), SEED)


@_query(f"WITH {_DRAWS}, {_D} SELECT round(sum(CASE WHEN t_i >= n THEN dist ELSE dist * n / t_i END), 4) AS estimate FROM dr JOIN d USING (a_id)")
def stratified_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    return sampling.stratified(a, b, lsh.first_collision(a, b, HASH), HASH, BUDGET, SEED).select(F.round("estimate", 4).alias("estimate"))


@_query(f"WITH {_NN} SELECT round(sum(dist), 4) AS estimate FROM nn")
def stratified_full_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that covers every stratum: the estimate is the exact sum."""
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    return sampling.stratified(a, b, lsh.first_collision(a, b, HASH), HASH, 10_000_000, SEED).select(F.round("estimate", 4).alias("estimate"))


_IMP = f"""{_COL}, {_RANKED}, cw AS (SELECT layer, n, w, sum(w) OVER (ORDER BY layer) AS hi, sum(w) OVER () AS d FROM st),
ut AS (SELECT t, {_u("layer", "t")} AS u, {_u("row", "t")} AS v FROM (SELECT unnest(range(1, {BUDGET + 1})) AS t)),
im AS (SELECT t, cw.layer, d / ({HASH.rho!r} * 2.0 ** cw.layer) AS factor, a_id FROM ut JOIN cw ON u * d >= hi - w AND u * d < hi JOIN rk ON rk.layer = cw.layer AND rk.rank = 1 + floor(v * n))"""


@_query(f"WITH {_IMP} SELECT t, layer, a_id FROM im")
def importance_layer_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.importance_draws(_collisions(spark, sf_dir), HASH, BUDGET, SEED).select("t", "layer", "a_id")


@_query(f"WITH {_IMP}, {_D} SELECT round(avg(factor * dist), 3) AS estimate FROM im JOIN d USING (a_id)")
def importance_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    return sampling.importance(a, b, lsh.first_collision(a, b, HASH), HASH, BUDGET, SEED).select(F.round("estimate", 3).alias("estimate"))


_UNI = f"""{_AB}, n AS (SELECT count(*) AS n FROM a), rk AS (SELECT a_id, row_number() OVER (ORDER BY a_id) AS rank FROM a),
un AS (SELECT t, a_id, n FROM (SELECT t, n, 1 + floor({_u("uniform", "t")} * n) AS r FROM (SELECT unnest(range(1, {BUDGET + 1})) AS t), n) x JOIN rk ON rank = r)"""


@_query(f"WITH {_UNI}, {_D} SELECT round(any_value(n) / {BUDGET}.0 * sum(dist), 4) AS estimate FROM un JOIN d USING (a_id)")
def uniform_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(_a(spark, sf_dir), _b(spark, sf_dir), BUDGET, SEED).select(F.round("estimate", 4).alias("estimate"))


@_query(f"WITH {_UNI}, {_D} SELECT t, a_id, round(dist, 6) AS dist FROM un JOIN d USING (a_id)")
def dedup_draws_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir)
    return sampling.distances_of(sampling.uniform_draws(a, BUDGET, SEED), a, _b(spark, sf_dir)).select("t", "a_id", F.round("dist", 6).alias("dist"))


GRID = lsh.Projection(k=1, dim=64, rho=0.05, top=6)
_SHIFT = f"({_u('shift', '0')} * {GRID.rho * (1 << GRID.top)!r})"
_CELL = f"list_transform(vec, lambda x: floor((x + {_SHIFT}) / ({GRID.rho!r} * 2.0 ** layer))::BIGINT)"
_GRID_KEYS = f"""{_AB}, l AS (SELECT unnest(range(0, {GRID.top + 1}))::INTEGER AS layer),
ka AS (SELECT a_id, vec, layer, {_CELL} AS key FROM a, l), kb AS (SELECT b_id, layer, {_CELL} AS key FROM b, l)"""


def _stepped(keys: str, p: lsh.Projection, live: str) -> str:
    """Layers (fc) and strata (st) at each step s, from the keys ka and kb and the live pairs la (s, a_id, vec) and lb (s, b_id, vec)."""
    return f"""{keys}, {live},
sb AS (SELECT DISTINCT s, layer, key FROM lb JOIN kb USING (b_id)),
met AS (SELECT la.s, la.a_id, min(ka.layer) AS layer FROM la JOIN ka USING (a_id) JOIN sb ON sb.s = la.s AND sb.layer = ka.layer AND sb.key = ka.key GROUP BY ALL),
ex AS (SELECT DISTINCT la.s, la.a_id FROM la JOIN lb ON la.s = lb.s AND la.vec = lb.vec),
fc AS (SELECT la.s, la.a_id, CASE WHEN ex.a_id IS NOT NULL THEN -2 ELSE coalesce(met.layer, {p.top + 1}) END::INTEGER AS layer
  FROM la LEFT JOIN met ON met.s = la.s AND met.a_id = la.a_id LEFT JOIN ex ON ex.s = la.s AND ex.a_id = la.a_id),
st AS (SELECT s, layer, count(*) AS n, count(*) * {p.rho!r} * 2.0 ** layer AS w FROM fc WHERE layer >= 0 GROUP BY s, layer)"""


def _live(window: int, every: int) -> str:
    return f"""qs AS (SELECT step AS s FROM b WHERE step >= {window} AND step % {every} = 0),
lb AS (SELECT s, b_id, vec FROM qs, b WHERE step > s - {window} AND step <= s), la AS (SELECT s, a_id, vec FROM qs, a)"""


_NEAR = "d AS (SELECT la.s, la.a_id, min(list_distance(la.vec, lb.vec)) AS dist FROM la JOIN lb USING (s) GROUP BY ALL)"
_BY_LAYER = "rk AS (SELECT s, a_id, layer, row_number() OVER (PARTITION BY s, layer ORDER BY a_id) AS rank FROM fc WHERE layer >= 0)"
_STRATIFIED = f"""c1 AS (SELECT *, {BUDGET} - count(*) OVER (PARTITION BY s) AS spare FROM st),
c2 AS (SELECT *, spare * w / sum(w) OVER (PARTITION BY s) AS q FROM c1), c3 AS (SELECT *, floor(q) AS fl, spare - sum(floor(q)) OVER (PARTITION BY s) AS left_ FROM c2),
al AS (SELECT s, layer, n, (1 + fl + CASE WHEN row_number() OVER (PARTITION BY s ORDER BY q - fl DESC, layer) <= left_ THEN 1 ELSE 0 END)::BIGINT AS t_i FROM c3),
{_BY_LAYER}, tt AS (SELECT s, layer, n, t_i, unnest(range(1, least(t_i, n) + 1)) AS t FROM al),
dr AS (SELECT tt.s, tt.layer, t, a_id, n, t_i FROM tt JOIN rk ON tt.s = rk.s AND tt.layer = rk.layer AND rk.rank = CASE WHEN t_i >= n THEN t ELSE 1 + floor({_u("stratum", "tt.s", "tt.layer", "t")} * n) END), {_NEAR},
es AS (SELECT s AS step, sum(CASE WHEN t_i >= n THEN dist ELSE dist * n / t_i END) AS est FROM dr JOIN d USING (s, a_id) GROUP BY s)"""
_IMPORTANCE = f"""{_BY_LAYER}, cw AS (SELECT s, layer, n, w, sum(w) OVER (PARTITION BY s ORDER BY layer) AS hi, sum(w) OVER (PARTITION BY s) AS d FROM st),
ut AS (SELECT s, t, {_u("layer", "s", "t")} AS u, {_u("row", "s", "t")} AS v FROM (SELECT DISTINCT s FROM st), (SELECT unnest(range(1, {BUDGET + 1})) AS t)),
im AS (SELECT ut.s, t, cw.d / ({HASH.rho!r} * 2.0 ** cw.layer) AS factor, a_id FROM ut JOIN cw ON cw.s = ut.s AND u * d >= hi - w AND u * d < hi JOIN rk ON rk.s = ut.s AND rk.layer = cw.layer AND rk.rank = 1 + floor(v * n)), {_NEAR},
ei AS (SELECT s AS step, avg(factor * dist) AS est FROM im JOIN d USING (s, a_id) GROUP BY s)"""
_UNIFORM = f"""ns AS (SELECT s, count(*) AS n FROM la GROUP BY s), ru AS (SELECT s, a_id, row_number() OVER (PARTITION BY s ORDER BY a_id) AS rank FROM la),
un AS (SELECT x.s, t, a_id, n FROM (SELECT s, n, t, 1 + floor({_u("uniform", "s", "t")} * n) AS r FROM ns, (SELECT unnest(range(1, {BUDGET + 1})) AS t)) x JOIN ru ON ru.s = x.s AND ru.rank = x.r), {_NEAR},
eu AS (SELECT s AS step, any_value(n) / {BUDGET}.0 * sum(dist) AS est FROM un JOIN d USING (s, a_id) GROUP BY s)"""
_W_HASH = _stepped(_LSH, HASH, _live(WINDOW, EVERY))
_W_GRID = _stepped(_GRID_KEYS, GRID, _live(WINDOW, EVERY))


def _steps(b: DataFrame, window: int, every: int, position: str = "step") -> stepwise.Steps:
    return stepwise.Steps(window, every, b.agg(F.max(position)).first()[0] or 0)


class _Sliding:
    """A, B and the layers at all steps of the sliding window over the embeddings; layers are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, p: lsh.Projection = HASH, buckets: stepwise.Buckets | None = None):
        b = _b(spark, sf_dir)
        self.steps, self.p, self.buckets = _steps(b, WINDOW, EVERY), p, buckets or stepwise.hashed(p)
        self.a, self.b = self.steps.always(_a(spark, sf_dir)), self.steps.live(b, "step")

    def layers(self) -> stepwise.Layers:
        return stepwise.Layers(self.a, self.b, self.buckets, self.p.top, self.steps)

    def stratified(self) -> DataFrame:
        return stepwise.stratified(self.a, self.b, self.layers(), self.p, self.steps, BUDGET, SEED)


def _grid() -> stepwise.Buckets:
    return stepwise.gridded(GRID.rho, GRID.top, SEED)


_ALL_ONCE = "qs AS (SELECT 0 AS s), la AS (SELECT 0 AS s, a_id, vec FROM a), lb AS (SELECT 0 AS s, b_id, vec FROM b)"


@_query(f"WITH {_stepped(_GRID_KEYS, GRID, _ALL_ONCE)}, {_STRATIFIED} SELECT round(est, 4) AS estimate FROM es")
def grid_tree_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified estimate over a shifted grid in place of hashing, of both sets whole: one step at which all rows are live."""
    once = stepwise.Steps(0, 1, 0)
    a, b = once.always(_a(spark, sf_dir)), once.always(_b(spark, sf_dir))
    layers = stepwise.Layers(a, b, _grid(), GRID.top, once)
    return stepwise.stratified(a, b, layers, GRID, once, BUDGET, SEED).select(F.round("strat_est", 4).alias("estimate"))


@_query(f"WITH {_W_HASH} SELECT s AS step, layer, n FROM st")
def windowed_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    return stepwise.step_strata(w.a, w.b, w.buckets, HASH, w.steps).select("step", "layer", "n")


@_query(f"WITH {_W_HASH} SELECT s AS step, a_id, layer FROM fc")
def windowed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    return stepwise.step_layers(w.a, w.b, w.buckets, HASH.top, w.steps)


@_query(f"WITH {_W_HASH} SELECT s AS step, round(sum(w), 6) AS total FROM st GROUP BY s")
def windowed_total_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    return stepwise.step_strata(w.a, w.b, w.buckets, HASH, w.steps).groupBy("step").agg(F.round(F.sum("w"), 6).alias("total"))


#: Parts as points of two small numbers: many repeats between the sides, and cells too small for all to meet.
PART_HASH = lsh.Projection(k=4, dim=2, rho=0.25, top=3)
_PG = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in PART_HASH.directions) + "]"
_PS = "[" + ", ".join(repr(float(x)) for x in PART_HASH.starts) + "]"
_PC = "[" + ", ".join("[" + ", ".join(str(int(x)) for x in row) + "]" for row in PART_HASH.carries) + "]"
_PJ = range(1, PART_HASH.k + 1)
_PH0 = "[" + ", ".join(f"floor((list_dot_product(vec, g[{j}]) + s0[{j}]) / {PART_HASH.k * PART_HASH.rho!r})::BIGINT" for j in _PJ) + "]"
_PKEY = "[" + ", ".join(f"(h0[{j}] + c[layer + 1][{j}]) >> layer" for j in _PJ) + "]"
_PART_POINTS = "[p_size::DOUBLE, floor(p_retailprice / 50)]"
_PART_KEYS = f"""a AS (SELECT p_partkey AS a_id, {_PART_POINTS} AS vec FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey AS b_id, (p_partkey - 1) // 2 AS step, {_PART_POINTS} AS vec FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT {_PG}::DOUBLE[][] AS g, {_PS}::DOUBLE[] AS s0, {_PC}::BIGINT[][] AS c), l AS (SELECT unnest(range(0, {PART_HASH.top + 1}))::INTEGER AS layer),
ka AS (SELECT a_id, vec, layer, {_PKEY} AS key FROM (SELECT a_id, vec, {_PH0} AS h0 FROM a, p), l, p), kb AS (SELECT b_id, layer, {_PKEY} AS key FROM (SELECT b_id, {_PH0} AS h0 FROM b, p), l, p)"""
_W_PARTS = _stepped(_PART_KEYS, PART_HASH, _live(60, 40))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, stepwise.Steps]:
    point = F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 50).cast("double")).alias("vec")
    parts = table(spark, sf_dir, "part")
    b = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b_id"), ((F.col("p_partkey") - 1) / 2).cast("long").alias("step"), point)
    steps = _steps(b, 60, 40)
    return steps.always(parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a_id"), point)), steps.live(b, "step"), steps


@_query(f"WITH {_W_PARTS} SELECT s AS step, layer, n, round(w, 6) AS w FROM st")
def windowed_strata_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata where many rows have exact matches and others meet B in no layer."""
    a, b, steps = _parts(spark, sf_dir)
    return stepwise.step_strata(a, b, stepwise.hashed(PART_HASH), PART_HASH, steps).select("step", "layer", "n", F.round("w", 6).alias("w"))


@_query(f"WITH {_W_PARTS} SELECT s AS step, count(*) FILTER (layer >= 0) AS in_strata, count(*) FILTER (layer = -2) AS same, count(*) FILTER (layer = {PART_HASH.top + 1}) AS unmet FROM fc GROUP BY s")
def windowed_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in strata, at distance 0, and without any collision, counted from the rows' own layers."""
    a, b, steps = _parts(spark, sf_dir)
    own = lambda what, name: F.sum(F.when(F.expr(what), F.col("n")).otherwise(0)).alias(name)
    layers = stepwise.Layers(a, b, stepwise.hashed(PART_HASH), PART_HASH.top, steps)
    return layers.counts().groupBy("step").agg(own("layer >= 0", "in_strata"), own("layer = -2", "same"), own(f"layer = {PART_HASH.top + 1}", "unmet"))


@_query(f"WITH {_W_PARTS}, {_STRATIFIED} SELECT step, round(est, 4) AS estimate FROM es")
def windowed_estimate_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, steps = _parts(spark, sf_dir)
    layers = stepwise.Layers(a, b, stepwise.hashed(PART_HASH), PART_HASH.top, steps)
    return stepwise.stratified(a, b, layers, PART_HASH, steps, BUDGET, SEED).select("step", F.round("strat_est", 4).alias("estimate"))


@_query(f"WITH {_W_HASH}, {_STRATIFIED} SELECT step, round(est, 4) AS estimate FROM es")
def windowed_stratified_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Sliding(spark, sf_dir).stratified().select("step", F.round("strat_est", 4).alias("estimate"))


@_query(f"WITH {_W_HASH}, {_IMPORTANCE} SELECT step, round(est, 3) AS estimate FROM ei")
def windowed_importance_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    return stepwise.importance(w.a, w.b, w.layers(), HASH, w.steps, BUDGET, SEED).select("step", F.round("is_est", 3).alias("estimate"))


@_query(f"WITH {_W_HASH}, {_UNIFORM} SELECT step, round(est, 4) AS estimate FROM eu")
def windowed_uniform_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    return stepwise.uniform(w.a, w.b, w.layers(), w.steps, BUDGET, SEED).select("step", F.round("uniform_est", 4).alias("estimate"))


@_query(f"WITH {_W_GRID}, {_STRATIFIED} SELECT step, round(est, 4) AS estimate FROM es")
def windowed_grid_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Sliding(spark, sf_dir, GRID, _grid()).stratified().select("step", F.round("strat_est", 4).alias("estimate"))


def _log_sql(parts: list[tuple[str, str, str, str]]) -> str:
    """SQL of a run log; parts: (column, steps, estimator, its result)."""
    own = ", ".join(f"{name} AS (WITH {steps}, {how} SELECT step, est FROM {result})" for name, steps, how, result in parts)
    values = ", ".join(f"round({n}.est, 3) AS {n}" for n, *_ in parts) + ", " + ", ".join(f"round(({n}.est - x.chamfer) / x.chamfer, 5) AS {n.replace('_est', '_err')}" for n, *_ in parts)
    return f"WITH x AS ({_SLIDE} SELECT s AS step, sum(dist) AS chamfer FROM m GROUP BY s), {own} SELECT step, round(x.chamfer, 3) AS chamfer, {values} FROM x " + " ".join(f"JOIN {n} USING (step)" for n, *_ in parts)


def _rounded_log(log: DataFrame) -> DataFrame:
    return log.select("step", *(F.round(c, 5 if c.endswith("_err") else 3).alias(c) for c in log.columns if c != "step"))


def _exact_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_chamfer(_a(spark, sf_dir), _b(spark, sf_dir).select("step", "vec"), WINDOW, EVERY).select("step", "chamfer")


_TREE, _STRAT, _IS, _UNIF = (("quadtree_est", _W_GRID, _STRATIFIED, "es"), ("strat_est", _W_HASH, _STRATIFIED, "es"), ("is_est", _W_HASH, _IMPORTANCE, "ei"), ("uniform_est", _W_HASH, _UNIFORM, "eu"))


@_query(_log_sql([_TREE, ("e2lsh_est", *_STRAT[1:]), _UNIF]))
def cost_log_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of all methods, written as CSV and read back."""
    w = _Sliding(spark, sf_dir)
    layers = w.layers()
    found = {
        "quadtree_est": _Sliding(spark, sf_dir, GRID, _grid()).stratified(),
        "e2lsh_est": stepwise.stratified(w.a, w.b, layers, HASH, w.steps, BUDGET, SEED),
        "uniform_est": stepwise.uniform(w.a, w.b, layers, w.steps, BUDGET, SEED),
    }
    return _logged(spark, stepwise.cost_log(_exact_steps(spark, sf_dir), found, "full"))


@_query(_log_sql([_STRAT]))
def cost_log_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, stepwise.cost_log(_exact_steps(spark, sf_dir), {"strat_est": _Sliding(spark, sf_dir).stratified()}, "hashing"))


@_query(_log_sql([_STRAT, _IS]))
def cost_log_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir)
    layers = w.layers()
    found = {"strat_est": stepwise.stratified(w.a, w.b, layers, HASH, w.steps, BUDGET, SEED), "is_est": stepwise.importance(w.a, w.b, layers, HASH, w.steps, BUDGET, SEED)}
    return _logged(spark, stepwise.cost_log(_exact_steps(spark, sf_dir), found, "importance"))


@_query(_log_sql([_TREE, _UNIF]))
def cost_log_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Sliding(spark, sf_dir, GRID, _grid())
    layers = w.layers()
    found = {"quadtree_est": stepwise.stratified(w.a, w.b, layers, GRID, w.steps, BUDGET, SEED), "uniform_est": stepwise.uniform(w.a, w.b, layers, w.steps, BUDGET, SEED)}
    return _logged(spark, stepwise.cost_log(_exact_steps(spark, sf_dir), found, "tree"))


def _logged(spark: SparkSession, log: DataFrame) -> DataFrame:
    """A log written to the shared folder and read back, with as many digits as SQL agrees on."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    text_files.write_cost_log(log, path)
    return _rounded_log(text_files.read_cost_log(spark, path))


_D_KEYS = f"""{_SCHEDULE}, a AS (SELECT pos AS a_id, vec FROM sch WHERE side = 'A'), b AS (SELECT pos AS b_id, pos AS step, vec FROM sch WHERE side = 'B'), {_LSH.replace(_AB + ", ", "")}"""
_D_LIVE = """qs AS (SELECT pos AS s FROM sch WHERE pos >= 60 AND pos % 20 = 0),
la AS (SELECT s, a_id, vec FROM qs, a WHERE a_id > s - 60 AND a_id <= s), lb AS (SELECT s, b_id, vec FROM qs, b WHERE b_id > s - 60 AND b_id <= s)"""
_W_DUAL = _stepped(_D_KEYS, HASH, _D_LIVE)


def _dual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, stepwise.Steps, stepwise.Layers]:
    a, b = _scheduled(spark, sf_dir)
    steps = _steps(a.select("pos").unionByName(b.select("pos")), 60, 20, "pos")
    a, b = steps.live(a.withColumnRenamed("pos", "a_id"), "a_id"), steps.live(b.withColumnRenamed("pos", "b_id"), "b_id")
    return a, b, steps, stepwise.Layers(a, b, stepwise.hashed(HASH), HASH.top, steps)


@_query(f"WITH {_W_DUAL} SELECT s AS step, layer, n FROM st")
def both_dynamic_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir)[3].counts().where("layer >= 0")


@_query(f"WITH {_W_DUAL}, {_STRATIFIED} SELECT step, round(est, 4) AS estimate FROM es")
def both_dynamic_stratified_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, steps, layers = _dual(spark, sf_dir)
    return stepwise.stratified(a, b, layers, HASH, steps, BUDGET, SEED).select("step", F.round("strat_est", 4).alias("estimate"))


@_query(f"WITH {_W_DUAL}, {_UNIFORM} SELECT step, round(est, 4) AS estimate FROM eu")
def both_dynamic_uniform_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, steps, layers = _dual(spark, sf_dir)
    return stepwise.uniform(a, b, layers, steps, BUDGET, SEED).select("step", F.round("uniform_est", 4).alias("estimate"))


# Evaluation: events stand for logged errors of several runs.

_ERR = "e AS (SELECT event_type AS kind, user_id % 5 AS seed, event_id // 5 AS step, (value - 50) / 50 AS err FROM events WHERE value IS NOT NULL)"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("seed"), F.floor(F.col("event_id") / 5).alias("step"), evaluate.relative_error("value", F.lit(50)).alias("err"))


@_query(f"WITH {_NN} SELECT a_id, round((1.0 - dist) / dist, 6) AS err FROM nn")
def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.nearest(_a(spark, sf_dir), _b(spark, sf_dir)).select("a_id", F.round(evaluate.relative_error(F.lit(1.0), "dist"), 6).alias("err"))


@_query(f"WITH {_ERR} SELECT kind, count(*) AS n, round(avg(err), 6) AS mean_signed, round(avg(abs(err)), 6) AS mean_abs, round(sqrt(avg(err * err)), 6) AS rmse, round(coalesce(var_samp(err), 0), 6) AS var FROM e GROUP BY kind")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summarize(_errors(spark, sf_dir), ["kind"], "err")
    return s.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("mean_signed", "mean_abs", "rmse", "var")))


@_query(f"WITH {_ERR} SELECT kind, round(avg(m), 6) AS mean_abs, count(*) AS n_seeds FROM (SELECT kind, seed, avg(abs(err)) AS m FROM e GROUP BY kind, seed) GROUP BY kind")
def seed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.seed_average(_errors(spark, sf_dir), ["kind"], "seed", "err").select("kind", F.round("mean_abs", 6).alias("mean_abs"), "n_seeds")


@_query(f"""WITH {_ERR}, l AS (SELECT kind, min(m) AS m FROM (SELECT kind, seed, max(step) AS m FROM e GROUP BY kind, seed) GROUP BY kind)
SELECT kind, step, round(avg(err), 6) AS mean, round(min(err), 6) AS low, round(max(err), 6) AS high FROM e JOIN l USING (kind) WHERE step <= m GROUP BY kind, step""")
def error_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluate.band(_errors(spark, sf_dir), ["kind"], "step", "seed", "err")
    return b.select("kind", "step", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@_query(f"WITH {_ERR} SELECT kind, round(quantile_cont(m, 0.95), 6) AS p95 FROM (SELECT kind, step, avg(err) AS m FROM e GROUP BY kind, step) GROUP BY kind")
def error_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.curve_limit(_errors(spark, sf_dir), ["kind"], "step", "err").select("kind", F.round("limit", 6).alias("p95"))


@_query(f"""WITH {_ERR}, s AS (SELECT kind, step % 2 AS outlier, seed, count(*) AS n, avg(err) AS ms, avg(abs(err)) AS ma, sqrt(avg(err * err)) AS r, coalesce(var_samp(err), 0) AS v FROM e GROUP BY ALL)
SELECT kind, outlier, count(*) AS n_seeds, sum(n)::BIGINT AS queries, round(avg(ms), 6) AS mean_signed, round(avg(ma), 6) AS mean_abs, round(avg(r), 6) AS rmse, round(avg(v), 6) AS var, round(coalesce(stddev_samp(ma), 0), 6) AS spread FROM s GROUP BY kind, outlier""")
def phase_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = evaluate.require_seeds(_errors(spark, sf_dir).withColumn("outlier", F.col("step") % 2), ["kind", "outlier"], "seed", 5)
    found = evaluate.phase_aggregate(errors, ["kind", "outlier"], "seed", "err")
    return found.select("kind", "outlier", "n_seeds", "queries", *(F.round(c, 6).alias(c) for c in ("mean_signed", "mean_abs", "rmse", "var", "spread")))


@_query(f"WITH {_ERR} SELECT kind, round(avg(m), 6) AS mean_cost, count(*) AS n_seeds FROM (SELECT kind, seed, avg((abs(err) + 2 * step) / (step + 1)) AS m FROM e GROUP BY kind, seed) GROUP BY kind")
def mean_cost_per_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds of an update over runs: updates and queries over the number of updates, the mean of each seed, then over seeds."""
    e = _errors(spark, sf_dir).withColumns({"update_ms": F.abs("err"), "query_ms": 2 * F.col("step"), "updates": F.col("step") + 1})
    costs = e.withColumn("cost", evaluate.per_update(e, "update_ms", "query_ms", "updates"))
    found = evaluate.mean_per(costs, ["kind"], "seed", "cost")
    return found.select("kind", F.round("mean_cost", 6).alias("mean_cost"), "n_seeds")


# Filters, guards, changes


@_query("SELECT vec_id FROM embeddings WHERE vec_id < 100")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows by position: the operator's own limit."""
    return table(spark, sf_dir, "embeddings").where("vec_id < 100").select("vec_id")


@_query("WITH n AS (SELECT count(*) FILTER (vec_id % 3 = 0) AS x, count(*) FILTER (vec_id % 3 <> 0) AS y FROM embeddings) SELECT vec_id, CASE WHEN (vec_id % 3 = 0) = (x >= y) THEN 'A' ELSE 'B' END AS side FROM embeddings, n")
def role_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of two sets becomes A."""
    e = table(spark, sf_dir, "embeddings")
    one, two = e.where("vec_id % 3 = 0"), e.where("vec_id % 3 <> 0")
    keep = one.count() >= two.count()
    return one.select("vec_id", F.lit("A" if keep else "B").alias("side")).unionByName(two.select("vec_id", F.lit("B" if keep else "A").alias("side")))


@_query("SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.has_dim("embedding", 64).alias("ok"))


@_query("SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_append(embedding, 'nan'::FLOAT) ELSE embedding END AS v FROM embeddings) WHERE len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 7 == 0, F.array_append("embedding", F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).where(V.is_finite("v")).select("vec_id")


@_query(f"WITH {_NN} SELECT round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM nn WHERE a_id % 10 <> 0")
def delete_a_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir)
    left = a.join(a.where("a_id % 10 = 0").select("a_id"), "a_id", "left_anti")
    return exact.chamfer(left, _b(spark, sf_dir)).select(F.round("chamfer", 4).alias("chamfer"), "n_a")


@_query(f"WITH {_AB}, nn AS (SELECT a_id, min(list_distance(a.vec, b.vec)) AS dist FROM a, b WHERE b_id % 5 <> 0 GROUP BY a_id) SELECT round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM nn")
def delete_b_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir)
    left = b.join(b.where("b_id % 5 = 0").select("b_id"), "b_id", "left_anti")
    return exact.chamfer(_a(spark, sf_dir), left).select(F.round("chamfer", 4).alias("chamfer"), "n_a")


@_query(f"WITH {_AB}, x AS (SELECT vec FROM a UNION ALL SELECT vec FROM b WHERE b_id % 50 = 1), i AS (SELECT row_number() OVER () AS k, vec FROM x), nn AS (SELECT k, min(list_distance(i.vec, b.vec)) AS dist FROM i, b GROUP BY k) SELECT round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM nn")
def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir)
    more = b.where("b_id % 50 = 1").select(F.col("b_id").alias("a_id"), "vec")
    return exact.chamfer(_a(spark, sf_dir).unionByName(more), b).select(F.round("chamfer", 4).alias("chamfer"), "n_a")


@_query(f"WITH {_LSH} SELECT layer, a_id, row_number() OVER (PARTITION BY layer, key ORDER BY a_id) AS place FROM ka WHERE (layer, key) IN (SELECT (layer, key) FROM kb)")
def bucket_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of all buckets that hold a row of B, with their places, from postings written by layer."""
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    lsh.postings(_a(spark, sf_dir), HASH).write.partitionBy("layer").parquet(path)
    held = lsh.postings(_b(spark, sf_dir), HASH, "b_id")
    return lsh.placed(lsh.members(spark.read.parquet(path), held)).select("layer", "a_id", "place")


@_query(f"""WITH {_AB}, o AS (SELECT vec AS o FROM a ORDER BY a_id LIMIT 1), r AS (SELECT 2 * max(list_distance(vec, o)) AS diameter FROM (SELECT vec FROM a UNION ALL SELECT vec FROM b), o),
l AS (SELECT min(list_distance(a.vec, b.vec)) AS least FROM a, b WHERE a.vec <> b.vec)
SELECT round(diameter, 6) AS diameter, round(least, 6) AS least, round(diameter / least, 5) AS ratio, greatest(1, ceil(log2(diameter / least)) + 1)::INTEGER AS depth FROM r, l""")
def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.aspect_ratio(_a(spark, sf_dir), _b(spark, sf_dir))
    return found.select(F.round("diameter", 6).alias("diameter"), F.round("least", 6).alias("least"), F.round("ratio", 5).alias("ratio"), "depth")


_FINAL = _LSH.replace("vec_id % 2 = 0)", "vec_id % 2 = 0 AND vec_id % 10 <> 0)").replace("vec_id % 2 = 1)", "vec_id % 2 = 1 AND ((vec_id - 1) // 2) % 5 <> 0)")


@_query(f"WITH {_stepped(_FINAL, HASH, _ALL_ONCE)} SELECT layer, n, round(w, 6) AS w FROM st")
def strata_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata after rows of both sides were inserted and deleted, from the counts of buckets and the changes alone."""
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    state = materialize(upkeep.applied(None, upkeep.change(a.where("a_id % 10 <> 6"), HASH, "a"), upkeep.change(b.where("step % 7 <> 3"), HASH, "b")))
    state = materialize(upkeep.applied(state, upkeep.change(a.where("a_id % 10 = 6"), HASH, "a"), upkeep.change(b.where("step % 7 = 3"), HASH, "b")))
    state = upkeep.applied(state, upkeep.change(a.where("a_id % 10 = 0"), HASH, "a", -1), upkeep.change(b.where("step % 5 = 0"), HASH, "b", -1))
    return upkeep.strata(materialize(state), HASH).select("layer", "n", F.round("w", 6).alias("w"))


_COUNTS = "SELECT layer, array_to_string(key, ',') AS key, sum(x)::BIGINT AS a_count, sum(y)::BIGINT AS b_count FROM (SELECT layer, key, 1 AS x, 0 AS y FROM ka UNION ALL SELECT layer, key, 0, 1 FROM kb) GROUP BY layer, key"


@_query(f"WITH {_LSH} {_COUNTS}")
def range_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of all layers, the upper four opened from the keys of the ninth as the range grows."""
    small = lsh.Projection(k=HASH.k, dim=HASH.dim, rho=HASH.rho, top=8)
    state = upkeep.applied(None, upkeep.change(_a(spark, sf_dir), small, "a"), upkeep.change(_b(spark, sf_dir), small, "b"))
    grown = upkeep.opened(materialize(state), small, HASH).where("layer >= 0")
    return grown.select("layer", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"), "a_count", "b_count")


@_query(f"""WITH {_LSH}, n AS ({_COUNTS.replace("array_to_string(key, ',') AS key", "key")}), h AS (SELECT h0 FROM ha UNION SELECT h0 FROM hb),
up AS (SELECT DISTINCT layer, {_KEY} AS key, {_KEY.replace("layer", "(layer + 1)")} AS parent FROM h, l, p WHERE layer < {HASH.top})
SELECT up.layer + 1 AS layer, array_to_string(parent, ',') AS key, count(*) AS n_children, sum(CASE WHEN a_count > 0 AND b_count = 0 THEN 1 ELSE 0 END)::BIGINT AS a_children FROM up JOIN n ON n.layer = up.layer AND n.key = up.key GROUP BY ALL""")
def bucket_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = upkeep.applied(None, upkeep.change(_a(spark, sf_dir), HASH, "a"), upkeep.change(_b(spark, sf_dir), HASH, "b"))
    return upkeep.children(state, HASH).select("layer", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"), "n_children", "a_children")


@_query(f"""WITH {_AB}, o AS (SELECT vec AS o FROM a WHERE a_id = 0), r AS (SELECT -1 AS step, max(list_distance(vec, o)) AS r FROM a, o UNION ALL SELECT step, list_distance(vec, o) FROM b, o),
q AS (SELECT step AS s FROM b WHERE step >= {WINDOW} AND step % {EVERY} = 0)
SELECT s AS step, round(max(r), 6) AS reach, greatest(0, ceil(log2((2 * max(r) - 1e-15) / 1e-4)))::INTEGER AS top FROM q JOIN r ON r.step <= s GROUP BY s""")
def growing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers that are open at each query step, by the farthest row that has come so far."""
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    rows = a.select(F.lit(-1).cast("long").alias("step"), "vec").unionByName(b.select("step", "vec"))
    found = geometry.reach_by_step(rows, a.where("a_id = 0"), WINDOW, EVERY)
    return found.select("step", F.round("reach", 6).alias("reach"), geometry.level_of(F.col("reach"), 1e-4).alias("top"))


@_query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have passed the guards on dimension and number, stored in floats and widened again."""
    e = exact.require_capacity(table(spark, sf_dir, "embeddings"), 1_100_000, "A")
    vec = V.widen(V.narrow(V.require_dim(V.widen("embedding"), 64)))
    return e.select("vec_id", F.round(F.aggregate(vec, F.lit(0.0), lambda m, x: m + x), 5).alias("total"))


# Files


def _folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_STEPS = "SELECT vec_id AS step, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INTEGER AS dim FROM embeddings"


def _roundtrip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    path = _folder(spark)
    vector_files.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), F.col("embedding").alias("vec")), path, kind)
    back = vector_files.read_vectors(spark, path, kind)
    return back.select("step", F.round(F.aggregate(V.widen("vec"), F.lit(0.0), lambda m, x: m + x), 5).alias("total"), F.size("vec").alias("dim"))


@_query(_STEPS)
def f32bin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "f32bin")


@_query(_STEPS)
def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "fvecs")


@_query("SELECT list_sum(list_transform(embedding, lambda x: floor(128 + 100 * x::DOUBLE)))::BIGINT AS total, 64 AS dim FROM embeddings")
def idx3_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 64 pixels, in files of a column, decoded again."""
    pixels = F.transform("embedding", lambda x: F.floor(128 + 100 * x.cast("double")).cast("double"))
    files = materialize(text_files.encoded(table(spark, sf_dir, "embeddings").select(pixels.alias("vec")), "idx3"))
    return text_files.decoded(files, "idx3", 64).select(F.aggregate(V.widen("vec"), F.lit(0.0), lambda m, x: m + x).cast("long").alias("total"), F.size("vec").alias("dim"))


@_query("SELECT round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INTEGER AS dim FROM embeddings")
def npy_zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialize(text_files.encoded(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")), "npy"))
    return text_files.decoded(files, "npy").select(F.round(F.aggregate(V.widen("vec"), F.lit(0.0), lambda m, x: m + x), 5).alias("total"), F.size("vec").alias("dim"))


@_query("SELECT round(l_quantity + l_discount, 4) AS total, 2 AS dim FROM lineitem")
def csv_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "lineitem").select(F.concat_ws(",", F.col("l_quantity").cast("string"), F.lit(""), F.col("l_discount").cast("string"))).write.text(path)
    return text_files.read_csv_vectors(spark, path).select(F.round(F.aggregate("vec", F.lit(0.0), lambda m, x: m + x), 4).alias("total"), F.size("vec").alias("dim"))


@_query(f"{_SLIDE} SELECT s AS step, round(sum(dist), 4) AS chamfer FROM m GROUP BY s")
def exact_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    text_files.write_exact_cache(_exact_steps(spark, sf_dir), path, {"window_size": str(WINDOW), "query_interval": str(EVERY)})
    return text_files.read_exact_cache(spark, path).select("step", F.round("chamfer", 4).alias("chamfer"))


# Streaming


@_query(f"{_SLIDE} SELECT s AS step, round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM m GROUP BY s")
def stream_sliding_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/embeddings.parquet"
    schema = spark.read.parquet(source).schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.read.parquet(source).write.parquet(f"{base}/in")
    odd = F.col("vec_id") % 2 == 1
    events = spark.readStream.schema(schema).parquet(f"{base}/in").select(
        F.when(odd, "B").otherwise("A").alias("side"), F.when(odd, ((F.col("vec_id") - 1) / 2).cast("long")).otherwise(F.col("vec_id")).alias("id"), F.col("embedding").alias("vec"))
    parts = sliding_parts(events, WINDOW, EVERY)
    parts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parts.schema).parquet(f"{base}/out").groupBy("step").agg(F.round(F.sum("part"), 4).alias("chamfer"), F.sum("n").alias("n_a"))


@_query(f"""WITH {_AB}, la AS (SELECT * FROM a WHERE a_id % 10 <> 0), q AS (SELECT step AS s FROM b WHERE step >= {WINDOW} AND step % {EVERY} = 0),
m AS (SELECT s, a_id, min(list_distance(la.vec, b.vec)) AS dist FROM q, b, la WHERE b.step > s - {WINDOW} AND b.step <= s AND (b.step % 7 <> 3 OR b.step = s) GROUP BY s, a_id)
SELECT s AS step, round(sum(dist), 4) AS chamfer, count(*) AS n_a FROM m GROUP BY s""")
def stream_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream where every tenth row of A is deleted before B begins, and some rows of B right after they came."""
    source = f"{sf_dir}/embeddings.parquet"
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    odd, step = F.col("vec_id") % 2 == 1, ((F.col("vec_id") - 1) / 2).cast("long")
    rows = spark.read.parquet(source)
    nothing = F.lit(None).cast("array<float>").alias("vec")
    live = rows.select(F.when(odd, "B").otherwise("A").alias("side"), F.when(odd, step).otherwise(F.col("vec_id")).alias("id"), F.col("embedding").alias("vec"), F.when(odd, 2 * step).otherwise(-2).alias("seq"))
    gone = rows.where("vec_id % 10 = 0").select(F.lit("A-").alias("side"), F.col("vec_id").alias("id"), nothing, F.lit(-1).cast("long").alias("seq"))
    gone_b = rows.where(odd & (step % 7 == 3)).select(F.lit("B-").alias("side"), step.alias("id"), nothing, (2 * step + 1).alias("seq"))
    events = live.unionByName(gone).unionByName(gone_b)
    events.write.parquet(f"{base}/in")
    parts = sliding_parts(spark.readStream.schema(events.schema).parquet(f"{base}/in"), WINDOW, EVERY)
    parts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parts.schema).parquet(f"{base}/out").groupBy("step").agg(F.round(F.sum("part"), 4).alias("chamfer"), F.sum("n").alias("n_a"))


@_query(f"WITH e AS (WITH {_W_HASH}, {_STRATIFIED} SELECT step, est FROM es), x AS ({_SLIDE} SELECT s AS step, sum(dist) AS chamfer FROM m GROUP BY s) SELECT step, round((est - chamfer) / chamfer, 6) AS err FROM e JOIN x USING (step)")
def estimate_against_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified estimates joined to the exact values of their steps."""
    found = evaluate.against_exact(_Sliding(spark, sf_dir).stratified(), _exact_steps(spark, sf_dir))
    return found.select("step", F.round(evaluate.relative_error("strat_est", "chamfer"), 6).alias("err"))


@_query(f"WITH {_ERR}, x AS (SELECT kind, seed, step, avg(err) AS err FROM e GROUP BY ALL) SELECT o.seed, o.step, round(o.err, 6) AS one, round(p.err, 6) AS other FROM x o JOIN x p USING (seed, step) WHERE o.kind = 'view' AND p.kind = 'click'")
def split_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _errors(spark, sf_dir).groupBy("kind", "seed", "step").agg(F.round(F.avg("err"), 6).alias("err"))
    own = lambda kind, name: mean.where(F.col("kind") == kind).select("seed", "step", F.col("err").alias(name))
    return evaluate.merge_logs(own("view", "one"), own("click", "other"), ["seed", "step"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
