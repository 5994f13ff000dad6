"""Layers at every step, in small blocks and segments, against counting by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lsh, stepwise

P = lsh.Projection(k=2, dim=2, rho=0.5, top=2)


def _by_hand(a, b, buckets, steps):
    """{(step, a_id): layer} from the names of all buckets of all rows."""
    named = lambda df, key: {(r[key], r.layer): (r.k1, r.k2) for r in stepwise._named(df, buckets).collect()}
    mine, theirs = named(a.select("a_id", "vec"), "a_id"), named(b.select("b_id", "vec"), "b_id")
    layers = [stepwise.SAME, *range(P.top + 1)]
    live = {}
    for r in b.collect():
        for s in range(r.lo, r.hi + 1, steps.every):
            live.setdefault(s, []).append(r.b_id)
    found = {}
    for r in a.collect():
        for s in range(r.lo, r.hi + 1, steps.every):
            met = [n for n in layers if any(theirs[i, n] == mine[r.a_id, n] for i in live.get(s, []))]
            found[s, r.a_id] = met[0] if met else P.top + 1
    return found


@pytest.mark.parametrize("moving", [False, True])
def test_blocks_and_segments_are_whole(spark, monkeypatch, moving):
    monkeypatch.setattr(stepwise, "KINDS", 8)
    monkeypatch.setattr(stepwise, "MEMBERS", 16)
    monkeypatch.setattr(stepwise, "STEPS", 3)
    draw = random.Random(5)
    points = lambda n: [(i, [float(draw.randrange(12)), float(draw.randrange(6))]) for i in range(n)]
    steps = stepwise.Steps(6, 2, 39)
    a = spark.createDataFrame(points(40), "a_id long, vec array<double>")
    b = steps.live(spark.createDataFrame(points(40), "b_id long, vec array<double>"), "b_id")
    a = steps.live(a, "a_id") if moving else steps.always(a)
    buckets = stepwise.hashed(P)
    want = _by_hand(a, b, buckets, steps)
    assert len(set(want.values())) > 2
    rows = stepwise.step_layers(a, b, buckets, P.top, steps).collect()
    assert len(rows) == len(want) and {(r.step, r.a_id): r.layer for r in rows} == want
    layers = stepwise.Layers(a, b, buckets, P.top, steps)
    assert layers.by_block.select("i").distinct().count() > 2
    groups: dict = {}
    for (s, i), n in sorted(want.items()):
        groups.setdefault((s, n), []).append(i)
    assert {(r.step, r.layer): r.n for r in layers.counts().collect()} == {k: len(v) for k, v in groups.items()}
    asked = [(s, n, k + 1, 0) for (s, n), v in groups.items() for k in range(len(v))] + [(*next(iter(groups)), 1, 1)]
    got = layers.pick(spark.createDataFrame(asked, "step long, layer int, rank long, t int")).collect()
    assert len(got) == len(asked) and all(groups[r.step, r.layer][r["rank"] - 1] == r.a_id for r in got)
    whole: dict = {}
    for s, i in sorted(want):
        whole.setdefault(s, []).append(i)
    got = layers.pick(spark.createDataFrame([(s, k + 1) for s, v in whole.items() for k in range(len(v))], "step long, rank long")).collect()
    assert len(got) == len(want) and all(whole[r.step][r["rank"] - 1] == r.a_id for r in got)


def test_layers_are_not_a_row_a_step(spark):
    """What is written is a row for each coordinate and segment of steps, however many rows and steps there are."""
    steps = stepwise.Steps(4, 1, 400)
    a = steps.always(spark.range(300).select(F.col("id").alias("a_id"), F.array((F.col("id") % 5).cast("double"), F.lit(0.0)).alias("vec")))
    b = steps.live(spark.range(401).select(F.col("id").alias("b_id"), F.array((F.col("id") % 7).cast("double"), F.lit(0.0)).alias("vec")), "b_id")
    layers = stepwise.Layers(a, b, stepwise.hashed(P), P.top, steps)
    assert layers.wide.count() == 5
    assert layers.counts().agg(F.sum("n")).first()[0] == 300 * 397


def test_distances_of_a_long_step_are_dealt_out(spark, monkeypatch):
    steps = stepwise.Steps(4, 2, 30)
    point = lambda key: F.array((F.col(key) * 7 % 11).cast("double"), F.lit(0.0)).alias("vec")
    a = steps.always(spark.range(20).select(F.col("id").alias("a_id"), point("id")))
    b = steps.live(spark.range(31).select(F.col("id").alias("b_id"), point("id")), "b_id")
    draws = a.select("a_id", F.explode(steps.of()).alias("step"))
    own = lambda: sorted((r.step, r.a_id, round(r.dist, 9)) for r in stepwise._distances(draws, a, b, steps).collect())
    together = own()
    monkeypatch.setattr(stepwise, "HELD", 1)
    assert together == own() and len(together) == draws.count()


def test_equal_fractions_do_not_depend_on_the_order_of_rows(spark):
    from itertools import permutations

    from tidewell.operators.allocate import allocation_stats

    # The strata of step 420 of both_dynamic_stratified_estimate: layers 8 and 9 have the same fraction.
    strata = [(layer, n, n * 1e-3 * 2.0**layer) for layer, n in ((8, 2), (9, 24), (10, 1), (11, 14), (12, 4))]
    found = set()
    orders = [(k, *r) for k, p in enumerate(permutations(strata)) for r in p]
    got = allocation_stats(spark.createDataFrame(orders, "step int, layer int, n long, w double").coalesce(1), 60, by=["step"])
    for row in got.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("layer", "t_i"))).alias("own")).collect():
        found.add(tuple(x.t_i for x in row.own))
    assert found == {(2, 12, 2, 28, 16)}
