"""Edge cases and fixed results of the operators."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import allocate, exact, geometry, lsh, sampling, windows
from tidewell.sources import text_and_archives, vector_files


def points(spark, rows, id_col):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{id_col} long, vec array<float>")


def test_chamfer_of_empty_sides(spark):
    some, none = points(spark, [[0, 0], [3, 4]], "a_id"), points(spark, [], "b_id")
    assert exact.chamfer(some, none).first()["chamfer"] == float("inf")
    assert exact.chamfer(points(spark, [], "a_id"), points(spark, [[1, 1]], "b_id")).first()["chamfer"] == 0


def test_nearest_with_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (40, 3)).tolist(), rng.integers(0, 4, (50, 3)).tolist()
    a, b = points(spark, [*x, None], "a_id"), points(spark, y, "b_id")
    got = {r["a_id"]: (r["b_id"], round(r["dist"], 6)) for r in exact.nearest(a, b, block=7).collect()}
    d = np.sqrt(((np.array(x)[:, None] - np.array(y)[None]) ** 2).sum(2))
    assert got == {i: (int(d[i].argmin()), round(float(d[i].min()), 6)) for i in range(40)}


@pytest.mark.parametrize(("n_a", "n_b", "start", "longest"), [(840, 140, "AAAAAAB", 6), (50, 30, "ABAAB", 2)])
def test_schedule(spark, n_a, n_b, start, longest):
    s = windows.merge_schedule(spark.range(n_a).withColumnRenamed("id", "idx"), spark.range(n_b).withColumnRenamed("id", "idx"))
    order = "".join(r["side"] for r in s.orderBy("pos").collect())
    assert [r["pos"] for r in s.select("pos").orderBy("pos").collect()] == list(range(n_a + n_b))
    assert order.startswith(start) and max(map(len, order.split("B"))) == longest


@pytest.mark.parametrize(("n", "w", "q", "count"), [(1178, 100, 20, 54), (10000, 500, 166, 57), (1000, 50, 17, 56), (1000, 50, 26, 37), (3058, 1500, 20, 78)])
def test_query_counts(spark, n, w, q, count):
    assert spark.range(n).where(windows.is_query_step("id", w, q)).count() == count


def test_scalars(spark):
    df = spark.createDataFrame([(8,), (70000,), (1001074,), (1100000,)], "n long")
    assert [r[0] for r in df.orderBy("n").select(V.compute_k("n")).collect()] == [25, 98, 119, 120]
    halves = spark.createDataFrame([(-5,), (-1,), (0,)], "n long").select(V.floor_half("n").alias("h"))
    assert [r[0] for r in halves.collect()] == [-3, -1, 0]


def test_allocation(spark):
    strata = spark.createDataFrame([(0, 7, 0.5), (1, 101, 3.2), (2, 0, 0.0), (3, 19, 9.9)], "layer int, n long, w double")
    assert [r["t_i"] for r in allocate.guaranteed(strata, 60).orderBy("layer").collect()] == [3, 14, 0, 43]
    with pytest.raises(Exception, match="smaller than the number of strata"):
        allocate.guaranteed(strata, 2).collect()
    assert {r["t_i"] for r in allocate.hamilton(strata, 0).collect()} == {0}


def test_estimates_over_seeds(spark):
    rng = np.random.default_rng(3)
    a, b = points(spark, rng.normal(size=(120, 8)), "a_id"), points(spark, rng.normal(size=(60, 8)), "b_id")
    p = lsh.Projection(k=5, dim=8, rho=0.05, top=8)
    truth = exact.chamfer(a, b).first()["chamfer"]
    met = lsh.first_collision(a, b, p).cache()
    found = [sampling.stratified(a, b, met, p, 40, seed).first()["estimate"] for seed in range(3)]
    assert abs(np.mean(found) / truth - 1) < 0.1
    whole = sampling.stratified(a, b, met, p, 10**6, 0).first()["estimate"]
    assert abs(whole - truth) < 1e-6 * truth


def test_outlier_is_far_and_last(spark):
    a = points(spark, [[0, 0], [2, 0], [1, 3]], "a_id")
    rows = geometry.inject_outlier(a, "a_id").orderBy("a_id").collect()
    assert rows[-1]["a_id"] == 3
    np.testing.assert_allclose(rows[-1]["vec"], [1 + 0.3 * (0 - 1), 1 + 0.3 * (0 - 1)], rtol=1e-6)


def test_block_sliding_min_equals_frames(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("s"), (F.hash("id") % 50).alias("v"))
    from pyspark.sql.window import Window

    frame = Window.partitionBy("k").orderBy("s").rowsBetween(-6, 0)
    got = windows.block_sliding_min(df, "k", "s", "v", 7, "m").withColumn("want", F.min("v").over(frame))
    assert got.where("m <> want").count() == 0 and got.count() == 200


@pytest.mark.parametrize("kind", ["f32bin", "fvecs"])
def test_a_partition_of_several_files(spark, tmp_path, kind, monkeypatch):
    writer = vector_files.Writer(f"file:{tmp_path}/x", kind, 1)
    monkeypatch.setattr(vector_files, "FILE", 4 * 2 * 10)
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda s: 3, "taskAttemptId": lambda s: 9})()))
    message = writer.write(iter([(i, [float(i), 1.0]) for i in range(25)]))
    assert len(message.files) == 3 and len(vector_files.Reader(f"{tmp_path}/x", kind).partitions()) == 1
    writer.commit([message, None])
    parts = vector_files.Reader(f"{tmp_path}/x", kind).partitions()
    rows = [v for p in parts for b in vector_files.Reader("", kind).read(p) for v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert rows == [(i, [float(i), 1.0]) for i in range(25)]
    other = writer.write(iter([(0, [0.0, 0.0])]))
    writer.abort([other])
    assert len(vector_files.Reader(f"{tmp_path}/x", kind).partitions()) == 3
    with pytest.raises(ValueError, match="dimension 1"):
        writer.write(iter([(0, [0.0, 0.0]), (1, [0.0])]))


@pytest.mark.parametrize("kind", ["f32bin", "fvecs"])
def test_vector_files(spark, tmp_path, kind):
    df = spark.range(300).select(F.col("id").alias("step"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    vector_files.write_vectors(df, str(tmp_path / "x"), kind)
    back = vector_files.read_vectors(spark, str(tmp_path / "x"), kind).orderBy("step").collect()
    assert [(r["step"], r["vec"][0]) for r in back] == [(i, float(i)) for i in range(300)]
    (tmp_path / f"bad.{kind}").write_bytes(struct.pack("<QQ", 9, 9) if kind == "f32bin" else struct.pack("<i", 0))
    with pytest.raises(ValueError):
        vector_files.shape(str(tmp_path / f"bad.{kind}"), kind)


def test_images_and_arrays(spark, tmp_path):
    raw = struct.pack(">IIII", 2051, 2, 28, 28) + bytes([7]) * 784 + bytes([9]) * 784
    (tmp_path / "i.idx3").write_bytes(raw)
    assert [r["vec"][0] for r in text_and_archives.read_idx3(spark, str(tmp_path / "i.idx3")).orderBy("step").collect()] == [7.0, 9.0]
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6.0).reshape(3, 2))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.npy", buffer.getvalue())
    assert [r["vec"] for r in text_and_archives.read_npy_zip(spark, str(tmp_path / "z.zip"), "m.npy").orderBy("step").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_logs(spark, tmp_path):
    text_and_archives.write_exact_cache(spark.createDataFrame([(100, 4357.2092208312943)], "step long, chamfer double"), str(tmp_path / "c"), {"window_size": "100"})
    assert text_and_archives.read_exact_cache(spark, str(tmp_path / "c")).first()["chamfer"] == 4357.2092208312943
    assert text_and_archives.read_cache_meta(spark, str(tmp_path / "c")).first()["value"] == "100"
    text_and_archives.write_json(spark, {"seed": 1, "per_update_ms": {"lsh": 0.5}, "name": 'a "b" \\ c'}, str(tmp_path / "t.json"))
    back = text_and_archives.read_json(spark, str(tmp_path / "t.json")).first()
    assert back["per_update_ms"]["lsh"] == 0.5 and back["name"] == 'a "b" \\ c'
    (tmp_path / "w.json").write_text('{"data_dir": "C:\\data\\x", "seed": 2}')
    assert text_and_archives.read_json(spark, str(tmp_path / "w.json")).first()["data_dir"] == "C:/data/x"


def test_guards(spark):
    a = points(spark, [[0, 0], [1, 2, 3], None], "a_id")
    assert a.where("a_id <> 1").select(V.require_dim("vec", 2)).count() == 2
    with pytest.raises(Exception, match="dimension 3"):
        a.select(V.require_dim("vec", 2)).collect()
    with pytest.raises(ValueError, match="3 rows"):
        exact.require_capacity(a, 2, "A")
    brute = exact.BruteForce(2)
    with pytest.raises(ValueError):
        brute.query([0, 0])
    with pytest.raises(ValueError):
        brute.insert([1, 2, 3])
    for v in ([3, 4], [0, 1], [0, 1]):
        brute.insert(v)
    assert brute.size() == 3 and brute.query([0, 0]) == (1, 1.0)
    brute.clear()
    assert brute.size() == 0


def test_close_pairs_of_long_vectors(spark):
    """Differences far below the error of matrix products, and thousands of equal vectors."""
    rng = np.random.default_rng(1)
    far = rng.normal(size=(1, 16)) * 1e6
    x = far + rng.normal(size=(30, 16)) * 1e-3
    y = np.concatenate([far + rng.normal(size=(40, 16)) * 1e-3, np.repeat(far, 3000, 0)])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    frame = lambda rows, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, vec array<double>")
    for block in (exact.BLOCK, 500):
        got = {r["a_id"]: (r["b_id"], r["dist"]) for r in exact.nearest(frame(x, "a_id"), frame(y, "b_id"), block=block).collect()}
        assert all(got[i][0] == int(want[i].argmin()) and abs(got[i][1] - want[i].min()) < 1e-9 for i in range(30))
    slid = windows.sliding_nearest(frame(x, "a_id"), frame(y[:40], "step"), 10, 5).collect()
    for r in slid:
        assert abs(r["dist"] - want[r["a_id"], r["step"] - 9 : r["step"] + 1].min()) < 1e-9
    assert len(slid) == 30 * 6


def test_windows_cut_into_stretches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=(1400, 3))
    frame = lambda rows, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, vec array<double>")
    a, b = frame(x, "a_id"), frame(y, "step")
    whole = {r["step"]: (r["chamfer"], r["n_a"]) for r in windows.sliding_chamfer(a, b, 300, 70).collect()}
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert whole.keys() == {s for s in range(1400) if s >= 300 and s % 70 == 0}
    assert all(abs(whole[s][0] - d[:, s - 299 : s + 1].min(1).sum()) < 1e-9 and whole[s][1] == 25 for s in whole)
    monkeypatch.setattr(windows, "LONG_BLOCK", 200)
    parts = {r["step"]: (r["chamfer"], r["n_a"]) for r in windows.sliding_chamfer(a, b, 300, 70, block=10).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[s][0] - whole[s][0]) < 1e-9 and parts[s][1] == 25 for s in whole)


def test_all_pinned_rows_count(spark):
    rows = lambda places: spark.createDataFrame([(p, [float(p), 0.0]) for p in places], "pos long, vec array<double>")
    found = windows.both_dynamic(rows(range(0, 40, 2)), rows(range(1, 40, 2)), 10, 5, rows([-1, -2, -3])).collect()
    for r in found:
        s = r["step"]
        live_a = [p for p in range(0, 40, 2) if s - 10 < p <= s] + [-1, -2, -3]
        live_b = [p for p in range(1, 40, 2) if s - 10 < p <= s]
        assert (r["n_a"], r["n_b"]) == (len(live_a), len(live_b))
        assert abs(r["chamfer"] - sum(min(abs(x - y) for y in live_b) for x in live_a)) < 1e-9
    assert len(found) == 6


def test_upkeep_refuses_what_is_not_there(spark):
    from tidewell.operators import upkeep

    p = lsh.Projection(k=3, dim=2, rho=0.5, top=3)
    a = points(spark, [[0, 0], [1, 1]], "a_id")
    state = upkeep.applied(None, upkeep.change(a, p, "a"))
    assert upkeep.applied(state, upkeep.change(a, p, "a", -1)).count() == 0
    with pytest.raises(Exception, match="not there"):
        upkeep.applied(state, upkeep.change(points(spark, [[5, 5]], "a_id"), p, "a", -1)).collect()


def test_evaluation_of_runs(spark):
    from tidewell.operators import evaluate, stepwise

    runs = spark.createDataFrame([(1, "fast", "OK"), (2, "fast", "OK"), (1, "slow", "OK"), (1, "fast", "FAILED")], "omp_threads int, kernel string, status string")
    assert evaluate.accepted_runs(runs, "fast").count() == 1
    errors = spark.createDataFrame([("x", s, 0.1 * s) for s in range(5)] + [("y", 1, 0.5)], "kind string, seed int, err double")
    assert evaluate.require_seeds(errors.where("kind = 'x'"), ["kind"], "seed", 5).count() == 5
    with pytest.raises(Exception, match="seeds: 1 of 5"):
        evaluate.require_seeds(errors, ["kind"], "seed", 5).collect()
    table = evaluate.markdown_table(errors.groupBy("kind").agg(evaluate.percent(F.avg("err")).alias("error")), ["kind"])
    assert table == ["| kind | error |", "| --- | --- |", "| x | 20.00 |", "| y | 50.00 |"]
    assert [r[0] for r in spark.range(1).select(evaluate.four_digits(F.lit(0.00032451))).collect()] == ["3.245e-04"]
    layers = spark.createDataFrame([(10, 1, 3), (10, 2, -2), (20, 1, 3)], "step long, a_id long, layer int")
    tops = spark.createDataFrame([(10, 1), (20, 5)], "step long, top int")
    assert sorted(map(tuple, stepwise.capped(layers, tops).collect())) == [(10, 1, 2), (10, 2, -2), (20, 1, 3)]


@pytest.mark.parametrize("mode", [{}, {"hashing_only": True, "with_importance": True}, {"grid_only": True, "no_outlier": True}, {"both_dynamic": True}, {"exact_only": True}])
def test_a_whole_run(spark, tmp_path, mode):
    from tidewell.config import ChamferConfig
    from tidewell.operators import stepwise
    from tidewell.plans.run import run

    rng = np.random.default_rng(4)
    for name, n in (("base.f32bin", 60), ("query.csv", 0)):
        if n:
            rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))], "step long, vec array<float>")
            vector_files.write_vectors(rows, str(tmp_path / name), "f32bin")
    (tmp_path / "test.csv").write_text("".join(",".join(map(str, v)) + "\n\n" for v in rng.normal(size=(40, 4)).round(4)))
    log = run(spark, ChamferConfig(str(tmp_path), n_max=100, window=15, every=5, rho=1e-2, k=6, budget=50, **mode)).orderBy("step").collect()
    if mode.get("both_dynamic"):
        assert [r["step"] for r in log] == list(range(15, 101, 5))
    else:
        assert [r["step"] for r in log] == list(range(15, 40, 5))
    for r in log:
        own = r.asDict()
        assert own["chamfer"] > 0
        for name in [c for c in own if c.endswith("_est")]:
            assert own[name.replace("_est", "_err")] == pytest.approx(own[name] / own["chamfer"] - 1) and abs(own[name] / own["chamfer"] - 1) < 2.0
    if not mode:
        assert set(log[0].asDict()) == {"step", "chamfer", *stepwise.LAYOUTS["full"], "quadtree_err", "e2lsh_err", "uniform_err"}


def test_missing_inputs_are_an_error(spark, tmp_path):
    from tidewell.sources import probe

    with pytest.raises(FileNotFoundError):
        probe.load_matrix(spark, str(tmp_path), probe.NAMES["a"])
    with pytest.raises(ValueError):
        probe.read_matrix(spark, "x.parquet")
    with pytest.raises(Exception, match="no file system"):
        vector_files.read_vectors(spark, "viewfs://a/b.f32bin", "f32bin").collect()


def test_config():
    from tidewell.config import ChamferConfig

    assert ChamferConfig("x").windows(1178) == (58, 21)
    for wrong in ({"hashing_only": True, "grid_only": True}, {"with_importance": True}, {"inject_outlier": True, "no_outlier": True}, {"window": 0}):
        with pytest.raises(ValueError):
            ChamferConfig("x", **wrong)


def test_missing_exact_value_is_an_error(spark):
    from tidewell.operators import evaluate

    estimates = spark.createDataFrame([(1, 2.0), (2, 3.0)], "step long, estimate double")
    known = spark.createDataFrame([(1, 2.0)], "step long, chamfer double")
    assert evaluate.against_exact(estimates.where("step = 1"), known).first()["chamfer"] == 2.0
    with pytest.raises(Exception, match="no exact value for step 2"):
        evaluate.against_exact(estimates, known).collect()


def test_state_equals_recomputation():
    """Inserts and deletes of both sides in any order: nearest rows kept in the state against distances of all pairs."""
    from tidewell.streaming.sliding import State

    rng = np.random.default_rng(6)
    state, a, b, step = State(7, 3), {}, {}, 0
    for _ in range(400):
        what = rng.choice(["A", "A-", "B", "B-"], p=[0.2, 0.1, 0.55, 0.15])
        if what == "A":
            i = int(rng.integers(0, 50))
            a[i] = rng.normal(size=3)
            state.insert_a(i, a[i])
        elif what == "A-":
            i = int(rng.integers(0, 50))
            a.pop(i, None)
            state.delete_a(i)
        elif what == "B-":
            i = int(rng.integers(max(0, step - 9), step + 1))
            b.pop(i, None)
            state.delete_b(i)
        else:
            b[step] = rng.normal(size=3)
            state.insert_b(step, b[step])
            live = [v for s, v in b.items() if s > step - 7]
            got = state.asked(step)
            if step >= 7 and step % 3 == 0 and a:
                want = sum(min(float(np.linalg.norm(x - y)) for y in live) for x in a.values())
                assert got is not None and abs(got[0] - want) < 1e-9 and got[1] == len(a)
            else:
                assert got is None
            step += 1
    assert step > 150
