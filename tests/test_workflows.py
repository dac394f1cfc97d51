import json
import struct

import pytest
from pyspark.sql import functions as F

import grids
from plotweave import cli
from plotweave.functions.geometry import RINGS
from plotweave.operators import adjacency, balance, partitioners, ranking
from plotweave.plans import apportionment, experiments, tasks
from plotweave.sources import schemas, sinks, tables


@pytest.fixture(scope="module")
def grid(spark):
    u = grids.units(spark, grids.cells(8, 8)).cache()
    e = adjacency.adjacency(u).cache()
    return u, e


def test_seats_and_tiers():
    assert sum(apportionment.DISTRICTS_2020.values()) == 435
    assert [apportionment.districts_for(s) for s in ("ID", "IA", "CA", "wy")] == [2, 4, 52, 1]
    assert [len(v) for v in apportionment.TIERS.values()] == [21, 14, 9] and apportionment.tier_for("ZZ") is None
    with pytest.raises(ValueError):
        apportionment.districts_for("ZZ")
    assert apportionment.states_of(None, " id, mt") == ["ID", "MT"] and len(apportionment.states_of("all", None)) == 44
    for bad in ((None, None), ("easy", "ID"), ("none", None)):
        with pytest.raises(ValueError):
            apportionment.states_of(*bad)


@pytest.mark.parametrize(("objective", "k"), [("realized", 4), ("chord", 4), ("realized", 3)])
def test_splitline(spark, grid, objective, k):
    u, e = grid
    plan = experiments.plan_trials(u, ["s"], 1, k=k)
    outlines = spark.createDataFrame([("TT", grids.ring(0, 0, 8, 8))], f"state_code string, rings {RINGS}")
    done = partitioners.splitline(u, e, plan, angle_steps=36, objective=objective, outlines=outlines, steps_a_task=12).cache()
    keys = partitioners.PROBLEM
    d = balance.district_populations(u, done.select(*keys, "unit_id", "district_id"), keys).collect()
    assert sorted(r["district_id"] for r in d) == list(range(k)) and sum(r["pop"] for r in d) == 640
    if k == 4:
        assert {r["pop"] for r in d} == {160}
        assert balance.cut_weight(e, done, keys).first()["cut"] == pytest.approx(16)


def test_splitline_arguments_and_failure(spark, grid):
    u, e = grid
    plan = experiments.plan_trials(u, ["s"], 1, k=2)
    with pytest.raises(ValueError):
        partitioners.splitline(u, e, plan, angle_steps=1)
    with pytest.raises(ValueError):
        partitioners.splitline(u, e, plan, objective="chord")
    point = u.withColumns({"cx": F.lit(1.0), "cy": F.lit(1.0)})
    rows = partitioners.splitline(point, e, plan, angle_steps=4).collect()
    assert len(rows) == 1 and rows[0]["unit_id"] is None and "No valid cut" in rows[0]["error"]


def test_compare_ranks_everything(spark, grid):
    u, e = grid
    outlines = spark.createDataFrame([("TT", grids.ring(0, 0, 8, 8))], f"state_code string, rings {RINGS}")
    done, ranked = experiments.compare(u, e, k=4, angle_steps=12, anneal_iterations=500, outlines=outlines, tolerance=0.01)
    rows = [r.asDict() for r in ranked.collect()]
    assert {r["experiment"] for r in rows} == set(experiments.NAMES)
    ok = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ok] == list(range(1, len(ok) + 1)) and ok[0]["gap_to_leader_pct"] == 0
    assert all(a["km"] <= b["km"] for a, b in zip(ok, ok[1:]))
    cut = {r["experiment"]: r["km"] for r in ok}
    assert cut["splitline-realized+kl"] <= cut["splitline-realized"] and all(r["max_dev"] <= 1.0 for r in ok)


def test_failed_base_and_custom(spark, grid):
    u, e = grid
    lumpy = u.withColumn("pop", F.when(F.col("unit_id") == 0, 10_000).otherwise(1).cast("bigint"))
    rows = {r["experiment"]: r for r in experiments.measure(
        lumpy, e, experiments.partitions(lumpy, e, experiments.plan_trials(u, ["metis"], 1, k=4), ["metis", "metis+kl"], attempts=1)).collect()}
    assert rows["metis"]["status"] == "failed" and rows["metis"]["km"] is None
    assert rows["metis+kl"]["error"].startswith("base 'metis' failed: RuntimeError")
    experiments.register_partitioner("stripes", lambda s, k, seed, start: ((s.x * k / 8).astype(int), {}))
    with pytest.raises(ValueError):
        experiments.register_partitioner("stripes", None)
    got = experiments.measure(u, e, experiments.partitions(u, e, experiments.plan_trials(u, ["stripes"], 1, k=4), ["stripes"])).first()
    assert got["status"] == "ok" and got["km"] == pytest.approx(0.024)
    with pytest.raises(ValueError):
        experiments.check_names(["nothing"])


def test_run_repairs_and_multi_start(spark, grid):
    u, e = grid
    done, result = experiments.run(u, e, k=2)
    r = result.first()
    assert r["status"] == "ok" and r["experiment"] == "metis+kl" and r["km"] == pytest.approx(0.008)
    found = experiments.multi_start(u, e, ["metis"], 3, k=4)
    t = found["trials"].orderBy("trial_index").collect()
    assert [x["seed"] for x in t] == [42, 43, 44] and {x["status"] for x in t} == {"ok"}
    assert found["best"].first()["km"] == min(x["km"] for x in t)
    kept = found["trials"].withColumnRenamed("trial_index", "trial").drop("seed")
    again = experiments.multi_start(u, e, ["metis"], 4, k=4, finished=kept)
    assert again["distribution"].first()["trials"] == 4


def results(spark, rows):
    return spark.createDataFrame(rows, "state_code string, experiment string, status string, km double, max_dev double, "
                                       "runtime_s double, input_order int")


def test_ranking(spark):
    r = results(spark, [("TN", "a", "ok", 1548.24, 0.3, 1.0, 1), ("TN", "b", "ok", 1375.33, 0.4, 1.0, 2),
                        ("TN", "c", "ok", 1548.24, 0.2, 1.0, 3), ("TN", "d", "failed", None, None, 1.0, 4)])
    got = {x["experiment"]: x for x in ranking.rank_experiments(r).collect()}
    assert [got[x]["rank"] for x in "abcd"] == [3, 1, 2, None]
    assert got["a"]["gap_to_leader_pct"] == pytest.approx(12.572, abs=1e-3) and got["d"]["gap_to_leader_pct"] is None
    lead = ranking.leaders(r).first()
    assert (lead["leader"], lead["runner_up"], lead["experiments_ok"], lead["experiments_failed"]) == ("b", "c", 3, 1)
    none = ranking.leaders(results(spark, [("XX", "a", "failed", None, None, 1.0, 1)])).first()
    assert none["leader"] is None and none["experiments_failed"] == 1


def test_trials(spark):
    t = spark.createDataFrame([("m", 0, 42, "ok", 100.0, 0.1, 1.0), ("m", 1, 43, "ok", 95.0, 0.1, 1.0), ("m", 2, 44, "ok", 102.0, 0.1, 1.0),
                               ("m", 3, 45, "failed", None, None, 1.0), ("s", 0, 42, "ok", 7.0, 0.1, 1.0)],
                              "experiment string, trial_index int, seed int, status string, km double, max_dev double, runtime_s double")
    d = {r["experiment"]: r for r in ranking.trial_distribution(t).collect()}
    assert d["m"]["mean_km"] == 99 and d["m"]["median_km"] == 100 and (d["m"]["trials_ok"], d["m"]["trials_failed"]) == (3, 1)
    assert d["s"]["std_km"] == 0
    b = {r["experiment"]: r for r in ranking.best_trials(t).collect()}["m"]
    assert (b["trial_index"], b["seed"], b["trial_dir"]) == (1, 43, "trial-01-seed-43")
    s = {r["experiment"]: r for r in ranking.saturation(t).collect()}["m"]
    assert (s["best_of_1"], s["best_of_2"], s["best_of_20"]) == (100, 95, 95)
    x = ranking.expected_trials(t, t.select("experiment").distinct(), 6)
    assert x.where("status = 'missing'").count() == 7


def test_ledger_upsert(spark):
    old = spark.createDataFrame([("ID", 1, "ok"), ("MT", 1, "ok")], "state_code string, at int, status string")
    new = spark.createDataFrame([("ID", 2, "failed"), ("MT", 0, "failed"), ("WY", 1, "ok")], old.schema)
    got = {r["state_code"]: r["status"] for r in ranking.upsert(old, new, ["state_code"], "at").collect()}
    assert got == {"ID": "failed", "MT": "ok", "WY": "ok"}


def test_sliding_mean(spark):
    s = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 60.0), (6, 90.0)], "t int, value double").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = [r["window_mean"] for r in ranking.sliding_mean(s).orderBy("t").collect()]
    assert got == [10, 15, 30, pytest.approx((20 + 60 + 90) / 3)]


def test_agenda():
    g = tasks.agenda_of(["ID"], ["metis", "metis+kl"])
    a, b = g.take(), g.take()
    assert [a.work, b.work] == ["metis", "metis+kl"] and g.take() is None and g
    g.close(a, "x")
    assert g.take() is None
    g.put_back(b)
    assert g.take() == b
    g.close(b)
    last = g.take()
    assert last == tasks.Job("ID", tasks.RANK) and g.errors == {a: "x"}
    g.close(last)
    assert not g
    trials = tasks.agenda_of_trials("TX", ["a", "b"], 3)
    assert [trials.take() for _ in range(7)] == [*[tasks.Job("TX", n, i) for n in "ab" for i in range(3)], None]
    for bad in (([], 3), (["a"], 0)):
        with pytest.raises(ValueError):
            tasks.agenda_of_trials("TX", *bad)


def test_admission_and_load():
    c = tasks.DEFAULTS
    assert tasks.admits(c, 0, 10) and tasks.admits(c | {"max_workers": 2}, 1, 10)
    for blocked in ({"paused": True}, {"freeze": True}, {"target_cpu_pct": 10}, {"max_workers": 1}):
        assert not tasks.admits(c | blocked, 1, 10)
    load = tasks.Load(5)
    assert [load.add(t, v) for t, v in ((0, 10), (1, 20), (2, 60), (6, 90))] == [10, 15, 30, pytest.approx((20 + 60 + 90) / 3)]


def test_control_log(tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: tasks.say(tmp_path, target_cpu_pct=50.0 + i, **({"paused": True} if i == 7 else {})), range(20)))
    now = tasks.heard(tmp_path)
    assert now["version"] == 20 and now["paused"] and 50 <= now["target_cpu_pct"] <= 69 and now["freeze"] is False
    with pytest.raises(ValueError):
        tasks.say(tmp_path, speed=3)


def test_work_off(tmp_path):
    seen = []

    def work(job):
        if job.work == "metis":
            raise RuntimeError("no")
        return job.work

    tasks.work_off(tasks.agenda_of(["ID"], ["metis", "metis+kl"]), work, tmp_path, target_cpu_pct=100.0, poll_seconds=0.01,
                   sample=lambda: 0.0, on_over=lambda j, v, e: seen.append((j.work, v, e)))
    assert sorted(seen) == [("metis", None, "RuntimeError: no"), ("metis+kl", "metis+kl", None), (tasks.RANK, tasks.RANK, None)]
    assert seen[-1][0] == tasks.RANK


def test_freeze_stops_and_resume_starts_anew(spark, tmp_path):
    import threading
    import time
    begun, seen = [], []

    def work(job):
        begun.append(time.monotonic())
        sleepy = F.udf(lambda i: time.sleep(0.2 if len(begun) == 1 else 0) or i, "long")
        return spark.range(0, 200, numPartitions=2).select(F.sum(sleepy("id"))).first()[0]

    def operator():
        while not begun:
            time.sleep(0.05)
        time.sleep(1)
        tasks.say(tmp_path, freeze=True)
        time.sleep(2)
        seen.append(len(begun))
        tasks.say(tmp_path, freeze=False)

    t = threading.Thread(target=operator)
    t.start()
    over = []
    tasks.work_off(tasks.Agenda([tasks.Job("ID", "metis")]), work, tmp_path, spark=spark, target_cpu_pct=100.0, poll_seconds=0.05,
                   sample=lambda: 0.0, on_over=lambda j, v, e: over.append((v, e)))
    t.join()
    assert seen == [1] and len(begun) == 2 and over == [(19900, None)]


def test_outputs(spark, tmp_path):
    from plotweave.operators import dissolve
    u = grids.units(spark, [(0, 0), (1, 0)], pop=1000)
    part = u.select("state_code", "unit_id", F.col("unit_id").cast("int").alias("district_id"))
    shapes = dissolve.district_shapes(u, part)
    info = sinks.RunInfo("TT", "Testlandia", "metis", 42, 1.5)
    got = sinks.write_outputs(tmp_path, shapes, 1.0, info)
    assert set(got) == sinks.FORMATS and all(p.stat().st_size for p in got.values())
    m = json.loads(got["metrics"].read_text())
    assert m["total_internal_boundary_km"] == 0.001 and m["population"]["per_district"] == [1000, 1000]
    assert m["compactness"]["polsby_popper"][0] == pytest.approx(0.7853981)
    assert len(got["log"].read_text().splitlines()) == 11
    back = tables.read_geojson(spark, str(got["geojson"])).orderBy("district_id").collect()
    assert [r["pop"] for r in back] == [1000, 1000] and len(back[0]["rings"][0]) == 4
    shp = got["shapefile"].read_bytes()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    assert got["png"].read_bytes()[:4] == b"\x89PNG"
    import zlib
    raw = got["png"].read_bytes()
    at = raw.index(b"IDAT")
    assert b"\0" * 24 in zlib.decompress(raw[at + 4:at + 4 + struct.unpack(">I", raw[at - 4:at])[0]])  # numbers in black
    with pytest.raises(ValueError):
        sinks.write_outputs(tmp_path, shapes, 1.0, info, {"pdf"})
    assert set(sinks.write_outputs(tmp_path / "light", shapes, 1.0, info, {"log"})) == {"log"}


def test_ledger_files(tmp_path):
    row = {"state_code": "ID", "status": "skipped", "error": None, "elapsed_seconds": 3.0, "leader": "metis", "leader_boundary_km": 5.0,
           "runner_up": None, "gap_to_runner_up_pct": None}
    bad = {"state_code": "ZZ", "status": "failed", "error": "a|b", "elapsed_seconds": 1.0}
    sinks.update_ledger(tmp_path, [row], apportionment.tier_for)
    sinks.update_ledger(tmp_path, [row, bad], apportionment.tier_for, sinks.run_entry(None, [row, bad]))
    got = json.loads((tmp_path / "summary.json").read_text())
    assert (got["ok_count"], got["failed_count"], got["state_count"], len(got["runs"])) == (1, 1, 2, 1)
    assert got["state_results"]["ID"]["status"] == "ok" and got["runs"][0]["skipped"] == ["ID"]
    text = (tmp_path / "summary.md").read_text()
    assert "| easy | ID | ok | metis | 5.00 | - | - | 3.0 |" in text and "a\\|b" in text and "| custom | 2 | 0 | 1 | 1 |" in text


def test_schemas(spark, grid):
    u, e = grid
    assert schemas.assert_schema(e, schemas.EDGES) is e
    with pytest.raises(ValueError):
        schemas.assert_schema(u, schemas.UNITS)
    a = spark.createDataFrame([("TT", 1)], "state_code string, srid int")
    with pytest.raises(ValueError):
        schemas.assert_same_srid(a, a.withColumn("srid", F.lit(2)))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A small state stored as raw tables, in degrees."""
    root = tmp_path_factory.mktemp("data")
    rows = [("MT", f"30{i:06d}", 100, grids.ring(-110 + x * 0.1, 45 + y * 0.1, 0.1, 0.1)) for i, (x, y) in enumerate(grids.cells(6, 6))]
    spark.createDataFrame(rows, f"state_code string, GEOID20 string, POP20 int, rings {RINGS}").withColumn("year", F.lit(2020)).write.partitionBy(
        "state_code", "year").parquet(f"{root}/blocks")
    spark.createDataFrame([("MT", "Montana", "30", grids.ring(-110, 45, 0.6, 0.6))],
                          f"STUSPS string, NAME string, STATEFP string, rings {RINGS}").write.parquet(f"{root}/states")
    return str(root)


def test_tables(spark, data):
    u = tables.read_units(spark, data, ["mt"])
    assert u.count() == 36 and u.agg(F.max("unit_id")).first()[0] == 35
    assert tables.read_states(spark, data, ["mt"]).first()["n_districts"] == 2
    with pytest.raises(ValueError):
        tables.read_states(spark, data, ["ZZ"])
    with pytest.raises(RuntimeError):
        tables.normalise_units(u.drop("pop").withColumnRenamed("geoid", "GEOID20"))
    e = tables.cached_edges(u, data)
    assert e.count() == 60 and tables.cached_edges(u, data).count() == 60
    changed = u.withColumn("pop", F.col("pop") + 1)
    assert tables.fingerprint(changed) != tables.fingerprint(u)


def test_jobs_by_experiment_go_on_where_they_were(spark, data, tmp_path):
    """With --cpu every experiment is a job; results that are there are kept, and the ranking reads them."""
    common = ["--data", data, "--tolerance", "0.02", "--angle-steps", "6", "--cpu", "100", "--poll", "0.05", "--output", str(tmp_path)]
    args = cli.parser().parse_args(["validate", "--states", "MT,ZZ", "--algorithms", "metis,metis+kl", *common])
    rows = {r["state_code"]: r for r in cli.validate(spark, args)}
    assert rows["MT"]["status"] == "ok" and rows["MT"]["experiments_ok"] == 2 and rows["ZZ"]["status"] == "failed"
    one = tmp_path / "MT" / "experiments" / "metis" / "task_result.json"
    kept = json.loads(one.read_text())
    assert kept["runtime_seconds"] > 0 and (tmp_path / "MT" / "districts.geojson").exists()
    one.write_text(json.dumps(kept | {"total_internal_boundary_km": 0.5}))
    (tmp_path / "MT" / "leader.json").unlink()
    (tmp_path / "MT" / "experiments" / "metis+kl" / "task_result.json").unlink()
    rows = {r["state_code"]: r for r in cli.validate(spark, args)}
    assert rows["MT"]["leader"] == "metis" and rows["MT"]["leader_boundary_km"] == 0.5 and rows["MT"]["experiments_ok"] == 2


def test_runtimes_add_up(spark, grid):
    u, e = grid
    names = ["splitline-realized", "splitline-realized+kl", "annealing-from-kl"]
    done = experiments.partitions(u, e, experiments.plan_trials(u, names, 1, k=4), names, angle_steps=12, anneal_iterations=2000)
    took = {r["experiment"]: r["runtime_s"] for r in experiments.measure(u, e, done).collect()}
    assert 0 < took[names[0]] < took[names[1]] < took[names[2]]


def test_matchings_and_random_graph(spark, grid):
    u, e = grid
    got = experiments.sweep_matchings(u, e, k=4, trials=2, attempts=1, tolerance=0.02).collect()
    assert {(r["ctype"], r["trial"]) for r in got} == {(c, t) for c in ("SHEM", "RM") for t in (0, 1)}


def test_command_line(spark, data, tmp_path, capsys):
    common = ["--data", data, "--tolerance", "0.02", "--angle-steps", "6"]
    assert cli.main(["run", "mt", "--output", str(tmp_path / "run"), *common]) == 0
    assert (tmp_path / "run" / "districts.geojson").exists()
    args = ["validate", "--states", "MT,ZZ", "--algorithms", "metis,metis+kl", "--output", str(tmp_path / "v"), *common]
    assert cli.main(args) == 0 and cli.main(args) == 0
    ledger = json.loads((tmp_path / "v" / "summary.json").read_text())
    assert ledger["state_results"]["MT"]["status"] == "ok" and ledger["state_results"]["ZZ"]["status"] == "failed"
    assert ledger["runs"][1]["skipped"] == ["MT"] and (tmp_path / "v" / "MT" / "leader.md").exists()
    back = sinks.read_task_results(spark, str(tmp_path / "v" / "MT" / "experiments"))
    assert back.count() == 2
    assert cli.main(["multi-start", "MT", "--algorithms", "metis", "--trials", "2", "--output", str(tmp_path / "m"), *common]) == 0
    assert "2 / 2" in (tmp_path / "m" / "_summary.md").read_text()
    assert cli.main(["validate-ctl", "pause", "--output", str(tmp_path / "v")]) == 0
    assert tasks.heard(tmp_path / "v")["paused"]
    for bad in (["validate", "--output", "x", "--cpu", "0"], ["multi-start", "MT", "--output", "x", "--trials", "0"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
