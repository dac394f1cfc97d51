"""Command line: run, compare, validate, multi-start and validate-ctl."""

from __future__ import annotations

import argparse
import json
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators import dissolve, kway, ranking
from plotweave.operators.ranking import SATURATION
from plotweave.plans import apportionment, experiments, tasks
from plotweave.sources import sinks, tables, workspace


def session() -> SparkSession:
    return SparkSession.builder.appName("plotweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _percent(text: str) -> float:
    value = float(text)
    if not 1 <= value <= 100:
        raise argparse.ArgumentTypeError("must be between 1 and 100")
    return value


def _count(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plotweave")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument("--output", required=True)
        return p

    def shared(p: argparse.ArgumentParser) -> None:
        p.add_argument("--data", help="root of the stored tables")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--tolerance", type=float, default=0.005)
        p.add_argument("--angle-steps", type=int, default=180)
        p.add_argument("--full-artifacts", action="store_true")
        p.add_argument("--iterations", type=_count, default=200_000, help="steps of annealing")
        p.add_argument("--cooling", type=float, default=0.99995)
        p.add_argument("--temperature", type=float, help="start of annealing; found from the partition if not given")
        p.add_argument("--ctype", choices=kway.MATCHINGS, default=kway.MATCHINGS[0])
        p.add_argument("--recursive", action="store_true", help="bisect only; districts may fall apart before repair")

    p = command("run", "one algorithm on one state")
    p.add_argument("state")
    p.add_argument("--algorithm", choices=("splitline", "metis", "annealing"), default="metis")
    p.add_argument("--districts", type=_count)
    p.add_argument("--no-refine", action="store_true")
    p.add_argument("--start", choices=sorted(experiments.STARTS), default="splitline", help="what annealing begins with")
    shared(p)
    p = command("compare", "all experiments on one state")
    p.add_argument("state")
    p.add_argument("--districts", type=_count)
    shared(p)
    p = command("validate", "all experiments on many states")
    p.add_argument("--tier", choices=[*sorted(apportionment.TIERS), "all"])
    p.add_argument("--states")
    p.add_argument("--algorithms")
    p.add_argument("--force", action="store_true")
    p.add_argument("--cpu", type=_percent)
    p.add_argument("--max-workers", type=_count)
    p.add_argument("--poll", type=float, default=3.0, help="seconds between looks at the load and the control log")
    shared(p)
    p = command("multi-start", "many seeds of some experiments on one state")
    p.add_argument("state")
    p.add_argument("--algorithms", default="metis+kl,splitline-realized+kl")
    p.add_argument("--trials", type=_count, default=20)
    p.add_argument("--districts", type=_count)
    p.add_argument("--force", action="store_true")
    shared(p)
    p = sub.add_parser("validate-ctl", help="steer a running batch")
    p.add_argument("action", choices=("set-cpu", "set-max-workers", "pause", "freeze", "resume", "status"))
    p.add_argument("value", nargs="?")
    p.add_argument("--output", required=True)
    return top


def options(args) -> dict:
    """What the partitioners are told."""
    return {"tolerance": args.tolerance, "angle_steps": args.angle_steps, "anneal_iterations": args.iterations, "cooling": args.cooling,
            "temperature": args.temperature, "ctype": args.ctype, "recursive": args.recursive, "contiguous": not args.recursive}


def load(spark: SparkSession, args, codes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, edges and outlines of some states."""
    units = tables.read_units(spark, args.data, codes)
    return units, tables.cached_edges(units, args.data), tables.read_states(spark, args.data, codes)


def _state(outlines: DataFrame, code: str, districts: int | None) -> dict:
    row = outlines.where(F.col("state_code") == code).select("state_code", "name", "fips", "n_districts", "srid").first()
    return {"code": code, "name": row["name"], "fips": row["fips"], "srid": row["srid"],
            "n_districts": districts or apportionment.districts_for(code)}


def _write(folder: Path, units: DataFrame, done: DataFrame, result: dict, state: dict, seed: int, formats: set[str] | None) -> None:
    """The artefacts of one result, or its failure log."""
    info = sinks.RunInfo(state["code"], state["name"], result["experiment"], seed, result["runtime_s"])
    if result["status"] != "ok":
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "run.log").write_text(sinks.failure_log(info, result["error"]))
        return
    own = done.where((F.col("experiment") == result["experiment"]) & (F.col("state_code") == state["code"])
                     & (F.col("trial") == result["trial"]) & F.col("unit_id").isNotNull())
    shapes = dissolve.district_shapes(units, own.select("state_code", "unit_id", "district_id"))
    sinks.write_outputs(folder, shapes, result["km"] * 1000.0, info, formats, state["srid"])


def run(spark: SparkSession, args) -> dict:
    code = args.state.upper()
    units, edges, outlines = load(spark, args, [code])
    state = _state(outlines, code, args.districts)
    done, results = experiments.run(units, edges, k=state["n_districts"], algorithm=args.algorithm, refine=not args.no_refine,
                                    seed=args.seed, start=args.start, **options(args))
    result = results.first().asDict()
    _write(Path(args.output), units, done, result, state, args.seed, None)
    if result["status"] != "ok":
        raise SystemExit(f"{code}: {result['error']}")
    return result


def record(units: DataFrame, done: DataFrame, ranked: list[dict], state: dict, folder: Path, seed: int, full: bool) -> None:
    """All artefacts of one state: every experiment's, the leader's in full, and the ranking."""
    for r in ranked:
        _write(folder / "experiments" / r["experiment"], units, done, r, state, seed, None if full else set(sinks.LIGHT_FORMATS))
    if leader := next((r for r in ranked if r["rank"] == 1), None):
        _write(folder, units, done, leader, state, seed, None)
    sinks.write_state_record(folder, state, ranked)


def compare(spark: SparkSession, args, code: str | None = None, names: list[str] | None = None, folder: Path | None = None) -> list[dict]:
    code = code or args.state.upper()
    units, edges, outlines = load(spark, args, [code])
    state = _state(outlines, code, getattr(args, "districts", None))
    done, ranked = experiments.compare(units, edges, k=state["n_districts"], experiments=names, seed=args.seed,
                                       outlines=outlines, **options(args))
    rows = [r.asDict() for r in ranked.orderBy(F.col("rank").asc_nulls_last(), "input_order").collect()]
    record(units, done, rows, state, folder or Path(args.output), args.seed, args.full_artifacts)
    return rows


def _summary(code: str, ranked: list[dict], seconds: float) -> dict:
    ok = [r for r in ranked if r["status"] == "ok"]
    return {"state_code": code, "status": "ok" if ok else "failed", "error": None if ok else "every experiment failed",
            "elapsed_seconds": seconds, "leader": ok[0]["experiment"] if ok else None,
            "leader_boundary_km": ok[0]["km"] if ok else None, "runner_up": ok[1]["experiment"] if len(ok) > 1 else None,
            "gap_to_runner_up_pct": ok[1]["gap_to_leader_pct"] if len(ok) > 1 else None,
            "experiments_ok": len(ok), "experiments_failed": len(ranked) - len(ok)}


def _cached(code: str, path: Path) -> dict:
    """The ledger row of a state that is skipped: failed if it was recorded without a leader."""
    ranked = json.loads(path.read_text())
    rows = [{"status": r["status"], "experiment": r["experiment"], "km": r["total_internal_boundary_km"],
             "gap_to_leader_pct": r["gap_to_leader_pct"]} for r in ranked["ranking"]]
    return _summary(code, rows, 0.0) | {"status": "failed" if ranked["leader"] is None else "skipped"}


def run_task(spark: SparkSession, args, code: str, name: str, folder: Path) -> None:
    """One experiment of one state; its districts and result are left in the state's folder, and a
    result that is there already is kept unless all is to be done anew."""
    home = folder / "experiments" / name
    if (home / "task_result.json").exists() and not args.force:
        return
    units, edges, outlines = load(spark, args, [code])
    state = _state(outlines, code, None)
    done, ranked = experiments.compare(units, edges, k=state["n_districts"], experiments=[name], seed=args.seed,
                                       outlines=outlines, **options(args))
    result = ranked.first().asDict()
    _write(home, units, done, result, state, args.seed, None if args.full_artifacts else set(sinks.LIGHT_FORMATS))
    done.write.mode("overwrite").parquet(f"{home}/districts.parquet")
    (home / "task_result.json").write_text(sinks.task_result_json(result))


def finish_state(spark: SparkSession, args, code: str, names: list[str], folder: Path) -> list[dict]:
    """Rank what a state's tasks have left; an experiment without a result has failed."""
    units, _, outlines = load(spark, args, [code])
    state = _state(outlines, code, None)
    order = spark.createDataFrame(list(enumerate(names, 1)), "input_order int, experiment string")
    there = any((folder / "experiments").glob("*/task_result.json"))
    found = (sinks.read_task_results(spark, f"{folder}/experiments") if there
             else spark.createDataFrame([], sinks.read_schema())).drop("input_order")
    results = order.join(found, "experiment", "left").select(
        F.lit(code).alias("state_code"), F.lit(0).alias("trial"), "*").withColumns({
            "error": F.when(F.col("status").isNull(), F.lit("no result")).otherwise(F.col("error")),
            "status": F.coalesce("status", F.lit("failed"))})
    rows = [r.asDict() for r in ranking.rank_experiments(results).orderBy(F.col("rank").asc_nulls_last(), "input_order").collect()]
    if leader := next((r for r in rows if r["rank"] == 1), None):
        done = spark.read.parquet(f"{folder}/experiments/{leader['experiment']}/districts.parquet")
        _write(folder, units, done, leader, state, args.seed, None)
    sinks.write_state_record(folder, state, rows)
    return rows


def validate(spark: SparkSession, args) -> list[dict]:
    """Batches of states. With ``--cpu`` every experiment of a state is a job of its own, several at
    once under the operator's control, and a batch that was broken off goes on where it was."""
    codes = apportionment.states_of(args.tier, args.states)
    names = experiments.check_names([a.strip() for a in args.algorithms.split(",")] if args.algorithms else experiments.NAMES)
    out, rows = Path(args.output), []

    def keep(row: dict) -> None:
        rows.append(row)
        sinks.update_ledger(out, [row], apportionment.tier_for)

    def failed(code: str, seconds: float, error: str) -> dict:
        return _summary(code, [], seconds) | {"error": error}

    todo, began = [], time.monotonic()
    for code in codes:
        if (leader := out / code / "leader.json").exists() and not args.force:
            keep(_cached(code, leader))
        else:
            todo.append(code)
    if args.cpu is None:
        for code in todo:
            began = time.monotonic()
            try:
                keep(_summary(code, compare(spark, args, code, names, out / code), time.monotonic() - began))
            except Exception as failure:  # noqa: BLE001  a state's failure is its ledger row
                keep(failed(code, time.monotonic() - began, f"{type(failure).__name__}: {failure}"))
    elif todo:
        def work(job: tasks.Job):
            if job.work == tasks.RANK:
                return finish_state(spark, args, job.state, names, out / job.state)
            return run_task(spark, args, job.state, job.work, out / job.state)

        def over(job: tasks.Job, value, error: str | None) -> None:
            if job.work == tasks.RANK:
                took = time.monotonic() - began
                keep(_summary(job.state, value, took) if error is None else failed(job.state, took, error))

        tasks.work_off(tasks.agenda_of(todo, names), work, out, spark=spark, poll_seconds=args.poll, on_over=over,
                       target_cpu_pct=args.cpu, max_workers=args.max_workers)
    sinks.update_ledger(out, [], apportionment.tier_for, sinks.run_entry(args.tier, rows))
    return rows


def multi_start(spark: SparkSession, args) -> dict:
    code, out = args.state.upper(), Path(args.output)
    names = experiments.check_names([a.strip() for a in args.algorithms.split(",")])
    units, edges, outlines = load(spark, args, [code])
    state = _state(outlines, code, args.districts)
    store = f"{args.output}/{code}/trials.parquet"
    finished = spark.read.parquet(store) if not args.force and Path(store).exists() else None
    found = experiments.multi_start(units, edges, names, args.trials, k=state["n_districts"], base_seed=args.seed,
                                    finished=finished, outlines=outlines, **options(args))
    trials = [r.asDict() for r in found["trials"].orderBy("experiment", "trial_index").collect()]
    if trials:
        (out / code).mkdir(parents=True, exist_ok=True)
        kept = found["trials"].where("status <> 'missing'").withColumnRenamed("trial_index", "trial").drop("seed")
        fresh = f"{store}.new"
        kept.coalesce(1).write.mode("overwrite").parquet(fresh)
        shutil.rmtree(store, ignore_errors=True)
        shutil.move(fresh, store)
    best = {r["experiment"]: r.asDict() for r in found["best"].collect()}
    distribution = [r.asDict() for r in found["distribution"].collect()]
    distribution.sort(key=lambda d: names.index(d["experiment"]))
    for d in distribution:
        folder = out / code / d["experiment"]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "best.json").write_text(json.dumps({"best": best.get(d["experiment"]), "distribution": d}, indent=2))
    (out / "distributions.json").write_text(json.dumps(
        {"state": code, "trials_per_algorithm": args.trials, "base_seed": args.seed, "results": trials}, indent=2, default=str))
    saturation = [r.asDict() for r in found["saturation"].collect()]
    (out / "_summary.md").write_text(sinks.trials_markdown(code, distribution, saturation, SATURATION))
    return {"best": best, "distribution": distribution}


def control(args) -> dict:
    said = {
        "pause": lambda: {"paused": True}, "freeze": lambda: {"freeze": True}, "resume": lambda: {"paused": False, "freeze": False},
        "set-cpu": lambda: {"target_cpu_pct": _percent(args.value)},
        "set-max-workers": lambda: {"max_workers": None if args.value in (None, "none") else _count(args.value)},
    }
    return tasks.heard(args.output) if args.action == "status" else tasks.say(args.output, **said[args.action]())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "validate-ctl":
        print(json.dumps(control(args), indent=2))
        return 0
    spark = session()
    try:
        return work(spark, args)
    finally:
        workspace.release(spark)


def work(spark: SparkSession, args) -> int:
    if args.command == "run":
        r = run(spark, args)
        print(f"{r['experiment']}: {r['km']:.2f} km, deviation {r['max_dev']:.4f} %")
    elif args.command == "compare":
        leader = next((r for r in compare(spark, args) if r["rank"] == 1), None)
        if leader is None:
            raise SystemExit(f"No experiment succeeded for {args.state.upper()}")
        print(f"leader: {leader['experiment']}, {leader['km']:.2f} km")
    elif args.command == "validate":
        rows = validate(spark, args)
        print(", ".join(f"{s} {sum(r['status'] == s for r in rows)}" for s in ("ok", "failed", "skipped")))
    else:
        for name, b in multi_start(spark, args)["best"].items():
            print(f"{name}: {b['km']:.2f} km in {b['trial_dir']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
