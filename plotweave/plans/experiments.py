"""The workflows: one run, a comparison of all experiments, batches of states, many trials.

All of them are the same chain over keyed problems: plan, partition, refine, measure, rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.operators import balance, partitioners, ranking
from plotweave.operators.kway import MATCHINGS
from plotweave.operators.partitioners import PROBLEM
from plotweave.sources.workspace import staged

#: The canonical experiments, in the order that breaks ties.
NAMES = ("splitline-chord", "splitline-realized", "splitline-realized+kl", "metis", "metis+kl", "annealing", "annealing-from-kl")
#: What an experiment starts from.
BASES = {"splitline-realized+kl": "splitline-realized", "metis+kl": "metis", "annealing": "splitline-realized",
         "annealing-from-kl": "splitline-realized+kl"}
#: Annealing by what it starts from.
STARTS = {"splitline": "annealing", "splitline+kl": "annealing-from-kl"}
CUSTOM: dict = {}


def register_partitioner(name: str, kernel) -> None:
    """Add an experiment: ``kernel(state, k, seed, start)`` returns districts and statistics."""
    if name in NAMES or name in CUSTOM:
        raise ValueError(f"{name!r} exists")
    CUSTOM[name] = kernel


def check_names(names) -> list[str]:
    unknown = [n for n in names if n not in NAMES and n not in CUSTOM]
    if unknown or not list(names):
        raise ValueError(f"unknown experiments {unknown}; known are {[*NAMES, *CUSTOM]}" if unknown else "no experiment given")
    return list(names)


def plan_trials(units: DataFrame, experiments: list[str], trials: int = 1, *, k: int | DataFrame, base_seed: int = 42) -> DataFrame:
    """``state_code``, ``experiment``, ``trial``, ``seed``, ``k``: states x experiments x trials.

    ``k`` is one number or a table of ``state_code``, ``k``. Trial i has the seed base + i.
    """
    if trials < 1:
        raise ValueError("trials must be >= 1")
    if not experiments:
        raise ValueError("at least one experiment required")
    spark = units.sparkSession
    names = spark.createDataFrame([(n,) for n in experiments], "experiment string")
    plan = units.select("state_code").distinct().crossJoin(F.broadcast(names)).crossJoin(
        F.broadcast(spark.range(trials).select(F.col("id").cast("int").alias("trial"))))
    plan = plan.withColumn("seed", F.lit(base_seed).cast("long") + F.col("trial"))
    return plan.withColumn("k", F.lit(k)) if isinstance(k, int) else plan.join(k.select("state_code", F.col("k").cast("int").alias("k")), "state_code")


def remaining(plan: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """The problems without a result yet; all of them with ``force``."""
    return plan if force else plan.join(results.select(*PROBLEM).distinct(), PROBLEM, "left_anti")


def _as(problems: DataFrame, name: str) -> DataFrame:
    return problems.withColumn("experiment", F.lit(name))


def _after(base: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the seconds of what it started from added to its own; null where unknown."""
    took = base.groupBy("state_code", "trial").agg(F.max("seconds").alias("__before"))
    return out.join(took, ["state_code", "trial"], "left").withColumn("seconds", F.col("seconds") + F.col("__before")).select(*out.columns)


def partitions(units: DataFrame, edges: DataFrame, problems: DataFrame, experiments: list[str], *, tolerance: float = 0.005,
               angle_steps: int = 180, anneal_iterations: int = 200_000, cooling: float = 0.99995,
               temperature: float | None = None, outlines: DataFrame | None = None, repair: bool = False, **kway) -> DataFrame:
    """Districts of every problem by experiment; a base is computed once and shared.

    ``problems`` has ``state_code``, ``trial``, ``seed``, ``k``. Errors stay rows: an experiment
    whose base failed fails with the base's error. ``seconds`` are those of work in tasks, the
    base's and the repair's included. ``kway`` are options of the k-way partitioner.
    """
    wanted, done = check_names(experiments), {}
    given = problems.select("state_code", "trial", "seed", "k").distinct()

    def seeds(name: str) -> DataFrame:
        return _as(given, name)

    def start(base: str, name: str) -> DataFrame:
        return make(base).where("unit_id is not null").select(*PROBLEM, "unit_id", "district_id").withColumn("experiment", F.lit(name))

    def make(name: str) -> DataFrame:
        if name in done:
            return done[name]
        if name in CUSTOM:
            out = partitioners.solve(units, edges, seeds(name), CUSTOM[name])
        elif name.startswith("splitline") and name not in BASES:
            objective = name.removeprefix("splitline-")
            if objective == "chord" and outlines is None:
                raise ValueError("splitline-chord needs outlines")
            out = partitioners.splitline(units, edges, seeds(name), angle_steps=angle_steps, objective=objective, outlines=outlines)
        elif name == "metis":
            out = partitioners.solve(units, edges, seeds(name), partitioners.kway_kernel(tolerance, **kway))
        else:
            base = BASES[name]
            kernel = (partitioners.refine_kernel(tolerance) if name.endswith("+kl")
                      else partitioners.anneal_kernel(tolerance, anneal_iterations, cooling, temperature))
            out = partitioners.solve(units, edges, seeds(name), kernel, start(base, name))
            lost = make(base).where("error is not null").select(
                *PROBLEM, F.concat(F.lit(f"base '{base}' failed: "), F.col("error")).alias("error")).withColumn("experiment", F.lit(name))
            out = out.unionByName(lost, allowMissingColumns=True)
        for c, kind in (("seconds", "double"), ("stats", "map<string,double>")):
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast(kind))
        out = out.select(*PROBLEM, "unit_id", "district_id", "seconds", "stats", "error")
        if name in BASES:
            out = _after(make(BASES[name]), out)
        out = staged(out, "partition")
        if repair:
            fixed = partitioners.solve(units, edges, seeds(name), partitioners.repair_kernel(tolerance), out)
            fixed = _after(out, fixed.select(*out.columns)).unionByName(out.where("error is not null"))
            out = staged(fixed, "repaired")
        done[name] = out
        return out

    found = [make(n) for n in wanted]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def measure(units: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """One result row for every problem: boundary, deviation, time, refinement, error."""
    part = done.where("unit_id is not null").select(*PROBLEM, "unit_id", "district_id")
    cut = balance.cut_weight(edges, part, PROBLEM)
    report = balance.population_report(balance.district_populations(units, part, PROBLEM), PROBLEM)
    base = done.groupBy(*PROBLEM).agg(
        F.max("error").alias("error"), F.max("seconds").alias("runtime_s"),
        F.max(F.col("stats")["moves"]).cast("long").alias("refine_iterations"),
        F.max(F.col("stats")["gain_pct"]).alias("refine_improvement_pct"))
    order = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("experiment"))
    return (
        base.join(cut, PROBLEM, "left").join(report.select(*PROBLEM, "districts", "max_abs_deviation_pct"), PROBLEM, "left")
        .select(*PROBLEM, F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"),
                (F.col("cut") / 1000.0).alias("km"), F.col("max_abs_deviation_pct").alias("max_dev"),
                "runtime_s", F.coalesce("refine_iterations", F.lit(0)).alias("refine_iterations"),
                F.coalesce("refine_improvement_pct", F.lit(0.0)).alias("refine_improvement_pct"), "error",
                F.when(order == 0, len(NAMES) + 1).otherwise(order).alias("input_order"))
    )


def compare(units: DataFrame, edges: DataFrame, *, k: int | DataFrame, experiments: list[str] | None = None, seed: int = 42,
            **options) -> tuple[DataFrame, DataFrame]:
    """All experiments on every state: the districts, and the ranking with one row a result."""
    names = check_names(NAMES if experiments is None else experiments)
    done = partitions(units, edges, plan_trials(units, names, 1, k=k, base_seed=seed), names, **options)
    results = staged(measure(units, edges, done), "results")
    return done, ranking.rank_experiments(results)


def run(units: DataFrame, edges: DataFrame, *, k: int | DataFrame, algorithm: str = "metis", refine: bool = True, seed: int = 42,
        start: str = "splitline", **options) -> tuple[DataFrame, DataFrame]:
    """One algorithm on every state, refined and repaired: the districts and one result a state.

    ``start`` is what annealing begins with: ``splitline`` or ``splitline+kl``.
    """
    if start not in STARTS:
        raise ValueError(f"start must be one of {sorted(STARTS)}")
    name = {"splitline": "splitline-realized", "annealing": STARTS[start]}.get(algorithm, algorithm)
    if refine and f"{name}+kl" in NAMES:
        name = f"{name}+kl"
    done = partitions(units, edges, plan_trials(units, [name], 1, k=k, base_seed=seed), [name], repair=True, **options)
    return done, measure(units, edges, done)


def validate(units: DataFrame, edges: DataFrame, *, k: int | DataFrame, finished: DataFrame | None = None, force: bool = False,
             **options) -> DataFrame:
    """A comparison of every state without a leader yet; ledger rows, one a state.

    ``finished`` has ``state_code``, ``leader`` of earlier batches: states with a leader are
    skipped, and a state whose recorded leader is null counts as failed.
    """
    skipped = None
    if finished is not None and not force:
        skipped = finished.select("state_code", "leader", F.when(F.col("leader").isNull(), "failed").otherwise("skipped").alias("status"))
        units = units.join(finished.select("state_code"), "state_code", "left_anti")
        edges = edges.join(finished.select("state_code"), "state_code", "left_anti")
    _, ranked = compare(units, edges, k=k, **options)
    rows = ranking.leaders(ranked.drop("rank", "gap_to_leader_pct", "tied_with_next")).withColumn(
        "status", F.when(F.col("leader").isNull(), "failed").otherwise("ok"))
    return rows if skipped is None else rows.unionByName(skipped, allowMissingColumns=True)


def multi_start(units: DataFrame, edges: DataFrame, experiments: list[str], trials: int, *, k: int | DataFrame, base_seed: int = 42,
                finished: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Many seeds of some experiments: all trials, their distribution, the best, and saturation.

    Trials in ``finished`` are not run again but counted; a trial that isn't found is ``missing``.
    """
    names = check_names(experiments)
    plan = plan_trials(units, names, trials, k=k, base_seed=base_seed)
    todo = plan if finished is None else remaining(plan, finished)
    results = measure(units, edges, partitions(units, edges, todo, names, **options))
    if finished is not None:
        results = results.unionByName(finished, allowMissingColumns=True)
    found = plan.select(*PROBLEM, "seed").join(results, PROBLEM, "left").withColumn(
        "status", F.coalesce("status", F.lit("missing"))).withColumnRenamed("trial", "trial_index")
    found = staged(found, "trials")
    keys = ("state_code", "experiment")
    return {"trials": found, "distribution": ranking.trial_distribution(found, keys), "best": ranking.best_trials(found, keys),
            "saturation": ranking.saturation(found, keys)}


def sweep_matchings(units: DataFrame, edges: DataFrame, *, k: int | DataFrame, trials: int = 10, base_seed: int = 42,
                    matchings: tuple[str, ...] = MATCHINGS, **options) -> DataFrame:
    """The k-way partitioner by kind of matching and seed: ``ctype`` and what :func:`measure` has."""
    plan, found = plan_trials(units, ["metis"], trials, k=k, base_seed=base_seed), None
    for kind in matchings:
        one = measure(units, edges, partitions(units, edges, plan, ["metis"], ctype=kind, **options)).withColumn("ctype", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found
