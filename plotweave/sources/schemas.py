"""Declared schemas, and a check that fails early."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from plotweave.functions.geometry import RINGS

STATES = f"state_code string, name string, fips string, n_districts int, srid int, rings {RINGS}"
UNITS = f"state_code string, unit_id bigint, geoid string, pop bigint, cx double, cy double, srid int, rings {RINGS}"
EDGES = "state_code string, src bigint, dst bigint, length double, is_synthetic boolean"
ASSIGNMENTS = "state_code string, experiment string, trial int, unit_id bigint, district_id int"
RESULTS = ("state_code string, experiment string, trial int, status string, km double, max_dev double, runtime_s double, "
           "refine_iterations bigint, refine_improvement_pct double, error string")
LEDGER = ("state_code string, status string, error string, tier string, elapsed_seconds double, leader string, "
          "leader_boundary_km double, runner_up string, gap_to_runner_up_pct double, experiments_ok bigint, "
          "experiments_failed bigint, updated_at timestamp")
RUNS = ("timestamp timestamp, tier string, states_attempted array<string>, ok array<string>, failed array<string>, "
        "skipped array<string>")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def assert_schema(df: DataFrame, ddl: str, what: str = "table") -> DataFrame:
    """``df`` itself if it has every declared column with its type; ValueError otherwise."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()} (found {have.get(f.name, 'none')})"
             for f in struct(ddl).fields if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{what} needs " + ", ".join(wrong))
    return df


def assert_same_srid(units: DataFrame, outlines: DataFrame) -> None:
    """Units and outlines of a state must share a reference system."""
    a = units.select("state_code", "srid").distinct()
    b = outlines.select("state_code", "srid").withColumnRenamed("srid", "other")
    odd = a.join(b, "state_code").where("srid <> other").limit(1).collect()
    if odd:
        raise ValueError(f"units and outline of {odd[0]['state_code']} are in {odd[0]['srid']} and {odd[0]['other']}")
