"""Populations, deviations and boundaries of partitions.

``units`` has ``state_code``, ``unit_id``, ``pop``; ``assignments`` has ``state_code``, ``unit_id``,
``district_id`` and may have further keys (experiment, trial), which ``keys`` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.adjacency import symmetric

KEYS = ["state_code"]


def ideal_population(total: Column, n: Column) -> Column:
    """Total over n; null where n isn't positive."""
    return F.when(n > 0, total.cast("double") / n)


def district_populations(units: DataFrame, assignments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys``, ``district_id``, ``pop``, ``units``: districts as sums over their units."""
    own = assignments.select(*dict.fromkeys([*keys, "state_code", "unit_id", "district_id"]))
    return (own.join(units.select("state_code", "unit_id", "pop"), ["state_code", "unit_id"])
            .groupBy(*keys, "district_id").agg(F.sum("pop").alias("pop"), F.count(F.lit(1)).alias("units")))


def deviations(districts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every district with its ideal and signed deviation in percent, null where the ideal isn't positive."""
    ideals = districts.groupBy(*keys).agg(
        ideal_population(F.sum("pop"), F.count(F.lit(1))).alias("ideal"))
    return districts.join(ideals, keys).withColumn(
        "deviation_pct", F.when(F.col("ideal") > 0, (F.col("pop") - F.col("ideal")) / F.col("ideal") * 100.0))


def population_report(districts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per partition: ideal, populations, deviations, largest absolute one and range.

    Deviations and what follows from them are null where the ideal isn't positive.
    """
    by_id = F.array_sort(F.collect_list(F.struct("district_id", "pop", "deviation_pct")))
    return (
        deviations(districts, keys).groupBy(*keys).agg(
            F.count(F.lit(1)).cast("int").alias("districts"), F.max("ideal").alias("ideal"), by_id.alias("d"),
            F.max(F.abs("deviation_pct")).alias("max_abs_deviation_pct"),
            (F.max("deviation_pct") - F.min("deviation_pct")).alias("range_pct"))
        .select(*keys, "districts", "ideal", F.transform("d", lambda x: x["pop"]).alias("per_district"),
                F.transform("d", lambda x: x["deviation_pct"]).alias("deviations_pct"),
                "max_abs_deviation_pct", "range_pct")
    )


def labelled_edges(edges: DataFrame, assignments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges with the districts of both ends, ``d1`` and ``d2``, for every partition."""
    a = assignments.select(*keys, F.col("unit_id").alias("src"), F.col("district_id").alias("d1"))
    b = assignments.select(*keys, F.col("unit_id").alias("dst"), F.col("district_id").alias("d2"))
    return edges.join(a, ["state_code", "src"]).join(b, [*keys, "dst"])


def cut_weight(edges: DataFrame, assignments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys``, ``cut``: length of all edges between districts; 0 where there is none."""
    cut = labelled_edges(edges, assignments, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("d1") != F.col("d2"), F.col("length")).otherwise(F.lit(0))).alias("cut"))
    return assignments.select(*keys).distinct().join(cut, keys, "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


def cut_by_pair(edges: DataFrame, assignments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys``, ``d1`` < ``d2``, ``length``, ``edges``: boundary of every two districts."""
    return (
        labelled_edges(edges, assignments, keys).where("d1 <> d2")
        .groupBy(*keys, F.least("d1", "d2").alias("district_1"), F.greatest("d1", "d2").alias("district_2"))
        .agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("edges"))
    )


def gain_table(edges: DataFrame, assignments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Boundary units' gains: ``keys``, ``unit_id``, ``own``, ``target``, ``gain``.

    The gain of a move is the length shared with the target less the length shared at home.
    """
    both = symmetric(edges.select("state_code", "src", "dst", "length"))
    here = assignments.select(*keys, "unit_id", F.col("district_id").alias("own"))
    there = assignments.select(*keys, F.col("unit_id").alias("other"), F.col("district_id").alias("target"))
    shared = (both.join(here, ["state_code", "unit_id"]).join(there, [*keys, "other"])
              .groupBy(*keys, "unit_id", "own", "target").agg(F.sum("length").alias("shared")))
    home = shared.where("own = target").select(*keys, "unit_id", F.col("shared").alias("home"))
    return shared.where("own <> target").join(home, [*keys, "unit_id"], "left").select(
        *keys, "unit_id", "own", "target", (F.col("shared") - F.coalesce("home", F.lit(0))).alias("gain"))


def balanced_moves(gains: DataFrame, units: DataFrame, districts: DataFrame, tolerance: float = 0.005,
                   keys: list[str] = KEYS) -> DataFrame:
    """Moves whose source keeps the lower and whose target keeps the upper bound."""
    size = deviations(districts, keys).select(*keys, "district_id", "pop", "ideal")
    source = size.select(*keys, F.col("district_id").alias("own"), F.col("pop").alias("own_pop"), "ideal")
    target = size.select(*keys, F.col("district_id").alias("target"), F.col("pop").alias("target_pop"))
    return (
        gains.join(units.select("state_code", "unit_id", "pop"), ["state_code", "unit_id"])
        .join(source, [*keys, "own"]).join(target, [*keys, "target"])
        .where((F.col("own_pop") - F.col("pop") >= F.col("ideal") * (1 - tolerance))
               & (F.col("target_pop") + F.col("pop") <= F.col("ideal") * (1 + tolerance)))
        .select(*keys, "unit_id", "own", "target", "gain", "pop")
    )


def best_move(moves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The move with the largest positive gain; ties to the lowest unit, then the lowest target."""
    best = F.max(F.struct("gain", (-F.col("unit_id")).alias("u"), (-F.col("target")).alias("t"), "own"))
    return moves.where("gain > 0").groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.u")).alias("unit_id"), "b.own", (-F.col("b.t")).alias("target"), "b.gain")
