"""Sweep-line cuts as window queries.

A sweep sorts the units of a region by their distance from a line through the origin, cuts where
the population below comes nearest to the wanted share, and never between units at one distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.sources.workspace import staged


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], value: str | dict[str, str], name: str = "running",
                slices: int | None = None) -> DataFrame:
    """Running sum of ``value`` within ``groups`` along ``order``, which must name rows uniquely.

    ``value`` is a column whose sum is called ``name``, or sums' names by column; without
    ``groups`` the table is one group. Rows are range-partitioned by group and order into slices;
    each slice is summed by itself and shifted by the totals of the group's earlier slices. A
    group of any size is thus summed by many tasks; the totals have a row for each slice and group.
    """
    sums = {value: name} if isinstance(value, str) else value
    key = [*groups, *order]
    parts = (slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),)
    dealt = staged(df.repartitionByRange(*parts, *key).withColumn("__slice", F.spark_partition_id()), "slices")
    totals = dealt.groupBy(*groups, "__slice").agg(*[F.sum(v).alias(f"__total_{v}") for v in sums])
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "__slice", *[
        F.coalesce(F.sum(f"__total_{v}").over(earlier), F.lit(0)).alias(f"__before_{v}") for v in sums])
    inside = Window.partitionBy(*groups, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"__inside_{v}": F.sum(v).over(inside) for v in sums})
    return summed.join(totals, [*groups, "__slice"]).withColumns(
        {n: F.col(f"__inside_{v}") + F.col(f"__before_{v}") for v, n in sums.items()}).drop(
        "__slice", *[f"__{x}_{v}" for x in ("inside", "before") for v in sums])


def sweep_districts(units: DataFrame, k: int, order: list[str]) -> DataFrame:
    """``state_code``, ``unit_id``, ``pop``, ``district_id``: k runs of about equal population."""
    running = prefix_sums(units.select("state_code", "unit_id", "pop", *[c for c in order if c != "unit_id"]),
                          ["state_code"], order, "pop", "below")
    totals = units.groupBy("state_code").agg(F.sum("pop").alias("total"))
    return running.join(totals, "state_code").select(
        "state_code", "unit_id", "pop",
        F.least(F.floor((F.col("below") - 1) * F.lit(float(k)) / F.col("total")), F.lit(k - 1)).cast("long").alias("district_id"))


def angles(spark, steps: int = 180) -> DataFrame:
    """``step``, ``theta``: ``steps`` angles from 0 up to pi."""
    return spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.col("id") * math.pi / steps).alias("theta"))


def directed(units: DataFrame, directions: DataFrame, nx: Column, ny: Column) -> DataFrame:
    """Every unit at every direction with its distance ``d``; ``directions`` is a small table."""
    return units.crossJoin(F.broadcast(directions)).withColumn("d", nx * F.col("x") + ny * F.col("y"))


def sweep_breaks(swept: DataFrame, groups: list[str], fraction: Column) -> DataFrame:
    """The chosen break of each group: ``groups``, ``threshold``, ``left_pop``, ``total``, ``balance_error``.

    ``swept`` has ``groups``, ``unit_id``, ``pop``, ``d``. A break lies where the next distance is
    greater; the one nearest to ``fraction`` of the population is taken, the first of equals.
    """
    line = Window.partitionBy(*groups).orderBy("d", "unit_id")
    cum = swept.withColumns({
        "below": F.sum("pop").over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("pop").over(Window.partitionBy(*groups)),
        "after": F.lead("d").over(line), "rn": F.row_number().over(line),
    }).where("after > d")
    miss = F.abs(F.col("below") - F.col("total") * fraction)
    return cum.groupBy(*groups).agg(F.min(F.struct(
        miss.alias("miss"), "rn", ((F.col("d") + F.col("after")) / 2).alias("threshold"), "below", "total")).alias("b")
    ).select(*groups, "b.threshold", F.col("b.below").alias("left_pop"), "b.total", F.col("b.miss").alias("balance_error"))


def realised_cuts(swept: DataFrame, breaks: DataFrame, edges: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, ``cost``: length of the edges that each group's break cuts."""
    sides = swept.join(breaks.select(*groups, "threshold"), groups).select(
        *groups, "unit_id", (F.col("d") < F.col("threshold")).alias("left"))
    a = sides.select(*groups, F.col("unit_id").alias("src"), F.col("left").alias("left_1"))
    b = sides.select(*groups, F.col("unit_id").alias("dst"), F.col("left").alias("left_2"))
    cost = edges.join(a, ["state_code", "src"]).join(b, [*groups, "dst"]).where("left_1 <> left_2").groupBy(*groups).agg(
        F.sum("length").alias("cost"))
    return breaks.join(cost, groups, "left").withColumn("cost", F.coalesce("cost", F.lit(0)))


def within_budget(cuts: DataFrame, regions: list[str], share: float = 0.0008) -> DataFrame:
    """The candidates of each region that meet the smallest budget that any of them meets.

    Budgets are ``share`` of the population (1 at least), doubled until one fits or the whole
    population is reached: the least power of two that covers the smallest miss, in closed form.
    """
    w = Window.partitionBy(*regions)
    base = F.greatest(F.lit(1.0), F.col("total") * share)
    doublings = F.greatest(F.ceil(F.log2(F.min("balance_error").over(w) / base)), F.lit(0))
    top = F.greatest(F.ceil(F.log2(F.col("total") / base)), F.lit(0))
    least = F.min("balance_error").over(w)
    return cuts.withColumns({"budget": base * F.pow(F.lit(2.0), F.least(doublings, top)), "__least": least}).where(
        (F.col("balance_error") <= F.col("budget")) | (F.col("__least") > F.col("budget"))).drop("__least")


def best_cut(cuts: DataFrame, regions: list[str], by: str = "step") -> DataFrame:
    """The cheapest candidate of each region, the first angle among equals."""
    w = Window.partitionBy(*regions).orderBy("cost", by)
    return cuts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
