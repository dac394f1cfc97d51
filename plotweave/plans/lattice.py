"""Lattice states derived from the sample tables.

Customers are units of a lattice 50 columns wide; ten columns make a state. A unit's population
is 1 plus its customer's orders, and edges to the right and upward neighbour carry whole weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str, columns_a_state: int = 10) -> DataFrame:
    """``state_code``, ``unit_id``, ``x``, ``y``, ``pop``, ``cx``, ``cy``."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count(F.lit(1)).alias("orders"))
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), F.expr("c_custkey % 50").alias("x"),
                                                 F.expr("c_custkey div 50").alias("y"))
    return at.join(orders, "unit_id", "left").select(
        F.concat(F.lit("S"), F.expr(f"x div {columns_a_state}").cast("string")).alias("state_code"), "unit_id", "x", "y",
        (F.coalesce("orders", F.lit(0)) + 1).alias("pop"), (F.col("x") + 0.5).alias("cx"), (F.col("y") + 0.5).alias("cy"))


def neighbours(units: DataFrame) -> DataFrame:
    """``state_code``, ``src``, ``dst``, ``length``: two equi-joins, to the right and upward."""
    a = units.select("state_code", F.col("unit_id").alias("src"), "x", "y")
    b = units.select("state_code", F.col("unit_id").alias("dst"), "x", "y")
    pairs = a.withColumn("x", F.col("x") + 1).join(b, ["state_code", "x", "y"]).unionAll(
        a.withColumn("y", F.col("y") + 1).join(b, ["state_code", "x", "y"]))
    return pairs.select("state_code", "src", "dst", F.expr("1000 + (src * 7919 + dst * 104729) % 1000").alias("length"))


def squares(units: DataFrame) -> DataFrame:
    """Units with ``rings``: the unit square of their cell."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    return units.withColumn("rings", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))


def scattered(units: DataFrame) -> DataFrame:
    """Districts in patches, many of them apart: ``state_code``, ``unit_id``, ``district_id``."""
    return units.select("state_code", "unit_id", F.expr("(x div 7 + (y div 5) * 3) % 4").alias("district_id"))


def islands(units: DataFrame) -> DataFrame:
    """The units without every state's eighth column, which leaves two columns apart."""
    return units.where("x % 10 <> 7")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results: nation as state, priority as experiment."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    r = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("state_code"), F.col("o_orderpriority").alias("experiment"))
        .agg(F.count(F.lit(1)).alias("n"), cents.alias("cents"), F.max("o_totalprice").alias("dev"))
    )
    ok = F.col("n") % 7 != 0
    return r.select("state_code", "experiment", F.when(ok, "ok").otherwise("failed").alias("status"),
                    F.when(ok, F.col("cents") / 100).alias("km"), F.when(ok, F.col("dev")).alias("max_dev"),
                    F.col("n").cast("double").alias("runtime_s"), F.substring("experiment", 1, 1).alias("input_order"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: priority as experiment, month of the date as trial."""
    t = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("experiment"), (F.month("o_orderdate") - 1).alias("trial_index")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.max("o_totalprice").alias("dev"))
    ok = F.col("n") % 5 != 0
    return t.select("experiment", "trial_index", (F.col("trial_index") + 42).alias("seed"),
                    F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.col("cents") / 100).alias("km"),
                    F.when(ok, F.col("dev")).alias("max_dev"), F.col("n").cast("double").alias("runtime_s"))


def random_edges(spark: SparkSession, n: int, share: float) -> DataFrame:
    """Edges of a graph of ``n`` units in which about ``share`` of all pairs are neighbours, by a rule
    that mixes their numbers."""
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("long"))).alias("dst"))
    chosen = pairs.where(F.col("dst") < n).where(
        F.expr("(src * 7919 + dst * 104729 + src * dst * 13) % 1000") < int(share * 1000))
    return chosen.select(F.lit("R").alias("state_code"), "src", "dst", F.expr("cast(1 + (src * 31 + dst * 17) % 99 as double)").alias("length"))
