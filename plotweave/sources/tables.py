"""Reading and normalising outlines, units and edges.

Raw tables are Parquet, partitioned by ``state_code`` and ``year``, so a state's filter prunes
folders. ``PLOTWEAVE_DATA`` names their root where none is given.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions import geometry
from plotweave.operators.adjacency import adjacency
from plotweave.operators.sweeps import prefix_sums
from plotweave.plans.apportionment import DISTRICTS_2020

#: Raised when the meaning of the stored edges changes; part of their folder.
EDGES_VERSION = 2


def data_root(root: str | None = None) -> str:
    return (root or os.environ.get("PLOTWEAVE_DATA", "data/processed")).rstrip("/")


def _srid() -> Column:
    known = [F.when(F.col("state_code") == s, n) for s, n in geometry.REGION_SRID.items()]
    return F.coalesce(*known, F.lit(geometry.DEFAULT_SRID))


def _projected(rings: Column) -> Column:
    """Geographic rings in the projection of their state."""
    out = geometry.project_rings(rings, geometry.DEFAULT_SRID)
    for state, srid in geometry.REGION_SRID.items():
        out = F.when(F.col("state_code") == state, geometry.project_rings(rings, srid)).otherwise(out)
    return out


def read_states(spark: SparkSession, root: str | None = None, codes: list[str] | None = None, year: int = 2020,
                projected: bool = True) -> DataFrame:
    """Outlines with seats. Raw columns: ``STUSPS``, ``NAME``, ``STATEFP``, ``rings``.

    ValueError for a code that isn't among the outlines.
    """
    raw = spark.read.parquet(f"{data_root(root)}/states").withColumn("state_code", F.upper("STUSPS"))
    if "year" in raw.columns:
        raw = raw.where(F.col("year") == year)
    if codes is not None:
        wanted = [c.upper() for c in codes]
        raw = raw.where(F.col("state_code").isin(wanted))
        found = {r["state_code"] for r in raw.select("state_code").distinct().collect()}
        if missing := sorted(set(wanted) - found):
            raise ValueError(f"Unknown state code: {missing}")
    seats = F.create_map(*[F.lit(x) for pair in DISTRICTS_2020.items() for x in pair])
    return raw.select("state_code", F.col("NAME").alias("name"), F.col("STATEFP").alias("fips"),
                      F.element_at(seats, F.col("state_code")).alias("n_districts"), _srid().cast("int").alias("srid"),
                      (_projected(F.col("rings")) if projected else F.col("rings")).alias("rings"))


def normalise_units(raw: DataFrame, projected: bool = True) -> DataFrame:
    """Raw blocks (``state_code``, ``GEOID20``, ``POP20``, ``rings``) as units.

    ``unit_id`` is the block's 0-based place in its state by ``GEOID20``, which names a block; the
    places of a state are counted by many tasks. RuntimeError without ``POP20``.
    """
    if "POP20" not in raw.columns:
        raise RuntimeError("blocks have no POP20 column")
    rings = _projected(F.col("rings")) if projected else F.col("rings")
    units = raw.select(F.upper("state_code").alias("state_code"), F.col("GEOID20").alias("geoid"),
                       F.col("POP20").cast("bigint").alias("pop"), "rings", F.lit(1).cast("bigint").alias("one"))
    return (prefix_sums(units, ["state_code"], ["geoid"], "one", "place").withColumn("unit_id", F.col("place") - 1)
        .withColumn("rings", rings).withColumn("srid", _srid().cast("int")).withColumn("c", geometry.centroid(F.col("rings")))
        .select("state_code", "unit_id", "geoid", "pop", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "srid", "rings"))


def read_units(spark: SparkSession, root: str | None = None, codes: list[str] | None = None, year: int = 2020,
               projected: bool = True) -> DataFrame:
    raw = spark.read.parquet(f"{data_root(root)}/blocks")
    if "year" in raw.columns:
        raw = raw.where(F.col("year") == year)
    if codes is not None:
        raw = raw.where(F.col("state_code").isin([c.upper() for c in codes]))
    return normalise_units(raw, projected)


def fingerprint(units: DataFrame) -> str:
    """A checksum of units that any change of them changes; names the edges computed from them."""
    h = F.xxhash64("state_code", "unit_id", "pop", F.to_json("rings"))
    row = units.agg(F.bit_xor(h).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{(row['x'] or 0) & (2**64 - 1):016x}-{row['n']}"


def cached_edges(units: DataFrame, root: str | None = None, cell: float | None = None) -> DataFrame:
    """The edges of ``units``, computed once and stored under their version and checksum.

    Changed units have another checksum, so edges are never read for units they don't belong to.
    """
    spark = units.sparkSession
    path = f"{data_root(root)}/edges/v={EDGES_VERSION}/{fingerprint(units)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        adjacency(units, cell=cell).write.mode("overwrite").partitionBy("state_code").parquet(path)
        return spark.read.parquet(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Districts of a GeoJSON file: ``district_id``, ``pop``, ``rings``."""
    point = "array<double>"
    schema = ("features array<struct<properties:struct<district_id:int,pop:bigint>,"
              "geometry:struct<type:string,coordinates:string>>>")
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    polygon = F.from_json("f.geometry.coordinates", f"array<array<{point}>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", polygon).otherwise(many)
    return f.select("f.properties.district_id", "f.properties.pop", F.transform(rings, lambda r: F.transform(
        F.slice(r, F.lit(1), F.size(r) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))
