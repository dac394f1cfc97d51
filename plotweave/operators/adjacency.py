"""Weighted adjacency of polygons, and edges over water.

Units share a boundary where they share segments, so adjacency is an aggregation by segment:
corners are put on a fixed integer grid, each side becomes a key with its ends in order, and a
key that two units run along in opposite directions is common boundary. No pair of polygons is
ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import geometry
from plotweave.operators.components import connected_components
from plotweave.sources.workspace import staged

KEYS = ("state_code",)


def unit_segments(units: DataFrame, grid: float = 1e-3) -> DataFrame:
    """``state_code``, ``unit_id``, ends on the grid in order, ``way``: one row for each side.

    ``way`` is 1 or -1 after the side's direction around the interior; sides that shrink to a
    point on the grid are left out.
    """
    on_grid = lambda c: F.round(c / grid).cast("long")
    sides = units.select(
        "state_code", "unit_id", F.posexplode("rings").alias("ring_no", "ring")
    ).select(
        "state_code", "unit_id",
        F.when(geometry.signed_area(F.col("ring")) < 0, -1).otherwise(1).alias("turn"),
        (F.col("ring_no") > 0).alias("later"), F.explode(geometry.segments(F.col("ring"))).alias("s"),
    ).select(
        "state_code", "unit_id", "turn", "later",
        *[on_grid(F.col(f"s.{p}.{c}")).alias(f"{p}{c}") for p in "ab" for c in "xy"],
    ).where("ax <> bx or ay <> by")
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    pick = lambda one, two: F.when(forward, F.col(one)).otherwise(F.col(two))
    return sides.select(
        "state_code", "unit_id", pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"),
        pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2"),
        (F.when(forward, 1).otherwise(-1) * F.col("turn")).alias("way"),
    )


def _gcd(a: Column, b: Column) -> Column:
    steps = F.sequence(F.lit(1), F.lit(92))  # Fibonacci's bound for 64 bits
    start = F.struct(F.abs(a).alias("p"), F.abs(b).alias("q"))
    return F.aggregate(steps, start, lambda s, _: F.struct(
        F.when(s["q"] == 0, s["p"]).otherwise(s["q"]).alias("p"),
        F.when(s["q"] == 0, F.lit(0).cast("long")).otherwise(s["p"] % s["q"]).alias("q")), lambda s: s["p"])


def split_at_junctions(segments: DataFrame) -> DataFrame:
    """Cut every segment at the ends of others that lie inside it on the same line.

    Lines have exact integer keys, so only segments of one line meet. Use it on segments left
    without a partner: where corners of one unit touch the side of another.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    g = _gcd(dx, dy)
    s = segments.withColumns({"ux": (dx / g).cast("long"), "uy": (dy / g).cast("long")}).withColumn(
        "line", F.struct("ux", "uy", (F.col("ux") * F.col("y1") - F.col("uy") * F.col("x1")).alias("c"))
    ).withColumns({"t1": F.when(F.col("ux") != 0, F.col("x1")).otherwise(F.col("y1")),
                   "t2": F.when(F.col("ux") != 0, F.col("x2")).otherwise(F.col("y2"))})
    ends = s.select("state_code", "line", F.col("t1").alias("t")).unionAll(
        s.select("state_code", "line", F.col("t2").alias("t"))).distinct()
    inner = s.join(ends, ["state_code", "line"]).where("t > t1 and t < t2").groupBy(
        "state_code", "line", "unit_id", "t1", "t2").agg(F.collect_list("t").alias("inner"))
    stops = F.array_sort(F.concat(F.array("t1", "t2"), F.coalesce("inner", F.array().cast("array<bigint>"))))
    place = lambda t, c: F.when(
        F.col("ux") != 0, F.col("x1") + (t - F.col("t1")) if c == "x"
        else F.col("y1") + ((t - F.col("t1")) / F.col("ux") * F.col("uy")).cast("long")
    ).otherwise(F.col("x1") if c == "x" else t)
    return (
        s.join(inner, ["state_code", "line", "unit_id", "t1", "t2"], "left")
        .withColumn("stops", stops)
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("stops") - 1)))
        .withColumns({"ta": F.expr("stops[i - 1]"), "tb": F.expr("stops[i]")})
        .select("state_code", "unit_id", place(F.col("ta"), "x").alias("x1"), place(F.col("ta"), "y").alias("y1"),
                place(F.col("tb"), "x").alias("x2"), place(F.col("tb"), "y").alias("y2"), "way")
    )


def _matched(segments: DataFrame) -> DataFrame:
    return segments.groupBy("state_code", "x1", "y1", "x2", "y2").agg(
        F.count(F.lit(1)).alias("sides"), F.sum("way").alias("turn"),
        F.min("unit_id").alias("src"), F.max("unit_id").alias("dst"), F.min("way").alias("way"))


def shared_edges(units: DataFrame, grid: float = 1e-3, junctions: bool = True) -> DataFrame:
    """``state_code``, ``src`` < ``dst``, ``length``: pairs of units with common boundary.

    Units that only touch in a point, and units that overlap, have no edge. With ``junctions``,
    sides without a partner are cut where other corners touch them and matched again.
    """
    found = _matched(unit_segments(units, grid))
    if junctions:
        found = staged(found, "sides")
        lone = found.where("sides = 1").select("state_code", F.col("src").alias("unit_id"), "x1", "y1", "x2", "y2", "way")
        found = found.where("sides = 2").unionByName(_matched(split_at_junctions(lone)).where("sides = 2"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * grid
    return (
        found.where("sides = 2 and turn = 0 and src < dst")
        .groupBy("state_code", "src", "dst").agg(F.sum(length).alias("length"))
        .where("length > 0")
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions: ``state_code``, ``unit_id``, ``other``, ``length``."""
    rest = [c for c in edges.columns if c not in ("state_code", "src", "dst")]
    return edges.select("state_code", F.col("src").alias("unit_id"), F.col("dst").alias("other"), *rest).unionAll(
        edges.select("state_code", F.col("dst").alias("unit_id"), F.col("src").alias("other"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """``state_code``, ``unit_id``, ``degree``, ``strength`` (the sum of lengths)."""
    return symmetric(edges).groupBy("state_code", "unit_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("length").alias("strength"))


def inside_subset(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges both ends of which are among ``units``."""
    own = units.select("state_code", "unit_id")
    for end in ("src", "dst"):
        edges = edges.join(own.withColumnRenamed("unit_id", end), ["state_code", end], "left_semi")
    return edges


def unit_components(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``state_code``, ``unit_id``, ``component``: the lowest unit that edges lead to."""
    found = connected_components(edges, by="state_code").withColumnRenamed("node", "unit_id")
    return units.select("state_code", "unit_id").join(found, ["state_code", "unit_id"], "left").select(
        "state_code", "unit_id", F.coalesce("component", "unit_id").alias("component"))


def mainland(components: DataFrame) -> DataFrame:
    """``state_code``, ``component``, ``units``, ``is_mainland``: most units, on a tie the lowest."""
    sizes = components.groupBy("state_code", "component").agg(F.count(F.lit(1)).alias("units"))
    best = Window.partitionBy("state_code").orderBy(F.desc("units"), "component")
    return sizes.withColumn("is_mainland", F.row_number().over(best) == 1)


def spacing(points: DataFrame) -> float:
    """A cell size at which the points of the densest state fill about one cell each."""
    box = points.groupBy("state_code").agg(
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count(F.lit(1)).alias("n"))
    wide = box.agg(F.min(F.sqrt(F.greatest(F.col("w") * F.col("h"), F.col("w") * F.col("w") / F.col("n"),
                                           F.col("h") * F.col("h") / F.col("n")) / F.col("n")))).first()[0]
    return float(wide) if wide else 1.0


def nearest(points: DataFrame, targets: DataFrame, cell: float | None = None, max_doublings: int = 64) -> DataFrame:
    """For every point the nearest target of its state; the lowest ``unit_id`` among equals.

    Points meet the targets of the nine grid cells around them; a target no farther than a cell is
    certainly the nearest. The points left over meet cells twice as large, and so on, so the work
    follows how sparse the points are and no point meets all targets. ``points`` and ``targets``
    have ``state_code``, ``unit_id``, ``x``, ``y``; returns ``state_code``, ``unit_id``,
    ``nearest``, ``distance``. Points of states without targets are left out. The first cells are
    as large as the targets are apart, unless ``cell`` says otherwise.
    """
    cell = cell or spacing(targets)
    cell_of = lambda c, size: F.floor(F.col(c) / size).cast("long")
    rest = staged(points.select("state_code", "unit_id", "x", "y").join(
        targets.select("state_code").distinct(), "state_code", "left_semi"), "points")
    goal = targets.select("state_code", F.col("unit_id").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    done: DataFrame | None = None
    size = cell
    for _ in range(max_doublings):
        if rest.isEmpty():
            break
        near = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
        offered = (
            rest.withColumn("i", F.explode(F.transform(near, lambda d: cell_of("x", size) + d)))
            .withColumn("j", F.explode(F.transform(near, lambda d: cell_of("y", size) + d)))
            .join(goal.withColumns({"i": cell_of("tx", size), "j": cell_of("ty", size)}), ["state_code", "i", "j"])
            .withColumn("d2", (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
            .groupBy("state_code", "unit_id").agg(F.min(F.struct("d2", "t")).alias("best"))
            .where(F.col("best.d2") <= size * size)
        )
        sure = staged(offered.select("state_code", "unit_id", F.col("best.t").alias("nearest"),
                                     F.sqrt("best.d2").alias("distance")), "nearest")
        done = sure if done is None else done.unionAll(sure)
        rest = staged(rest.join(sure, ["state_code", "unit_id"], "left_anti"), "points")
        size *= 2
    if done is None:
        return rest.select("state_code", "unit_id", F.col("unit_id").alias("nearest"), F.lit(0.0).alias("distance"))
    return done


def water_edges(units: DataFrame, edges: DataFrame, cell: float | None = None) -> DataFrame:
    """Edges of length 0 from every unit off the mainland to the nearest one on it.

    Only in states that have edges and more than one component. ``units`` has ``cx``, ``cy``.
    """
    parts = staged(unit_components(units, edges), "components")
    kinds = mainland(parts).join(edges.select("state_code").distinct(), "state_code", "left_semi")
    at = units.select("state_code", "unit_id", F.col("cx").alias("x"), F.col("cy").alias("y")).join(
        parts.join(kinds, ["state_code", "component"]), ["state_code", "unit_id"])
    found = nearest(at.where("not is_mainland"), at.where("is_mainland"), cell)
    return found.select("state_code", F.least("unit_id", "nearest").alias("src"),
                        F.greatest("unit_id", "nearest").alias("dst"), F.lit(0.0).alias("length"))


def adjacency(units: DataFrame, grid: float = 1e-3, cell: float | None = None) -> DataFrame:
    """All edges: ``state_code``, ``src``, ``dst``, ``length``, ``is_synthetic``."""
    real = staged(shared_edges(units, grid), "edges")
    water = water_edges(units, real, cell)
    return real.withColumn("is_synthetic", F.lit(False)).unionByName(water.withColumn("is_synthetic", F.lit(True)))


def heavy_edge_matching(edges: DataFrame, units: DataFrame) -> DataFrame:
    """One round of mutual heaviest choices: pairs of units that prefer each other.

    A unit prefers its heaviest neighbour, then the lowest. Returns ``state_code``, ``unit_id``,
    ``coarse_id`` (the lower unit of a pair, or the unit itself).
    """
    choice = symmetric(edges).groupBy("state_code", "unit_id").agg(
        F.max(F.struct(F.col("length"), (-F.col("other")).alias("o"))).alias("best")
    ).select("state_code", "unit_id", (-F.col("best.o")).alias("choice"))
    back = choice.select("state_code", F.col("unit_id").alias("choice"), F.col("choice").alias("back"))
    pairs = choice.join(back, ["state_code", "choice"]).where("back = unit_id")
    return units.select("state_code", "unit_id").join(pairs, ["state_code", "unit_id"], "left").select(
        "state_code", "unit_id", F.least("unit_id", F.coalesce("choice", "unit_id")).alias("coarse_id"))
