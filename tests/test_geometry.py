import math

import pytest
from pyspark.sql import functions as F

import grids
from plotweave.functions import geometry, shapes
from plotweave.operators import adjacency, balance, dissolve
from plotweave.operators.components import connected_components


def one(spark, rings, *columns):
    df = spark.createDataFrame([(rings,)], f"rings {geometry.RINGS}")
    return df.select(*columns).first()


def test_square(spark):
    r = F.col("rings")
    a, p = geometry.area(r), geometry.perimeter(r)
    got = one(spark, grids.ring(0, 0), a, p, geometry.polsby_popper(a, p), geometry.schwartzberg(a, p),
              shapes.convex_hull_ratio(a, shapes.hull_area("rings")), shapes.reock(a, shapes.circle_area("rings")))
    assert list(got) == pytest.approx([1, 4, math.pi / 4, 2 / math.sqrt(math.pi), 1, 2 / math.pi])
    thin = one(spark, grids.ring(0, 0, 100, 1), geometry.polsby_popper(a, p))
    assert thin[0] < 0.05


def test_degenerate(spark):
    a, p = geometry.area(F.col("rings")), geometry.perimeter(F.col("rings"))
    got = one(spark, [[{"x": 1.0, "y": 1.0}]], a, p, geometry.polsby_popper(a, p), geometry.schwartzberg(a, p),
              shapes.convex_hull_ratio(a, shapes.hull_area("rings")))
    assert list(got) == [0, 0, 0, None, 0]


def test_hole_and_points(spark):
    hole = [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 2.0}, {"x": 2.0, "y": 2.0}, {"x": 2.0, "y": 1.0}]
    rings = [*grids.ring(0, 0, 3, 3), hole]
    inside = lambda x, y: geometry.contains(F.col("rings"), F.lit(x), F.lit(y))
    p = geometry.representative_point(F.col("rings"))
    got = one(spark, rings, geometry.area(F.col("rings")), inside(0.5, 0.5), inside(1.5, 1.5), geometry.contains(F.col("rings"), p["x"], p["y"]))
    assert list(got) == [8, True, False, True]
    c = one(spark, grids.ring(2, 4, 2, 2), geometry.centroid(F.col("rings")))[0]
    assert (c["x"], c["y"]) == (3, 5)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-96.0, 23.0), (-116.2, 43.6), (-80.1, 25.8)], "lon double, lat double")
    for srid in geometry.ALBERS:
        p = geometry.project(F.col("lon"), F.col("lat"), srid)
        for r in df.select("lon", "lat", p.alias("p")).select("*", geometry.unproject(F.col("p.x"), F.col("p.y"), srid).alias("g")).collect():
            assert (r["g"]["lon"], r["g"]["lat"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
    origin = df.select(geometry.project(F.lit(-96.0), F.lit(23.0)).alias("p")).first()["p"]
    assert (origin["x"], origin["y"]) == pytest.approx((0, 0), abs=1e-6)
    assert geometry.srid_of("hi") == 102007 and geometry.srid_of("ID") == 5070
    with pytest.raises(ValueError):
        geometry.project(F.lit(0), F.lit(0), 1)


def test_projection_near_and_beyond_the_poles(spark):
    lats = [29.5, 89.4, 89.5, 89.9, 89.99, 90.0, 90.1, 151.5, 210.0, 269.9, 270.0, 271.3, 450.0, 1829.9, -89.9, -90.0, -100.5]
    df = spark.createDataFrame([(-99.7, t) for t in lats], "lon double, lat double")
    folded = [(t if abs(t) <= 90 else math.degrees(math.asin(math.sin(math.radians(t))))) for t in lats]
    for srid in geometry.ALBERS:
        p = df.select("*", geometry.project(F.col("lon"), F.col("lat"), srid).alias("p"))
        plain, near = geometry.unproject(F.col("p.x"), F.col("p.y"), srid), geometry.unproject(F.col("p.x"), F.col("p.y"), srid, F.col("lat"))
        got = p.select(plain["lat"], near["lat"], near["lon"]).collect()
        assert [r[0] for r in got] == pytest.approx(folded, abs=2e-9)
        assert [r[1] for r in got] == pytest.approx(lats, abs=2e-9)
        assert [r[2] for r in got] == pytest.approx([-99.7] * len(lats), abs=2e-9)


def edges_of(df):
    return sorted((r["src"], r["dst"], round(r["length"], 9)) for r in df.collect())


def test_grid_has_twelve_edges(spark):
    got = edges_of(adjacency.shared_edges(grids.units(spark, grids.cells(3, 3))))
    assert len(got) == 12 and all(x[2] == 1 for x in got)


def test_touching_apart_and_overlapping(spark):
    assert edges_of(adjacency.shared_edges(grids.units(spark, [(0, 0), (1, 1)]))) == []
    assert edges_of(adjacency.shared_edges(grids.units(spark, [(0, 0), (5, 5)]))) == []
    assert edges_of(adjacency.shared_edges(grids.units(spark, [(0, 0), (0, 0)]))) == []
    assert edges_of(adjacency.adjacency(grids.units(spark, [(0, 0)]))) == []


def test_junction(spark):
    rows = [("TT", 0, grids.ring(0, 0, 2, 2)), ("TT", 1, grids.ring(2, 0)), ("TT", 2, grids.ring(2, 1))]
    u = spark.createDataFrame(rows, f"state_code string, unit_id bigint, rings {geometry.RINGS}")
    assert edges_of(adjacency.shared_edges(u)) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]
    assert edges_of(adjacency.shared_edges(u, junctions=False)) == [(1, 2, 1)]
    flipped = u.withColumn("rings", F.transform("rings", F.reverse))
    assert edges_of(adjacency.shared_edges(flipped)) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]


def test_islands(spark):
    u = grids.units(spark, [(0, 0), (1, 0), (2, 0), (100, 100)])
    got = adjacency.adjacency(u).collect()
    assert sorted((r["src"], r["dst"], r["is_synthetic"]) for r in got) == [(0, 1, False), (1, 2, False), (2, 3, True)]
    u = grids.units(spark, [(x, 0) for x in range(5)] + [(x, 50) for x in range(50, 53)])
    got = adjacency.adjacency(u).collect()
    assert sum(r["is_synthetic"] for r in got) == 3 and sum(not r["is_synthetic"] for r in got) == 6
    assert all(r["length"] == 0 and r["src"] == 4 for r in got if r["is_synthetic"])


def test_no_edges_no_water(spark):
    assert adjacency.adjacency(grids.units(spark, [(0, 0), (9, 9)])).count() == 0


def test_shapes_of_districts(spark):
    u = grids.units(spark, grids.cells(3, 3))
    part = u.select("state_code", "unit_id", F.when(F.col("unit_id") == 4, 1).otherwise(0).alias("district_id"))
    got = {r["district_id"]: r for r in dissolve.district_shapes(u, part).collect()}
    assert got[1]["area"] == pytest.approx(1) and got[0]["area"] == pytest.approx(8) and len(got[0]["rings"]) == 2
    assert got[0]["pop"] == 80 and got[0]["perimeter"] == pytest.approx(16)
    points = u.select("state_code", "unit_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    shapes_ = dissolve.district_shapes(u, part).select("state_code", F.col("district_id").cast("bigint").alias("shape_id"), "rings")
    at = {r["unit_id"]: r["shape_id"] for r in dissolve.locate(points, shapes_, 2.0).collect()}
    assert at == {i: int(i == 4) for i in range(9)}
    far = points.withColumn("x", F.col("x") + 100)
    assert {r["shape_id"] for r in dissolve.locate_or_nearest(far, shapes_, 2.0).collect()} == {0}


@pytest.mark.parametrize("cell", [0.7, 5.0, 1000.0])
def test_nearest_shape_is_by_its_sides(spark, cell):
    """Beside the middle of a long side, whose corners are far away."""
    import math
    import random
    shapes_ = spark.createDataFrame([("TT", 0, grids.ring(0, 0, 100, 1)), ("TT", 1, grids.ring(50, 3, 1, 1)), ("TT", 2, grids.ring(20, 30, 2, 9))],
                                    f"state_code string, shape_id bigint, rings {geometry.RINGS}")
    rng = random.Random(3)
    points = [("TT", 0, 50.5, 1.8), *(("TT", i, rng.uniform(-40, 140), rng.uniform(-40, 60)) for i in range(1, 60))]
    boxes = [(0, 0, 100, 1), (50, 3, 51, 4), (20, 30, 22, 39)]
    away = lambda x, y, b: math.hypot(max(b[0] - x, 0, x - b[2]), max(b[1] - y, 0, y - b[3]))
    expected = {i: min(range(3), key=lambda s: (away(x, y, boxes[s]), s)) for _, i, x, y in points}
    got = dissolve.locate_or_nearest(spark.createDataFrame(points, "state_code string, unit_id int, x double, y double"), shapes_, cell)
    assert {r["unit_id"]: r["shape_id"] for r in got.collect()} == expected and expected[0] == 0


def test_corner_touching_rings_stay_apart(spark):
    u = grids.units(spark, [(0, 0), (1, 1)])
    part = u.select("state_code", "unit_id", F.lit(0).alias("district_id"))
    got = dissolve.district_shapes(u, part).first()
    assert len(got["rings"]) == 2 and got["area"] == pytest.approx(2)


def test_boundary_and_population(spark):
    u = grids.units(spark, grids.cells(2, 2))
    e = adjacency.shared_edges(u)
    part = u.select("state_code", "unit_id", F.col("unit_id").cast("int").alias("district_id"))
    assert balance.cut_weight(e, part).first()["cut"] == pytest.approx(4)
    d = spark.createDataFrame([("TT", 0, 990), ("TT", 1, 1010)], "state_code string, district_id int, pop bigint")
    r = balance.population_report(d).first()
    assert r["ideal"] == 1000 and r["deviations_pct"] == [-1, 1] and r["max_abs_deviation_pct"] == 1 and r["range_pct"] == 2


def test_components_of_paths_and_ties(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(7, 7), (None, 3)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}
    assert connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("held", [3, 50, 2_000_000])
def test_components_equal_a_search(spark, held):
    import random
    rng = random.Random(held)
    rows = [(rng.choice("AB"), rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [("A", 5, 5), ("B", -2**40, 2**40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, a, b in rows:
        low, high = sorted((find((g, a)), find((g, b))))
        root[high] = low
    df = spark.createDataFrame(rows, "g string, src bigint, dst bigint").repartition(5)
    got = {(r["g"], r["node"]): (r["g"], r["component"]) for r in connected_components(df, by="g", held=held).collect()}
    assert got == {x: find(x) for x in root}


def test_split_by_a_line(spark):
    r = F.col("rings")
    sides = [geometry.area(shapes.clip_half_plane(r, F.lit(0.3), F.lit(1.0), left)) for left in (True, False)]
    a, b, whole = one(spark, grids.ring(0, 0, 4, 3), *sides, geometry.area(r))
    assert a + b == pytest.approx(whole) and 0 < a < whole
    box = geometry.bounds(r)
    line = one(spark, grids.ring(0, 0, 4, 3), geometry.cut_line(box, F.lit(0.3), F.lit(1.0)))[0]
    assert math.hypot(line["b"]["x"] - line["a"]["x"], line["b"]["y"] - line["a"]["y"]) == pytest.approx(22)
