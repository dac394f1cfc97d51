"""Writing districts, records and ledgers.

What a sink gathers on the driver is one state's districts, or one row a state: bounded by the
number of districts or states, never by units. Tables of units stay in Parquet.
"""

from __future__ import annotations

import json
import platform
import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import plotweave
from plotweave.functions import geometry, shapes
from plotweave.operators.ranking import CRITERION
from plotweave.plans.apportionment import TIERS

FORMATS = frozenset({"geojson", "shapefile", "png", "metrics", "log"})
LIGHT_FORMATS = frozenset({"png", "metrics", "log"})
# Fixed value: the projection file of EPSG:5070.
PRJ_5070 = (
    'PROJCS["NAD_1983_Contiguous_USA_Albers",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",'
    'SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'
    'PROJECTION["Albers"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],'
    'PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],'
    'PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]'
)
@dataclass(frozen=True)
class RunInfo:
    state_code: str
    state_name: str
    algorithm: str
    seed: int
    runtime_seconds: float | None
    revision: str | None = None

    def seconds(self) -> str:
        return "unknown" if self.runtime_seconds is None else f"{self.runtime_seconds:.3f}"


def chosen_formats(formats: set[str] | None) -> set[str]:
    selected = set(FORMATS) if formats is None else set(formats)
    if unknown := selected - FORMATS:
        raise ValueError(f"Unknown format key(s): {sorted(unknown)}. Valid: {sorted(FORMATS)}")
    return selected


def district_rows(districts: DataFrame) -> list[dict]:
    """One state's districts with their compactness, in order of number."""
    a, p = F.col("area"), F.col("perimeter")
    d = districts.select(
        "district_id", "pop", "rings", geometry.polsby_popper(a, p).alias("polsby_popper"),
        shapes.reock(a, shapes.circle_area("rings")).alias("reock"), geometry.schwartzberg(a, p).alias("schwartzberg"),
        shapes.convex_hull_ratio(a, shapes.hull_area("rings")).alias("convex_hull_ratio"))
    return [r.asDict(recursive=True) for r in d.orderBy("district_id").collect()]


def build_metrics(rows: list[dict], boundary_m: float, run: RunInfo) -> dict:
    """The nested record of one partition."""
    ideal = sum(r["pop"] for r in rows) / len(rows)
    off = [(r["pop"] - ideal) / ideal * 100.0 for r in rows]
    return {
        "state": run.state_code, "state_name": run.state_name, "algorithm": run.algorithm, "districts": len(rows),
        "total_internal_boundary_km": boundary_m / 1000.0,
        "population": {"ideal": ideal, "per_district": [r["pop"] for r in rows], "deviations_pct": off,
                       "max_abs_deviation_pct": max(map(abs, off)), "range_pct": max(off) - min(off)},
        "compactness": {c: [r[c] for r in rows] for c in ("polsby_popper", "reock", "schwartzberg", "convex_hull_ratio")},
        "runtime_seconds": run.runtime_seconds, "seed": run.seed, "version": plotweave.__version__,
        "generated_at": datetime.now(timezone.utc).isoformat(),
    }


def run_log(metrics: dict, run: RunInfo) -> str:
    values = [
        ("plotweave", plotweave.__version__), ("python", platform.python_version()), ("generated_at", metrics["generated_at"]),
        ("state", f"{run.state_code} ({run.state_name})"), ("algorithm", run.algorithm), ("districts", metrics["districts"]),
        ("seed", run.seed), ("runtime_seconds", run.seconds()), ("revision", run.revision or "unknown"),
        ("max_abs_deviation_pct", f"{metrics['population']['max_abs_deviation_pct']:.6f}"),
        ("total_internal_boundary_km", f"{metrics['total_internal_boundary_km']:.6f}"),
    ]
    return "".join(f"{k} {v}\n" for k, v in values)


def failure_log(run: RunInfo, error: str) -> str:
    return (f"state {run.state_code} ({run.state_name})\nalgorithm {run.algorithm}\nseed {run.seed}\n"
            f"runtime_seconds {run.seconds()}\nstatus FAILED\nerror {error}\n")


def geojson(rows: list[dict]) -> str:
    """A feature collection; outer rings run counter-clockwise and close, each with its holes."""
    features = []
    for r in rows:
        polygons: list = []
        for ring in r["rings"]:
            points = [[p["x"], p["y"]] for p in ring]
            turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))
            points = [*points, points[0]]
            if turn >= 0 or not polygons:
                polygons.append([points])
            else:
                polygons[_holder(polygons, points[0])].append(points)
        kind = {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {
            "type": "MultiPolygon", "coordinates": polygons}
        features.append({"type": "Feature", "properties": {"district_id": r["district_id"], "pop": r["pop"]}, "geometry": kind})
    return json.dumps({"type": "FeatureCollection", "features": features})


def _holder(polygons: list, point: list[float]) -> int:
    """The outer ring around a point, the last one if none is."""
    for i, (outer, *_) in enumerate(polygons):
        odd = False
        for a, b in zip(outer, outer[1:]):
            if (a[1] > point[1]) != (b[1] > point[1]):
                odd ^= point[0] < (b[0] - a[0]) * (point[1] - a[1]) / (b[1] - a[1]) + a[0]
        if odd:
            return i
    return len(polygons) - 1


def write_shapefile(path: Path, rows: list[dict], prj: str = PRJ_5070) -> None:
    """``.shp``, ``.shx``, ``.dbf``, ``.prj`` and ``.cpg`` by the published format."""
    shapes_, offsets, at = [], [], 50
    box_all = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for n, r in enumerate(rows, 1):
        parts = [[(p["x"], p["y"]) for p in [*ring, ring[0]]][::-1] for ring in r["rings"]]  # outer rings clockwise
        points = [p for part in parts for p in part]
        box = [min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)]
        box_all = [min(box_all[0], box[0]), min(box_all[1], box[1]), max(box_all[2], box[2]), max(box_all[3], box[3])]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        body = struct.pack("<i4d2i", 5, *box, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts)
        body += b"".join(struct.pack("<2d", *p) for p in points)
        shapes_.append(struct.pack(">2i", n, len(body) // 2) + body)
        offsets.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2

    def header(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *box_all, 0, 0, 0, 0)

    path.with_suffix(".shp").write_bytes(header(at) + b"".join(shapes_))
    path.with_suffix(".shx").write_bytes(header(50 + 4 * len(rows)) + b"".join(offsets))
    fields = [("district_i", 18), ("pop", 18)]
    now = datetime.now(timezone.utc)
    head = struct.pack("<4BIHH20x", 3, now.year - 1900, now.month, now.day, len(rows), 33 + 32 * len(fields), 1 + sum(n for _, n in fields))
    head += b"".join(struct.pack("<11sc4xBB14x", name.encode(), b"N", size, 0) for name, size in fields) + b"\r"
    body = b"".join(b" " + b"".join(f"{v:>{n}d}".encode() for v, (_, n) in zip((r["district_id"], r["pop"]), fields)) for r in rows)
    path.with_suffix(".dbf").write_bytes(head + body + b"\x1a")
    path.with_suffix(".prj").write_text(prj)
    path.with_suffix(".cpg").write_text("UTF-8")


# The twenty colours of the common "tab20" palette.
TAB20 = ("1f77b4", "aec7e8", "ff7f0e", "ffbb78", "2ca02c", "98df8a", "d62728", "ff9896", "9467bd", "c5b0d5",
         "8c564b", "c49c94", "e377c2", "f7b6d2", "7f7f7f", "c7c7c7", "bcbd22", "dbdb8d", "17becf", "9edae5")


# Digits of three columns and five lines, a line a digit of base 8.
DIGITS = ("75557", "26227", "71747", "71717", "55711", "74717", "74757", "71111", "75757", "75717")


def _label(image: bytearray, size: int, text: str, middle: tuple[int, int], room: float) -> None:
    """Write a number in black around a point, as large as the room there allows."""
    dot = max(2, min(round(room / (4 * len(text) + 2)), size // 120))
    left, top = middle[0] - dot * (4 * len(text) - 1) // 2, middle[1] - 5 * dot // 2
    for i, digit in enumerate(text):
        for y, bits in enumerate(DIGITS[int(digit)]):
            for x in range(3):
                if int(bits) >> (2 - x) & 1:
                    for line in range(max(0, top + y * dot), min(size, top + (y + 1) * dot)):
                        first = max(0, left + (4 * i + x) * dot)
                        last = min(size, first + dot)
                        image[3 * (line * size + first):3 * (line * size + last)] = bytes(3 * max(0, last - first))


def write_png(path: Path, rows: list[dict], size: int = 1500) -> None:
    """A map of the districts in colours, filled line by line by the even-odd rule, with their
    numbers, each in the middle of the widest stretch of its district."""
    points = [p for r in rows for ring in r["rings"] for p in ring]
    low = (min(p["x"] for p in points), min(p["y"] for p in points))
    high = (max(p["x"] for p in points), max(p["y"] for p in points))
    scale = 0.94 * size / max(high[0] - low[0], high[1] - low[1], 1e-12)
    pad = 0.03 * size
    image = bytearray(b"\xff" * (3 * size * size))
    numbers = []
    for i, r in enumerate(rows):
        widest = (0.0, 0, 0)
        colour = bytes.fromhex(TAB20[i % len(TAB20)])
        sides = []
        for ring in r["rings"]:
            at = [((p["x"] - low[0]) * scale + pad, size - pad - (p["y"] - low[1]) * scale) for p in ring]
            sides += zip(at, at[1:] + at[:1])
        by_line: dict[int, list[float]] = {}
        for (x1, y1), (x2, y2) in sides:
            if y1 == y2:
                continue
            for line in range(max(0, round(min(y1, y2))), min(size, round(max(y1, y2)))):
                by_line.setdefault(line, []).append(x1 + (line + 0.5 - y1) * (x2 - x1) / (y2 - y1))
        for line, xs in by_line.items():
            xs.sort()
            for a, b in zip(xs[::2], xs[1::2]):
                first, last = max(0, round(a)), min(size, round(b))
                if last > first:
                    image[3 * (line * size + first):3 * (line * size + last)] = colour * (last - first)
                    near = abs(line - size / 2) / size  # of equally wide stretches one towards the middle
                    widest = max(widest, (last - first - near, (first + last) // 2, line))
        numbers.append((str(r["district_id"]), widest[1:], widest[0]))
    for number, middle, room in numbers:
        if number.isdigit() and room > 0:
            _label(image, size, number, middle, room)
    raw = b"".join(b"\0" + image[3 * size * y:3 * size * (y + 1)] for y in range(size))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", size, size, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def geographic(districts: DataFrame, srid: int) -> DataFrame:
    """Districts with rings in degrees, as GeoJSON has them."""
    point = lambda p: geometry.unproject(p["x"], p["y"], srid)
    return districts.withColumn("rings", F.transform("rings", lambda r: F.transform(
        r, lambda p: F.struct(point(p)["lon"].alias("x"), point(p)["lat"].alias("y")))))


def write_outputs(folder: str | Path, districts: DataFrame, boundary_m: float, run: RunInfo, formats: set[str] | None = None,
                  srid: int | None = None) -> dict[str, Path]:
    """Write the chosen artefacts of one partition and return their paths by key.

    ``districts`` has ``district_id``, ``pop``, ``rings``, ``area``, ``perimeter``. With ``srid``,
    the GeoJSON is in degrees. The metrics are always computed.
    """
    selected, folder = chosen_formats(formats), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    rows = district_rows(districts)
    metrics = build_metrics(rows, boundary_m, run)
    paths = {"geojson": "districts.geojson", "shapefile": "districts.shp", "png": "districts.png",
             "metrics": "metrics.json", "log": "run.log"}
    out = {k: folder / v for k, v in paths.items() if k in selected}
    if "geojson" in out:
        shown = rows if srid is None else [
            r.asDict(recursive=True) for r in geographic(districts, srid).select("district_id", "pop", "rings").orderBy("district_id").collect()]
        out["geojson"].write_text(geojson(shown))
    if "shapefile" in out:
        write_shapefile(out["shapefile"], rows)
    if "png" in out:
        write_png(out["png"], rows)
    if "metrics" in out:
        out["metrics"].write_text(json.dumps(metrics, indent=2))
    if "log" in out:
        out["log"].write_text(run_log(metrics, run))
    return out


# --- leaders, trials and the ledger ----------------------------------------------------------

# Columns of the pages as (heading, field, pattern); numbers stand on the right.
RANKING = (("Rank", "rank", "{}"), ("Experiment", "experiment", ""), ("Status", "status", ""), ("Boundary (km)", "km", "{:.2f}"),
           ("Gap to leader", "gap_to_leader_pct", "+{:.2f}%"), ("Max dev (%)", "max_dev", "{:.4f}"), ("Runtime (s)", "runtime", "{}"))
DISTRIBUTION = (("Algorithm", "experiment", ""), ("Trials OK / N", "counted", "{}"), ("Min (km)", "min_km", "{:.2f}"),
                ("Max (km)", "max_km", "{:.2f}"), ("Mean (km)", "mean_km", "{:.2f}"), ("Median (km)", "median_km", "{:.2f}"),
                ("Std (km)", "std_km", "{:.2f}"), ("Std (%)", "std_pct", "{:.3f}"))
LEDGER = (("Tier", "tier", ""), ("State", "state_code", ""), ("Status", "status", ""), ("Leader", "leader", ""),
          ("Leader boundary (km)", "leader_boundary_km", "{:.2f}"), ("Runner-up", "runner_up", ""),
          ("Gap to runner-up", "gap_to_runner_up_pct", "+{:.2f}%"), ("Runtime (s)", "runtime", "{}"))
HISTORY = (("Timestamp", "timestamp", ""), ("Tier", "tier", ""), ("Attempted", "states_attempted", "{}"), ("OK", "ok", "{}"),
           ("Failed", "failed", "{}"), ("Skipped", "skipped", "{}"))


def table(columns, rows: list[dict], none: str = "—") -> str:
    """Rows as a Markdown table; what is null is shown as ``none``, bars inside texts are escaped."""
    def line(cells) -> str:
        return "| " + " | ".join(cells) + " |"

    def cell(row: dict, field: str, pattern: str) -> str:
        value = row.get(field)
        return none if value is None else (pattern or "{}").format(value).replace("|", "\\|")

    heads = [line(h for h, _, _ in columns), "|" + "|".join("---:" if p else "---" for _, _, p in columns) + "|"]
    return "\n".join([*heads, *(line(cell(r, f, p) for _, f, p in columns) for r in rows)])


def page(title: str, facts: dict, sections: dict[str, str]) -> str:
    """A title, a list of facts and headed sections, with a blank line between them."""
    blocks = [f"# {title}", "\n".join(f"- {k}: {v}" for k, v in facts.items())]
    blocks += [x for heading, body in sections.items() for x in (f"## {heading}", body)]
    return "\n\n".join(b for b in blocks if b) + "\n"


def _runtime(row: dict, seconds: str) -> dict:
    """A row as shown: seconds with the error beside, and failures in capitals."""
    took = None if row.get(seconds) is None else f"{row[seconds]:.1f}"
    if row["status"] != "failed":
        return row | {"runtime": took}
    return row | {"status": "FAILED", "runtime": f"{took or '?'} ({row.get('error') or ''})"}


def leader_markdown(state: dict, ranking: list[dict], trials: int = 1) -> str:
    """The ranking of one state as a page: by rank, failures last in the order of the input."""
    by_rank = {r["rank"]: r for r in ranking if r["rank"] is not None}
    failed = sorted((r for r in ranking if r["rank"] is None), key=lambda r: r["input_order"])
    leader = by_rank[1]["experiment"] if 1 in by_rank else "— none (all experiments failed)"
    rows = [_runtime(r, "runtime_s") for r in [*(by_rank[n] for n in sorted(by_rank)), *failed]]
    return page(f"{state['name']} — current leader: {leader}", {
        "State": f"{state['code']} ({state['name']})", "Districts": state["n_districts"], "Criterion": CRITERION,
        "Trials per experiment": trials}, {"Ranking": table(RANKING, rows)})


def leader_json(state: dict, ranking: list[dict], trials: int = 1) -> str:
    leader = next((r["experiment"] for r in ranking if r["rank"] == 1), None)
    shown = [{"rank": r["rank"], "experiment": r["experiment"], "status": r["status"], "total_internal_boundary_km": r["km"],
              "max_abs_deviation_pct": r["max_dev"], "runtime_seconds": r["runtime_s"], "refine_iterations": r["refine_iterations"],
              "refine_improvement_pct": r["refine_improvement_pct"], "gap_to_leader_pct": r["gap_to_leader_pct"],
              "tied_with_next": r["tied_with_next"], "error": r["error"]} for r in ranking]
    return json.dumps({"state": state, "leader": leader, "criterion": CRITERION, "trials_per_experiment": trials,
                       "generated_at": datetime.now(timezone.utc).isoformat(), "ranking": shown}, indent=2)


def task_result_json(r: dict) -> str:
    return json.dumps({"name": r["experiment"], "status": r["status"], "total_internal_boundary_km": r["km"],
                       "max_abs_deviation_pct": r["max_dev"], "runtime_seconds": r["runtime_s"],
                       "refine_iterations": r["refine_iterations"], "refine_improvement_pct": r["refine_improvement_pct"],
                       "error": r["error"]}, indent=2)


TASK_RESULT = ("name string, status string, total_internal_boundary_km double, max_abs_deviation_pct double, runtime_seconds double, "
               "refine_iterations bigint, refine_improvement_pct double, error string")


def read_schema() -> str:
    """Columns of :func:`read_task_results`."""
    return ("experiment string, status string, km double, max_dev double, runtime_s double, refine_iterations bigint, "
            "refine_improvement_pct double, error string, input_order string")


def read_task_results(spark, folder: str) -> DataFrame:
    """Results of ``<folder>/<experiment>/task_result.json``, in order of path."""
    return spark.read.schema(TASK_RESULT).json(f"{folder}/*/task_result.json", multiLine=True).select(
        F.col("name").alias("experiment"), "status", F.col("total_internal_boundary_km").alias("km"),
        F.col("max_abs_deviation_pct").alias("max_dev"), F.col("runtime_seconds").alias("runtime_s"), "refine_iterations",
        "refine_improvement_pct", "error", F.input_file_name().alias("input_order"))


def write_state_record(folder: str | Path, state: dict, ranking: list[dict]) -> dict[str, Path]:
    """``leader.json``, ``leader.md`` and one ``task_result.json`` an experiment."""
    folder = Path(folder)
    for r in ranking:
        (folder / "experiments" / r["experiment"]).mkdir(parents=True, exist_ok=True)
        (folder / "experiments" / r["experiment"] / "task_result.json").write_text(task_result_json(r))
    out = {"json": folder / "leader.json", "markdown": folder / "leader.md"}
    out["json"].write_text(leader_json(state, ranking))
    out["markdown"].write_text(leader_markdown(state, ranking))
    return out


def trials_markdown(state: str, distribution: list[dict], saturation: list[dict], sizes: tuple) -> str:
    """The distribution and best-of-n tables of many trials."""
    best = {s["experiment"]: s for s in saturation}
    rows = [d | best.get(d["experiment"], {}) | {"counted": f"{d['trials_ok']} / {d['trials']}"} for d in distribution]
    sizes_ = [("Algorithm", "experiment", ""), *((f"N={n}", f"best_of_{n}", "{:.2f}") for n in sizes)]
    return page(f"Multi-start results — {state}", {}, {
        "Distribution per algorithm": table(DISTRIBUTION, rows), "Best-of-N saturation": table(sizes_, rows)})


def ledger_markdown(states: list[dict], runs: list[dict]) -> str:
    """The ledger by tier, in the order of the tiers, and state; then the history of runs."""
    rows = [_runtime(s, "elapsed_seconds") for tier in (*TIERS, None) for s in sorted(states, key=lambda s: s["state_code"])
            if (s.get("tier") if s.get("tier") in TIERS else None) == tier]
    count = status_tally(states)
    history = [r | {"tier": r.get("tier") or "custom"} | {
        c: len(r.get(c) or []) for c in ("states_attempted", "ok", "failed", "skipped")} for r in runs]
    return page("Leader ledger", {
        "Total states tracked": len(states), "OK": count["ok"], "Failed": count["failed"], "Validate invocations recorded": len(runs)},
        {"Per-state leader": table(LEDGER, rows, "-")} | ({"Run history": table(HISTORY, history, "-")} if runs else {}))


def status_tally(states: list[dict]) -> Counter:
    return Counter(s["status"] for s in states)


def update_ledger(folder: str | Path, rows: list[dict], tier_of, run: dict | None = None) -> dict[str, Path]:
    """Merge states into ``summary.json`` and ``summary.md``; a given run is appended to the log."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = {"json": folder / "summary.json", "markdown": folder / "summary.md"}
    ledger = json.loads(out["json"].read_text()) if out["json"].exists() else {}
    kept = ledger.get("state_results", {})
    kept |= {r["state_code"]: r | {"status": {"skipped": "ok"}.get(r["status"], r["status"]), "tier": tier_of(r["state_code"])}
             for r in rows}
    states, runs = [kept[code] for code in sorted(kept)], [*ledger.get("runs", []), *([run] if run else [])]
    count = status_tally(states)
    out["json"].write_text(json.dumps({
        "state_results": {s["state_code"]: s for s in states}, "runs": runs, "ok_count": count["ok"],
        "failed_count": count["failed"], "state_count": len(states)}, indent=2, default=str))
    out["markdown"].write_text(ledger_markdown(states, runs))
    return out


def run_entry(tier: str | None, rows: list[dict]) -> dict:
    by = lambda status: [r["state_code"] for r in rows if r["status"] == status]
    return {"timestamp": datetime.now(timezone.utc).isoformat(), "tier": tier, "states_attempted": [r["state_code"] for r in rows],
            "ok": by("ok"), "failed": by("failed"), "skipped": by("skipped")}

